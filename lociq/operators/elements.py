"""Elements with two terminal repeats: dedup of overlapping calls, nesting across rounds, strand votes.

Columns: key, seqid, start1, end1 (1-based inclusive), aln, p, and where needed tsd and the inner ends l_end, r_start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components, depths, direct_children, settle, unsettle
from .grouped import per_group
from .interval import BIN, islands, meeting, overlap_join

#: How much more distance per aligned base the call with most matching bases may have than the closest one.
RATE_CAP = 2.5


def groups_of(n: int, links) -> np.ndarray:
    """The least row that each is linked with; links: pieces (i, j)."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


class Cluster:
    """Calls that overlap, as arrays. Relations are looked up for pairs that meet, a piece at a time."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.key = rows["key"].to_numpy(object)
        self.start, self.end = rows["start1"].to_numpy("i8"), rows["end1"].to_numpy("i8")
        self.aln, self.p = rows["aln"].to_numpy("f8"), rows["p"].to_numpy("f8")
        self.tsd = rows["tsd"].map(bool).to_numpy() & rows["tsd"].notna().to_numpy()
        self.l_end, self.r_start = rows["l_end"].to_numpy("f8"), rows["r_start"].to_numpy("f8")  # nan: not known
        self.known = ~(np.isnan(self.l_end) | np.isnan(self.r_start))
        self.low, self.high = np.fmin(self.start, self.r_start), np.fmax(self.end, self.l_end)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A repeat in common."""
        out = np.zeros(len(i), bool)
        ends = ((self.start, self.l_end), (self.r_start, self.end))
        for s, t in ends:
            for u, v in ends:
                out |= (s[i] <= v[j]) & (u[j] <= t[i])
        return out & self.known[i] & self.known[j]

    def inside(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i inside j, strictly shorter; without a repeat in common is for the caller."""
        return (self.end[i] - self.start[i] < self.end[j] - self.start[j]) & (self.start[j] <= self.start[i]) & (self.end[i] <= self.end[j])

    def nested(self, among: np.ndarray):
        """Pieces (inner, outer) of the rows among, which have no repeat in common."""
        for i, j in meeting(self.low[among], self.high[among]):
            i, j = among[i], among[j]
            a, b = self.inside(i, j), self.inside(j, i)
            inner, outer = np.concatenate((i[a], j[b])), np.concatenate((j[a], i[b]))
            free = ~self.shared(inner, outer)
            yield inner[free], outer[free]

    def best(self, at: np.ndarray) -> int:
        """That with most matching bases, but the closest one where its distance per aligned base is far less."""
        top = at[np.argmax(self.aln[at] * (1.0 - self.p[at]))]
        near = at[np.lexsort((-self.aln[at], self.p[at]))[0]]
        rate = lambda i: max(self.p[i], 1e-10) / max(self.aln[i], 1)
        return int(near if rate(top) > RATE_CAP * rate(near) else top)

    def survivors(self) -> list[tuple[int, str]]:
        """(row, its nestings): with a duplication before without, nests stay, one of each group with common repeats."""
        every = np.arange(len(self.key))
        # rivals: with a duplication and not nested with the row
        rivals = np.full(len(every), int(self.tsd.sum()))
        if self.tsd.any() and not self.tsd.all():
            for i, j in self.nested(every):
                np.subtract.at(rivals, i, self.tsd[j].astype(int))
                np.subtract.at(rivals, j, self.tsd[i].astype(int))
        left = np.flatnonzero(self.tsd | (rivals == 0))
        if len(left) == 1:
            return [(int(left[0]), ".")]
        among = np.zeros(len(every), bool)
        for i, j in self.nested(left):
            among[i] = among[j] = True
        nests, rest = left[among[left]], left[~among[left]]
        pieces = ((i, j) for i, j in meeting(self.low[nests], self.high[nests]))
        group = groups_of(len(nests), ((i[s], j[s]) for i, j in pieces if (s := self.shared(nests[i], nests[j])).any()))
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        kept = [self.best(nests[g]) for g in np.split(order, starts[1:])] if len(nests) else []
        names: dict[int, list[tuple[int, str]]] = {i: [] for i in kept}
        for inner, outer in self.nested(np.sort(np.array(kept, np.int64))) if kept else ():
            for i, j in zip(inner.tolist(), outer.tolist(), strict=True):
                names[i].append((j, f"nest-inner:{self.key[j]}"))
                names[j].append((i, f"nest-outer:{self.key[i]}"))
        out = [(i, ";".join(n for _, n in sorted(names[i])) or ".") for i in kept]
        return out + ([(self.best(rest), ".")] if len(rest) else [])


def _clusters(start: np.ndarray, end: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Rows in order of (start, end): a row joins the cluster before it where it overlaps a member by the threshold."""
    latest = np.full(len(start), -1)  # the last row before that it overlaps so
    for i, j in meeting(start, end):
        i, j = np.minimum(i, j), np.maximum(i, j)
        both = np.minimum(end[i], end[j]) - np.maximum(start[i], start[j]) + 1
        shorter = np.maximum(np.minimum(end[i] - start[i], end[j] - start[j]) + 1, 1)
        near = np.maximum(both, 0) / shorter >= threshold
        np.maximum.at(latest, j[near], i[near])
    out, first = [], 0
    for i, at in enumerate([*latest[1:].tolist(), -1], 1):
        if at < first:
            out.append(np.arange(first, i))
            first = i
    return out


RESULT = "key string, seqid string, start1 bigint, end1 bigint, aln bigint, p double, tsd string, nest_status string"


def deduplicated(elements: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One survivor of each cluster of overlapping calls, but true nestings stay, with their relations.

    Sorted calls join the cluster before them where they overlap any of its members by ``threshold`` of the shorter. A
    cluster can't reach across a stretch that no call covers, so each island is a task of its own.
    """

    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start1", "end1", "key"]).reset_index(drop=True)
        kept = []
        for rows in _clusters(pdf["start1"].to_numpy("i8"), pdf["end1"].to_numpy("i8"), threshold):
            kept += [(rows[i], nests) for i, nests in Cluster(pdf.iloc[rows]).survivors()] if len(rows) > 1 else [(rows[0], ".")]
        return pdf.iloc[[i for i, _ in kept]].assign(nest_status=[n for _, n in kept])[names]

    rows = elements.withColumn("__to", F.col("end1") + 1)
    alone = lambda p: p.assign(nest_status=".")[names]
    return per_group(islands(rows, ["seqid"], "start1", "__to"), ["seqid", "island"], run, RESULT, alone)


def _ends_in_bins(ends: DataFrame, bin_width: int) -> DataFrame:
    """ends (row, seqid, lo, hi) -> __row, __rep: the row that stands for the stretch of touching ends in a bin; and a row
    a bin, with seqid and __b, whose __rep stands for the stretch that begins before it and __last for the last begun in it.

    A repeat that ends before it begins touches those that hold both its ends. What a bin needs of those before it is the
    largest end.
    """
    at, to = F.least("lo", "hi"), F.greatest("lo", "hi")
    rows = ends.select("seqid", F.floor(at / bin_width).alias("__b"), at.alias("__at"), to.alias("__to"), (F.col("lo") > F.col("hi")).cast("int").alias("__kind"), "row")
    earlier = W.partitionBy("seqid").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    reach = rows.groupBy("seqid", "__b").agg(F.max(F.when(F.col("__kind") == 0, F.col("__to"))).alias("__to")).withColumn("__to", F.max("__to").over(earlier))
    low = np.iinfo(np.int64).min
    reach = reach.select("seqid", "__b", F.lit(0).cast("bigint").alias("__at"), F.coalesce("__to", F.lit(low)).alias("__to"), F.lit(2).alias("__kind"), F.lit(-1).cast("bigint").alias("row"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, at, to, row = (pdf[c].to_numpy("i8") for c in ("__kind", "__at", "__to", "row"))
        order = np.flatnonzero(kind == 0)
        order = order[np.lexsort((row[order], at[order]))]
        s, r = at[order], row[order]
        reach = np.maximum.accumulate(np.concatenate((to[kind == 2][:1], to[order])))
        new = s > reach[:-1]
        stretch = np.cumsum(new)  # 0: begun before the bin
        x, y, turned = at[kind == 1], to[kind == 1], row[kind == 1]
        i = np.searchsorted(s, x, side="right")
        held = reach[i] >= y
        of = np.concatenate(([0], stretch))[i[held]]
        row, stretch = np.concatenate((r, turned[held])), np.concatenate((stretch, of))
        begun = r[new]
        first = row[stretch == 0].min() if (stretch == 0).any() else None
        reps = np.concatenate(([-1 if first is None else first], begun))
        out = pd.DataFrame({"seqid": None, "__b": pd.array([None] * len(row), "Int64"), "__row": pd.array(row, "Int64"), "__rep": pd.array(reps[stretch], "Int64"), "__last": pd.array([None] * len(row), "Int64")})
        mark = pd.DataFrame({"seqid": pdf["seqid"].iloc[:1].to_numpy(object), "__b": pd.array(pdf["__b"].iloc[:1], "Int64"), "__row": pd.array([None], "Int64"), "__rep": pd.array([first], "Int64"), "__last": pd.array([begun[-1] if len(begun) else None], "Int64")})
        return pd.concat([out, mark], ignore_index=True)

    return per_group(rows.unionByName(reach), ["seqid", "__b"], each, "seqid string, __b bigint, __row bigint, __rep bigint, __last bigint")


def best_of_shared_ends(e: DataFrame, bin_width: int = BIN >> 6) -> DataFrame:
    """row: the best of each group of calls that share an end, chained (most matching bases; ties by key). e: row (unique,
    from 0) and the columns of elements, whose repeats lie within them. Groups are told by the stretches that touching ends
    cover: a call links two stretches at most, and no pair of calls is made."""
    long = lambda c: F.col(c).cast("bigint")
    ends = F.explode(F.array(F.struct(long("start1").alias("lo"), long("l_end").alias("hi")), F.struct(long("r_start").alias("lo"), long("end1").alias("hi"))))
    known = e.where("seqid is not null and start1 is not null and end1 is not null")
    ends = known.select("row", "seqid", ends.alias("x")).select("row", "seqid", "x.lo", "x.hi").where("lo is not null and hi is not null")
    found = settle(_ends_in_bins(ends, bin_width))
    stretches = settle(found.where("__row is not null").groupBy("__row").agg(F.min("__rep").alias("a"), F.max("__rep").alias("b")))
    earlier = W.partitionBy("seqid").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = found.where("__row is null").select(F.col("__rep").alias("a"), F.last("__last", True).over(earlier).alias("b")).where("a is not null")
    root = components(stretches.where("a <> b").select("a", "b").distinct().union(carried))
    rows = e.select("row", F.struct((-(F.col("aln") * (1 - F.col("p")))).alias("score"), "key", "row").alias("m")).join(stretches, F.col("row") == F.col("__row"), "left")
    # a row a stretch, so that few are joined with the groups
    best = rows.groupBy(F.coalesce("a", "row").alias("at")).agg(F.min("m").alias("m"))
    best = settle(best.join(root, F.col("at") == F.col("node"), "left").groupBy(F.coalesce("root", "at").alias("root")).agg(F.min("m").alias("m")).select("m.row"))
    unsettle(found)
    unsettle(stretches)
    return best


def reconciled(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """elements of all rounds (key is unique) -> survivors with depth, and the direct nestings (outer, inner).

    Calls that share an end across rounds are one group, of which the best stays (most matching bases; ties by key);
    containment of the survivors, reduced to direct children, gives the depth.
    """
    e = settle(elements.where("key is not null").select("key", "seqid", "start1", "end1", "l_end", "r_start", "aln", "p", F.monotonically_increasing_id().alias("row")))
    left = settle(e.join(best_of_shared_ends(e), "row", "left_semi").drop("row"))
    unsettle(e)
    touch = F.lit(False)
    for s, t in (("start1", "l_end"), ("r_start", "end1")):
        for u, v in (("b_start1", "b_l_end"), ("b_r_start", "b_end1")):
            touch |= (F.col(s) <= F.col(v)) & (F.col(u) <= F.col(t))
    inside = (F.col("start1") <= F.col("b_start1")) & (F.col("b_end1") <= F.col("end1")) & (F.col("b_end1") - F.col("b_start1") < F.col("end1") - F.col("start1")) & ~touch
    nest = overlap_join(left, left, ["seqid"], on=inside, a_cols=("start1", "end1"), b_cols=("start1", "end1")).select(F.col("key").alias("outer"), F.col("b_key").alias("inner"))
    children = settle(direct_children(settle(nest)))
    depth = depths(children, left.select(F.col("key").alias("node")))
    return left.join(depth, F.col("key") == F.col("node")).drop("node"), children


def strand_vote(domains: DataFrame, order: list[str]) -> DataFrame:
    """key, strand, concordant, discordant: pairs of domains that stand in the expected order against those that don't.

    domains: key, gene, start. Ties have no strand.
    """
    rank = F.lit(None).cast("int")
    for i, g in enumerate(order):
        rank = F.when(F.col("gene") == g, i).otherwise(rank)
    d = domains.withColumn("rank", rank).where("rank is not null").select("key", "rank", "start")
    pairs = d.join(d.toDF("key", "rank2", "start2"), "key").where("rank < rank2 and start <> start2")  # of one element: a few domains
    votes = pairs.groupBy("key").agg(F.count_if(F.col("start") < F.col("start2")).alias("concordant"), F.count_if(F.col("start") > F.col("start2")).alias("discordant"))
    return votes.withColumn("strand", F.when(F.col("concordant") > F.col("discordant"), "+").when(F.col("discordant") > F.col("concordant"), "-"))


def merged_loci(hits: DataFrame, slop: int = 50) -> DataFrame:
    """Solo loci: seqid, start0, end0, n_hits, n_consensi, families, best (by bits, then id), any_tsd.

    hits: id, seqid, start0, end0, consensus, family, bits, tsd.
    """
    rows = islands(hits, ["seqid"], gap=slop)
    return rows.groupBy("seqid", "island").agg(
        F.min("start0").alias("start0"), F.max("end0").alias("end0"), F.count("*").alias("n_hits"), F.count_distinct("consensus").alias("n_consensi"),
        F.array_join(F.array_sort(F.collect_set("family")), ";").alias("families"), F.max_by("id", F.struct("bits", -F.col("id"))).alias("best"), F.bool_or("tsd").alias("any_tsd"),
    ).drop("island")


def scored(predicted: DataFrame, truth: DataFrame, least: float = 0.9) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by reciprocal overlap: precision counts predictions, recall detected truths."""
    bp = F.least("end0", "b_end0") - F.greatest("start0", "b_start0")
    both = F.least(bp / (F.col("end0") - F.col("start0")), bp / (F.col("b_end0") - F.col("b_start0")))
    hit = overlap_join(predicted, truth, ["seqid"], on=both >= least).select("id", "b_id")
    n = predicted.agg(F.count("*").alias("np")).join(truth.agg(F.count("*").alias("nt"))).join(hit.agg(F.count_distinct("id").alias("tp"), F.count_distinct("b_id").alias("found")))
    precision, recall = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.when(F.col("nt") > 0, F.col("found") / F.col("nt")).otherwise(0.0)
    out = n.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("found")).alias("fn"), precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
