"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

Method: a text falls into paragraphs (lines, cut further after sentence ends and every LONG characters). A
paragraph's digest, seeded with the number of equal paragraphs before it, is added to one cell in each of three
parts of a sketch; a cell holds a count, the sum of its digests and the sum of their checks. Sketches of two versions
subtract cell by cell; peeling cells that hold a single digest recovers the digests that differ, on either side
(``differing``). Where peeling gets stuck, both sketches are built again twice as large. Likeness is the share of common
paragraphs among all of both, as the recovered differences tell it. Sketches end to grow at 16 cells for each digest of
both: what is stuck there (digests whose checks collide) is told by the digests themselves.

Many sketches are subtracted and peeled at once, in arrays.

Defined cases: a null or empty text has no paragraphs and an all-zero sketch; two such are alike (1.0). Equal texts
have equal fingerprints. Documents are ordered by descending doc_id, ties by a hash of the text (null as empty) and the
text, null ids last; the next of the last is the first, so a single document is its own next. Repeated rows are kept.
Texts of any length are taken whole. Other columns are dropped, so none can clash; an empty table gives an empty one.

Hot ids: groups hold neighbouring ids and some 32 MB of texts; an id that repeats over several groups, or is null, is
split further by the texts' hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, small_batches

PARTS = 3
CELLS = 18
LONG = 512
BREAK = re.compile(r"\n+|(?<=[.!?])[ \t]+")
#: Documents worked on at once, and the characters that end a round early.
DOCS, CHARS = 512, 4_000_000
#: Bytes of text in a group of neighbouring doc_ids, about.
GROUP_BYTES = 32 << 20
#: Groups at most: beyond some 500 GB they grow instead. A group is streamed, so its size is time and not memory.
MOST_GROUPS = 16_384
CELL = np.dtype([("count", "<i8"), ("sum", "<u8"), ("check", "<u4")])


def paragraphs(text: str | None) -> list[str]:
    out = []
    for p in BREAK.split(text or ""):
        if p:
            out += [p] if len(p) <= LONG else [p[i : i + LONG] for i in range(0, len(p), LONG)]
    return out


def digests(text: str | None) -> np.ndarray:
    """A digest for each paragraph; the second of two equal paragraphs has another than the first."""
    import xxhash

    seen: dict[bytes, int] = {}
    out = []
    for p in paragraphs(text):
        raw = p.encode()
        n = seen[raw] = seen.get(raw, -1) + 1
        out.append(xxhash.xxh64_intdigest(raw, n))
    return np.array(out, "<u8")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketches:
    """n sketches of ``cells`` cells."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count, self.sum, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        part = self.cells // PARTS
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        check = _mix(keys, 9).astype(np.uint32)
        signed = np.where(sign > 0, keys, np.uint64(0) - keys)
        check = np.where(sign > 0, check, np.uint32(0) - check)
        for j in range(PARTS):
            at = owner * self.cells + j * part + (_mix(keys, j) % np.uint64(part)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, signed)
            np.add.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.sum, out.check = self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, digest and side (1 or -1) of the digests that one side alone has, and for each sketch whether that is
        all. The cells are used up."""
        found = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            keys = np.where(sign > 0, self.sum[at], np.uint64(0) - self.sum[at])
            check = _mix(keys, 9).astype(np.uint32)
            pure = self.check[at] == np.where(sign > 0, check, np.uint32(0) - check)
            at, sign, keys = at[pure], sign[pure], keys[pure]
            if not len(at):
                break
            owner = at // self.cells
            order = np.lexsort((keys, owner))
            first = np.concatenate(([True], (owner[order][1:] != owner[order][:-1]) | (keys[order][1:] != keys[order][:-1])))
            one = order[first]
            owner, sign, keys = owner[one], sign[one], keys[one]
            found.append((owner, keys, sign))
            self.add(owner, keys, -sign)
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        owner, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
        return owner, keys, sign, ~left.reshape(self.n, self.cells).any(axis=1)

    def hex(self) -> list[str]:
        raw = np.zeros(self.n * self.cells, CELL)
        raw["count"], raw["sum"], raw["check"] = self.count, self.sum, self.check
        return [r.tobytes().hex() for r in raw.reshape(self.n, self.cells)]


def _flat(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return owner, np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketches(keys: list[np.ndarray], cells: int = CELLS) -> Sketches:
    out = Sketches(len(keys), cells)
    out.add(*_flat(keys))
    return out


def differing(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None, second: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, digest, side (1: of a alone, -1: of b alone), of each pair, from subtracted and peeled sketches."""
    out, todo, cells = [], np.arange(len(a)), CELLS
    most = np.array([16 * (len(x) + len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    while len(todo):
        s = first if first is not None and cells == CELLS else sketches([a[i] for i in todo], cells)
        t = second if second is not None and cells == CELLS else sketches([b[i] for i in todo], cells)
        owner, keys, side, whole = s.minus(t).peel()
        kept = whole[owner]
        out.append((todo[owner[kept]], keys[kept], side[kept]))
        todo, cells = todo[~whole], cells * 2
        for i in todo[most[todo] < cells]:
            (x, m), (y, n) = (np.unique(k[i], return_counts=True) for k in (a, b))
            every = np.union1d(x, y)
            more = np.zeros(len(every), np.int64)
            more[np.searchsorted(every, x)] += m
            more[np.searchsorted(every, y)] -= n
            out.append((np.full(np.abs(more).sum(), i), np.repeat(every, np.abs(more)), np.repeat(np.sign(more), np.abs(more))))
        todo = todo[most[todo] >= cells]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None, second: Sketches | None = None) -> np.ndarray:
    """Common paragraphs among all of both, of each pair."""
    pair, _, side = differing(a, b, first, second)
    only_a, only_b = (np.bincount(pair[side == x], minlength=len(a)) for x in (1, -1))
    size = np.array([len(x) for x in a], np.int64)
    return np.where(size + only_b > 0, (size - only_a) / np.maximum(size + only_b, 1), 1.0)


def version_differences(versions: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """versions with removed and added: the sorted digests of the paragraphs that one text alone has."""
    from .common import column, with_columns

    def compute(batch):
        a, b = ([digests(t) for t in column(batch, c)] for c in (before, after))
        pair, keys, side = differing(a, b)
        return [[np.sort(keys[(pair == i) & (side == x)]).view("<i8") for i in range(len(a))] for x in (1, -1)]

    return with_columns(versions, "removed array<bigint>, added array<bigint>", compute)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(rows: list[tuple], names: list[str]):
    """rows: (doc_id, text, next text)"""
    import pyarrow as pa

    changed = [edited(t, n) for _, t, n in rows]
    own, other, following = [digests(t) for _, t, _ in rows], [digests(t) for t in changed], [digests(n) for _, _, n in rows]
    s, t = sketches(own), sketches(other)
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(s.hex()), pa.array(t.hex()),
        pa.array(likeness(own, other, s, t)), pa.array(likeness(own, following, s)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _follow(names: list[str]):
    """Rows sorted by group, then leads last, then in order: each row meets the one behind it."""

    def run(batches):
        ready: list[tuple] = []
        chars, held = 0, None  # held: (group, doc_id, text), waits for the row behind it
        for batch in sliced(batches):
            for group, lead, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if held and held[0] == group:
                    ready.append((held[1], held[2], text))
                    chars += len(held[2]) + len(text)
                held = None if lead else (group, doc, text)
                if len(ready) >= DOCS or chars >= CHARS:
                    yield _fingerprinted(ready, names)
                    ready, chars = [], 0
        if ready:
            yield _fingerprinted(ready, names)

    return run


class Groups:
    """Which group a document falls into: descending groups, of which those of null ids are negative, follow the order of
    the result.

    cuts: the lower ends of the groups of known ids, of which an id that repeats has several: these share its hashes
    out evenly. nulls: the number of groups of the rows without an id.
    """

    def __init__(self, cuts: list[int], nulls: int) -> None:
        self.cuts, self.nulls = np.array(cuts, np.int64), nulls

    def of(self, known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.cuts, ids, side="left"), np.searchsorted(self.cuts, ids, side="right")
        share = (hashes.astype(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64  # of the signed order
        part = lambda n: np.minimum((share * n).astype(np.int64), np.maximum(n - 1, 0))
        # an id at several cuts has as many groups; its least hashes stand behind the greater ids
        at = np.where(high > low, high - part(high - low), low)
        return np.where(known, at, -1 - part(np.full(len(ids), self.nulls)))


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    ids = batch.column(0)
    return np.asarray(ids.is_valid()), np.asarray(pc.fill_null(ids, 0)), np.asarray(batch.column(1))


def _deal(groups: Groups, leads: dict[int, tuple[int, tuple]]):
    """Rows with their group; a group's first documents also go, as leads, to the group before it."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            known, ids, hashes = _columns(batch)
            group = groups.of(known, ids, hashes)
            key = zip(known.tolist(), ids.tolist(), hashes.tolist(), strict=True)
            first = [i for i, (g, k) in enumerate(zip(group.tolist(), key, strict=True)) if g in leads and leads[g][1] == k]
            at = np.concatenate((np.arange(len(group)), np.array(first, np.int64)))
            to = np.concatenate((group, np.array([leads[group[i]][0] for i in first], "<i8")))
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(at)) >= len(group)), *rows.columns], names=["group", "lead", "doc_id", "h", "text"])

    return run


def _firsts(groups: Groups):
    """Each group's first document in a batch, in the order of the result: the greatest id, then the least hash."""

    def run(batches):
        import pyarrow as pa

        best: dict[int, tuple] = {}
        for batch in batches:
            known, ids, hashes = _columns(batch)
            for g, *key in zip(groups.of(known, ids, hashes).tolist(), known.tolist(), ids.tolist(), hashes.tolist(), strict=True):
                if g not in best or (-key[1], key[2]) < (-best[g][1], best[g][2]):
                    best[g] = tuple(key)
        rows = [(g, *k) for g, k in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["group", "known", "id", "h"])

    return run


def fingerprint_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Texts are shuffled once, into groups of neighbouring ids. What the driver sees is a few numbers a group: the groups'
    cuts (quantiles of the ids) and first documents; of each group the first document alone travels twice.
    """
    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), hashed.alias("h"), F.col(text).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.count("doc_id").alias("known")).first()
    parts = max(1, min(max(4 * n, -(-(size["bytes"] or 0) // GROUP_BYTES)), MOST_GROUPS, size["known"]))
    step = max(1, size["rows"] // parts)
    shares = ", ".join(f"{i / parts:.9f}D" for i in range(1, parts))
    cuts = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {100 * parts})").alias("e")).first()["e"] if parts > 1 else []
    groups = Groups(cuts or [], max(1, -(-(size["rows"] - size["known"]) // step)))
    each = docs.select("doc_id", "h").mapInArrow(_firsts(groups), "group bigint, known boolean, id bigint, h bigint")
    firsts = {r["group"]: tuple(r["k"]) for r in each.groupBy("group").agg(F.min_by(F.struct("known", "id", "h"), F.struct(-F.col("id"), F.col("h"))).alias("k")).collect()}
    down = sorted(firsts, reverse=True)
    leads = {g: (down[i - 1], firsts[g]) for i, g in enumerate(down)}  # down[-1] is before the first: around
    dealt = docs.mapInArrow(_deal(groups, leads), "group bigint, lead boolean, doc_id bigint, h bigint, text string")
    spread = max(n, min(parts, -(-(size["bytes"] or 0) // (2 * GROUP_BYTES))))
    in_order = dealt.repartition(spread, "group").sortWithinPartitions("group", "lead", F.desc_nulls_last("doc_id"), "h", F.asc_nulls_first("text"))
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return in_order.drop("h").mapInArrow(_follow(names), RESULT)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
