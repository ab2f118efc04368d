"""Graphs as edge tables: components, containment depth, direct children, cliques, two-colouring, purges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where a local session names none, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="lociq-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage: written to the folder that all executors share, and read again; survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Delete the files of a settled table that no plan reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/settled-" in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root: the least node that is reachable, by alternating large and small stars.

    edges: a, b. Every round is a settled table; the least neighbour of a node is pre-aggregated before it is joined.
    """
    now = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    last = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            break
        last = sign
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(down.select("m", "b")).where("x <> y")
        after = settle(small.toDF("a", "b").distinct())
        unsettle(now)
        now = after
    found = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    if nodes is None:
        return found.union(found.select("root", "root").distinct())
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def direct_children(edges: DataFrame) -> DataFrame:
    """The transitive reduction of a containment relation (outer, inner)."""
    a, b = edges.toDF("outer", "mid"), edges.toDF("mid", "inner")
    two = a.join(b, "mid").select("outer", "inner").distinct()
    return edges.toDF("outer", "inner").join(two, ["outer", "inner"], "left_anti")


def depths(children: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, depth: the longest path inwards to a leaf (0). Rounds run until nothing changes: one a level of nesting."""
    now, children = settle(nodes.select("node", F.lit(0).alias("depth"))), settle(children)
    while True:
        up = children.join(now, F.col("inner") == F.col("node")).groupBy("outer").agg((F.max("depth") + 1).alias("d"))
        new = settle(now.join(up, F.col("node") == F.col("outer"), "left").select("node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")))
        unsettle(now)
        if new.where("moved").isEmpty():
            return new.select("node", "depth")
        now = new.drop("moved")


def cliques(pairs: DataFrame, species: list[str]) -> DataFrame:
    """One gene of each species, all of them reciprocal. pairs: s1, g1, s2, g2 in both directions."""
    edge = pairs.select("s1", "g1", "s2", "g2").distinct()
    out = edge.where((F.col("s1") == species[0]) & (F.col("s2") == species[1])).select(F.col("g1").alias(species[0]), F.col("g2").alias(species[1]))
    for k in range(2, len(species)):
        new = edge.where((F.col("s1") == species[0]) & (F.col("s2") == species[k])).select(F.col("g1").alias(species[0]), F.col("g2").alias(species[k]))
        out = out.join(new, species[0])
        for j in range(1, k):
            with_ = edge.where((F.col("s1") == species[j]) & (F.col("s2") == species[k])).select(F.col("g1").alias(species[j]), F.col("g2").alias(species[k]))
            out = out.join(with_, [species[j], species[k]], "left_semi")
    return out.select(*species)


def two_colour(edges: DataFrame) -> DataFrame:
    """node, root, colour, conflicts of its component: parity along links that must differ (or, where ``same``, agree).

    Components are found first; each, a few chromosomes, is coloured as a group of its own, in which equal links are one
    row with a count. edges: a, b, same.
    """
    from collections import deque

    import pandas as pd

    each = edges.groupBy("a", "b", "same").agg(F.count("*").alias("n"))
    root = components(each.select("a", "b"))
    dealt = each.join(root, F.col("a") == F.col("node")).select("root", "a", "b", "same", "n")

    def colour(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, same, n in zip(pdf["a"], pdf["b"], pdf["same"], pdf["n"], strict=True):
            near.setdefault(a, []).append((b, same, n))
            near.setdefault(b, []).append((a, same, n))
        start = min(near)
        found, queue, wrong = {start: 0}, deque([start]), 0
        while queue:
            a = queue.popleft()
            for b, same, n in sorted(near[a]):
                c = found[a] if same else 1 - found[a]
                if b not in found:
                    found[b] = c
                    queue.append(b)
                elif found[b] != c:
                    wrong += n  # counted once for each of the two visits
        return pd.DataFrame({"node": list(found), "root": pdf["root"].iloc[0], "colour": list(found.values()), "conflicts": wrong})

    kind = edges.schema["a"].dataType.simpleString()
    return dealt.groupBy("root").applyInPandas(colour, f"node {kind}, root {kind}, colour int, conflicts int")


def overlap_groups(df: DataFrame, protected: DataFrame, policy: str, key: str = "id") -> DataFrame:
    """Rows kept of each overlap component, by policy: longest, lowest (divergence), drop (all go), retain.

    df: key, root (component), length, divergence; singletons stay. protected: key; protected rows leave the contest
    after components are formed and stay. Ties are all kept.
    """
    rows = df.join(protected.select(key, F.lit(True).alias("__p")), key, "left")
    # a row a component, so that no window holds a large one
    stats = rows.groupBy("root").agg(F.count("*").alias("__n"), F.max(F.when(F.col("__p").isNull(), F.col("length"))).alias("__longest"), F.min(F.when(F.col("__p").isNull(), F.col("divergence"))).alias("__lowest"))
    rows = rows.join(stats, "root")
    best = {"longest": F.col("length").eqNullSafe(F.col("__longest")), "drop": F.lit(False), "retain": F.lit(True)}.get(policy, F.col("divergence").eqNullSafe(F.col("__lowest")))
    return rows.where((F.col("__n") == 1) | F.coalesce("__p", F.lit(False)) | best).select(*df.columns)


def unique_longest(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """With ``kept``: of rows that share the keys the longest stays if it is alone; a tie drops all; single rows stay."""
    w = W.partitionBy(*keys)
    top = F.max(length).over(w)
    rows = df.withColumn("__top", top).withColumn("__tie", F.sum((F.col(length) == F.col("__top")).cast("int")).over(w)).withColumn("__n", F.count("*").over(w))
    return rows.withColumn("kept", (F.col("__n") == 1) | ((F.col(length) == F.col("__top")) & (F.col("__tie") == 1))).drop("__top", "__tie", "__n")
