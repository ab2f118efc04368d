"""Mixing sources to target weights: a Pfair schedule of source blocks.

Method: the documents of a source, in doc_id order, are cut into blocks. With integer weights w of sum W, block i of
a source (from 0) is released at slot floor(i * W / w) and due by slot ceil((i + 1) * W / w); each slot goes to the
released block with the earliest deadline. That schedule is feasible, so after any number of slots each source has
had its weight's share of them to less than one block. It repeats every W slots: one period is computed, as far as there
are blocks for it, and block i takes the slot of block i mod w in period i div w. A period of up to MAX_PERIOD slots is
broadcast; a longer one is written by one task, which holds a row per source, and joined as a table. The driver holds the
sizes of the sources.

Every document has one place, (slot, place in block); nothing is dropped or repeated. A source that has run out
leaves its slots idle, and the others keep their proportions; ``on_target`` marks the slots before the first source
runs out, where the mix has its target weights.

Defined cases: a null source is a source of its own, with the default weight unless the weights have None. Documents
without an id come first in their source, in an order of their text's hash; ties of doc_id go by that hash, and equal
rows are interchangeable. Repeated rows are kept. An empty table gives an empty one. Weights must be integers of 1 or
more; sources that occur but have no weight get the default. Texts of any length go along as they are; columns that clash
with the result's are replaced.

Places are counted within (source, group of neighbouring ids), so a source that holds a third of all rows is spread
over as many tasks as the others together.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import chain
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BLOCK_ROWS = 64
MAX_PERIOD = 100_000
#: Groups of neighbouring ids: four to a partition, and their edges in the plan.
GROUPS, MOST_EDGES = 4, 4096
#: Targets of the query and the pipeline; all other sources have weight 1.
TARGETS = {"src0": 5}


def reduced(weights: dict[str | None, int]) -> dict[str | None, int]:
    """The weights over their common divisor."""
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights must be integers of 1 or more")
    common = reduce(gcd, weights.values(), 0) or 1
    return {s: w // common for s, w in weights.items()}


def schedule(weights: dict[str | None, int], blocks: dict[str | None, int] | None = None):
    """(source, number of the block within the period, release, deadline, slot), slot by slot, of one period of the
    reduced weights; or until all sources have had as many ``blocks``."""
    total = sum(weights.values())
    name = lambda s: (s is not None, s or "")
    waiting = sorted((0, -(-total // w), name(s), 0) for s, w in weights.items())
    by_name = {name(s): s for s in weights}
    open_ = {s for s in weights if blocks is None or blocks[s] > 0}
    ready: list = []
    for slot in range(total):
        if not open_:
            return
        while waiting and waiting[0][0] <= slot:
            release, deadline, key, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, key, i, release))
        deadline, key, i, release = heapq.heappop(ready)
        source = by_name[key]
        yield source, i, release, deadline, slot
        if blocks is not None and i + 1 >= blocks[source]:
            open_.discard(source)
        w = weights[source]
        if i + 1 < w:
            heapq.heappush(waiting, ((i + 1) * total // w, -(-(i + 2) * total // w), key, i + 1))


def period(weights: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    return list(schedule(reduced(weights)))


PLAN = "__ps string, __i bigint, __r bigint, __d bigint, __t bigint"


def _plan(spark: SparkSession, weights: dict[str | None, int], blocks: dict[str | None, int]) -> DataFrame:
    """The schedule as a table: to be broadcast where it has MAX_PERIOD rows at most, else settled."""
    if sum(weights.values()) <= MAX_PERIOD:
        return F.broadcast(spark.createDataFrame(list(schedule(weights)), PLAN))

    def run(_):
        import pyarrow as pa

        types = [pa.string(), *[pa.int64()] * 4]
        rows: list = []
        for row in chain(schedule(weights, blocks), [None]):
            if row is None or len(rows) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split(" ")[0] for c in PLAN.split(", ")])
                rows = []
            if row is not None:
                rows.append(row)

    return cut(spark.range(0, 1, 1, 1).mapInArrow(run, PLAN))


def mix(docs: DataFrame, weights: dict[str | None, int], default: int = 1, block_rows: int = BLOCK_ROWS, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with block, release, deadline, slot, place, on_target."""
    spark = docs.sparkSession
    rows = docs.drop("block", "release", "deadline", "slot", "place", "on_target").withColumns({
        "__s": F.col(source).cast("string"), "__id": F.col(doc_id).cast("bigint"),
        "__h": F.when(F.col(doc_id).isNull(), F.xxhash64(text)),
    })
    sizes = {r["__s"]: r["n"] for r in rows.groupBy("__s").agg(F.count("*").alias("n")).collect()}
    shares = reduced({s: weights.get(s, default) for s in sizes})
    length = sum(shares.values())
    held = {s: -(-n // block_rows) for s, n in sizes.items()}
    # of each source also the first block that it doesn't have, in whose slot it is idle
    plan = _plan(spark, shares, {s: min(w, held[s] + 1) for s, w in shares.items()})
    sources = spark.createDataFrame([(s, w, held[s]) for s, w in shares.items()], "__ws string, __w bigint, __b bigint")
    idle = sources.join(plan, F.col("__ws").eqNullSafe(F.col("__ps")) & (F.col("__b") % F.col("__w") == F.col("__i")))
    first_idle = idle.agg(F.min(F.floor(F.col("__b") / F.col("__w")) * length + F.col("__t")).alias("t")).first()["t"] or 0
    sources = F.broadcast(sources) if len(sizes) <= MAX_PERIOD else sources
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")) * GROUPS, MOST_EDGES)
    edges = rows.agg(F.percentile_approx("__id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n)).alias("e")).first()["e"]
    edges = sorted(set(edges or [0]))
    # ids beyond an edge belong to the next group; those without an id are spread by their text's hash
    group = F.when(F.col("__id").isNull(), F.shiftright("__h", 56) - 1000).otherwise(_edge(edges, F.col("__id")))
    rows = rows.withColumn("__g", group.cast("bigint"))
    counts = rows.groupBy("__s", "__g").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__s").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("__s").alias("__cs"), F.col("__g").alias("__cg"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    tie = F.coalesce(F.col("__h"), F.xxhash64(text))
    rank = F.row_number().over(W.partitionBy("__s", "__g").orderBy("__id", tie))
    rows = rows.withColumn("__rank", rank)
    rows = rows.join(counts, F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__g") == F.col("__cg")))
    at = F.col("__before") + F.col("__rank") - 1
    rows = rows.withColumns({"block": F.floor(at / block_rows), "place": (at % block_rows).cast("int")})
    rows = rows.join(sources, F.col("__s").eqNullSafe(F.col("__ws")))
    rows = rows.join(plan, F.col("__s").eqNullSafe(F.col("__ps")) & (F.col("block") % F.col("__w") == F.col("__i")))
    base = F.floor(F.col("block") / F.col("__w")) * length
    return rows.withColumns({
        "release": base + F.col("__r"), "deadline": base + F.col("__d"), "slot": base + F.col("__t"),
        "on_target": base + F.col("__t") < first_idle,
    }).select(*[c for c in docs.columns if c not in NEW], *NEW)


NEW = ["block", "release", "deadline", "slot", "place", "on_target"]


def _edge(edges: list[int], value: Column) -> Column:
    """How many of the sorted edges lie below the value: among every k-th first, then among the k of that stretch."""
    k = int(len(edges) ** 0.5) + 1
    below = lambda part: F.aggregate(part, F.lit(0), lambda n, e: n + (e < value).cast("int"))
    literal = lambda part: F.array(*[F.lit(e).cast("bigint") for e in part]).cast("array<bigint>")
    coarse = below(literal(edges[k - 1 :: k]))
    return F.element_at(F.transform(F.array(coarse), lambda c: c * k + below(F.slice(literal(edges), c * k + 1, k))), 1)


def in_order(docs: DataFrame, weights: dict[str | None, int], **options) -> DataFrame:
    """The documents, sorted by (slot, place): files written from it read as the mix."""
    return mix(docs, weights, **options).orderBy("slot", "place").select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, TARGETS).drop("text")


def op2_sql() -> str:
    """The query, with a schedule of its own: a recursion over slots that picks the released block of the earliest
    deadline. Sources are those of the table; one that is null isn't provided for."""
    weight = " ".join(f"WHEN '{s}' THEN {w}" for s, w in TARGETS.items())
    return f"""
WITH RECURSIVE s AS (SELECT DISTINCT source FROM documents), x AS (SELECT source, CAST(CASE source {weight} ELSE 1 END AS BIGINT) AS w FROM s),
l AS (SELECT list(source ORDER BY source) AS names, list(w ORDER BY source) AS ws, CAST(sum(w) AS BIGINT) AS total FROM x),
e AS (SELECT CAST(-1 AS BIGINT) AS t, names, ws, total, list_transform(ws, lambda z: CAST(0 AS BIGINT)) AS had, CAST(NULL AS BIGINT) AS j FROM l
 UNION ALL SELECT t + 1, names, ws, total, list_transform(had, lambda c, i: CASE WHEN i = pick THEN c + 1 ELSE c END), pick
 FROM (SELECT *, list_min(list_filter(list_transform(had, lambda c, i: CASE WHEN c < ws[i] AND (c * total) // ws[i] <= t + 1 THEN {{'d': ((c + 1) * total + ws[i] - 1) // ws[i], 'i': i}} END), lambda z: z IS NOT NULL)).i AS pick FROM e WHERE t + 1 < total)),
p AS (SELECT names[j] AS source, had[j] - 1 AS i, ((had[j] - 1) * total) // ws[j] AS r, (had[j] * total + ws[j] - 1) // ws[j] AS d, t, ws[j] AS w, total FROM e WHERE j IS NOT NULL),
n AS (SELECT source, CAST(ceil(count(*) / {BLOCK_ROWS}.0) AS BIGINT) AS blocks FROM documents GROUP BY source),
idle AS (SELECT min((blocks // w) * total + t) AS first_idle FROM n JOIN p ON p.source = n.source AND p.i = n.blocks % p.w),
k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents),
b AS (SELECT doc_id, source, k // {BLOCK_ROWS} AS block, CAST(k % {BLOCK_ROWS} AS INTEGER) AS place FROM k)
SELECT b.doc_id, b.source, b.block, (b.block // w) * total + r AS release, (b.block // w) * total + d AS deadline,
       (b.block // w) * total + t AS slot, place, (b.block // w) * total + t < first_idle AS on_target
FROM b JOIN p ON p.source = b.source AND p.i = b.block % p.w CROSS JOIN idle
"""
