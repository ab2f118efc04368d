"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of a vector are cut into SLICES slices; a slice is a local list of (query, vector) scores, and a
pair's score is the sum of its local scores. Phase 1 gathers the k best entries of each local list of one candidate
block, whose scores alone are then summed; the k-th best of them is a safe cutoff for the query. Phase 2 hands each query
block its cutoffs and collects every entry of all blocks that has a local score of at least cutoff / SLICES: a pair whose
local scores all lie below that can't reach the cutoff. Phase 3 resolves the collected entries' scores exactly, and the
best k of each block meet in a ranked window whose limit is applied before the shuffle. So the local scores of all pairs
are computed once, and those of one block twice.

The stated query set meets all rows in blocks of at most some ROWS rows of either side, dealt by block ids, so a
task holds two blocks and nothing is broadcast.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part.
Shorter vectors count as ending in zeros. Repeated rows are rows of their own: a query's own row alone is left out.
Ties go to the smaller id. Fewer candidates than k: all. Components and scores saturate at the limits of long. Vectors
of any length are taken whole; other columns are dropped, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SLICES = 4
#: Rows of a block: of candidates, and of queries, for each of whose blocks the candidates travel once.
ROWS, QUERY_ROWS = 4096, 32_768
STEP = 256


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """id, copy (1, 2, … for repeated ids), v array<bigint> of floor(scale * x)."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).where(fine)
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("v")))


def _dtype(most: int, dims: int):
    """A type in which all sums of products are exact."""
    bound = most * most * max(dims, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def _pack(dims: int, small: bool):
    """The rows of a block as one row of bytes."""

    def run(table):
        import pyarrow as pa

        v = np.zeros((table.num_rows, dims), "<i2" if small else "<i8")
        flat = table["v"].combine_chunks()
        ends = np.asarray(flat.offsets) - flat.offsets[0].as_py()
        sizes = np.diff(ends)
        at = np.repeat(np.arange(len(sizes)), sizes)
        v[at, np.arange(len(at)) - np.repeat(ends[:-1], sizes)] = np.asarray(flat.flatten())
        ids, copies = (np.asarray(table[c].combine_chunks()).astype("<i8") for c in ("id", "copy"))
        return pa.table({"block": [table["block"][0].as_py()], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "v": [v.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("v", pa.binary())]))

    return run


PACKED = "block bigint, ids binary, copies binary, v binary"


def _blocks(rows: DataFrame, n: int, dims: int, small: bool) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "copy"), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(_pack(dims, small), PACKED)


def _pairs(queries: DataFrame, nq: int, candidates: DataFrame, nc: int, extra: str) -> DataFrame:
    """Each of the nq query blocks with each of the nc candidate blocks, dealt by the ids of both."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    block = F.col("block")
    q = queries.select(F.lit(True).alias("query"), block.alias("qb"), each(nc).alias("cb"), "ids", "copies", "v", extra)
    c = candidates.select(F.lit(False).alias("query"), each(nq).alias("qb"), block.alias("cb"), "ids", "copies", "v", F.lit(None).cast("binary").alias(extra))
    return q.unionByName(c).groupBy("qb", "cb")


def _local_scores(table, dims: int, small: bool, dtype):
    """Steps of a block's queries: their ids and cutoffs, the candidates' ids, the local scores, own rows masked."""
    rows = {r["query"]: r for r in table.to_pylist()}
    if len(rows) < 2:
        return
    q, c = rows[True], rows[False]
    load = lambda r: np.frombuffer(r["v"], "<i2" if small else "<i8").reshape(-1, dims).astype(dtype)
    ids = lambda r, k="ids": np.frombuffer(r[k], "<i8")
    qv, cv, edges = load(q), load(c), [dims * s // SLICES for s in range(SLICES + 1)]
    for at in range(0, len(qv), STEP):
        part = slice(at, at + STEP)
        local = [qv[part, a:b] @ cv[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]
        own = (ids(q)[part, None] == ids(c)[None]) & (ids(q, "copies")[part, None] == ids(c, "copies")[None])
        yield part, ids(q)[part], ids(q, "copies")[part], q, ids(c), local, own


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best entries by score, then by smaller id."""
    order = np.lexsort((vec, -score if score.dtype != object else np.array([-s for s in score]), query))
    sorted_query = query[order]
    starts = np.concatenate(([True], sorted_query[1:] != sorted_query[:-1])) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - first < k]


def _to_long(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], "<i8")
    return score.astype("<i8")


def _phase1(k: int, dims: int, small: bool, dtype):
    def run(table):
        import pyarrow as pa

        out: list = [[], [], []]
        for _, qid, qcopy, _, _, local, own in _local_scores(table, dims, small, dtype):
            n = own.shape[1]
            seen = np.zeros(own.shape, bool)
            for s in local:
                top = np.argpartition(s, n - min(k, n), axis=1)[:, n - min(k, n) :] if dtype is not object else np.argsort(-s, axis=1)[:, :k]
                np.put_along_axis(seen, top, True, axis=1)
            seen &= ~own
            query, at = np.nonzero(seen)
            score = sum((s[query, at] for s in local[1:]), local[0][query, at])
            kept = _best(query, score, at, k)
            for o, x in zip(out, (qid[query[kept]], qcopy[query[kept]], _to_long(score[kept])), strict=True):
                o.append(x)
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, "<i8") for n, o in zip(("id", "copy", "score"), out, strict=True)}, schema=pa.schema([(n, pa.int64()) for n in ("id", "copy", "score")]))

    return run


def _phase3(k: int, dims: int, small: bool, dtype):
    def run(table):
        import pyarrow as pa

        names = ("id", "copy", "vec_id", "score")
        out: list = [[], [], [], []]
        for part, qid, qcopy, q, cid, local, own in _local_scores(table, dims, small, dtype):
            known = {(i, c): t for i, c, t in np.frombuffer(q["cutoffs"] or b"", "<i8").reshape(-1, 3).tolist()}
            cutoff = [known.get((i, c)) for i, c in zip(qid.tolist(), qcopy.tolist(), strict=True)]
            free = np.array([t is None for t in cutoff])[:, None]
            # integers: x >= t / m exactly when m * x >= t, and x >= floor of it keeps at least these
            least = np.array([0 if t is None else -(-t // SLICES) for t in cutoff], dtype if dtype is object else np.float64 if dtype != np.int64 else np.int64)[:, None]
            enough = np.zeros(own.shape, bool)
            for s in local:
                enough |= (s >= least).astype(bool)
            query, at = np.nonzero((enough | free) & ~own)
            score = sum((s[query, at] for s in local[1:]), local[0][query, at])
            reach = np.array([-(1 << 63) if t is None else t for t in cutoff], object if dtype is object else "<i8")[query]
            fit = free[query, 0] | (score >= reach).astype(bool)
            query, at, score = query[fit], at[fit], score[fit]
            kept = _best(query, score, cid[at], k)
            for o, x in zip(out, (qid[query[kept]], qcopy[query[kept]], cid[at[kept]], _to_long(score[kept])), strict=True):
                o.append(x)
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, "<i8") for n, o in zip(names, out, strict=True)}, schema=pa.schema([(n, pa.int64()) for n in names]))

    return run


def top_k(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """rows of ``quantised`` -> query_id, query_copy, rank, vec_id, score: the k best of each row where is_query."""
    rows = cut(rows)
    m = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("d"), F.max(F.array_max("v")).alias("a"), F.min(F.array_min("v")).alias("least")).first()
    empty = "query_id bigint, query_copy bigint, rank int, vec_id bigint, score bigint"
    if not m["q"] or m["n"] < 2:
        return rows.sparkSession.createDataFrame([], empty)
    dims, most = max(m["d"], 1), max(m["a"] or 0, -(m["least"] or 0))
    small, dtype = most < 1 << 15, _dtype(most, m["d"])
    nq, nc = -(-m["q"] // QUERY_ROWS), -(-m["n"] // ROWS)
    candidates = cut(_blocks(rows, nc, dims, small))
    queries = cut(_blocks(rows.where(is_query), nq, dims, small))
    best_first = W.partitionBy("id", "copy").orderBy(F.desc("score"))
    seeds = _pairs(queries.withColumn("cutoffs", F.lit(None).cast("binary")), nq, candidates.where("block = 0"), 1, "cutoffs").applyInArrow(_phase1(k, dims, small, dtype), "id bigint, copy bigint, score bigint")
    cutoffs = seeds.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= k).where(F.col("r") == k)
    cutoffs = cutoffs.withColumn("block", F.pmod(F.xxhash64("id", F.col("copy").cast("int")), F.lit(nq)))

    def pack(table):
        import pyarrow as pa

        packed = np.stack([np.asarray(table[c].combine_chunks()) for c in ("id", "copy", "score")], axis=1).astype("<i8").tobytes()
        return pa.table({"b": [table["block"][0].as_py()], "cutoffs": [packed]}, schema=pa.schema([("b", pa.int64()), ("cutoffs", pa.binary())]))

    handed = cutoffs.groupBy("block").applyInArrow(pack, "b bigint, cutoffs binary")
    queries = cut(queries.join(handed, queries["block"] == handed["b"], "left").drop("b"))
    found = _pairs(queries, nq, candidates, nc, "cutoffs").applyInArrow(_phase3(k, dims, small, dtype), "id bigint, copy bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("id", "copy").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("copy").alias("query_copy"), "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, F.col("id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
