"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them, exactly.

Equal sets are one node. Two sets of x <= y shingles are near only where x >= 0.8 y and at most (x + y) / 9 shingles
are in one of them alone; for either that is a quarter of its own size at most. The space of hashes is cut into parts,
their number by size: a shingle in one set alone spoils one part, so all but n/4 of a set's parts that aren't empty are
equal in the other. In any order of the parts' contents that all sets share, the first n/4 + 1 of each set then have an
equal one among them (a prefix filter), and only these are emitted; contents that are frequent in a sample stand last, so
that a passage of many texts seldom brings them together. A set with fewer parts that aren't empty also emits the empty
ones.

Sets that share a part are first compared with the least of them, and then only where that left them unconnected
with each other, by blocks of fingerprints. A set leaves that with PARTNERS hits at most; where there are more, the others
wait until those are compared and connected, in another round, as long as any are apart: a large group of copies costs its
size, and its pairs are never emitted. Each round takes GROWTH times as many, so that a set whose hits all turn out not to
be near needs rounds by their count's logarithm. Pairs go by their fingerprints first, of two bits
or more for each shingle, each the parity of the shingles that hash to it: a bit that differs takes a shingle that only
one set has, so the radius of a near pair is known and none is lost; the larger of two is folded. The distances of many
pairs are counted at once, bit-sliced (simhash). What is left is compared by the whole sets, which travel as compressed
texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, drop_cut, give_back, n_partitions, sliced, with_columns
from .components import components

WORDS = 5
SKETCH, WIDEST = 8, 512  # words of 64 bits
LOOKUP = 1 << 23  # bits
LEAST = 4  # smaller sets are near to equal ones only
#: Documents whose parts are counted to know the frequent ones, and the share of them that makes a part frequent.
SAMPLE, FREQUENT = 20_000, 0.001
STAR = 4096  # pairs of one set that a task compares
CHUNK = 512  # sets of a key that are compared with each other at once
PARTNERS, GROWTH = 4, 8  # of a set in the first round, and how many times more in each further one


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes; words as for the fingerprint, and fewer than a shingle's are the only shingle."""
    import xxhash

    w = (text or "").encode().lower().split()
    whole = map(b" ".join, zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else [b" ".join(w)] * bool(w)
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in whole], "<u8"))


def _parts(h: np.ndarray, level: int, last: np.ndarray) -> np.ndarray:
    """The first n/4 + 1 parts of the set at a level, which sets of level to 2 * level shingles have; those in ``last``
    (sorted) stand behind all others."""
    m, need = level * 3 // 5 + 4, len(h) // 4 + 1
    part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    keys = np.add.reduceat(h, starts) ^ np.uint64(m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    if len(starts) < need:
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part)
        return np.concatenate((keys, (empty + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(m)))
    if len(last):
        late = last[np.minimum(np.searchsorted(last, keys), len(last) - 1)] == keys
        if late.any():
            keys = np.concatenate((keys[~late], np.sort(keys[late])))
    return keys[:need]


NONE = np.zeros(0, np.uint64)


def keys(h: np.ndarray, last: np.ndarray = NONE) -> np.ndarray:
    """Sets that are near and not equal have one of these in common."""
    if len(h) < LEAST:
        return h[:0]
    level = 1 << (len(h).bit_length() - 1)
    above = [_parts(h, 2 * level, last)] if 5 * len(h) >= 8 * level else []
    return np.concatenate([_parts(h, level, last), *above])


def all_parts(h: np.ndarray) -> np.ndarray:
    """All that ``keys`` chooses from, but empty parts."""
    if len(h) < LEAST:
        return h[:0]
    out = []
    for level in (1 << (len(h).bit_length() - 1), 2 << (len(h).bit_length() - 1)):
        m = level * 3 // 5 + 4
        part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out.append(np.add.reduceat(h, starts) ^ np.uint64(m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(out)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the set, SKETCH words or as many times two as it takes for two bits a shingle."""
    words = SKETCH
    while words < WIDEST and 64 * words < 2 * len(h):
        words *= 2
    odd = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches (n, more words) as those of fewer words."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)


def _node(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes())


def with_nodes(docs: DataFrame) -> DataFrame:
    """With node, a digest of the set, its size n, its sketch folded to SKETCH words, and the whole one."""

    def compute(batch):
        nodes, sizes, wide = [], [], []
        for t in column(batch, "text"):
            h = shingles(t)
            nodes.append(_node(h))
            sizes.append(len(h))
            wide.append(sketch(h))
        return [np.array(nodes, "<u8").view("<i8"), np.array(sizes, "<i4"), [folded(w[None], SKETCH)[0] for w in wide], wide]

    return with_columns(docs, "node bigint, n int, sketch array<bigint>, wide array<bigint>", compute)


def frequent(docs: DataFrame) -> np.ndarray:
    """The parts that are frequent among a bounded sample of the texts, sorted; fewer than a thousand to a set's parts."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * share)).select("text")

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            found = [all_parts(shingles(t)) for t in column(batch, "text")]
            key, n = np.unique(np.concatenate(found) if found else NONE, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8")), pa.array(n)], names=["key", "n"])

    least = max(16, int(SAMPLE * FREQUENT))
    got = some.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key").toArrow()
    return np.sort(np.asarray(got["key"].combine_chunks()).astype("<i8").view("<u8")) if got.num_rows else NONE


def _keyed(last: np.ndarray):
    """Texts -> (key, node), equal sets of a batch once."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            seen: dict[int, np.ndarray] = {}
            for h in map(shingles, column(batch, "text")):
                if (node := _node(h)) not in seen:
                    seen[node] = keys(h, last)
            node = np.repeat(np.array(list(seen), "<u8").view("<i8"), [len(k) for k in seen.values()])
            key = np.concatenate(list(seen.values())) if seen else NONE
            yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8")), pa.array(node)], names=["key", "node"])

    return run


def _stars(batches):
    """Rows sorted by key and node -> each key's least node with each other one; only that node is held."""
    import pyarrow as pa

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        a = np.where(at < 0, last[1] if last else 0, node[at])
        fresh = new | np.concatenate(([last is None or node[0] != last[2]], node[1:] != node[:-1]))
        out = np.flatnonzero((a != node) & fresh)
        last = (key[-1], a[-1], node[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, a, node)], names=["key", "a", "b"])


def _looked_up(docs: DataFrame, one: DataFrame) -> DataFrame:
    """docs without most of the rows that are not among the ids (a bitmap by hash), so that few texts are shuffled."""
    at = F.pmod(F.xxhash64("__id", "__h"), F.lit(LOOKUP))
    found = one.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    # buckets are counted from one, of the positions from one on; position 0 has a bucket of its own
    size = 32_768
    held = np.zeros(LOOKUP + size, np.uint8)
    for r in found:
        held[r.k * size : r.k * size + size] = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")[:size]
    packed = np.packbits(held)

    def has(batches):
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            k, p = (np.asarray(batch.column(batch.num_columns - i)).astype(np.int64) for i in (2, 1))
            i = k * size + p
            kept = pa.array(np.flatnonzero(packed[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1))
            yield batch.take(kept).select(range(batch.num_columns - 2))

    of = F.pmod(F.xxhash64("doc_id", "h"), F.lit(LOOKUP))
    rows = docs.select(*docs.columns, F.bitmap_bucket_number(of).alias("__k"), F.bitmap_bit_position(of).alias("__p"))
    return rows.mapInArrow(has, docs.schema)


def _compared(batches):
    """Rows sorted by (a, part), a's own text first -> the pairs (a, b) whose whole sets are near."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    of, own = None, NONE
    for batch in sliced(batches):
        found = []
        for a, part, b, z in zip(*(column(batch, c) for c in ("a", "part", "b", "z")), strict=True):
            h = shingles(unpack(z).decode())
            if b is None:
                of, own = (a, part), h
            elif of == (a, part):
                both = len(np.intersect1d(own, h, assume_unique=True))
                if 9 * both >= 4 * (len(own) + len(h)):
                    found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])


def _near(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are near. A set with many partners is compared by several tasks."""
    n = n_partitions(pairs)
    wanted = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
    one = ids.join(wanted, ids["node"] == wanted["a"], "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("m"))
    one = cut(one.select("node", F.col("m.doc_id").alias("__id"), F.col("m.h").alias("__h")))
    rows = _looked_up(docs, one).join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("node", "text")

    def packed(batch):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return [[pack((t or "").encode()) for t in column(batch, "text")]]

    texts = cut(with_columns(rows, "z binary", packed).drop("text").groupBy("node").agg(F.first("z").alias("z")))
    parts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")))
    others = pairs.join(texts.withColumnRenamed("node", "b"), "b").join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", "z")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("node", "a"), "a")
    dealt = others.unionByName(own.select("a", "part", F.lit(None).cast("bigint").alias("b"), "z")).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    near = cut(dealt.mapInArrow(_compared, "a bigint, b bigint"))
    for t in (one, texts, parts):
        drop_cut(t)
    return near


def _likely(pairs: DataFrame, once: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and fingerprints are those of near sets, counted bit-sliced."""
    from .simhash import within_radius

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            lists = [batch.column(batch.schema.names.index(c)) for c in ("as", "bs")]
            flat, sizes = [np.asarray(x.flatten()).view("<u8") for x in lists], [np.asarray(x.value_lengths()).astype(np.int64) for x in lists]
            starts = [np.cumsum(n) - n for n in sizes]
            radius, good = np.asarray(batch.column(batch.schema.names.index("both"))) // 9, np.zeros(batch.num_rows, bool)
            for pair in {*zip(*(n.tolist() for n in sizes), strict=True)}:
                at = np.flatnonzero((sizes[0] == pair[0]) & (sizes[1] == pair[1]))
                x, y = (folded(f[s[at][:, None] + np.arange(n)], min(pair)) for f, s, n in zip(flat, starts, pair, strict=True))
                good[at] = within_radius(x ^ y, radius[at])
            kept = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(kept) for i in range(2)], names=["a", "b"])

    of = lambda c: once.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("wide").alias(f"{c}s"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where("5 * least(an, bn) >= 4 * greatest(an, bn)")
    return rows.select("a", "b", (F.col("an") + F.col("bn")).alias("both"), "as", "bs").mapInArrow(run, "a bigint, b bigint")


def _hits(partners: int):
    """Rows sorted by group: (group, node, root, n, sketch, wide, failed) -> likely pairs (a, b) of different roots that
    haven't failed yet, ``partners`` for each; a row of nulls where there are more."""

    def run(batches):
        import pyarrow as pa

        from .simhash import within_radius

        def likely(rows: list[tuple]):
            # columns of several whole groups; within a group by size, so that partners stand behind
            group, node, root, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            order = np.lexsort((n, group))
            group, node, root, n = group[order], node[order], root[order], n[order]
            small = np.array([rows[i][4] for i in order], np.int64).view(np.uint64)
            last = np.searchsorted(group, group, side="right")
            reach = last - np.arange(len(group)) - 1
            x = np.repeat(np.arange(len(group)), reach)
            y = np.arange(len(x)) - np.repeat(np.cumsum(reach) - reach, reach) + x + 1
            some = (root[x] != root[y]) & (5 * n[x] >= 4 * n[y])
            x, y = x[some], y[some]
            parts = [np.zeros(0, np.int64)]
            for at in range(0, len(x), 1 << 15):
                p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                parts.append(at + np.flatnonzero(within_radius(small[p] ^ small[q], (n[p] + n[q]) // 9)))
            kept = np.concatenate(parts)
            x, y = x[kept], y[kept]
            wide = {i: np.array(rows[order[i]][5], np.int64).view(np.uint64) for i in {*x.tolist(), *y.tolist()}}
            good = []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                words = min(len(wide[i]), len(wide[j]))
                apart = folded(wide[i][None], words)[0] ^ folded(wide[j][None], words)[0]
                good.append(9 * int(np.bitwise_count(apart).sum()) <= n[i] + n[j] and node[j] not in (rows[order[i]][6] or ()))
            x, y = x[np.array(good, bool)], y[np.array(good, bool)]
            by = np.argsort(y, kind="stable")
            new = np.concatenate(([True], y[by][1:] != y[by][:-1]))[: len(by)]
            nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            x, y = x[by[nth < partners]], y[by[nth < partners]]
            more = [None] * int((nth >= partners).any())
            pairs = [np.minimum(node[x], node[y]).tolist() + more, np.maximum(node[x], node[y]).tolist() + more]
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], names=["a", "b"])

        held: list[tuple] = []
        for batch in sliced(batches):
            for row in zip(*(column(batch, c) for c in ("group", "node", "root", "n", "sketch", "wide", "failed")), strict=True):
                if len(held) >= 2 * CHUNK and row[0] != held[-1][0]:
                    yield likely(held)
                    held = []
                held.append(row)
        if held:
            yield likely(held)

    return run


def near_roots(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, h, text), ids (doc_id, h, node, n, sketch) -> node, root; only nodes with links are listed."""
    rows = docs.select("text").mapInArrow(_keyed(frequent(docs)), "key bigint, node bigint")
    rows = rows.repartition(n_partitions(ids), "key").sortWithinPartitions("key", "node")
    met = cut(rows.mapInArrow(_stars, "key bigint, a bigint, b bigint"))
    once = cut(ids.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")))
    pairs = cut(_likely(met.select("a", "b").distinct(), once))
    near = _near(pairs, docs, ids)
    drop_cut(pairs)
    root, failed, partners = components(near), None, PARTNERS
    while True:
        give_back(docs.sparkSession)
        pairs, more = _apart(met, once, root, failed, partners)
        if pairs.isEmpty():  # then there are no more either
            break
        found = _near(pairs, docs, ids)
        if not found.isEmpty():  # else all groups are as they were
            near = cut(near.union(found))
            root = components(near)
        if not more:
            break
        new = pairs.join(found, ["a", "b"], "left_anti")
        failed, partners = cut(new if failed is None else failed.union(new)), partners * GROWTH
    for t in (met, once):
        drop_cut(t)
    return root


def _apart(met: DataFrame, once: DataFrame, root: DataFrame, failed: DataFrame | None, partners: int) -> tuple[DataFrame, bool]:
    """Likely pairs of sets that share a key and have different roots, ``partners`` of a set in a block, and whether there
    are more than these."""
    root = cut(root)
    of_root = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}r"))
    named = met.join(of_root("a"), "a", "left").join(of_root("b"), "b", "left").withColumns({"ar": F.coalesce("ar", "a"), "br": F.coalesce("br", "b")})
    # keys that hold members of several groups; the key's least was compared with all others already
    mixed = cut(named.where("ar <> br").select("key").distinct())
    members = named.join(mixed, "key", "left_semi").select("key", F.col("b").alias("node"), F.col("br").alias("root"))
    # large keys are compared by pairs of chunks
    sizes = cut(members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), "chunks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (F.col("chunks") == 1) | (c != F.col("chunk")))
    group = F.explode(F.transform(others, lambda c: F.xxhash64("key", F.least(c, "chunk"), F.greatest(c, "chunk"))))
    dealt = members.join(sizes, "key").withColumn("chunk", chunk).withColumn("group", group).join(once, "node")
    if failed is None:
        dealt = dealt.withColumn("failed", F.lit(None).cast("array<bigint>"))
    else:  # as many as a set's partners of all rounds, for each of its blocks
        both = failed.union(failed.select("b", "a")).groupBy("a").agg(F.collect_set("b").alias("failed"))
        dealt = dealt.join(both.withColumnRenamed("a", "node"), "node", "left")
    dealt = dealt.select("group", "node", "root", "n", "sketch", "wide", "failed").repartition(n_partitions(met), "group").sortWithinPartitions("group")
    hits = cut(dealt.mapInArrow(_hits(partners), "a bigint, b bigint").distinct())
    for t in (root, mixed, sizes):
        drop_cut(t)
    return hits.where("a is not null"), not hits.where("a is null").isEmpty()
