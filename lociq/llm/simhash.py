"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: the 64 majority bits of the XXH64 values (seed 42) of word shingles. Equal fingerprints are one node.
Candidates: the 64 bits are cut into m blocks; two fingerprints that differ in at most r bits agree in m - r blocks
at least, so each node goes into a bucket for every choice of m - r blocks. m grows with the number of nodes until
buckets are small, at any m no link is lost. A bucket of more than CHUNK nodes is split into chunks and compared by
pairs of chunks.

Method: within a bucket the fingerprints are stored vertically, 64 of them in a word for each bit. The words of a
plane, negated where the query's bit is one, are added to carry-save counters that start at 2^k - 1 - r, so that a
carry out of the top marks a fingerprint beyond the radius; words whose 64 are all beyond are abandoned. The hits of
a bucket are reduced to a star for each of its groups before they leave the task: no pairs are emitted.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle: the whole sequence is the only shingle. Repeated rows are kept. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, release, with_columns
from .components import components
from .near_copies import near_roots, with_nodes

CHUNK = 2048
BUCKET = 128
ROWS = 65_536
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 4) -> int:
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: A-Z only, and white space \x20 \x09-\x0D only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65_536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.packbits(ones * 2 > len(h), bitorder="little").view("<u8"))[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """With fingerprint as a signed long."""

    def compute(batch):
        return [np.array([fingerprint(t, words) for t in column(batch, text)], "<u8").view("<i8")]

    return with_columns(docs, "fingerprint bigint", compute)


def block_masks(radius: int, nodes: int) -> list[int]:
    """Masks of m - r of m blocks; m is the least for which a bucket of random fingerprints has BUCKET at most."""
    for m in range(radius + 1, 17):
        if nodes >> (64 * (m - radius) // m) <= BUCKET:
            break
    edge = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def within(groups: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) in the same group, at most radius bits apart. groups is sorted; prints are unsigned."""
    n = len(groups)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.append(starts, n))
    words = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)[:-1]))
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[group]
    lanes = np.zeros((int(words.sum()), 64), np.uint64)
    held = np.zeros(lanes.shape, bool)
    member = np.full(lanes.shape, -1, np.int64)
    at = (first_word[group] + place // 64, place % 64)
    lanes[at], held[at], member[at] = prints, True, np.arange(n)
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    planes = [pack((lanes >> np.uint64(b) & np.uint64(1)).astype(bool)) for b in range(64)]
    # each member as a query against its group's words from its own on
    reach = words[group] - place // 64
    query = np.repeat(np.arange(n), reach)
    word = np.arange(len(query)) - np.repeat(np.cumsum(reach) - reach, reach) + (first_word[group] + place // 64)[query]
    over = ~pack(held)[word]
    own = word == at[0][query]
    lane = at[1][query[own]].astype(np.uint64)
    over[own] |= ONES >> (np.uint64(63) - lane)  # itself and those before it
    k = max(1, radius.bit_length())
    left = (1 << k) - 1 - radius
    counters = [np.full(len(query), ONES if left >> i & 1 else 0, np.uint64) for i in range(k)]
    for b in range(64):
        bit = (prints[query] >> np.uint64(b)) & np.uint64(1)
        carry = planes[b][word] ^ (np.uint64(0) - bit)
        for i in range(k):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b % 8 == 7:
            alive = over != ONES
            if alive.mean() < 0.7:
                query, word, over, counters = query[alive], word[alive], over[alive], [c[alive] for c in counters]
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, hit = np.nonzero(bits)
    return query[row], member[word[row], hit]


def within_radius(differing: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of each row of ``differing`` (n, words; the bits in which a pair differs) whether at most its radius are set.

    The pairs' bits are stored vertically, 64 pairs in a word, and the planes added to carry-save counters that start at
    2^k - 1 - radius, each pair's own; words of which all pairs are beyond are abandoned.
    """
    n, bits = len(differing), 64 * differing.shape[1]
    pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8")
    lanes = -(-n // 64) * 64
    padded = np.zeros((lanes, differing.shape[1]), "<u8")
    padded[:n] = differing
    planes = pack(np.ascontiguousarray(np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").T))
    radius = np.minimum(np.concatenate((radius, np.zeros(lanes - n, np.int64))).astype(np.int64), bits)
    k = max(1, int(radius.max(initial=0)).bit_length())
    start = (1 << k) - 1 - radius
    counters = [pack((start >> i & 1).astype(np.uint8)) for i in range(k)]
    over = pack((np.arange(lanes) >= n).astype(np.uint8))
    word = np.arange(len(over))
    out = over.copy()
    for b in range(bits):
        carry = planes[b, word]
        for i in range(k):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if b % 32 == 31:
            out[word] = over
            alive = over != ONES
            if 10 * np.count_nonzero(alive) < 7 * len(alive):
                word, over, counters = word[alive], over[alive], [c[alive] for c in counters]
    out[word] = over
    return ~np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)[:n]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each position's component, by label propagation over the links of one batch."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            return root


def _links(radius: int):
    def of(groups: np.ndarray, prints: np.ndarray):
        a, b = within(groups, prints.view("<u8"), radius)
        root = stars(len(groups), a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return prints[moved], prints[root[moved]]

    def run(batches):
        """Rows sorted by group; whole groups are taken together, several small ones at once."""
        import pyarrow as pa

        held: list = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            groups, prints = (np.concatenate([h[i] for h in held]) for i in range(2))
            end = len(groups) if last else int((groups != groups[-1]).sum())
            held, rows = [(groups[end:], prints[end:])], len(groups) - end
            if end:
                a, b = of(groups[:end], prints[:end])
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            return None

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
                rows += batch.num_rows
                if rows >= ROWS and (out := flush(False)) is not None:
                    yield out
        if rows and (out := flush(True)) is not None:
            yield out
        release()

    return run


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes (fingerprint, distinct) -> links (a, b) that join all nodes at most radius bits apart, as stars."""
    masks = block_masks(radius, nodes.count())
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(signed(m)).cast("bigint"))) for i, m in enumerate(masks)]))
    rows = nodes.select("fingerprint", key.alias("key"))
    # buckets of one node have no links; the others are counted first, so that large ones can be split
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("fingerprint", F.lit(7)), chunks).cast("int")
    others = F.filter(F.sequence(F.lit(0), chunks - 1), lambda c: (chunks == 1) | (c != chunk))
    pair = F.transform(others, lambda c: F.xxhash64("key", F.least(c, chunk), F.greatest(c, chunk)))
    dealt = rows.join(sizes, "key").select("fingerprint", F.explode(pair).alias("group"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.select("group", "fingerprint").repartition(n, "group").sortWithinPartitions("group")
    return sorted_.mapInArrow(_links(radius), "a bigint, b bigint")


def fingerprint_roots(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs (doc_id, fingerprint) -> fingerprint, least (doc_id), root: the least fingerprint that is reachable."""
    nodes = cut(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fingerprint"), radius))
    return nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_components(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs (doc_id, fingerprint) -> with component_id: the least doc_id reachable over links of at most radius bits."""
    named = fingerprint_roots(docs, radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(F.col("fingerprint").alias("__f"), "component_id")
    return docs.join(named, docs["fingerprint"] == named["__f"]).drop("__f")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = cut(with_fingerprints(docs).select("doc_id", "fingerprint"))
    return near_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (``near_copies``: five-word shingles, similarity 0.8 or more, transitive)
    stays: that with the least doc_id (null last), of these that with the least text hash."""
    texts = docs.select("doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = cut(with_nodes(texts).drop("text"))
    roots = near_roots(texts, ids).withColumnRenamed("node", "__n")
    least = ids.join(roots, ids["node"] == roots["__n"], "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m"))
    least = least.select(F.col("m.doc_id").alias("__id"), F.col("m.h").alias("__lh"))
    # 128 bits of a row's id and text, without nulls: the join and the removal of repeated rows share one shuffle
    marks = lambda i, h: [h, F.xxhash64(F.lit(5), i.isNull(), F.coalesce(i, F.lit(0)), h)]
    h, mark = marks(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = docs.withColumns({"__h": h, "__m": mark})
    h, mark = marks(F.col("__id"), F.col("__lh"))
    kept = rows.join(least.select(h.alias("__h"), mark.alias("__m")), ["__h", "__m"], "left_semi")
    return kept.dropDuplicates(["__h", "__m"]).select(*docs.columns)
