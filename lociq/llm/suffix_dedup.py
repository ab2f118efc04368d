"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else are removed.

1. Equal texts are one row with a count (their digest is the key, pre-aggregated before the shuffle); a text of at
   least ``length`` bytes that occurs twice is removed whole.
2. Anchors choose what needs suffixes at all, without loss: the least hash of the GRAM-byte strings within a window of
   ``length`` bytes is the window's anchor, so equal windows have equal anchors, at equal places. A run of windows with
   one occurrence of an anchor is a context: short, whatever the text, and no two of its windows are equal. A stretch of
   equal contexts behind one another, as in periodic text, is one context with a count. Contexts whose anchor occurs in
   no other hold no repeat; a context that occurs twice is repeated whole.
3. The other contexts of repeated anchors are dealt by anchor. Their suffixes are sorted in shards, and the shards'
   Burrows-Wheeler transforms are merged by interleave refinement (bwt_merge), which gives common prefixes and the
   intervals of repeated strings.
4. Anchors with more than GROUP_BYTES of different contexts, which one task shouldn't gather, are split before that: by
   how far the anchor is from a window's start, into ranges that narrow from round to round (WIDTHS), and by the bytes
   that all windows of a range have in common. Equal windows stay together, contexts that differ there don't, and those
   that become equal are one. In the last round a range is one window, so what is left of any group is equal.
5. The spans go back to all occurrences of a context, then to the texts, and unite there.

Equality of texts is told by 128 bits of SHA-256, that of contexts by 64 bits of the anchor's and 64 of their own hash.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated rows are documents of their
own, so they remove each other. Strings may overlap and may start twice in one text. Very long texts are cut into pieces
of windows for step 2. Columns that clash are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt_merge import covered, repeated_starts
from .common import column, cut, n_partitions, sliced, with_columns

LENGTH = 200
GRAM = 64
GROUP_BYTES = 2 << 20
BATCH_BYTES = 1 << 17
#: Windows in a range of a group that is split, by round.
WIDTHS = (18, 3, 1)
#: Windows of a text that are looked at together.
PIECE = 1 << 20

_SALT = np.random.default_rng(20_200).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram(length: int) -> int:
    return 1 << min(GRAM, length).bit_length() - 1


def _grams(data: bytes, gram: int) -> np.ndarray:
    """The hash of each string of ``gram`` bytes, from those of its halves."""
    h, mul, size = _SALT[np.frombuffer(data, np.uint8)], 0x9E3779B97F4A7C15, 1
    while size < gram:
        h = h[:-size] * np.uint64(mul) + h[size:]
        mul, size = mul * mul % (1 << 64), size * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def contexts(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor, begin, size, end, times of each context: size bytes from begin on, which repeat up to end, times in all.

    len(data) >= length. Pieces of a long text are worked on in turn; a border between them only cuts a context in two.
    """
    n = len(data) - length + 1
    parts = [_contexts(data[a : a + PIECE + length - 1], a, length) for a in range(0, n, PIECE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _contexts(data: bytes, at: int, length: int) -> tuple[np.ndarray, ...]:
    h = _grams(data, _gram(length))
    reach, size, least = length - _gram(length) + 1, 1, h
    while size * 2 <= reach:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if reach > size:
        least = np.minimum(least[: size - reach], least[reach - size :])
    # the next window has another anchor, or the next occurrence of the same
    new = np.flatnonzero((least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])) + 1
    begin = np.concatenate(([0], new))
    anchor, size = least[begin], np.append(new, len(least)) - begin + length - 1
    end, times = begin + size, np.ones(len(begin), np.int64)
    again = (anchor[1:] == anchor[:-1]) & (size[1:] == size[:-1])
    if again.any():
        raw = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
        for first, last in edges.reshape(-1, 2).tolist():  # contexts first to last, of one anchor and size
            period = int(begin[first + 1] - begin[first])
            a, b = int(begin[first]), int(end[last])
            wrong = np.concatenate(([0], np.cumsum(raw[a : b - period] != raw[a + period : b])))
            from_ = begin[first:last] - a
            again[first:last] = (np.diff(begin[first : last + 1]) == period) & (wrong[from_ + size[first]] == wrong[from_])
        head = np.flatnonzero(np.concatenate(([True], ~again)))
        times = np.diff(np.append(head, len(begin)))
        end = end[head + times - 1]
        anchor, begin, size = anchor[head], begin[head], size[head]
    return anchor.view("<i8"), begin + at, size, end + at, times


def _key(data: bytes) -> tuple[int, int]:
    d = hashlib.sha256(data).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def _packed(length: int, text: str):
    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            rows = [(*_key(t), len(t), pack(t)) for t in ((x or "").encode() for x in column(batch, text)) if len(t) >= length]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["d1", "d2", "n", "z"])

    return run


def distinct_texts(docs: DataFrame, text: str, length: int) -> DataFrame:
    """d1, d2, n, z (compressed), copies: each text of at least ``length`` bytes once."""
    rows = docs.select(text).mapInArrow(_packed(length, text), "d1 bigint, d2 bigint, n int, z binary")
    return rows.groupBy("d1", "d2").agg(F.first("n").alias("n"), F.first("z").alias("z"), F.count("*").alias("copies"))


def _unpack(batch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z) for z in column(batch, "z")]


def _digests(pieces: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(p) for p in pieces], np.uint64).view("<i8")


def _occurrences(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made: list = []
            for data, d1, d2, copies in zip(_unpack(batch), *(column(batch, c) for c in ("d1", "d2", "copies")), strict=True):
                anchor, begin, size, end, times = contexts(data, length)
                content = _digests([data[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
                fill = lambda v, n=len(begin): np.full(n, v, "<i8")
                made.append((anchor, content, fill(d1), fill(d2), begin.astype("<i4"), size.astype("<i4"), end.astype("<i4"), times * copies, np.full(len(begin), copies == 1)))
                if sum(len(m[0]) for m in made) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=OCCURRENCE)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=OCCURRENCE)

    return run


OCCURRENCE = ["anchor", "content", "d1", "d2", "begin", "size", "end", "copies", "alone"]
OCCURRENCE_TYPE = "anchor bigint, content bigint, d1 bigint, d2 bigint, begin int, size int, end int, copies bigint, alone boolean"
#: A string of a group g with its digest c; where it is one's only occurrence, the context (anchor, content) that it is
#: part of, from ``shift`` on, and its anchor's place x.
STRING = ["g", "c", "one", "anchor", "content", "shift", "x", "bytes"]
STRING_TYPE = "g bigint, c bigint, one boolean, anchor bigint, content bigint, shift int, x int, bytes binary"


def _strings(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=STRING)


def _extract(length: int):
    """A text's wanted contexts, as strings of their anchor's group."""

    def run(batches):
        gram = _gram(length)
        for batch in sliced(batches):
            rows = []
            for data, wanted in zip(_unpack(batch), column(batch, "wanted"), strict=True):
                for w in wanted:
                    piece = data[w["begin"] : w["begin"] + w["size"]]
                    # the anchor of all windows is the first of its kind from the last window's start on
                    x = -1
                    if w["large"]:
                        at = len(piece) - length
                        x = at + int(np.argmax(_grams(piece[at:], gram).view("<i8") == w["anchor"]))
                    rows.append((w["anchor"], w["content"], w["one"], w["anchor"], w["content"], 0, x, piece))
            yield _strings(rows)

    return run


def _split(length: int, width: int):
    """Strings -> their windows whose anchor is 0 to width - 1, width to 2 width - 1, … bytes behind the start."""

    def run(batches):
        import xxhash

        reach = length - _gram(length)
        for batch in sliced(batches):
            rows = []
            for _, _, one, anchor, content, shift, x, piece in zip(*(column(batch, c) for c in STRING), strict=True):
                last = len(piece) - length  # starts of windows: 0 to last, x - last to x bytes before the anchor
                for near in range(max(0, x - last) // width * width, x + 1, width):
                    far = min(near + width - 1, reach)
                    low, high = max(0, x - far), min(last, x - near)
                    core = piece[x - near : x - far + length]  # of all windows of the range
                    part = piece[low : high + length]
                    g = xxhash.xxh64_intdigest(core, near * 256 + width)
                    rows.append((_signed(g), _signed(xxhash.xxh64_intdigest(part)), one, anchor, content, shift + low, x - low, part))
            yield _strings(rows)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _merge(length: int):
    """Strings sorted by group -> the spans, in their context, that are repeated in those that occur once."""

    def spans(rows: list[tuple]):
        import pyarrow as pa

        starts = repeated_starts([r[5] for r in rows], length)
        ends = np.cumsum([len(r[5]) + 1 for r in rows])
        out = []
        for row, part, end in zip(rows, np.split(starts, np.searchsorted(starts, ends[:-1])), ends.tolist(), strict=True):
            if row[1] and len(part):
                out.append((row[2], row[3], (covered(part - (end - len(row[5]) - 1), length) + row[4]).astype("<i4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "content", "spans"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in sliced(batches):
            for row in zip(*(column(batch, c) for c in ("g", "one", "anchor", "content", "shift", "bytes")), strict=True):
                if size >= BATCH_BYTES and row[0] != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield spans(held)

    return run


def _whole(batch):
    """Strings that occur twice: all of each."""
    return [[np.array([[s, s + len(x)]], "<i4").tobytes() for s, x in zip(column(batch, "shift"), column(batch, "bytes"), strict=True)]]


def _groups(each: DataFrame) -> DataFrame:
    """g, large: the groups whose strings that occur once may share a window with others. each: g, times, size."""
    groups = each.groupBy("g").agg(F.count("*").alias("n"), F.max((F.col("times") == 1).cast("int")).alias("some"), (F.sum("size") > GROUP_BYTES).alias("large"))
    return groups.where("some = 1 and n > 1").select("g", "large")


def _in_groups(strings: DataFrame, length: int) -> DataFrame:
    """anchor, content, spans: what merging finds in groups that a task can hold."""
    n = n_partitions(strings)
    return strings.repartition(n, "g").sortWithinPartitions("g", "c").mapInArrow(_merge(length), "anchor bigint, content bigint, spans binary")


def _narrowed(strings: DataFrame, length: int) -> list[DataFrame]:
    """anchor, content, spans: of strings of large groups, split until a task can hold them."""
    found = []
    for width in WIDTHS:
        parts = strings.mapInArrow(_split(length, width), STRING_TYPE)
        times = F.sum(F.when(F.col("one"), 1).otherwise(2)).alias("times")
        each = parts.groupBy("g", "c").agg(times, *[F.first(c).alias(c) for c in STRING[3:]])
        each = cut(each.withColumn("size", F.length("bytes")).withColumn("one", F.col("times") == 1))
        twice = cut(each.where("times > 1").select("g", "c"))
        # the parts of a string that occurs in all texts are many: the table of two columns beside them lets the join split
        found.append(with_columns(parts.where("one").join(twice, ["g", "c"]), "spans binary", _whole).select("anchor", "content", "spans"))
        groups = cut(_groups(each))
        in_groups = cut(each.join(groups, "g"))
        found.append(_in_groups(in_groups.where("not large").select(*STRING), length))
        strings = in_groups.where("large").select(*STRING)
        if strings.isEmpty():
            break
    return found


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """texts (d1, d2, n, z, copies) and their spans (d1, d2, parts): parts are begin, end and spans of repeated contexts.

    Texts with copies have no spans: they are removed whole.
    """
    texts = cut(distinct_texts(docs, text, length))
    everywhere = texts.mapInArrow(_occurrences(length), OCCURRENCE_TYPE)
    often = cut(everywhere.groupBy("anchor").agg(F.sum("copies").alias("times")).where("times > 1").select("anchor"))
    occurrences = cut(everywhere.join(often, "anchor"))
    each = cut(occurrences.groupBy("anchor", "content").agg(F.sum("copies").alias("times"), F.min(F.struct("d1", "d2", "begin", "size")).alias("at")))
    groups = cut(_groups(each.select(F.col("anchor").alias("g"), "times", F.col("at.size").alias("size"))).withColumnRenamed("g", "anchor"))
    wanted = each.join(groups, "anchor").select("at.d1", "at.d2", F.struct("anchor", "content", (F.col("times") == 1).alias("one"), "large", "at.begin", "at.size").alias("w"))
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_list("w").alias("wanted"))  # of one text: bounded by its length
    taken = cut(texts.select("d1", "d2", "z").join(wanted, ["d1", "d2"]).select("z", "wanted").mapInArrow(_extract(length), STRING_TYPE))
    found = _in_groups(taken.where("x < 0"), length)
    large = taken.where("x >= 0")
    if not large.isEmpty():
        for more in _narrowed(large, length):
            found = found.unionByName(more)
    whole = each.where("times > 1").select("anchor", "content", F.lit(None).cast("binary").alias("spans"))
    spans = occurrences.where("alone").join(found.unionByName(whole), ["anchor", "content"])
    parts = spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("begin", "end", "spans")).alias("parts"))  # as above
    return texts, parts


def unite(parts: list[dict]) -> np.ndarray:
    """The maximal spans of a text, (n, 2), from its contexts' spans."""
    made = []
    for p in parts:
        if p["spans"] is None:
            made.append(np.array([[p["begin"], p["end"]]]))
        else:
            made.append(np.frombuffer(p["spans"], "<i4").reshape(-1, 2).astype(np.int64) + p["begin"])
    all_ = np.concatenate(made)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(all_[:, 1])
    first = np.concatenate(([True], all_[1:, 0] > reach[:-1]))
    at = np.flatnonzero(first)
    return np.stack((all_[at, 0], reach[np.append(at[1:], len(all_)) - 1]), axis=1)


def without(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _inwards(data: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without the bytes of characters that they hold in part."""
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _digested(docs: DataFrame, text: str) -> DataFrame:
    def compute(batch):
        data = [(t or "").encode() for t in column(batch, text)]
        keys = [_key(d) for d in data]
        return [[k[0] for k in keys], [k[1] for k in keys], [len(d) for d in data], [hashlib.sha256(d).hexdigest() for d in data]]

    return with_columns(docs, "__d1 bigint, __d2 bigint, __n bigint, __sha string", compute)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts, parts = repeated_spans(docs, "text", length)

    def cleaned(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = []
            for data, p in zip(_unpack(batch), column(batch, "parts"), strict=True):
                spans = unite(p)
                kept = without(data, spans)
                rows.append((len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["d1", "d2", "n_removed", "n_spans", "kept_sha256"])

    some = texts.where("copies = 1").select("d1", "d2", "z").join(parts, ["d1", "d2"]).mapInArrow(cleaned, "d1 bigint, d2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = texts.where("copies > 1").select("d1", "d2", F.col("n").cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    rows = _digested(docs, "text").drop("text")
    found = some.unionByName(whole)
    return rows.join(found, (F.col("__d1") == F.col("d1")) & (F.col("__d2") == F.col("d2")), "left").select(
        "doc_id", F.col("__n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha256", "__sha").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with the repeated spans cut out of their text, to whole characters. All rows stay.

    A null text stays null.
    """
    texts, parts = repeated_spans(docs, text, length)

    def cleaned(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [without(d, _inwards(d, unite(p))).decode() for d, p in zip(_unpack(batch), column(batch, "parts"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["d1", "d2", "kept"])

    some = texts.where("copies = 1").select("d1", "d2", "z").join(parts, ["d1", "d2"]).mapInArrow(cleaned, "d1 bigint, d2 bigint, kept string")
    found = some.unionByName(texts.where("copies > 1").select("d1", "d2", F.lit("").alias("kept")))
    found = found.toDF("__f1", "__f2", "__kept")
    rows = _digested(docs, text).join(found, (F.col("__d1") == F.col("__f1")) & (F.col("__d2") == F.col("__f2")), "left")
    return rows.withColumn(text, F.coalesce("__kept", text)).select(*docs.columns)
