"""Masking and cutting of sequences. A sequence is one row or, where long, a table of chunks with their offset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_spans(sequences: DataFrame, spans: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """The spans of a sequence as an array; of one sequence only, so bounded by its own annotation."""
    rows = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start0", "end0", *extra))).alias("__spans"))
    return sequences.join(rows, key, "left")


def hard_mask(sequences: DataFrame, spans: DataFrame, key: str = "seqid", seq: str = "seq", letter: str = "N") -> DataFrame:
    """Bases in the spans replaced by the letter."""

    @F.pandas_udf("string")
    def mask(s: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(s, at, strict=True):
            if text is None or rows is None:
                out.append(text)
                continue
            b = bytearray(text, "ascii", "replace")
            for r in rows:
                a, e = max(0, r["start0"]), min(len(b), r["end0"])
                if a < e:
                    b[a:e] = letter.encode() * (e - a)
            out.append(b.decode())
        return pd.Series(out)

    return _with_spans(sequences, spans, key, []).withColumn(seq, mask(seq, "__spans")).drop("__spans")


def tri_state_mask(sequences: DataFrame, features: DataFrame, key: str = "seqid", seq: str = "seq", keep: int = 20, feature_letter: str = "N", far_letter: str = "V") -> DataFrame:
    """Features masked, ``keep`` bases beside them as they are, all else the far letter; letters other than ACGT stay."""

    @F.pandas_udf("string")
    def mask(s: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(s, at, strict=True):
            if text is None:
                out.append(None)
                continue
            b = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
            state = np.full(len(b), ord(far_letter), np.uint8)
            for margin, letters in ((keep, b), (0, np.full(len(b), ord(feature_letter), np.uint8))):
                for r in rows if rows is not None else []:
                    a, e = max(0, r["start0"] - margin), min(len(b), r["end0"] + margin)
                    state[a:e] = letters[a:e]
            base = np.isin(b, np.frombuffer(b"ACGTacgt", np.uint8))
            out.append(np.where(base, state, b).tobytes().decode())
        return pd.Series(out)

    return _with_spans(sequences, features, key, []).withColumn(seq, mask(seq, "__spans")).drop("__spans")


#: Letters by depth, beyond them X (fixed values).
DEPTH_LETTERS = "NRDYSWKMBH"


def depth_paint(sequences: DataFrame, spans: DataFrame, key: str = "seqid", seq: str = "seq") -> DataFrame:
    """Spans (start0, end0, depth) painted with the letter of their depth, outer ones first."""

    @F.pandas_udf("string")
    def paint(s: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(s, at, strict=True):
            if text is None or rows is None:
                out.append(text)
                continue
            b = bytearray(text, "ascii", "replace")
            for r in sorted(rows, key=lambda r: (r["depth"], r["start0"])):
                a, e = max(0, r["start0"]), min(len(b), r["end0"])
                letter = DEPTH_LETTERS[r["depth"]] if r["depth"] < len(DEPTH_LETTERS) else "X"
                if a < e:
                    b[a:e] = letter.encode() * (e - a)
            out.append(b.decode())
        return pd.Series(out)

    return _with_spans(sequences, spans, key, ["depth"]).withColumn(seq, paint(seq, "__spans")).drop("__spans")


def excised(sequences: DataFrame, spans: DataFrame, key: str = "seqid", seq: str = "seq") -> DataFrame:
    """The bases outside the union of the spans, joined."""

    @F.pandas_udf("string")
    def cut(s: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(s, at, strict=True):
            if text is None or rows is None:
                out.append(text)
                continue
            parts, done = [], 0
            for r in rows:
                parts.append(text[done : max(done, r["start0"])])
                done = max(done, r["end0"])
            out.append("".join(parts) + text[done:])
        return pd.Series(out)

    return _with_spans(sequences, spans, key, []).withColumn(seq, cut(seq, "__spans")).drop("__spans")


def extracted(sequences: DataFrame, spans: DataFrame, key: str = "seqid", seq: str = "seq") -> DataFrame:
    """spans with their bases; the minus strand is turned round. Parts beyond the ends are left out."""
    from ..functions.sequence import reverse_complement

    start = F.greatest(F.col("start0"), F.lit(0))
    piece: Column = F.substring(F.col("__seq"), (start + 1).cast("int"), F.greatest(F.col("end0") - start, F.lit(0)).cast("int"))
    rows = spans.join(sequences.select(key, F.col(seq).alias("__seq")), key)
    turned = F.when(F.col("strand") == "-", reverse_complement(piece)).otherwise(piece) if "strand" in spans.columns else piece
    return rows.withColumn(seq, turned).drop("__seq")


def chunked(sequences: DataFrame, size: int = 1 << 20, key: str = "seqid", seq: str = "seq") -> DataFrame:
    """key, chunk, offset0, seq: long sequences as rows that fit in memory."""
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass, whatever the length
    rows = sequences.select(key, F.posexplode(F.when(F.length(seq) > 0, parts).otherwise(F.array(F.lit("")))).alias("chunk", seq))
    return rows.select(key, F.col("chunk").cast("bigint").alias("chunk"), (F.col("chunk").cast("bigint") * size).alias("offset0"), seq)


def extracted_from_chunks(chunks: DataFrame, spans: DataFrame, size: int = 1 << 20, key: str = "seqid", seq: str = "seq", ident: str = "id") -> DataFrame:
    """ident, seq: bases of spans over chunked sequences, by an equi-join on (key, chunk)."""
    each = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start0") / size), F.floor((F.col("end0") - 1) / size))))
    met = each.join(chunks, [key, "chunk"])
    a, e = F.greatest(F.col("start0") - F.col("offset0"), F.lit(0)), F.least(F.col("end0") - F.col("offset0"), F.lit(size))
    part = F.substring(F.col(seq), (a + 1).cast("int"), (e - a).cast("int"))
    parts = met.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))).alias("p"))
    return parts.select(ident, F.array_join(F.transform("p", lambda x: x["part"]), "").alias(seq))
