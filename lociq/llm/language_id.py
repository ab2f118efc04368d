"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Method: the hashed n-grams of a text's characters (code points, in lower case) are weighted by (1 + log count) * idf and scaled to length 1. Document frequencies
are counted over all training documents. The regression is trained by follow-the-regularised-leader (proximal, one
step size per weight) with L1 and L2 penalties, which leave most weights zero; a temperature fitted to rows left out
of the training calibrates its probabilities.

The weights are fitted to a bounded sample of the training rows: some TRAIN_ROWS different rows and TRAIN_CHARS
characters in all, chosen by a hash of id and text. The driver gets one count per bucket and the sample's n-grams. Every
whole text, whatever its length, is then predicted in one narrow pass.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null lang or doc_id aren't
learned from. Without training rows every text is ``und``; with one language all others have it. Repeated rows are
learned from once and predicted each, equal texts alike; columns that clash are replaced. An empty table gives an empty
one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, sliced, with_columns
from .ngrams import characters, counted, hashed, present
from .quality import bounded, held_out

ORDERS, BITS = (1, 2, 3), 16
TRAIN_ROWS, TRAIN_CHARS = 6000, 30_000_000


def buckets(text: str | None) -> np.ndarray:
    return hashed(characters((text or "").lower()), ORDERS, BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket, and the number of documents: summed in each task first."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in sliced(batches):
            for t in column(batch, "text"):
                total[present(buckets(t), BITS)] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out, n = np.zeros(1 << BITS, np.int64), 0
    for b, k in zip(rows["bucket"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if b < 0:
            n = k
        else:
            out[b] = k
    return out, n


def weighted(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, rounds: int = 3, step: float = 0.5, l1: float = 0.02, l2: float = 0.05, seed: int = 1) -> np.ndarray:
    """weights (classes, buckets)"""
    z, n = np.zeros((classes, 1 << BITS)), np.zeros((classes, 1 << BITS))

    def weights(at):
        s = z[:, at]
        return np.where(np.abs(s) <= l1, 0.0, -(s - np.sign(s) * l1) / ((1 + np.sqrt(n[:, at])) / step + l2))

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = _softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x
            new = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(new) - np.sqrt(n[:, at])) / step * w
            n[:, at] = new
    return weights(slice(None))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """That with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], weight: np.ndarray, idf: np.ndarray, heat: float) -> None:
        self.languages, self.weight, self.idf, self.heat = languages, weight, idf, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        at, count = counted(buckets(text), BITS)
        p = _softmax(self.weight[:, at] @ weighted(at, count, self.idf) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """docs (doc_id, text, lang), training rows only."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    seen, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)) + 1

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [counted(buckets(t), BITS) for t in column(batch, "text")]
            at, count = ([m[i].astype("<i4").tobytes() for m in made] for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("doc_id")), pa.array(column(batch, "lang"), pa.string()), pa.array(at, pa.binary()), pa.array(count, pa.binary())], names=["doc_id", "lang", "at", "n"])

    sized = docs.withColumn("__n", F.coalesce(F.length("text"), F.lit(0)))
    sample = bounded(sized, ["doc_id", "lang", "text"], train_rows, "__n", train_chars).drop("__n").mapInArrow(run, "doc_id bigint, lang string, at binary, n binary")
    got = sample.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("at", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), idf, 1.0)
    rows = [(at, weighted(at, np.frombuffer(c, "<i4"), idf)) for a, c in zip(got["at"].to_pylist(), got["n"].to_pylist(), strict=True) for at in [np.frombuffer(a, "<i4")]]
    labels = np.array([languages.index(x) for x in got["lang"].to_pylist()])
    # drawn, so that no pattern in the ids keeps a language out of the training
    out = np.random.default_rng(7).permutation(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    weight = ftrl([r for r, o in zip(rows, out, strict=True) if not o], labels[~out], len(languages))
    logits = np.array([weight[:, at] @ x for (at, x), o in zip(rows, out, strict=True) if o]).reshape(-1, len(languages))
    return Model(languages, weight, idf, temperature(logits, labels[out]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """With lang_pred and score."""

    def compute(batch):
        made = [model.predict(t) for t in column(batch, "text")]
        return [[m[i] for m in made] for i in range(2)]

    return with_columns(docs, "lang_pred string, score double", compute)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    return predicted(docs.select("doc_id", "text"), train(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
