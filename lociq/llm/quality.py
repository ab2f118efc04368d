"""Quality classifier: naive Bayes support vectors.

Method: the indicators of hashed n-grams are scaled by the log ratio of their smoothed shares in the two classes and
by one over the length of what results; a linear model with hinge loss is fitted to them by dual coordinate descent, and
interpolated with its mean weight. Its margin, of the same scaled indicators, becomes a score through a logistic curve
fitted to rows left out of the descent. The n-grams are those of the text's bytes, and those of its words when each is
told by how lately it occurred, which shows repetition in any vocabulary.

The model is fitted to a bounded sample of the labelled rows: some TRAIN_ROWS of them and TRAIN_CHARS characters in all,
chosen by a hash. A table of two numbers per bucket goes to the executors. Every whole text is scored, whatever its
length, in one narrow pass.

Defined cases: a null or empty text has no n-gram, and its score is that of the bias. Rows with a null doc_id are scored,
never learned from, and not held out. Labels other than 0 and 1, or null, are not learned from; a document with several
labels is learned from once for each, and of rows that repeat a doc_id that with the least text hash is learned from.
Where a class is missing, all scores are the share of label 1 (0.5 without labels). Repeated rows are scored each, equal
texts alike; columns that clash are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, sliced, with_columns
from .ngrams import as_bytes, hashed, present, recency

ORDERS, WORD_ORDERS, BITS = (1, 2, 3), (1, 2, 3, 4, 5, 6), 18
TRAIN_ROWS, TRAIN_CHARS = 8000, 40_000_000
CUT = 0.7


class Model(NamedTuple):
    """Score of a text with the buckets ``at``: logistic(slope * margin + offset), and the margin is
    (weight[at] @ ratio[at] + bias) / sqrt(ratio[at] @ ratio[at] + 1)."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        return float((self.weight[at] @ r + self.bias) / np.sqrt(r @ r + 1))


def features(text: str | None) -> np.ndarray:
    """The buckets of a text's n-grams, in order."""
    text = text or ""
    return present(np.concatenate((hashed(as_bytes(text), ORDERS, BITS), hashed(recency(text), WORD_ORDERS, BITS, 1))), BITS)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, limit: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of min |w|^2 / 2 + bias^2 / 2 + sum of limit * hinge, by dual coordinate descent.

    rows: (buckets, values, of which the last is the constant's). y: 1 or -1.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (float(w[at] @ x[:-1]) + bias * x[-1]) - 1.0
            new = min(max(alpha[i] - gradient / float(x @ x), 0.0), limit[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[at] += step * x[:-1]
                bias += step * x[-1]
                alpha[i] = new
    return w, bias, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, blend: float = 0.5, seed: int = 1) -> Model:
    n, size = len(rows), 1 << BITS
    share = float(labels.mean()) if n else 0.5
    if n < 2 or share in (0.0, 1.0):
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    left_out, used = (order[: n // 4], order[n // 4 :]) if n >= 40 else (order, order)
    seen = np.ones((2, size))
    for i in used:
        seen[int(labels[i]), rows[i]] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    scaled = []
    for i in used:
        x = np.append(ratio[rows[i]], 1.0)
        scaled.append((rows[i], x / np.sqrt(x @ x)))
    y = np.where(labels[used] > 0, 1.0, -1.0)
    limit = np.where(labels[used] > 0, cost, cost * min(20.0, share / (1 - share)))
    w, bias, _ = descend(scaled, y, limit, size, rounds, rng)
    model = Model((1 - blend) * np.abs(w).mean() + blend * w, ratio, bias, 1.0, 0.0)
    slope, offset = _logistic(np.array([model.margin(rows[i]) for i in left_out]), labels[left_out])
    return model._replace(slope=slope, offset=offset)


def score(model: Model, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.slope * model.margin(features(text)) + model.offset, -30, 30))))


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton's method on the smoothed log loss."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = margin.std() or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-6 * c)
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0] / scale), float(c[1])


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """crc32 of doc_id as text, by folds; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded(rows: DataFrame, key: list[str], most: int, weight: str | None = None, total: int = 0) -> DataFrame:
    """About ``most`` different rows at most, chosen by a hash of the key, and about ``total`` of a weight in all."""
    n = rows.agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w")).first()
    share = min(1.0, most / max(n["n"], 1), total / max(n["w"] or 0, 1) if weight else 1.0)
    if share < 1.0:
        rows = rows.where(F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * share))
    return rows.dropDuplicates()


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality) -> the model. Held-out ids are never learned from."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    sample = bounded(usable, ["doc_id", "quality"], train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # train_rows rows at most, about
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = cut(texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(h, F.col("text"))).alias("text")))
    chosen = bounded(texts.withColumn("__n", F.coalesce(F.length("text"), F.lit(0))), ["doc_id", "quality"], train_rows, "__n", train_chars)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [features(t).astype("<i4").tobytes() for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("doc_id")), batch.column(batch.schema.names.index("quality")).cast(pa.int32()), pa.array(made, pa.binary())], names=["doc_id", "quality", "at"])

    got = chosen.drop("__n").mapInArrow(run, "doc_id bigint, quality int, at binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("at", "ascending")])
    return fit([np.frombuffer(x, "<i4") for x in got["at"].to_pylist()], np.array(got["quality"].to_pylist(), float))


def scored(docs: DataFrame, model: Model, least: float = CUT) -> DataFrame:
    """With score (0 to 1) and predicted (1 from ``least`` on)."""

    def compute(batch):
        s = np.array([score(model, t) for t in column(batch, "text")])
        return [s, (s >= least).astype("<i4")]

    return with_columns(docs, "score double, predicted int", compute)


def learned(model: Model) -> bool:
    """Whether the training rows had both classes."""
    return model.slope != 0.0


def accepted(docs: DataFrame, model: Model, least: float = CUT) -> DataFrame:
    """The documents with a score of ``least`` or more, all their columns as they are."""
    judged = with_columns(docs, "__keep boolean", lambda batch: [[score(model, t) >= least for t in column(batch, "text")]])
    return judged.where("__keep").select(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
