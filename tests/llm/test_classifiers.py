import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.llm import language_id as li
from lociq.llm import quality as qu

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("sf", "least"), [("0.01", 0.9), ("0.1", 0.98)])  # some 300 and 3,000 training rows
def test_quality_on_held_out_rows(spark, sf, least):
    sf = f"/root/testdata/sf{sf}"
    got = {r.doc_id: r for r in qu.op4_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    out = [r for r in labels if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in out]) > least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality_defined_cases(spark, tmp_path):
    texts = [None, "", "a", "Good words in a row, no doubt.", "BAD!! BAD!! BAD!!", "x " * 30_000, "Good words in a row, no doubt."]
    docs = spark.createDataFrame([(i if i else None, t, 0.5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    none.write.parquet(f"{tmp_path}/a/labels.parquet")
    rows = qu.op4_quality_classifier(spark, f"{tmp_path}/a").collect()
    assert len(rows) == 14 and all(abs(r.score - 0.5) < 1e-9 for r in rows)
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0), (4, 1), (5, 0), (None, 1), (6, None), (3, 7)], "doc_id long, quality int")
    model = qu.train(docs, labels)
    out = qu.scored(docs, model)
    assert out.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in out.collect())
    assert qu.scored(docs.limit(0), model).collect() == []


def test_bounded(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < qu.bounded(df, ["doc_id"], 1000).count() < 1200
    same = df.select(F.lit(5).cast("long").alias("doc_id"))
    assert qu.bounded(same, ["doc_id"], 1000).count() <= 2000
    assert 300 < qu.bounded(df.withColumn("n", F.lit(10)), ["doc_id"], 1000, "n", 4000).count() < 500


def test_language_on_held_out_rows(spark):
    got = li.op6_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_defined_cases(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", None), (3, "12 34!", "en"), (None, "some words", "en"), (4, "é" * 20_000, "fr"), (5, "plain words", "en"), (5, "plain words", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = li.op6_language_id(spark, f"{tmp_path}/a").collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [r.lang_pred for r in li.op6_language_id(spark, f"{tmp_path}/b").collect()] == ["und"]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/c/documents.parquet")
    assert li.op6_language_id(spark, f"{tmp_path}/c").collect() == []


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3)) + np.eye(3)[labels] * 1.0
    assert 4 < li.temperature(logits * 5, labels) / li.temperature(logits, labels) < 6


def test_descent_reaches_the_optimum():
    """The conditions of an optimum, which are its proof, and the primal value beside random neighbours."""
    rng = np.random.default_rng(2)
    size, n = 12, 60
    rows = [(at := np.sort(rng.choice(size, rng.integers(1, 6), replace=False)), rng.normal(size=len(at) + 1)) for _ in range(n)]
    y, limit = rng.choice([-1.0, 1.0], n), rng.uniform(0.1, 2, n)
    w, bias, alpha = qu.descend(rows, y, limit, size, 3000, rng)
    dense = np.zeros((n, size + 1))
    for i, (at, x) in enumerate(rows):
        dense[i, at], dense[i, -1] = x[:-1], x[-1]
    u = np.append(w, bias)
    assert np.allclose(u, (alpha * y) @ dense)
    gradient = y * (dense @ u) - 1
    assert (gradient[alpha <= 1e-9] > -1e-4).all() and (gradient[alpha >= limit - 1e-9] < 1e-4).all()
    inner = (alpha > 1e-9) & (alpha < limit - 1e-9)
    assert inner.any() and np.abs(gradient[inner]).max() < 1e-4
    primal = lambda v: v @ v / 2 + (limit * np.maximum(0, 1 - y * (dense @ v))).sum()
    assert all(primal(u) <= primal(u + rng.normal(scale=0.05, size=len(u))) + 1e-6 for _ in range(200))


def test_scores_are_those_of_the_fitted_model():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc d" if i % 2 else "xyz d"), 30)) for i in range(80)]
    model = qu.fit([qu.features(t) for t in texts], np.arange(80) % 2.0)
    for t in ["", None, "abc abc", texts[0]]:
        x = np.zeros(len(model.weight) + 1)
        x[qu.features(t)], x[-1] = model.ratio[qu.features(t)], 1.0
        margin = np.append(model.weight, model.bias) @ (x / np.linalg.norm(x))
        assert abs(qu.score(model, t) - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-9


def test_leader_against_dense_version(monkeypatch):
    monkeypatch.setattr(li, "BITS", 5)
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(32, 6, replace=False)), rng.normal(size=6)) for _ in range(50)]
    labels = rng.integers(0, 3, 50)
    step, l1, l2 = 0.5, 1.0, 0.05
    z, n = np.zeros((3, 32)), np.zeros((3, 32))
    order = np.random.default_rng(1)

    def weights():
        out = np.zeros((3, 32))
        for c in range(3):
            for j in range(32):
                if abs(z[c, j]) > l1:
                    out[c, j] = -(z[c, j] - np.sign(z[c, j]) * l1) / ((1 + n[c, j] ** 0.5) / step + l2)
        return out

    for _ in range(3):
        for i in order.permutation(50):
            x = np.zeros(32)
            x[rows[i][0]] = rows[i][1]
            w = weights()
            p = np.exp(w @ x) / np.exp(w @ x).sum()
            for c in range(3):
                g = (p[c] - (labels[i] == c)) * x
                sigma = (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / step
                z[c] += g - sigma * w[c]
                n[c] += g * g
    assert np.allclose(li.ftrl(rows, labels, 3, l1=l1), weights()) and (weights() == 0).any()


def test_temperature_against_a_grid():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 4, 500)
    logits = rng.normal(size=(500, 4)) * 3 + np.eye(4)[labels]

    def loss(t):
        s = logits / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(500), labels]).mean())

    assert abs(li.temperature(logits, labels) - min(np.exp(np.linspace(-3.9, 2.9, 4000)), key=loss)) < 0.01


def test_languages_of_other_scripts_and_clashing_columns(spark):
    texts = {"ru": "что это и как они были", "uk": "що це і як вони були", "el": "και το ήταν αυτό που", "ja": "これは日本語の文です", "zh": "这是一个中文句子吗"}
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.permutation(list(texts[k]))) + texts[k], k, "x") for i, k in enumerate(list(texts) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = li.train(docs)
    out = li.predicted(docs.drop("lang").withColumn("lang_pred", F.lit(0)), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in out.collect()]) > 0.97
    assert li.buckets("日本").size == 3 and li.buckets(None).size == 0
