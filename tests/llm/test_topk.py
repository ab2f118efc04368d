import math
import random

from pyspark.sql import functions as F

from lociq.llm import topk_search as tk


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a)[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in tk.op7_topk_search(spark, str(path)).collect())


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "ROWS", 64)
    rng = random.Random(1)
    one = [rng.gauss(0, 0.1) for _ in range(10)]
    import numpy as np

    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(one if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(10)])) for i in range(300)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [float("inf"), 0.0]), (None, f32(one)), (20, f32(one)), (20, f32(one)), (304, []), (305, [0.5, -0.25])]
    assert run(spark, rows, tmp_path / "a") == brute(rows)


def test_few_and_large_values(spark, tmp_path):
    rows = [(0, [3.0, -1e6]), (1, [1e6, 1e6]), (2, [-2.0, 5.0]), (20, [0.0, 0.0])]
    assert run(spark, rows, tmp_path / "a") == brute(rows)
    assert run(spark, [(0, [1.0])], tmp_path / "b") == []
    assert run(spark, [], tmp_path / "c") == []
    big = [(0, [2.0**40, 1.0]), (1, [2.0**40, 2.0]), (2, [-(2.0**40), 2.0])]
    got = run(spark, big, tmp_path / "d")
    assert [(r, v) for _, r, v, _ in got] == [(1, 1), (2, 2)] and got[0][3] == (1 << 63) - 1
