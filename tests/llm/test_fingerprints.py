import hashlib
import random

import numpy as np
import xxhash

from lociq.llm import ibf_fingerprint as fp


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next)"""
    h = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1]), r[1] is not None, r[1] or ""))
    out = []

    def alike(a, b):
        from collections import Counter

        a, b = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
        return (a & b).total() / (a | b).total() if a | b else 1.0

    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(t, e), 9), round(alike(t, n), 9)))
    return sorted(out, key=str)


def got(spark, rows, path):
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    res = fp.op9_document_fingerprints(spark, str(path)).collect()
    assert all(r.fingerprint == r2.fingerprint for r in res for r2 in res if r.doc_id == r2.doc_id and r.n_chars == r2.n_chars and r.edited_sha256 == r2.edited_sha256)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in res), key=str)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    line = [" ".join(rng.choice("abcde") * rng.randrange(1, 9) for _ in range(9)) for _ in range(300)]
    rows = [(rng.randrange(10**6), "\n".join(rng.choice(line) + "." for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [(5, "é🙂. ß!\n" * 300), (6, None), (7, ""), (8, "x"), (9, "y" * 20_000), (9, "y" * 20_000), (9, None), (None, "no id. at all"), (None, None)]
    assert got(spark, rows, tmp_path / "a") == brute(rows)


def test_small_tables(spark, tmp_path):
    for i, rows in enumerate([[], [(1, "one. two. three. four.")], [(None, None)], [(3, "a. b"), (3, "a. b")]]):
        assert got(spark, rows, tmp_path / str(i)) == brute(rows)


def test_peeling_retries_larger():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 1 << 63, n, np.uint64) for n in (0, 1, 5, 100, 3000)]
    b = [np.concatenate((x[: len(x) // 2], rng.integers(0, 1 << 63, len(x) // 3, np.uint64))) for x in a]
    want = [len(set(x.tolist()) & set(y.tolist())) / max(1, len(set(x.tolist()) | set(y.tolist()))) if len(x) or len(y) else 1.0 for x, y in zip(a, b)]
    assert np.allclose(fp.likeness(a, b), want)


def test_repeated_and_null_ids_over_many_groups(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdef") * 3 + "." for _ in range(rng.randrange(30)))
    rows = [(7, text()) for _ in range(150)] + [(None, text()) for _ in range(100)] + [(rng.randrange(20), text()) for _ in range(150)] + [(9, "same. rows.")] * 60
    assert got(spark, rows, tmp_path) == brute(rows)
    groups = fp.Groups([1, 5, 5, 5, 9], 2)
    h = np.array([-(1 << 63), 0, (1 << 63) - 1])
    assert groups.of(np.ones(3, bool), np.array([5, 5, 5]), h).tolist() == [4, 3, 2]
    assert groups.of(np.ones(6, bool), np.array([0, 1, 4, 6, 9, 10]), np.zeros(6, np.int64)).tolist() == [0, 1, 1, 4, 5, 5]
    assert groups.of(np.zeros(3, bool), np.zeros(3, np.int64), h).tolist() == [-1, -2, -2]


def test_counts_beyond_two_bytes_and_differences(spark):
    keys = np.arange(300_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = fp.sketches([keys])
    cells = np.frombuffer(bytes.fromhex(s.hex()[0]), fp.CELL)
    assert cells["count"].sum() == 3 * len(keys) and cells["count"].min() > 32_767
    assert fp.likeness([keys], [keys[:-5]]).tolist() == [(len(keys) - 5) / len(keys)]
    stuck = [np.array([5, 5, 5, 9], np.uint64)], [np.array([5, 7], np.uint64)]  # equal digests can't be peeled
    assert sorted(zip(*(x.tolist() for x in fp.differing(*stuck)), strict=True)) == [(0, 5, 1), (0, 5, 1), (0, 7, -1), (0, 9, 1)]
    rows = [("one. two. three.", "one. 2. three."), (None, "a."), ("", "")]
    out = fp.version_differences(spark.createDataFrame(rows, "before string, after string")).collect()
    assert [(len(r.removed), len(r.added)) for r in out] == [(1, 1), (0, 1), (0, 0)] and out[0].removed[0] == int(np.array([fp.digests("two.")[0]], "<u8").view("<i8")[0])
