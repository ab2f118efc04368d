import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lociq.llm import simhash as sh


def brute_print(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def brute_components(rows, radius=4):
    """rows: (doc_id, print)"""
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, p, least[find(i)]) for i, (d, p) in enumerate(rows)]


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_print(text)


def test_bit_sliced_comparison():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints, groups = [], []
    for g, size in enumerate([1, 2, 63, 64, 65, 200, 3]):
        for _ in range(size):
            p = rng.choice(base)
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
            groups.append(g)
    for radius in (0, 1, 3, 4, 7):
        a, b = sh.within(np.array(groups), np.array(prints, "<u8"), radius)
        want = {(i, j) for j in range(len(prints)) for i in range(j) if groups[i] == groups[j] and (prints[i] ^ prints[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 16)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for d in range(600):
        p = base[0] if d % 3 == 0 else rng.choice(base)
        for _ in range(rng.randrange(6)):
            p ^= 1 << rng.randrange(64)
        rows.append((d * 7 % 601, p))
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in rows]
    got = sh.near_components(spark.createDataFrame(signed, "doc_id long, fingerprint long")).collect()
    assert sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == sorted(brute_components(rows))
    for m in (4, 40, 10**6, 10**8):
        assert all(x.bit_count() <= 64 for x in sh.block_masks(4, m))


def test_query_with_nulls_empty_ties(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, None, 1), (2, "", 1), (7, " \t\n", 1), (3, "a b", 1), (3, "a b", 1), (9, "A B", 2), (10, long, 3), (11, long + " end", 3), (12, long.upper(), None)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in sh.op5_simhash(spark, str(tmp_path)).collect())
    assert got == sorted(brute_components([(d, brute_print(t)) for d, t, _ in rows]))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert sh.op5_simhash(spark, f"{tmp_path}/e").collect() == []
