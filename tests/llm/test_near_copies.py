import random

import numpy as np
from lociq.llm import near_copies as nc
from lociq.llm import simhash


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    """rows: (doc_id, text); the least doc_id of each component."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and near(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted({min(d for (d, _), r in zip(rows, root, strict=True) if r == c) for c in root})


def planted(rng):
    """Texts of 1 to 600 words with edited copies around the bound, one large group of copies, one common passage."""
    words = [f"w{i}" for i in range(500)]
    common = [rng.choice(words) for _ in range(30)]
    texts = []
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 31, 33, 40, 60, 70, 130, 200, 300, 600]:
        base = [rng.choice(words) for _ in range(size)]
        texts.append(base)
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(1, 3 + size // 30)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            texts.append(t + [rng.choice(words)] * rng.randrange(1 + size // 6))
    base = [rng.choice(words) for _ in range(150)]
    texts += [[*base[: 20 * i % 150], f"x{i}", *base[20 * i % 150 :]] for i in range(60)]
    texts += [[rng.choice(words) for _ in range(40)] + common for _ in range(40)]
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]


def test_keys_of_near_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        x = int(rng.integers(4, 200))
        pool = rng.integers(0, 2**64, 2 * x + 4, dtype=np.uint64)
        extra = int(rng.integers(0, x // 4 + 1))  # of the other set alone
        gone = int(rng.integers(0, x // 5 + 1))
        a, b = np.unique(pool[:x]), np.unique(pool[gone : x + extra])
        if near(set(a.tolist()), set(b.tolist())) and (len(a) != len(b) or (a != b).any()):
            assert np.intersect1d(nc.keys(a), nc.keys(b)).size
            common = np.intersect1d(nc.all_parts(a), nc.all_parts(b))
            last = np.unique(rng.choice(common, min(len(common), int(rng.integers(1, 20))), replace=False))
            assert np.intersect1d(nc.keys(a, last), nc.keys(b, last)).size


def test_bit_sliced_distances():
    rng = np.random.default_rng(7)
    for n in (0, 1, 63, 64, 200):
        x = rng.integers(0, 2**64, (n, 8), dtype=np.uint64) & rng.integers(0, 2**64, (n, 8), dtype=np.uint64)
        radius = rng.integers(0, 300, n)
        far = np.array([sum(int(w).bit_count() for w in r) for r in x.tolist()])
        assert simhash.within_radius(x, radius).tolist() == (far <= radius).tolist()
    assert simhash.within_radius(np.full((70, 8), 2**64 - 1, np.uint64), np.full(70, 10_000)).all()


def test_stage_against_brute_force(spark):
    rows = planted(random.Random(4))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == brute_kept(rows)


def test_near_copies_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == brute_kept(rows)


def test_large_groups_of_near_copies_take_rounds(spark, monkeypatch):
    """Chains and clouds of copies, many of which are near to others but not to the least of a key."""
    monkeypatch.setattr(nc, "PARTNERS", 1)
    monkeypatch.setattr(nc, "CHUNK", 16)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    for i in range(40):
        rows.append((100 + i, " ".join([*base[:30], *[rng.choice(words) for _ in range(25)]])))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == brute_kept(rows)


def test_rounds_that_find_nothing_take_no_groups_again(spark, monkeypatch):
    """Texts that share parts but aren't near: one look for groups, and what the driver can spare is given back in each round."""
    calls, given = [], []
    real, back = nc.components, nc.give_back
    monkeypatch.setattr(nc, "components", lambda edges: calls.append(1) or real(edges))
    monkeypatch.setattr(nc, "give_back", lambda session: given.append(1) or back(session))
    monkeypatch.setattr(nc, "PARTNERS", 1)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join([*base, *[rng.choice(words) for _ in range(25)]])) for i in range(30)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == brute_kept(rows) == list(range(30))
    assert len(calls) == 1 and given
