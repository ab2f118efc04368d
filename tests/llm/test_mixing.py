import random
from collections import Counter

import pytest

from lociq.llm import mixing as mx


def slots_of(weights, length):
    """Brute force: an earliest-deadline-first run over single blocks, without a period."""
    total = sum(weights.values())
    done, out = Counter(), []
    for t in range(length):
        ready = [(-(-(done[s] + 1) * total // w), s) for s, w in weights.items() if done[s] * total // w <= t]
        _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_period_keeps_every_prefix_within_a_block():
    rng = random.Random(1)
    for _ in range(40):
        weights = {f"s{i:02}": rng.randrange(1, 40) for i in range(rng.randrange(1, 12))}
        table = mx.period(weights)
        total, had = sum(weights.values()), Counter()
        assert all(r <= t < d for _, _, r, d, t in table)
        for s, i, _, _, t in sorted(table, key=lambda x: x[4]):
            assert had[s] == i
            had[s] += 1
            assert all(abs(had[x] - (t + 1) * w / total) < 1 for x, w in weights.items())
    with pytest.raises(ValueError):
        mx.period({"a": 0})


def test_long_periods_are_tables(spark, monkeypatch):
    """A period beyond the bound of a broadcast, of which few slots are needed, gives the same places."""
    rows = [(i, "abc"[i % 3], "t") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for weights in ({"a": 7, "b": 5, "c": 3}, {"a": 400_003, "b": 300_001, "c": 299_999}):
        shown = []
        for most in (1_000_000_000, 4):
            monkeypatch.setattr(mx, "MAX_PERIOD", most if sum(weights.values()) < 100 else 4)
            shown.append(sorted(tuple(r) for r in mx.mix(docs, weights, block_rows=2).collect()))
        slots = {b: t for t, b in enumerate(slots_of(weights, 120))}
        assert shown[0] == shown[1] and all(slot == slots[s, block] for _, s, _, block, _, _, slot, _, _ in shown[0])


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 3 % 1009, rng.choice(["a", "a", "a", "b", "c", None]), f"t{i}", 1) for i in range(1000)]
    weights = {"a": 2, "b": 3, None: 1, "unused": 50}
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, source string, text string, slot int"), weights, default=4, block_rows=8).collect()
    used = {"a": 2, "b": 3, "\0": 1, "c": 4}
    slots = {b: t for t, b in enumerate(slots_of(used, 5000))}
    want = {}
    for s in ("a", "b", "c", None):
        for n, d in enumerate(sorted(r[0] for r in rows if r[1] == s)):
            want[d] = (n // 8, n % 8, slots["\0" if s is None else s, n // 8])
    assert {r.doc_id: (r.block, r.place, r.slot) for r in got} == want and len(got) == 1000
    assert all(r.release <= r.slot < r.deadline for r in got)
    taken = Counter(r.slot for r in got if r.on_target)
    assert sorted(taken) == list(range(len(taken))) and min(Counter(r.slot for r in got).values()) > 0


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a", f"x{i % 7}") for i in range(300)] + [(5, "a", "same")] * 50 + [(6, None, None), (7, "b", "")]
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {}, block_rows=4).collect()
    assert len(got) == 352 and sorted((r.block, r.place) for r in got if r.source == "a") == [(i // 4, i % 4) for i in range(350)]
    assert mx.mix(spark.createDataFrame([], "doc_id long, source string, text string"), {}).collect() == []
    assert [r.doc_id for r in mx.in_order(spark.createDataFrame([(i, "ab"[i % 2], "") for i in range(8)], "doc_id long, source string, text string"), {}, block_rows=1).collect()] == list(range(8))
