import random
from collections import Counter

import numpy as np

from lociq.llm import bwt_merge as bm


def brute_starts(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out, at = [], 0
    for t in texts:
        out += [at + i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        at += len(t) + 1
    return out


def test_merged_transforms_against_brute_force():
    rng = random.Random(1)
    for length in (1, 2, 7, 20):
        for alphabet in (b"ab", bytes(range(256)), b"\x00\xff", b"a"):
            words = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(6)]
            texts = [b"".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(25)] + [b"", b"a" * 300]
            for shard in (50, 1 << 18):
                assert bm.repeated_starts(texts, length, shard).tolist() == brute_starts(texts, length), (length, alphabet)
    assert bm.repeated_starts([], 5).tolist() == []


def test_shard_order_is_that_of_suffixes():
    rng = random.Random(2)
    s = np.array([rng.choice([0, 1, 2, 300 % 257]) for _ in range(400)], np.uint16)
    order, bwt, step = bm.shard_bwt(s, 1 << 20)
    assert order.tolist() == sorted(range(400), key=lambda i: [*s[i:].tolist(), -1])
    assert all(order[step[r]] == order[r] - 1 and bwt[r] == s[order[r] - 1] for r in range(400) if order[r])


def test_covered():
    assert bm.covered(np.array([3, 4, 9, 20]), 5).tolist() == [[3, 14], [20, 25]]
    assert bm.covered(np.array([]), 5).tolist() == []


def brute_documents(rows, length):
    import hashlib

    texts = [(t or "").encode() for _, t in rows]
    starts = brute_starts(texts, length)
    out, at = [], 0
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in starts:
            if at <= s < at + len(t):
                gone[s - at : s - at + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
        at += len(t) + 1
    return sorted(out, key=str)


def sample(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé🙂 ") for _ in range(rng.randrange(1, 60)))
    shared = [word() * 3 for _ in range(8)]
    rows = [(i, "".join(rng.choice([word(), rng.choice(shared)]) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(rng.randrange(200), t[: rng.randrange(1, len(t) + 2)] + "x" + t[5:]) for _, t in rows[:20] if t]
    return rows + [(1, None), (2, ""), (3, "a" * 5 * length), (4, "same text " * 40), (4, "same text " * 40), (None, "same text " * 40), (5, "q" * length), (6, "ab" * length + "c")]


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    from lociq.llm import suffix_dedup as sd

    for name, length, group in (("a", 40, 1 << 20), ("b", 40, 200), ("c", 33, 1 << 20)):
        monkeypatch.setattr(sd, "GROUP_BYTES", group)
        rows = sample(5, length)
        spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted((tuple(r) for r in sd.op3_suffix_dedup(spark, f"{tmp_path}/{name}", length).collect()), key=str)
        assert got == brute_documents(rows, length)


def test_contexts_hold_all_windows_once(monkeypatch):
    from lociq.llm import suffix_dedup as sd

    rng = random.Random(9)
    word = lambda n: bytes(rng.choice(b"ab cd") for _ in range(n))
    texts = [word(700), b"a" * 900, b"abc" * 300, (word(90) + word(30)) * 9, word(50) + b"-" * 500 + word(400) + b"-" * 300, b"".join(word(66) + bytes([i]) for i in range(9)) + b"xyz" * 120]
    for piece in (1 << 20, 97):
        monkeypatch.setattr(sd, "PIECE", piece)
        for t in texts:
            seen, anchors = [], {}
            for anchor, begin, size, end, times in zip(*(x.tolist() for x in sd.contexts(t)), strict=True):
                step = size - 199
                assert end - begin == size + (times - 1) * step
                for k in range(times):
                    assert t[begin + k * step :][:size] == t[begin : begin + size]
                    seen += range(begin + k * step, begin + (k + 1) * step)
                for i in range(step):  # equal windows have equal anchors
                    assert anchors.setdefault(t[begin + i : begin + i + 200], anchor) == anchor
            assert seen == list(range(len(t) - 199))
    assert max(len(x) for x in sd.contexts(b"a" * 50_000)) <= 50_000 // 97 + 2


def test_large_groups_are_split(spark, tmp_path, monkeypatch):
    """Many different contexts around one passage, long texts in pieces, runs of one letter of any length."""
    from lociq.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "GROUP_BYTES", 1000)
    monkeypatch.setattr(sd, "PIECE", 500)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(n) for n in (70, 150, 199, 200, 260, 420)]
    rows = [(i, text(rng.randrange(300)) + rng.choice(passages) + text(rng.randrange(300))) for i in range(150)]
    rows += [(200 + i, text(20) + "-" * rng.randrange(150, 800) + text(rng.randrange(3))) for i in range(30)]
    rows += [(300 + i, passages[5][: 30 * i] + "x" + passages[5][20 * i :] + "y" * (i % 3)) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in sd.op3_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_documents(rows, 200)


def test_very_long_texts(spark):
    from lociq.llm import suffix_dedup as sd

    long = "q" * 20_000_000
    rows = [(1, long), (2, "a" * 150 + "q" * 250 + "b" * 120), (3, "".join(chr(97 + (i * i) % 23) + str(i) for i in range(30_000)))]
    kept = {r.doc_id: r.text for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: "", 2: "a" * 150 + "b" * 120, 3: rows[2][1]}


def test_empty_table_and_cleaned_texts(spark, tmp_path):
    from lociq.llm import suffix_dedup as sd

    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sd.op3_suffix_dedup(spark, str(tmp_path)).collect() == []
    passage = "é passage that is shared, " * 10
    rows = [(1, "first " + passage + "one"), (2, "second " + passage + "two"), (3, None), (4, "short")]
    docs = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, kept int, d1 int")
    got = {r.doc_id: r.text for r in sd.remove_repeats(docs).collect()}
    assert got == {1: "firstone", 2: "secondtwo", 3: None, 4: "short"}
