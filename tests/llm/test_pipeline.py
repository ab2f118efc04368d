import zlib

import corpus_pipeline as cp
import public_tokenizers
import sentencepiece
from lociq.llm import mixing, quality, simhash
from tests.llm.test_mixing import slots_of
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_repeats import brute_documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = cp.cut(cp.keep_quality(spark, docs, SF))
    want = {d for d, r in rows.items() if quality.score(model, r.text) >= 0.7}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want
    single = cp.cut(cp.drop_near_duplicates(spark, kept, SF))
    assert sorted(r.doc_id for r in single.collect()) == brute_kept([(d, rows[d].text) for d in want]) and single.columns == columns
    cleaned = cp.cut(cp.drop_repeated_passages(spark, single, SF))
    got = {r.doc_id: r for r in cleaned.collect()}
    removed = {d: n for d, _, n, _, _ in brute_documents([(r.doc_id, r.text) for r in single.collect()], 200)}
    assert cleaned.columns == columns and cleaned.dtypes == docs.dtypes and set(got) == set(removed)
    for d, n in removed.items():  # whole characters only: up to 3 bytes less at either end of a span
        assert 0 <= len(got[d].text.encode()) - (len(rows[d].text.encode()) - n) <= 6 * (n > 0) * 20
        assert n or got[d].text == rows[d].text
        assert got[d].n_chars == len(got[d].text)
    mixed = cp.mix_sources(spark, cleaned, SF)
    order = [r.doc_id for r in mixed.collect()]
    sources = sorted({r.source for r in got.values()})
    slots = {b: t for t, b in enumerate(slots_of({s: mixing.TARGETS.get(s, 1) for s in sources}, 4000))}
    place = {}
    for s in sources:
        for i, d in enumerate(sorted(d for d, r in got.items() if r.source == s)):
            place[d] = (slots[s, i // mixing.BLOCK_ROWS], i % mixing.BLOCK_ROWS)
    assert order == sorted(place, key=place.get) and mixed.columns == columns
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = cp.to_tokens(spark, cp.cut(mixed), SF).collect()
    assert {r.doc_id: r.ids for r in last} == {d: lib.encode(r.text) for d, r in got.items()}
    whole = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in cp.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in last}


def test_empty_null_and_repeated_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "words " * 400, "en", "a", 5), (2, "words " * 400, "en", "a", 5), (None, "x y z", None, None, 3)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = cp.run(spark, f"{tmp_path}/{name}").collect()  # without labels none is rejected
        assert sorted((r.doc_id, r.n_tokens > 0) for r in got if r.doc_id) == ([(1, False), (2, False)] if rows else [])
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, None), (2, "words " * 400), (None, "x y z")], key=str)
