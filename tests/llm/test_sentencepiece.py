import hashlib

import public_tokenizers
import pytest
import sentencepiece

from lociq.llm import sentencepiece_codec as sc

MODEL = sc.read_model(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "Hello, world.\n\nTabs\tand\x00nul", "▁literal ▁▁ mark▁", "naïve café Übergröße", "日本語 テキスト🙂🙂 x",
    "<s> </s> <unk> <0x0A>", "\r\n \r\n", "x" * 3000, "ab " * 2000, "éê" * 500 + "  🙂", "é ‍ ﻿bom", "    four   three  two one",
]


def test_encodes_and_decodes_as_the_library():
    e, lib = sc.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for t in TEXTS:
        ids, begins, ends = e.encode(t)
        assert ids.tolist() == lib.encode(t), t
        assert e.decoded(ids.tolist()).decode() == lib.decode(lib.encode(t)), t
        data = t.encode()
        assert [(b, n) for b, n in zip(begins, ends)] == [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces], t
        assert b"".join(data[b:n] for b, n in zip(begins, ends)) == data


def test_normalises_through_a_compiled_map():
    """A model with the map of a built-in rule, against the library's own normaliser and spans."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    rule = pb.ModelProto()
    rule.ParseFromString(normalizer.serialized_model_proto())
    for squeeze in (False, True):
        proto.normalizer_spec.CopyFrom(rule.normalizer_spec)
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        proto.normalizer_spec.add_dummy_prefix = True
        proto.normalizer_spec.escape_whitespaces = True
        raw = proto.SerializeToString()
        e, lib = sc.Encoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        assert e.map.units
        for t in [*TEXTS, "ﬁne ①② ｆｕｌｌ　width", "㍿ Å Å"]:
            ids, begins, ends = e.encode(t)
            assert ids.tolist() == lib.encode(t), (squeeze, t)
            spans = [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
            assert [n for n in ends] == [n for _, n in spans], (squeeze, t)


def without_bytes():
    """The model without byte fallback: what its pieces don't spell is unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == p.BYTE:
            p.type = p.UNUSED
    return proto.SerializeToString()


def test_decodes_any_ids_as_the_library():
    import random

    rng = random.Random(6)
    for raw in (MODEL, without_bytes()):
        e, lib = sc.Encoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        special = [i for i in range(lib.get_piece_size()) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)]
        some = [*special, lib.piece_to_id("▁"), lib.piece_to_id("▁the"), *rng.sample(range(lib.get_piece_size()), 200)]
        for _ in range(2000):
            ids = [rng.choice(some) for _ in range(rng.randrange(7))]
            assert e.decoded(ids).decode() == lib.decode(ids), ids
        for t in [*TEXTS, "hello 漢字 fox"]:
            assert e.encode(t)[0].tolist() == lib.encode(t), t
            assert e.decoded(lib.encode(t)).decode() == lib.decode(lib.encode(t)), t


def test_query(spark, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(99, None, None), (0, "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sc.op1_sentencepiece(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, len(lib.encode(t or "")), sha(",".join(map(str, lib.encode(t or "")))), sha(lib.decode(lib.encode(t or "")))) for i, t, _ in rows)
    assert got == want


def test_operators_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "one two", 5), (2, None, 6)], "ids long, text string, more long")
    out = sc.decode(sc.encode(df, MODEL), MODEL).orderBy("more").collect()
    assert out[0].decoded == "one two" and out[0].ends[-1] == 7 and out[1].ids == [] and out[1].decoded == ""
    assert sc.encode(df.limit(0), MODEL).collect() == []
