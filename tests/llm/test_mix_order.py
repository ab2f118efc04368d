import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_tokens_are_numbered_in_the_order_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = cp.mix_sources(spark, docs, SF)
    order = [r.doc_id for r in mixed.collect()]
    got = cp.to_tokens(spark, cp.cut(mixed), SF).select("doc_id", "place").collect()
    assert {r.doc_id: r.place for r in got} == {d: i for i, d in enumerate(order)} and len(got) == len(order)
    unmixed = cp.to_tokens(spark, cp.cut(docs), SF).select("doc_id", "place").collect()
    assert {r.doc_id: r.place for r in unmixed} != {r.doc_id: r.place for r in got}


def test_places_of_frames_without_files(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id int").repartition(3).orderBy("doc_id")
    assert sorted((r.doc_id, r.place) for r in cp.places(df).collect()) == [(i, i) for i in range(50)]
