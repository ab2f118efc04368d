"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents. A stage works on all that its predecessor
kept; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.llm import mixing, quality, sentencepiece_codec, simhash, suffix_dedup
from lociq.llm.common import cut, give_back


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go. It learns from the labelled ones of ``docs``.

    Where these don't have both labels there is nothing to tell documents apart by, and none is rejected.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    give_back(spark)
    return quality.accepted(docs, model) if quality.learned(model) else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    give_back(spark)
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that occur elsewhere are cut out of the texts; n_chars follows."""
    give_back(spark)
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the files hold it from the first row to the last."""
    give_back(spark)
    return mixing.in_order(docs, mixing.TARGETS)


def places(docs: DataFrame) -> DataFrame:
    """docs with place: the number, from 0, of each row in the order of the files that hold them."""
    if not docs.inputFiles():
        docs = cut(docs)
    rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    name = F.element_at(F.split("__file", "/"), -1)
    before = F.sum("__n").over(W.orderBy(name, "__file").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    files = files.select(F.col("__file").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    placed = rows.join(F.broadcast(files), F.col("__file") == F.col("__of"))
    return placed.select(*docs.columns, (F.col("__before") + F.col("__row")).alias("place"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, begins, ends, n_tokens, decoded_sha256, place: the document's place in the mix, by which a
    trainer reads the tokens."""
    import public_tokenizers

    give_back(spark)
    model = sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.tokenised(places(docs).select("doc_id", "source", "text", "place"), model).drop("text")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Trained models, components and merged transforms: not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
