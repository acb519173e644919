"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

Rows without a doc_id pass the stages that decide by doc_id; null texts pass all and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import _spark, ngram_join, piece_codec, registry, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.learn(docs.select("doc_id", "text"), labels, registry.remainder(5) != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; rows equal in id and text are one."""
    return ngram_join.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller doc_id holds; a document of which nothing is left goes."""
    return suffix_dedup.remove(docs, suffix_dedup.passages(docs.select("doc_id", "text"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    found = registry.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text_hash").where("contaminated")
    # by id and text: of rows that repeat an id, only those go that hold the passages
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(found, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, and digests of them and of what they decode to."""
    done = piece_codec.encode(docs.select("doc_id", "text"), registry.tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return done.select("doc_id", "ids", *registry.piece_columns()).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither the learned classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = _spark.fresh_path(spark, name)
        # what a stage wrote on its way goes, and its input when its output is there
        with _spark.scratch(spark):
            docs = _spark.written(stage(spark, docs, sf_dir), path)
        if last:
            _spark.drop_path(spark, last)
        last = path
    return docs
