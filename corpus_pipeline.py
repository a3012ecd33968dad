"""A training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import langid, linedup, packing, pii, shingles
from evispark.llm.common import scratch_path, vocabulary

KEY = "example key"


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it as ``lang``; others (null, no letters, no language fits) go."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; every document stays, if need be with an empty text."""
    return counted(linedup.drop_repeated_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; a null doc_id stays."""
    return shingles.keep_first(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms."""
    return counted(pii.pseudonymise(docs, KEY), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 ids."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("near duplicates", near_duplicates), ("PII", personal), ("packing", sequences)]

# Language models, keyed permutations and packing are beyond SQL; the tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
