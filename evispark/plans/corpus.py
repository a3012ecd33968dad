"""The given tables seen as passages, questions and links.

documents are passages: tenant = lang, ordinal = doc_id, fifty consecutive ids
make one source document; four consecutive ids share a page and the fourth reaches into the next.
benchmark items are questions asked of every tenant of the documents; their gold
pages are those of the passages quoting the item verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.containment import verbatim_pairs
from evispark.operators.ranking import attach_row
from evispark.session import settle

BLOCK = 65536


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    page = F.expr("cast(doc_id div 4 + 1 as int)")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("tenant"), "source",
        F.expr("concat('vol-', doc_id div 50)").alias("document"), "text", page.alias("page_number"),
        F.when(F.col("doc_id") % 4 == 3, F.array(page, page + 1)).otherwise(F.array(page)).alias("pages"),
    )


def chunk_name(tenant="tenant", doc_id="doc_id"):
    """Citable id such as EN-00042."""
    digits = F.col(doc_id).cast("string")
    return F.concat(F.upper(F.col(tenant)), F.lit("-"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))


def tenants(spark: SparkSession, sf: str) -> DataFrame:
    """One row with the languages of the documents, of which there are few however many documents."""
    return table(spark, sf, "documents").agg(F.array_sort(F.collect_set("lang")).alias("tenants"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", "text")
    asked = attach_row(b, tenants(spark, sf)).select(F.explode("tenants").alias("tenant"), "item_id", "text")
    return asked.select(F.concat_ws("-", "tenant", "item_id").alias("qid"), "tenant", "item_id", "text")


def gold_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, tenant, item_id, doc_id, page_number) of verbatim quotations."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("tenant"), "text")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    pairs = verbatim_pairs(docs, items, "item_id")
    return pairs.filter(F.col("tenant").isNotNull()).select(
        F.concat_ws("-", "tenant", "item_id").alias("qid"), "tenant", "item_id", "doc_id",
        F.expr("cast(doc_id div 4 + 1 as int)").alias("page_number"),
    )


def expected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, page) distinct gold pages.

    Gold is an input of an evaluation; here it is derived, so it is settled
    once instead of being derived again by every join that reads it.
    """
    return settle(gold_documents(spark, sf).select("qid", F.col("page_number").alias("page")).distinct())
