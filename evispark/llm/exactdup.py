"""Exact duplicates by recipes of content-defined chunks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import settle

BLANKS = r"[\x20\x09-\x0D]"
# A chunk ends before letters that a few places in a hundred show, after 512 characters at least and 4,096 at most.
CHUNK = r"(?s).{511,4095}?[aeiost](?=[bcdfg][aeio])|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def recipes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, text_sha256, chars, recipe): the ordered identifiers of the chunks.

    Texts are cut at places that their own content marks, so equal texts have
    equal recipes and long texts are from here on a short list of numbers.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_n"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"))
    cut = rows.select("doc_id", "chars", F.sha2("_n", 256).alias("text_sha256"), F.regexp_extract_all("_n", F.lit(CHUNK), F.lit(0)).alias("_chunks"))
    return cut.withColumn("recipe", F.transform("_chunks", lambda c: F.xxhash64(c)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal if they are so without blanks (space and \\t to \\r); a null
    text is empty. Of equal texts the row with most code points stays, then the
    smallest doc_id. A null doc_id sorts last; rows that repeat a doc_id are all
    kept or all dropped. No rows give no rows.

    Chunks get 64-bit digests; all distinct chunks are compared under their
    digest. In the case that one digest stands for two contents, the chunks in
    question are named by their content's SHA-256 instead.
    """
    cut = recipes(docs)
    clash = settle(
        cut.select(F.explode("_chunks").alias("chunk")).withColumn("d", F.xxhash64("chunk")).distinct().groupBy("d").count().filter("count > 1").select("d")
    )
    if clash.isEmpty():
        named = cut.withColumn("ids", F.col("recipe").cast("array<string>"))
    else:
        bad = F.array_distinct(F.collect_list("d"))
        one = clash.agg(bad.alias("_bad"))
        named = cut.join(F.broadcast(one)).withColumn("ids", F.transform("_chunks", lambda c: F.when(F.array_contains("_bad", F.xxhash64(c)), F.sha2(c, 256)).otherwise(F.xxhash64(c).cast("string"))))
    # the ordered list is compared as a whole, by its own SHA-256
    lists = settle(named.select("doc_id", "chars", "text_sha256", F.sha2(F.array_join("ids", ","), 256).alias("list"), F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("_s")))
    part = lists.groupBy("list", "_s").agg(F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("k"), (-F.coalesce("doc_id", F.lit(0))).alias("m"))).alias("b"), F.count(F.lit(1)).alias("n"))
    groups = part.groupBy("list").agg(F.max("b").alias("b"), F.sum("n").alias("group_size"))
    keep = F.when(F.col("b.k"), -F.col("b.m")).alias("keep_id")
    wide = part.select("list", "_s").join(groups.select("list", keep, "group_size"), "list")
    out = lists.join(wide, ["list", "_s"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
