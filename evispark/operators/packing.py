"""Packing ranked passages into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text
from evispark.functions.arrays import let


def context_blocks(hits: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Adds block (header, newline, text) and its token count."""
    block = F.concat(text.context_header(F.col(chunk_id), F.col("page_number")), F.lit("\n"), F.col("text"))
    return hits.withColumn("block", block).withColumn("tokens", text.token_count(F.col("block")))


def pack_prefix(hits: DataFrame, budget: int = 2200, keys=("qid",)) -> DataFrame:
    """Stop at the first overflow, but always keep rank 1.

    The running sum never falls, so a filter on it is the stopping rule.
    Groups hold one question's ranked hits.
    """
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("running_tokens", F.sum("tokens").over(w)).filter(
        (F.col("rank") == 1) | (F.col("running_tokens") <= budget)
    )


def pack_skip(hits: DataFrame, budget: int = 2200, keys=("qid",)) -> DataFrame:
    """Whole units in rank order, skipping those that do not fit.

    Order-dependent, hence a fold over the question's ranked units.
    """
    rest = [c for c in hits.columns if c not in (*keys, "rank", "tokens")]
    units = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "tokens", *rest))).alias("_u"))
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<int>").alias("taken"))
    fold = F.aggregate(
        "_u", start,
        lambda s, u: F.when(
            (s["left"] > 0) & (u["tokens"] <= s["left"]),
            F.struct(
                (s["left"] - u["tokens"]).cast("bigint").alias("left"),
                F.concat(s["taken"], F.array(u["rank"].cast("int"))).alias("taken"),
            ),
        ).otherwise(s),
    )
    kept = let(fold["taken"], lambda t: F.filter("_u", lambda u: F.array_contains(t, u["rank"])))
    return units.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.*").select(*hits.columns)


def context_text(packed: DataFrame, keys=("qid",)) -> DataFrame:
    """One row a question: joined blocks and the ids in them."""
    rows = packed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "block", "chunk_id"))).alias("_b"))
    return rows.select(
        *keys, F.array_join("_b.block", "\n\n").alias("context"), F.col("_b.chunk_id").alias("supplied")
    )


def redundancy(packed: DataFrame, keys=("qid",)) -> DataFrame:
    """Share of tokens in units whose pages were all seen at better ranks."""
    pages = packed.select(*keys, "rank", "tokens", F.explode_outer("pages").alias("page"))
    first = Window.partitionBy(*keys, "page")
    seen = pages.withColumn("_first", F.min("rank").over(first))
    unit = seen.groupBy(*keys, "rank").agg(
        F.max("tokens").alias("tokens"),
        F.min(F.col("page").isNotNull() & (F.col("_first") < F.col("rank"))).alias("duplicate"),
    )
    total = F.sum("tokens")
    share = F.sum(F.when(F.col("duplicate"), F.col("tokens")).otherwise(0)) / total
    return unit.groupBy(*keys).agg(F.when(total > 0, share).otherwise(F.lit(0.0)).alias("redundancy"))


def oversized(units: DataFrame, budget: int = 2200) -> DataFrame:
    """Units no budget-respecting packer can ever deliver."""
    return units.filter(F.col("tokens") > budget)
