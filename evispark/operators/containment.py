"""Which texts quote which items verbatim, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.session import broadcast_if, fits_broadcast, spread


def verbatim_pairs(docs: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, doc_id, tenant) where docs.text contains items.text.

    A token strictly inside an item is also a token of every text quoting it.
    Each item is therefore joined on its rarest inner token, and only these
    candidates are compared. Items with no inner token use their first
    characters (at most three) as the join key instead.
    """
    small = fits_broadcast(items)
    toks = T.raw_tokens(F.col("text"))
    inner = items.withColumn("_t", toks).withColumn("_in", F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0))))
    named = inner.filter(F.size("_in") > 0).select(item_id, F.explode(F.array_distinct("_in")).alias("tok"))
    vocabulary = named.select("tok").distinct()
    # Both readers of the pairs found ask for ids that are not null, so that Spark reuses their exchange.
    docs = docs.filter("doc_id is not null")
    d = spread(docs.select("doc_id", "tenant", "text"), "doc_id")
    found = (
        d.select("doc_id", F.explode_outer(F.array_distinct(toks)).alias("tok"))
        .join(broadcast_if(vocabulary, small), "tok")
        .repartition("doc_id")
    )
    frequency = found.groupBy("tok").agg(F.count("doc_id").alias("df"))
    anchors = (
        named.join(frequency, "tok", "left")
        .groupBy(item_id)
        .agg(F.min_by("tok", F.struct(F.coalesce("df", F.lit(0)), F.col("tok"))).alias("tok"))
    )
    candidates = found.join(broadcast_if(anchors, small), "tok").select(item_id, "doc_id")
    brief = inner.filter((F.size("_in") <= 0) & (F.length("text") > 0))
    if not brief.isEmpty():
        candidates = candidates.unionByName(_by_first_characters(d, brief, item_id, small))
    texts = candidates.join(broadcast_if(items.select(item_id, F.col("text").alias("_item")), small), item_id)
    return (
        texts.join(docs.select("doc_id", "tenant", "text"), "doc_id")
        .filter(F.contains("text", F.col("_item")))
        .select(item_id, "doc_id", "tenant")
    )


def _piece(n: int):
    return lambda i: F.concat(*[F.get(F.col("c"), i + j) for j in range(n)])


def _by_first_characters(docs: DataFrame, brief: DataFrame, item_id: str, small: bool) -> DataFrame:
    keyed = brief.select(item_id, F.substring("text", 1, 3).alias("gram"))
    chars = docs.select("doc_id", F.split("text", "").alias("c"))
    grams = []
    for n in (1, 2, 3):
        at = F.when(F.size("c") >= n, F.sequence(F.lit(0), F.size("c") - n)).otherwise(F.array().cast("array<int>"))
        grams.append(F.array_distinct(F.transform(at, _piece(n))))
    exploded = chars.select("doc_id", F.explode_outer(F.concat(*grams)).alias("gram"))
    return exploded.join(broadcast_if(keyed, small), "gram").select(item_id, "doc_id")
