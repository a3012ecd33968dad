"""Reciprocal-rank fusion, over-fetch and rerank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import numeric, text
from evispark.operators.ranking import by_score, top_k


def rrf(arms: list[DataFrame], k_out: int, k: float = 60.0, depth: int = 50) -> DataFrame:
    """(qid, tenant, doc_id, score, rank) fused from two or more ranked arms.

    One groupBy over the union; each arm contributes at most ``depth`` rows a
    question, so the shuffle is bounded by questions, not by the corpus.
    """
    if len(arms) < 2:
        raise ValueError("fusion needs at least two arms")
    cut = [a.filter(F.col("rank") <= depth).select("qid", "tenant", "doc_id", "rank") for a in arms]
    rows = reduce(DataFrame.unionByName, cut)
    fused = rows.groupBy("qid", "tenant", "doc_id").agg(
        F.sum(numeric.reciprocal_rank_term(F.col("rank"), k)).alias("score"),
        F.count(F.lit(1)).cast("int").alias("n_arms"),
    )
    return top_k(fused, ["qid"], by_score(), k_out)


def overlap(question: Column, passage: Column) -> Column:
    """Offline rerank score: share of question terms found in the passage."""
    q = F.array_distinct(text.query_terms(question))
    return F.size(F.array_intersect(q, text.tokens(passage))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Top k by rerank score, prior rank breaking ties.

    ``candidates`` carry (qid, doc_id, score, rank). ``score`` is any Column,
    e.g. a pandas UDF around a cross-encoder; without one the prior score stays.
    """
    new = F.col("score") if score is None else score
    prior = candidates.withColumn("rerank_score", new.cast("double")).withColumnRenamed("rank", "prior_rank")
    return top_k(prior, ["qid"], [F.round("rerank_score", 9).desc(), F.col("prior_rank").asc()], k)
