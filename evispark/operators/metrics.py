"""Page-level retrieval metrics; NULL where a question has no gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import numeric
from evispark.operators.ranking import exact_percentiles, linear


def page_metrics(hits: DataFrame, questions: DataFrame, expected: DataFrame, keys=("qid",)) -> DataFrame:
    """page_hit, recall, reciprocal rank, nDCG and linked share a question.

    ``hits`` (keys, rank, pages[, link_depth]), ``questions`` (keys) lists the
    questions to report, ``expected`` (qid, page) the distinct gold pages.
    """
    return _measured(hits, questions, expected, keys).select(
        *keys, "retrieved", "answerable",
        F.when(F.col("answerable"), F.col("n_found") > 0).alias("page_hit"),
        F.when(F.col("answerable"), F.col("n_found") / F.col("n_expected")).alias("recall"),
        F.when(F.col("answerable"), F.coalesce(F.lit(1.0) / F.col("best_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(F.col("answerable") & (F.col("retrieved") > 0), F.col("dcg") / _ideal()).otherwise(F.lit(0.0)).alias("ndcg"),
        "linked",
        F.when(F.col("retrieved") > 0, F.col("linked") / F.col("retrieved")).otherwise(F.lit(0.0)).alias("linked_share"),
    )


def _ideal():
    n = F.least("n_expected", "retrieved").cast("int")
    ranks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))


def _measured(hits: DataFrame, questions: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Everything the metrics need, from one pass over the hits.

    Hits come out of an expensive plan, so they are read once: pages are
    unnested, gold pages flagged, and first ranks found per question.
    """
    keys = list(keys)
    depth = F.col("link_depth") if "link_depth" in hits.columns else F.lit(0)
    tokens = F.col("tokens") if "tokens" in hits.columns else F.lit(0)
    pages = hits.select(
        *keys, "rank", depth.alias("_depth"), tokens.alias("_tokens"), F.explode_outer(F.array_distinct("pages")).alias("page")
    )
    flagged = pages.join(expected.select("qid", "page", F.lit(True).alias("_gold")), ["qid", "page"], "left")
    w = Window.partitionBy(*keys, "page")
    seen = flagged.select(
        *keys, "rank", "page", "_depth", "_tokens", F.coalesce("_gold", F.lit(False)).alias("_gold"),
        F.min("rank").over(w).alias("_first"), F.min("_depth").over(w).alias("_nearest"),
    )
    new = F.col("page").isNotNull() & (F.col("_first") == F.col("rank"))
    # A rank gains once however many new gold pages it brings.
    unit = seen.groupBy(*keys, "rank").agg(
        F.max("_depth").alias("_depth"), F.max("_tokens").alias("_tokens"), F.count_if(new).alias("_new"),
        F.count_if(new & F.col("_gold")).alias("_gain"), F.max("_gold").alias("_hit"),
        F.count_if(new & F.col("_gold") & (F.col("_nearest") > 0)).alias("_by_link"),
        F.min(F.col("page").isNotNull() & (F.col("_first") < F.col("rank"))).alias("_dup"),
    )
    each = unit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("_depth") > 0).alias("linked"),
        F.sum("_gain").alias("n_found"), F.min(F.when(F.col("_hit"), F.col("rank"))).alias("best_rank"),
        F.sum(F.when(F.col("_gain") > 0, numeric.discount(F.col("rank"))).otherwise(F.lit(0.0))).alias("dcg"),
        F.sum("_tokens").alias("n_tokens"), F.sum("_new").alias("n_pages"), F.sum("_by_link").alias("pages_only_by_links"),
        F.sum(F.when(F.col("_dup"), F.col("_tokens")).otherwise(0)).alias("duplicate_tokens"),
    )
    gold = expected.groupBy("qid").agg(F.count("page").alias("n_expected"))
    j = questions.select(*keys).join(each, keys, "left").join(gold, ["qid"], "left")
    zeros = ("retrieved", "linked", "n_found", "n_tokens", "n_pages", "pages_only_by_links", "duplicate_tokens", "n_expected")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})
    return j.withColumn("dcg", F.coalesce("dcg", F.lit(0.0))).withColumn("answerable", F.col("n_expected") > 0)


def context_metrics(packed: DataFrame, questions: DataFrame, expected: DataFrame, keys=("qid",)) -> DataFrame:
    """Metrics of a packed context: hit is false, not NULL, without gold.

    redundancy is NULL for a question with nothing packed.
    """
    m = _measured(packed, questions, expected, keys)
    share = F.when(F.col("n_tokens") > 0, F.col("duplicate_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return m.select(
        *keys, F.col("retrieved").alias("n_units"), "n_tokens", "n_pages",
        (F.col("answerable") & (F.col("n_found") > 0)).alias("page_hit"),
        F.when(F.col("answerable"), F.col("n_found") / F.col("n_expected")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("retrieved") > 0, share).alias("redundancy"),
    )


def arm_summary(rows: DataFrame) -> DataFrame:
    """Means for each arm over answerable questions."""
    return rows.filter("answerable").groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("page_hit").cast("double")).alias("page_hit"),
        F.avg("recall").alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    )


def link_mechanism(packed: DataFrame, questions: DataFrame, expected: DataFrame, keys=("qid",)) -> DataFrame:
    """How many packed units and gold pages came only through links."""
    return _measured(packed, questions, expected, keys).filter("retrieved > 0").select(
        *keys, F.col("retrieved").alias("packed"), F.col("linked").alias("traversed"), "pages_only_by_links"
    )


def hits_ndcg(hits: Column, expected: Column) -> Column:
    """Binary page-nDCG of a row's stored hits, in their order.

    ``hits`` is an array of structs with page_number and page_numbers, ``expected`` an array of pages. A hit gains once,
    where it is the first to show some expected page; the ideal shows a new page at each of the first ranks.
    """
    pages = lambda h: F.array_distinct(F.array_compact(F.concat(F.array(h["page_number"].cast("int")), F.coalesce(h["page_numbers"].cast("array<int>"), F.array().cast("array<int>")))))
    want = F.array_distinct(expected.cast("array<int>"))
    indexed = F.transform(hits, lambda h, i: F.struct(pages(h).alias("p"), (i + 1).alias("rank")))
    start = F.struct(want.alias("left"), F.lit(0.0).alias("dcg"))
    step = lambda s, h: F.struct(
        F.array_except(s["left"], h["p"]).alias("left"),
        (s["dcg"] + F.when(F.size(F.array_intersect(s["left"], h["p"])) > 0, numeric.discount(h["rank"])).otherwise(0.0)).alias("dcg"),
    )
    dcg = F.aggregate(indexed, start, step)["dcg"]
    n = F.least(F.size(want), F.size(hits))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda t, i: t + numeric.discount(i))
    return F.when(n > 0, dcg / ideal).otherwise(F.lit(0.0))


def frozen_arms(records: DataFrame, top_k: int) -> DataFrame:
    """(condition, qid, metrics, ndcg) of stored per-question records of one depth.

    ``records``: condition, qid, top_k (null: that depth), metrics, hits, expected_pages. nDCG was not stored with them
    and is worked out from the stored hits.
    """
    return records.filter(F.coalesce("top_k", F.lit(top_k)) == top_k).select("condition", "qid", "metrics", hits_ndcg(F.col("hits"), F.col("expected_pages")).alias("ndcg"))


def describe(answers: DataFrame, keys, latency: str, judge_cost: str) -> DataFrame:
    """Nineteen columns a condition: counts, graded means, refusals, evidence at context, calls, latencies and costs.

    ``answers`` has answerable, the four outcomes, refused (0 or 1), negative_refusal_correct, page_hit, page_recall,
    calls and generation_cost. Graded and evidence means are over answerable questions and skip nulls. Two aggregates
    and one exact selection of the latencies; no group is ever held.
    """
    yes = F.col("answerable")
    of = lambda c: F.avg(F.when(yes, F.col(c).cast("double")))
    mean = lambda c: F.avg(c)
    plain = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes).alias("n_answerable"), F.count_if(~yes).alias("n_controls"),
        *[of(c).alias(c) for c in ("answer_correctness", "answer_completeness", "groundedness", "citation_quality")],
        of("refused").alias("positive_refusal_rate"), F.avg(F.when(~yes, F.col("negative_refusal_correct"))).alias("control_refusal_accuracy"),
        of("page_hit").alias("page_hit_at_context"), of("page_recall").alias("expected_page_recall_at_context"), mean("calls").alias("mean_generator_calls"),
        mean("generation_cost").alias("mean_generation_cost_usd"), mean(judge_cost).alias("mean_judge_cost_usd"),
        F.avg(F.col("generation_cost") + F.col(judge_cost)).alias("mean_total_cost_usd"),
    )
    waits = exact_percentiles(answers, keys, latency, {"median_latency_ms": linear(0.5), "p95_latency_ms": linear(0.95)})
    return plain.join(waits, list(keys))
