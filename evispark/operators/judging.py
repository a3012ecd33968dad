"""Judge outcomes, trial aggregation, reliability, and the judge loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import jsonx
from evispark.functions.jsonx import SCORES
from evispark.session import settle

OUTCOMES = ("answer_correctness", "answer_completeness", "groundedness", "citation_quality")


def outcomes(answerable: Column, disposition: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """Controls only score their refusal; refusing an answerable question
    scores the floor 1.0; otherwise the four scores stand."""
    refused = disposition == "refusal"
    floor = {"answer_correctness", "answer_completeness"}
    out = {}
    for name, key in zip(OUTCOMES, SCORES):
        low = F.lit(1.0) if name in floor else F.lit(None).cast("double")
        out[name] = F.when(~answerable, F.lit(None).cast("double")).when(refused, low).otherwise(scores[key].cast("double"))
    out["negative_refusal_correct"] = F.when(~answerable, refused.cast("double"))
    return out


def answer_scores(trials: DataFrame, keys) -> DataFrame:
    """Cell means over judge trials; NULLs are skipped, never imputed."""
    return trials.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in (*OUTCOMES, "negative_refusal_correct")],
        F.avg((F.col("disposition") == "refusal").cast("double")).alias("refusal_fraction"),
        F.count(F.lit(1)).alias("judge_trials"),
        F.sum("attempts").alias("judge_attempts"),
        F.sum("cost").alias("judge_cost_usd"),
    )


def reliability(trials: DataFrame, keys) -> DataFrame:
    """Agreement of trials within answerable cells, and the retry rate."""
    cells = trials.groupBy(*keys).agg(
        F.max("answerable").alias("answerable"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("attempts") > 1).alias("retried"), F.sum(F.col("attempts") - 1).alias("retries"),
        (F.max("answer_correctness") - F.min("answer_correctness")).alias("range"),
    )
    return cells.agg(
        F.count(F.lit(1)).alias("answer_cells"), F.sum("n").alias("trial_records"),
        F.sum("retries").alias("schema_retry_count"), (F.sum("retried") / F.sum("n")).alias("schema_retry_rate"),
        F.count_if("answerable").alias("positive_answer_cells"),
        F.avg(F.when(F.col("answerable"), (F.col("range") == 0).cast("double"))).alias("exact_agreement"),
        F.avg(F.when(F.col("answerable"), F.col("range"))).alias("mean_range"),
    )


def saturation(trials: DataFrame, keys, dimensions=OUTCOMES, ceiling: float = 0.98) -> DataFrame:
    """(keys, dimension): mean, share at 5, distinct scores, still discriminating."""
    long = trials.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dimensions])).alias("s")
    ).select(*keys, "s.dimension", "s.v").filter("v is not null")
    share = F.avg((F.col("v") >= 5).cast("double"))
    return long.groupBy(*keys, "dimension").agg(
        F.count(F.lit(1)).alias("trials_scored"), F.avg("v").alias("mean"), share.alias("at_ceiling"),
        F.array_join(F.sort_array(F.collect_set(F.col("v").cast("int"))).cast("array<string>"), ",").alias("distinct_values"),
        (share < ceiling).alias("discriminating"),
    )


RUBRIC = ("r1", "r2", "r3", "g1", "g2", "g3")


def rubric_summary(trials: DataFrame, keys, cost: str = "cost") -> DataFrame:
    """Six dimensions averaged over trials; spread of the per-trial overall."""
    mean = lambda names: sum((F.col(n) for n in names), F.lit(0.0)) / F.lit(float(len(names)))
    each = trials.withColumn("_overall", mean(RUBRIC))
    agg = each.groupBy(*keys).agg(
        *[F.avg(n).alias(n) for n in RUBRIC], F.stddev_pop("_overall").alias("overall_std"),
        F.sum(cost).alias("total_cost"), F.count(F.lit(1)).alias("n_trials"),
    )
    return agg.withColumn("retrieval_mean", mean(RUBRIC[:3])).withColumn("generation_mean", mean(RUBRIC[3:])).withColumn(
        "overall_mean", mean(RUBRIC)
    )


def range_violations(rows: DataFrame, keys, ranges: dict[str, tuple[float, float | None]]) -> DataFrame:
    """(rule, keys, value) of numbers outside their range: ``{"calls": (0, None), "accuracy": (1, 5)}``; nulls are no numbers and pass."""

    def outside(c, low, high):
        v = F.col(c).cast("double")
        bad = (v < low) | F.isnan(v) | (F.lit(False) if high is None else v > high)
        return F.when(bad, F.struct(F.lit(c).alias("rule"), v.alias("value")))

    found = F.array_compact(F.array(*[outside(c, low, high) for c, (low, high) in ranges.items()]))
    return rows.select(*keys, F.explode(found).alias("_f")).select("_f.rule", *keys, "_f.value")


def run_judge(tasks: DataFrame, judge: Callable[[str, int], str], max_attempts: int = 3) -> DataFrame:
    """Ask ``judge(prompt, attempt)`` until the reply parses, at most ``max_attempts`` times.

    ``tasks`` carry evaluation_id, answerable, prompt. An attempt is one step
    over the tasks still open; its replies are settled, so no later step asks
    again, and parsed on the JVM. A retry's prompt ends with what was wrong.
    Every raw reply is kept, null for a call that raised; an exhausted task is
    a row with ``valid`` false.
    """
    names = ["response_disposition", *SCORES, "explanation"]

    def ask(batches):
        for pdf in batches:
            replies, errors = [], []
            for prompt, attempt in zip(pdf["prompt"], pdf["attempts"]):
                try:
                    replies.append(judge(prompt, int(attempt)))
                    errors.append(None)
                except Exception as e:  # the injected model may raise anything
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(reply=replies, failure=errors)

    state = tasks.select("evaluation_id", "answerable", "prompt", F.lit(0).alias("attempts"), F.array().cast("array<string>").alias("raw"))
    open_, done = state, []
    columns = state.columns
    asked_schema = "evaluation_id string, answerable boolean, prompt string, attempts int, raw array<string>, reply string, failure string"
    told = "\n\nYour reply to this was not accepted. Wrong in it: "
    for _ in range(max_attempts):
        base = F.coalesce(F.substring_index("prompt", told, 1), F.col("prompt"))
        asked = settle(open_.select(*columns).mapInPandas(ask, asked_schema))
        read = asked.withColumn("_p", jsonx.parse_judge("reply", "evaluation_id", "answerable")).select(
            "evaluation_id", "answerable", base.alias("prompt"), (F.col("attempts") + 1).alias("attempts"), F.concat("raw", F.array("reply")).alias("raw"),
            "_p.valid", F.coalesce("failure", "_p.error").alias("error"), *[f"_p.{n}" for n in names],
        )
        done.append(read.filter("valid"))
        last = read.filter("not valid")
        open_ = last.withColumn("prompt", F.concat("prompt", F.lit(told), "error"))
        if last.isEmpty():
            break
    done.append(last)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("evaluation_id", "attempts", "raw", "valid", "error", *names)


def evaluation_id(*parts: Column, length: int = 24) -> Column:
    """Opaque id that hides which system produced the answer."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit("blind-"), F.substring(F.sha2(key, 256), 1, length))
