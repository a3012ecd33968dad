"""Gates over whole runs: relations of what is wrong, found without moving what is right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import jsonx
from evispark.operators import judging
from evispark.session import settle

# Ranges of keys that are compared by digest before any row is.
RANGES = 4096


def _range_digests(rows: DataFrame, keys, values, side: str) -> DataFrame:
    """(range, n, low, high): for each range of keys the number of its rows and two sums over their sha256.

    Sums, unlike exclusive-or, tell repeated rows from missing ones; they combine map-side, so a task sends at most
    ``RANGES`` rows.
    """
    line = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*keys, *values])]), {"ignoreNullFields": "false"}), 256)
    number = lambda a: F.conv(F.substring("_line", a, 15), 16, 10).cast("decimal(20,0)")
    return (
        rows.select(_range(keys).alias("_range"), line.alias("_line"))
        .groupBy("_range")
        .agg(F.count(F.lit(1)).alias(f"{side}n"), F.sum(number(1)).alias(f"{side}low"), F.sum(number(16)).alias(f"{side}high"))
    )


def _range(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(RANGES)).cast("int")


def reconcile(expected: DataFrame, actual: DataFrame, keys, values=()) -> DataFrame:
    """(rule, keys) where two relations differ: missing, extra, duplicate, or ``<column>_differs``.

    Each side is summed to one digest a range of keys; rows of ranges whose digests agree go no further. The others
    meet by key. Equal relations so cost one pass each and no shuffle of their rows. Nulls are values like others.
    """
    keys, values = list(keys), list(values)
    both = _range_digests(expected, keys, values, "e").join(_range_digests(actual, keys, values, "a"), "_range", "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"e{c}").eqNullSafe(F.col(f"a{c}")) for c in ("n", "low", "high")])
    differ = F.broadcast(settle(both.filter(~same).select("_range")))  # at most RANGES numbers

    def narrowed(rows, side):
        kept = rows.withColumn("_range", _range(keys)).join(differ, "_range", "left_semi").drop("_range")
        return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_{side}"), *[F.max(F.struct(F.col(v).alias("v"))).alias(f"_{side}_{v}") for v in values])

    e, a = narrowed(expected, "e"), narrowed(actual, "a")
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    a = a.withColumnsRenamed(names)
    j = e.join(a, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]), "full_outer")
    paired = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    rules = [
        F.when(F.col("_a").isNull(), F.lit("missing")), F.when(F.col("_e").isNull(), F.lit("extra")), F.when(F.coalesce("_a", F.lit(0)) > 1, F.lit("duplicate")),
        *[F.when(paired & ~F.col(f"_e_{v}").eqNullSafe(F.col(f"_a_{v}")), F.lit(f"{v}_differs")) for v in values],
    ]
    found = F.explode(F.array_compact(F.array(*rules))).alias("rule")
    return j.select(found, *[F.coalesce(F.col(k), F.col(names[k])).alias(k) for k in keys])


def index_gaps(schedule: DataFrame, index: str) -> DataFrame:
    """(rule, index) where ``index`` is not 0, 1, ... n - 1, each once."""
    n = schedule.agg(F.count(F.lit(1)).alias("_n"))
    seen = schedule.groupBy(F.col(index).alias("index")).agg(F.count(F.lit(1)).alias("_c"))
    wrong = F.when(F.col("_c") > 1, F.lit("index_duplicate")).when(F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("_n")), F.lit("index_out_of_range"))
    return seen.join(F.broadcast(n)).select(wrong.alias("rule"), "index").filter("rule is not null")


def field_mismatches(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(field, declared, actual) of two one-row relations where a column of ``actual`` is declared otherwise or not at all."""
    text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    pair = lambda df: F.array(*[F.struct(F.lit(c).alias("field"), text(df, c).alias("v")) for c in actual.columns])
    d = declared.select(F.explode(pair(declared)).alias("d")).select(F.col("d.field"), F.col("d.v").alias("declared"))
    a = actual.select(F.explode(pair(actual)).alias("a")).select(F.col("a.field"), F.col("a.v").alias("actual"))
    return d.join(a, "field").filter(~F.col("declared").eqNullSafe(F.col("actual")))


def run_violations(
    cells: DataFrame, schedule: DataFrame, generation: DataFrame, scores: DataFrame, trials: DataFrame, keys, trials_per_answer: int, arms: int,
) -> DataFrame:
    """(source, rule, keys, trial_index) of everything that keeps a run from being complete and of one piece.

    ``cells`` are all due cells (keys, answerable), with ``arms`` of them for each question. The schedule must hold each of
    them once under indices without gaps; generation and scores must hold each once, with its answerability, and scores
    with the digest of the generated answer and ``judge_trials`` of ``trials_per_answer``; ``trials`` must hold every
    cell's trials 1 to ``trials_per_answer`` once, each with that digest and answerability.
    """
    keys = list(keys)
    none = F.lit(None).cast("bigint").alias("trial_index")
    told = lambda source, df: df.select(F.lit(source).alias("source"), "rule", *keys, none)
    answers = generation.groupBy(*keys).agg(F.max("answer_sha256").alias("answer_sha256"))
    due = cells.select(*keys, "answerable")
    answered = due.join(answers, keys, "left").select(*keys, "answerable", "answer_sha256")
    asked = answered.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trials_per_answer).cast("bigint"))).alias("trial_index"))
    gaps = index_gaps(schedule, "schedule_index")
    at = schedule.select(F.col("schedule_index").alias("index"), *keys)
    out = [
        told("schedule", reconcile(due.select(*keys), schedule.select(*keys), keys)),
        told("schedule", gaps.join(at, gaps["index"].eqNullSafe(at["index"])).select("rule", *keys)),
        told("generation", reconcile(due, generation, keys, ["answerable"])),
        told("score", reconcile(answered.select(*keys, "answerable", "answer_sha256", F.lit(trials_per_answer).cast("bigint").alias("judge_trials")), scores, keys, ["answerable", "answer_sha256", "judge_trials"])),
        reconcile(asked, trials, [*keys, "trial_index"], ["answerable", "answer_sha256"]).select(F.lit("trial").alias("source"), "rule", *keys, "trial_index"),
        told("cell", cells.groupBy(keys[-1]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != arms).select(F.lit("incomplete_product").alias("rule"), *[F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in keys[:-1]], keys[-1])),
    ]
    return reduce(DataFrame.unionByName, out)


def judge_record_violations(records: DataFrame, tasks: DataFrame, keys, model: str, max_attempts: int) -> DataFrame:
    """(rule, keys) of stored judge records that must not be resumed from.

    ``records`` carry, besides ``keys``, evaluation_id, answer_sha256, answerable, ``assessment`` (the JSON reply),
    ``outcomes`` (a struct of the derived scores), ``attempts`` (array of structs with validation_error),
    ``invocations`` (array of structs with model_id, input_tokens, output_tokens, cost_usd) and the sums
    judge_input_tokens, judge_output_tokens, judge_cost_usd. ``tasks`` say what each key must have. The reply is parsed
    anew and its outcomes derived anew; a reply that does not parse has no outcomes to compare.
    """
    keys = list(keys)
    due = tasks.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("evaluation_id", "answer_sha256", "answerable")], F.lit(True).alias("_known"))
    j = records.join(due, keys, "left").withColumn("_p", jsonx.parse_judge("assessment", "_evaluation_id", "_answerable"))
    again = judging.outcomes(F.col("_answerable"), F.col("_p.response_disposition"), {s: F.col(f"_p.{s}") for s in jsonx.SCORES})
    same = reduce(lambda a, b: a & b, [F.col(f"outcomes.{n}").eqNullSafe(c) for n, c in again.items()])
    total = lambda c, zero: F.aggregate("invocations", zero, lambda s, x: s + x[c].cast("double" if c == "cost_usd" else "bigint"))
    long, double = F.lit(0).cast("bigint"), F.lit(0.0)
    field = lambda c: F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c}_mismatch"))
    rules = [
        F.when(F.col("_known").isNull(), F.lit("unknown_task")), field("evaluation_id"), field("answer_sha256"), field("answerable"),
        F.when(F.col("_known") & ~F.coalesce("_p.valid", F.lit(False)), F.lit("assessment_invalid")),
        F.when(F.col("_known") & F.coalesce("_p.valid", F.lit(False)) & ~same, F.lit("outcomes_mismatch")),
        F.when(~F.coalesce(F.size("attempts").between(1, max_attempts), F.lit(False)), F.lit("attempt_log")),
        F.when(F.try_element_at("attempts", F.lit(-1))["validation_error"].isNotNull(), F.lit("last_attempt_invalid")),
        F.when(~F.size("invocations").eqNullSafe(F.size("attempts")), F.lit("invocation_log")),
        F.when(F.exists("invocations", lambda x: ~x["model_id"].eqNullSafe(F.lit(model))), F.lit("model_mismatch")),
        F.when(~total("input_tokens", long).eqNullSafe(F.col("judge_input_tokens").cast("bigint")), F.lit("input_tokens_sum")),
        F.when(~total("output_tokens", long).eqNullSafe(F.col("judge_output_tokens").cast("bigint")), F.lit("output_tokens_sum")),
        F.when(~F.coalesce(F.abs(total("cost_usd", double) - F.col("judge_cost_usd")) <= 1e-12, F.lit(False)), F.lit("cost_sum")),
    ]
    return j.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), *keys)


def digest_join(generation: DataFrame, scores: DataFrame, keys, digest: str = "answer_sha256") -> DataFrame:
    """Scores with their generation record; of columns that both have, the score's count.

    A score without a record, or of another answer, is refused when a task meets it, so nothing is read twice for the check.
    """
    keys = list(keys)
    own = [c for c in generation.columns if c not in scores.columns]
    right = generation.select(*keys, *own, F.col(digest).alias("_digest"), F.lit(True).alias("_found"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    checked = (
        F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("score has no generation record: "), name)))
        .when(~F.col(digest).eqNullSafe(F.col("_digest")), F.raise_error(F.concat(F.lit("answer digest mismatch: "), name)))
        .otherwise(F.col(digest))
    )
    j = scores.join(right, keys, "left").withColumn(digest, checked)
    return j.select(*keys, *own, *[c for c in scores.columns if c not in keys])


def scrubbed(records: DataFrame, drop, digest: str, of: Column) -> DataFrame:
    """``records`` without the columns ``drop`` and with ``digest`` computed anew by ``of`` from what is left, with the old one as ``old_<digest>``."""
    return records.withColumnRenamed(digest, f"old_{digest}").drop(*drop).withColumn(digest, of)


def carried(rows: DataFrame, rewritten: DataFrame, digest: str) -> DataFrame:
    """``rows`` that name a record by its old ``digest``, naming it by the new one.

    ``rewritten`` comes from `scrubbed`. Two records that shared an old digest must still share the new one; a row that
    names no known record keeps its digest.
    """
    names = rewritten.groupBy(F.col(f"old_{digest}").alias("_old")).agg(F.min(digest).alias("_new"), F.max(digest).alias("_other"))
    new = F.when(F.col("_new") != F.col("_other"), F.raise_error(F.concat(F.lit("one digest, two records: "), F.col("_old")))).otherwise(F.coalesce("_new", digest))
    return rows.join(names, rows[digest] == names["_old"], "left").withColumn(digest, new).select(*rows.columns)
