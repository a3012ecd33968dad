"""Catalogue: gates over whole runs, on records derived from the events with known faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark.functions import jsonx
from evispark.operators import experiment, gates, judging, metrics
from evispark.operators.ranking import attach_row, dense_index
from evispark.plans import corpus
from evispark.plans.q_evaluation import judge_raw, trials
from evispark.plans.q_retrieval import arm_bm25
from evispark.plans.registry import query
from evispark.plans.sql import compose, cte
from evispark.session import settle

KEYS = ["flow", "arm", "qid"]
TRIALS = 6
ARMS = ("raw", "treated")

cte("g_questions", (), "SELECT user_id AS qid, user_id % 5 <> 0 AS answerable, row_number() OVER (ORDER BY user_id) - 1 AS q FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
cte("g_flows", (), "SELECT event_type AS flow, row_number() OVER (ORDER BY event_type) - 1 AS f, count(*) OVER () AS nf FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")
cte("g_cells", ("g_questions", "g_flows"), "SELECT flow, arm, qid, answerable, (q * nf + f) * 2 + a AS schedule_index FROM g_questions, g_flows, (VALUES ('raw', 0), ('treated', 1)) x(arm, a)")
cte("g_schedule", ("g_cells",), "SELECT * EXCLUDE answerable FROM g_cells WHERE NOT (qid % 41 = 1 AND flow = 'view') UNION ALL SELECT * EXCLUDE answerable FROM g_cells WHERE qid % 83 = 2 AND arm = 'raw' AND flow = 'click'")
ANSWER_SQL = "sha256(concat(flow, '|', arm, '|', qid))"
cte(
    "g_generation", ("g_cells",),
    f"""SELECT CASE WHEN qid % 97 = 1 AND n = 2 THEN 'other' ELSE flow END AS flow, arm, qid, CASE WHEN qid % 53 = 5 AND flow = 'view' THEN NOT answerable ELSE answerable END AS answerable,
    {ANSWER_SQL} AS answer_sha256 FROM g_cells, (VALUES (1), (2)) x(n) WHERE (qid * 7 + length(flow)) % 41 <> 0 AND (n = 1 OR (arm = 'treated' AND (qid % 43 = 4 OR qid % 97 = 1)))""",
)
cte("g_trials0", ("trials",), "SELECT *, row_number() OVER (PARTITION BY flow, arm, qid ORDER BY trial) AS trial_index FROM trials")
cte(
    "g_trials", ("g_trials0",),
    f"SELECT flow, arm, qid, trial_index, answerable, CASE WHEN qid % 71 = 8 AND trial_index = 3 THEN sha256('x') ELSE {ANSWER_SQL} END AS answer_sha256 FROM g_trials0",
)
cte(
    "g_scores", ("g_trials0",),
    f"SELECT flow, arm, qid, bool_or(answerable) AS answerable, count(*) AS judge_trials, CASE WHEN qid % 59 = 6 THEN sha256('y') ELSE {ANSWER_SQL} END AS answer_sha256 FROM g_trials0 GROUP BY flow, arm, qid",
)


def flows(spark, sf):
    return corpus.table(spark, sf, "events").agg(F.array_sort(F.collect_set("event_type")).alias("flows"))


def cells(spark, sf):
    """All due cells with their place in the schedule: questions x flows x arms, a question's cells made in its own row."""
    users = corpus.table(spark, sf, "events").select(F.col("user_id").alias("qid")).filter("qid is not null").distinct()
    q = attach_row(dense_index(users, F.floor(F.col("qid") / corpus.BLOCK), ["qid"], "q"), flows(spark, sf))
    f = q.select("qid", "q", F.size("flows").alias("nf"), F.posexplode("flows").alias("f", "flow"))
    a = f.select("*", F.posexplode(F.array(*[F.lit(a) for a in ARMS])).alias("a", "arm"))
    return a.select("flow", "arm", "qid", (F.col("qid") % 5 != 0).alias("answerable"), ((F.col("q") * F.col("nf") + F.col("f")) * 2 + F.col("a")).alias("schedule_index"))


def answer_sha():
    return F.sha2(F.concat_ws("|", "flow", "arm", F.col("qid").cast("string")), 256)


def schedule(c):
    twice = (F.col("qid") % 83 == 2) & (F.col("arm") == "raw") & (F.col("flow") == "click")
    times = F.when((F.col("qid") % 41 == 1) & (F.col("flow") == "view"), 0).when(twice, 2).otherwise(1)
    return c.select(*KEYS, "schedule_index", F.explode(F.array_repeat(F.lit(1), times)).alias("_n")).drop("_n")


def generation(c):
    twice = (F.col("arm") == "treated") & ((F.col("qid") % 43 == 4) | (F.col("qid") % 97 == 1))
    rows = c.filter((F.col("qid") * 7 + F.length("flow")) % 41 != 0).select("*", F.posexplode(F.array_repeat(F.lit(1), F.when(twice, 2).otherwise(1))).alias("n", "_one"))
    flipped = F.when((F.col("qid") % 53 == 5) & (F.col("flow") == "view"), ~F.col("answerable")).otherwise(F.col("answerable"))
    other = F.when((F.col("qid") % 97 == 1) & (F.col("n") == 1), F.lit("other")).otherwise(F.col("flow"))
    return rows.select(other.alias("flow"), "arm", "qid", flipped.alias("answerable"), answer_sha().alias("answer_sha256"))


def numbered(spark, sf):
    return trials(spark, sf).withColumn("trial_index", F.row_number().over(Window.partitionBy(*KEYS).orderBy("trial")).cast("bigint"))


def trial_records(t):
    sha = F.when((F.col("qid") % 71 == 8) & (F.col("trial_index") == 3), F.sha2(F.lit("x"), 256)).otherwise(answer_sha())
    return t.select(*KEYS, "trial_index", "answerable", sha.alias("answer_sha256"))


def scores(t):
    s = t.groupBy(*KEYS).agg(F.max("answerable").alias("answerable"), F.count(F.lit(1)).alias("judge_trials"))
    return s.withColumn("answer_sha256", F.when(F.col("qid") % 59 == 6, F.sha2(F.lit("y"), 256)).otherwise(answer_sha()))


DUE = "(SELECT flow, arm, qid, answerable FROM g_cells)"
ANSWERED = "(SELECT c.flow, c.arm, c.qid, c.answerable, g.sha FROM g_cells c LEFT JOIN (SELECT flow, arm, qid, max(answer_sha256) AS sha FROM g_generation GROUP BY ALL) g USING (flow, arm, qid))"


def against(source: str, due: str, have: str, keys: str, checks: dict[str, str]) -> str:
    """SQL of what `gates.reconcile` tells, by plain outer joins."""
    on = " AND ".join(f"e.{k} = a.{k}" for k in keys.split(", "))
    cols = ", ".join(f"coalesce(e.{k}, a.{k}) AS {k}" for k in keys.split(", "))
    index = "" if "trial_index" in keys else ", NULL::BIGINT AS trial_index"
    counted = f"(SELECT {keys}, count(*) AS n, {', '.join(f'max({c}) AS {c}' for c in checks) or '1 AS one'} FROM {have} GROUP BY {keys})"
    parts = [f"SELECT '{source}' AS source, '{rule}' AS rule, {cols}{index} FROM {due} e FULL JOIN {counted} a ON {on} WHERE {where}"
             for rule, where in [("missing", "a.qid IS NULL"), ("extra", "e.qid IS NULL"), ("duplicate", "a.n > 1"),
                                 *[(f"{c}_differs", f"a.qid IS NOT NULL AND e.qid IS NOT NULL AND {want} IS DISTINCT FROM a.{c}") for c, want in checks.items()]]]
    return " UNION ALL ".join(parts)


@query(
    "run_violations",
    compose(
        " UNION ALL ".join([
            against("schedule", DUE, "g_schedule", "flow, arm, qid", {}),
            "SELECT 'schedule', CASE WHEN c > 1 THEN 'index_duplicate' ELSE 'index_out_of_range' END, flow, arm, qid, NULL FROM "
            "(SELECT *, count(*) OVER (PARTITION BY schedule_index) AS c, count(*) OVER () AS n FROM g_schedule) WHERE c > 1 OR schedule_index < 0 OR schedule_index >= n",
            against("generation", DUE, "g_generation", "flow, arm, qid", {"answerable": "e.answerable"}),
            against("score", ANSWERED, "g_scores", "flow, arm, qid", {"answerable": "e.answerable", "answer_sha256": "e.sha", "judge_trials": str(TRIALS)}),
            against("trial", f"(SELECT *, unnest(range(1, {TRIALS + 1})) AS trial_index FROM {ANSWERED})", "g_trials", "flow, arm, qid, trial_index", {"answerable": "e.answerable", "answer_sha256": "e.sha"}),
        ]),
        "g_cells", "g_schedule", "g_generation", "g_scores", "g_trials",
    ),
)
def run_violations(spark, sf):
    """Everything that keeps the derived run from being complete, by relation and rule."""
    c = settle(cells(spark, sf))
    t = settle(numbered(spark, sf))
    n_flows = c.select("flow").distinct().count()
    return gates.run_violations(c.drop("schedule_index"), schedule(c), generation(c), scores(t), trial_records(t), KEYS, TRIALS, n_flows * len(ARMS))


@query(
    "manifest_mismatches",
    compose(
        """SELECT field, declared, actual FROM (SELECT unnest(['question_count', 'answerable_count', 'control_count', 'expected_records', 'ordered_qid_sha256', 'schedule_length']) AS field,
          unnest([n::VARCHAR, (a + 1)::VARCHAR, c::VARCHAR, (n * nf * 2)::VARCHAR, sha256(concat(qids, chr(10))), NULL]) AS declared,
          unnest([n::VARCHAR, a::VARCHAR, c::VARCHAR, (n * nf * 2)::VARCHAR, sha256(qids), s::VARCHAR]) AS actual
          FROM (SELECT count(*) AS n, count(*) FILTER (answerable) AS a, count(*) FILTER (NOT answerable) AS c, string_agg(qid::VARCHAR, ',' ORDER BY qid) AS qids FROM g_questions),
            (SELECT count(*) AS nf FROM g_flows), (SELECT count(*) AS s FROM g_schedule)) WHERE declared IS DISTINCT FROM actual""",
        "g_questions", "g_flows", "g_schedule",
    ),
)
def manifest_mismatches(spark, sf):
    """What a run's manifest declares against what its relations hold; the list of questions is part of the manifest."""
    c = settle(cells(spark, sf))
    q = c.select("qid", "answerable").distinct()
    counts = q.agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if("answerable").alias("answerable_count"), F.count_if(~F.col("answerable")).alias("control_count"),
        F.array_join(F.sort_array(F.collect_list("qid")).cast("array<string>"), ",").alias("qids"),
    )
    actual = attach_row(attach_row(counts, c.agg(F.count(F.lit(1)).alias("expected_records"))), schedule(c).agg(F.count(F.lit(1)).alias("schedule_length")))
    actual = actual.withColumn("ordered_qid_sha256", F.sha2("qids", 256))
    declared = actual.withColumn("answerable_count", F.col("answerable_count") + 1).withColumn("ordered_qid_sha256", F.sha2(F.concat("qids", F.lit("\n")), 256))
    return gates.field_mismatches(declared.drop("qids", "schedule_length"), actual.drop("qids"))


def judge_records(spark, sf):
    """Judge records of all trials with an accounting each; every 13th, 17th, 19th, ... is spoiled in its own way."""
    t = judge_raw(numbered(spark, sf))
    k = F.col("trial")
    hit = lambda m: k % m == 0
    calls = F.transform(
        F.sequence(F.lit(1), F.col("attempts")),
        lambda i: F.struct(
            F.when(hit(29) & (i == 1), F.lit("other")).otherwise(F.lit("judge")).alias("model_id"), (F.col("k") + i).alias("input_tokens"),
            (i * 2).alias("output_tokens"), (i * 0.25).alias("cost_usd"),
        ),
    )
    log = F.transform(F.sequence(F.lit(1), F.col("attempts")), lambda i: F.struct(F.when((i < F.col("attempts")) | hit(31), F.lit("no")).alias("validation_error")))
    derived = judging.outcomes(F.col("answerable"), F.col("disposition"), {s: F.col(f"raw_{s}") for s in jsonx.SCORES})
    n = F.col("attempts")
    r = t.select(
        *KEYS, "trial_index", "evaluation_id", "answerable", F.col("raw").alias("assessment"),
        F.when(hit(23), F.sha2(F.lit("z"), 256)).otherwise(answer_sha()).alias("answer_sha256"),
        F.struct(*[(c + F.when(hit(37), 1).otherwise(0) if name == "groundedness" else c).alias(name) for name, c in derived.items()]).alias("outcomes"),
        F.when(hit(41), F.slice(log, 1, n - 1)).otherwise(log).alias("attempts"), calls.alias("invocations"),
        (n * F.col("k") + n * (n + 1) / 2 + F.when(hit(43), 1).otherwise(0)).cast("bigint").alias("judge_input_tokens"),
        (n * (n + 1) + F.when(hit(47), 1).otherwise(0)).cast("bigint").alias("judge_output_tokens"),
        (n * (n + 1) / 8 + F.when(hit(53), 0.001).otherwise(0.0)).cast("double").alias("judge_cost_usd"),
    )
    return r, t.filter(~hit(59)).select(*KEYS, "trial_index", "evaluation_id", answer_sha().alias("answer_sha256"), "answerable")


# The reply is written out and read back as JSON here too, so the twin judges the text, not how it was made.
cte(
    "j_raw", ("g_trials0",),
    r"""SELECT *, CASE k % 11 WHEN 1 THEN 'Here it is: ' || body WHEN 2 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 9 THEN body || ' done' ELSE body END AS raw FROM (
      SELECT *, '{"schema_version": "1.0", "evaluation_id": "' || CASE WHEN k % 11 = 8 THEN 'blind-other' ELSE evaluation_id END || '", "response_disposition": "' || disposition
        || '", "correctness": ' || CASE k % 11 WHEN 4 THEN '"' || correctness || '"' WHEN 5 THEN 'true' WHEN 6 THEN '9' WHEN 10 THEN 'NaN' ELSE CASE WHEN scored THEN correctness::VARCHAR ELSE 'null' END END
        || ', "completeness": ' || CASE WHEN scored THEN completeness::VARCHAR ELSE 'null' END || ', "groundedness": ' || CASE WHEN scored THEN groundedness::VARCHAR ELSE 'null' END
        || ', "citation_quality": ' || CASE WHEN scored THEN citation_quality::VARCHAR ELSE 'null' END || ', "explanation": "ok"'
        || CASE k % 11 WHEN 3 THEN ', "extra": 1' WHEN 7 THEN ', "explanation": "again"' ELSE '' END || '}' AS body
      FROM (SELECT *, answerable AND disposition <> 'refusal' AS scored, 'blind-' || substr(sha256(concat(flow, '|', arm, '|', qid, '|', trial)), 1, 24) AS evaluation_id FROM g_trials0))""",
)
SCORE_NAMES = ("correctness", "completeness", "groundedness", "citation_quality")
KINDS = " AND ".join(f"coalesce(json_type(j, '$.{n}') = CASE WHEN graded THEN 'UBIGINT' ELSE 'NULL' END, FALSE) AND (NOT graded OR TRY_CAST(j->>'$.{n}' AS BIGINT) BETWEEN 1 AND 5)" for n in SCORE_NAMES)
cte(
    "j_read", ("j_raw",),
    f"""SELECT *, coalesce(whole AND j->>'$.schema_version' = '1.0' AND j->>'$.evaluation_id' = evaluation_id AND said IN ('substantive_answer', 'refusal')
      AND json_type(j, '$.explanation') = 'VARCHAR' AND length(trim(j->>'$.explanation')) > 0 AND {KINDS}, FALSE) AS valid FROM (
      SELECT *, j->>'$.response_disposition' AS said, answerable AND j->>'$.response_disposition' = 'substantive_answer' AS graded,
        list_sort(json_keys(j)) = ['citation_quality', 'completeness', 'correctness', 'evaluation_id', 'explanation', 'groundedness', 'response_disposition', 'schema_version'] AS whole
      FROM (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM j_raw))""",
)


@query(
    "judge_replies_read",
    compose(
        "SELECT trial, valid, CASE WHEN valid THEN said END AS response_disposition, "
        + ", ".join(f"CASE WHEN valid AND graded THEN (j->>'$.{n}')::INT END AS {n}" for n in SCORE_NAMES) + " FROM j_read", "j_read",
    ),
)
def judge_replies_read(spark, sf):
    """Judge replies as text, read strictly on both sides."""
    r = judge_raw(trials(spark, sf))
    p = r.select("trial", jsonx.parse_judge("raw", "evaluation_id", "answerable").alias("p"))
    return p.select("trial", "p.valid", "p.response_disposition", *[f"p.{n}" for n in SCORE_NAMES])


JUDGE_RULES = {
    "unknown_task": "trial % 59 = 0", "answer_sha256_mismatch": "trial % 59 <> 0 AND trial % 23 = 0", "assessment_invalid": "trial % 59 <> 0 AND NOT valid",
    "outcomes_mismatch": "trial % 59 <> 0 AND valid AND trial % 37 = 0 AND graded", "attempt_log": "trial % 41 = 0 AND attempts = 1",
    "last_attempt_invalid": "(trial % 31 = 0 OR trial % 41 = 0) AND attempts - (trial % 41 = 0)::INT > 0", "invocation_log": "trial % 41 = 0", "model_mismatch": "trial % 29 = 0",
    "input_tokens_sum": "trial % 43 = 0", "output_tokens_sum": "trial % 47 = 0", "cost_sum": "trial % 53 = 0",
}


@query(
    "judge_record_violations",
    compose(" UNION ALL ".join(f"SELECT '{rule}' AS rule, flow, arm, qid, trial_index FROM j_read WHERE {where}" for rule, where in JUDGE_RULES.items()), "j_read"),
)
def judge_record_violations(spark, sf):
    records, tasks = judge_records(spark, sf)
    return gates.judge_record_violations(records, tasks, [*KEYS, "trial_index"], "judge", 3)


@query(
    "generation_with_scores",
    compose(
        f"""SELECT s.flow, s.arm, s.qid, s.answerable, round(s.latency, 6) AS latency, s.judge_trials, {ANSWER_SQL.replace('flow', 's.flow').replace('arm', 's.arm').replace('qid', 's.qid')} AS answer_sha256
        FROM (SELECT flow, arm, qid, bool_or(answerable) AS answerable, max(latency) AS latency, count(*) AS judge_trials FROM g_trials0 GROUP BY ALL) s""",
        "g_trials0",
    ),
)
def generation_with_scores(spark, sf):
    """Scores joined to what was generated; the score's answerability wins, the generation's latency is taken over."""
    t = settle(numbered(spark, sf))
    made = t.groupBy(*KEYS).agg(F.lit(None).cast("boolean").alias("answerable"), F.max("latency").alias("latency")).withColumn("answer_sha256", answer_sha())
    given = t.groupBy(*KEYS).agg(F.max("answerable").alias("answerable"), F.count(F.lit(1)).alias("judge_trials")).withColumn("answer_sha256", answer_sha())
    joined = gates.digest_join(made, given, KEYS)
    return joined.withColumn("latency", F.round("latency", 6)).select(*KEYS, "answerable", "latency", "judge_trials", "answer_sha256")


@query(
    "scrubbed_records",
    compose(
        """SELECT flow, arm, qid, trial_index, sha256(concat(flow, '|', arm, '|', qid, '|', model, '|', tokens)) AS record_sha256 FROM (
          SELECT t.flow, t.arm, t.qid, t.trial_index, c.model, c.tokens FROM g_trials0 t JOIN (
            SELECT flow, arm, qid, max(model) AS model, sum(tokens_in)::BIGINT AS tokens FROM g_trials0 GROUP BY ALL) c USING (flow, arm, qid))""",
        "g_trials0",
    ),
)
def scrubbed_records(spark, sf):
    """Records lose the operator's account; trials that name a record by its digest name it by the new one."""
    t = settle(numbered(spark, sf))
    body = lambda *more: F.sha2(F.concat_ws("|", "flow", "arm", F.col("qid").cast("string"), "model", F.col("tokens").cast("string"), *more), 256)
    made = t.groupBy(*KEYS).agg(F.max("model").alias("model"), F.sum("tokens_in").alias("tokens")).withColumn("account", F.concat(F.lit("user-"), F.col("qid").cast("string")))
    made = made.withColumn("record_sha256", body("account"))
    rows = t.select(*KEYS, "trial_index").join(made.select(*KEYS, "record_sha256"), KEYS)
    clean = gates.scrubbed(made, ["account"], "record_sha256", body())
    return gates.carried(rows, clean, "record_sha256")


@query(
    "superseded_cells",
    compose("SELECT flow, arm, qid FROM g_cells WHERE qid % 89 = 3 OR (flow = 'view' AND qid % 101 = 4)", "g_cells"),
)
def superseded_cells(spark, sf):
    """Cells whose question, or whose very cell, a later review has withdrawn; a run that still holds one is refused."""
    c = cells(spark, sf)
    questions = c.filter("qid % 89 = 3").select("qid").distinct()
    single = c.filter("flow = 'view' and qid % 101 = 4").select(*KEYS)
    return experiment.superseded(c.select(*KEYS), KEYS, questions, single)


KEY_LIST = "['citation_quality', 'completeness', 'correctness', 'evaluation_id', 'explanation', 'groundedness', 'response_disposition', 'schema_version']"


@query(
    "judge_key_report",
    compose(
        f"""SELECT trial, array_to_string(list_sort(list_filter({KEY_LIST}, lambda x: NOT list_contains(json_keys(j), x))), ',') AS missing,
        array_to_string(list_sort(list_filter(list_distinct(json_keys(j)), lambda x: NOT list_contains({KEY_LIST}, x))), ',') AS extra
        FROM (SELECT trial, CASE WHEN json_valid(raw2) AND NOT contains(raw2, ': NaN') THEN raw2::JSON END AS j FROM (SELECT trial, CASE WHEN k % 11 IN (0, 3) AND trial % 4 = 0 THEN replace(raw, '"correctness"', '"score"') ELSE raw END AS raw2 FROM j_raw
          WHERE k % 11 <> 7)) WHERE j IS NOT NULL""",
        "j_raw",
    ),
)
def judge_key_report(spark, sf):
    """Which keys a judge's reply lacks and which it has too many; one key renamed in some."""
    r = judge_raw(trials(spark, sf)).filter("k % 11 <> 7")
    renamed = F.when((F.col("k") % 11).isin(0, 3) & (F.col("trial") % 4 == 0), F.replace("raw", F.lit('"correctness"'), F.lit('"score"'))).otherwise(F.col("raw"))
    k = r.select("trial", jsonx.key_report(renamed).alias("k")).filter("k is not null")
    return k.select("trial", F.array_join("k.missing", ",").alias("missing"), F.array_join("k.extra", ",").alias("extra"))


cte(
    "frozen_hits", ("bm25_10", "chunks"),
    "SELECT h.qid, h.rank, c.pages FROM bm25_10 h JOIN chunks c ON c.doc_id = h.doc_id",
)


@query(
    "frozen_arms",
    compose(
        """SELECT 'bm25' AS condition, qid, n_hits, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0.0) / ideal ELSE 0.0 END, 6) AS ndcg FROM (
          SELECT g.qid, h.n AS n_hits, (SELECT sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) FROM generate_series(1, least(g.n, h.n)::BIGINT) t(i)) AS ideal,
            (SELECT sum(1.0::DOUBLE / log2(r + 1.0::DOUBLE)) FROM (SELECT DISTINCT min(f.rank) AS r FROM frozen_hits f JOIN expected e ON e.qid = f.qid AND list_contains(f.pages, e.page) WHERE f.qid = g.qid GROUP BY e.page)) AS dcg
          FROM (SELECT qid, count(*) AS n FROM expected GROUP BY qid) g JOIN (SELECT qid, count(*) AS n FROM frozen_hits GROUP BY qid) h USING (qid))""",
        "frozen_hits", "expected",
    ),
)
def frozen_arms(spark, sf):
    """Stored records of one condition, hits in an array, and the nDCG that was not stored with them."""
    hits = arm_bm25(spark, sf, 10).join(corpus.chunks(spark, sf).select("tenant", "doc_id", "pages", "page_number"), ["tenant", "doc_id"])
    stored = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "page_number", F.col("pages").alias("page_numbers")))).alias("hits"))
    gold = corpus.expected_pages(spark, sf).groupBy("qid").agg(F.collect_list("page").alias("expected_pages"))
    rows = stored.join(gold, "qid").select(F.lit("bm25").alias("condition"), "qid", F.lit(10).alias("top_k"), F.struct(F.size("hits").cast("long").alias("n_hits")).alias("metrics"), "hits", "expected_pages")
    other = rows.withColumn("top_k", F.lit(5))  # another depth, which is left out
    f = metrics.frozen_arms(rows.unionByName(other), 10)
    return f.select("condition", "qid", "metrics.n_hits", F.round("ndcg", 6).alias("ndcg"))


@query(
    "store_snapshot",
    """SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus, count(*) AS n, array_to_string(list_sort(list_distinct(list(len(embedding)))), ',') AS dimensions,
    count(*) FILTER (embedding IS NULL) AS without_vector FROM embeddings GROUP BY 1""",
)
def store_snapshot(spark, sf):
    """What a vector store holds: rows, dimensions and missing vectors of each corpus."""
    e = corpus.table(spark, sf, "embeddings").withColumn("corpus", F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    return experiment.store_snapshot(e, "corpus", "embedding")
