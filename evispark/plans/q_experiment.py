"""Catalogue: schedules, resume, upserts, gates, cost, samples, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import numeric
from evispark.functions import text as T
from evispark.operators import audit, experiment, stats, tree
from evispark.operators.ranking import attach_row
from evispark.plans import corpus, sql
from evispark.plans.q_evaluation import PRICE_SQL, cells, rounded, trials
from evispark.plans.registry import query
from evispark.plans.sql import compose, cte

FLOWS = ["simple", "reranked", "agentic", "self_reflect", "lookahead"]
CONDITIONS = ["raw", "hybrid", "native"]
BLK = corpus.BLOCK
values = lambda xs: ", ".join(f"('{x}')" for x in xs)

cte(
    "schedule", (),
    f"""SELECT (row_number() OVER (ORDER BY item_id, md5('42|' || qid || '|' || flow), md5('42|' || qid || '|' || flow || '|' || condition)) - 1) AS schedule_index,
    qid, flow, condition FROM (SELECT item_id, item_id::VARCHAR AS qid, flow, condition FROM benchmark, (VALUES {values(FLOWS)}) f(flow), (VALUES {values(CONDITIONS)}) c(condition))""",
)


def schedule(spark, sf):
    q = corpus.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "item_id")
    return experiment.factorial_schedule(q, "item_id", F.floor(F.col("item_id") / BLK), FLOWS, CONDITIONS)


@query("factorial_schedule", compose("SELECT * FROM schedule", "schedule"))
def factorial_schedule(spark, sf):
    return schedule(spark, sf)


@query(
    "resume_remaining",
    compose(
        f"""SELECT schedule_index, qid, flow, condition FROM schedule s WHERE NOT EXISTS (SELECT 1 FROM events e
        WHERE e.user_id::VARCHAR = s.qid AND e.event_type = CASE s.flow WHEN 'simple' THEN 'click' WHEN 'reranked' THEN 'view'
          WHEN 'agentic' THEN 'error' ELSE 'none' END AND s.condition = CASE WHEN e.event_id % 2 = 0 THEN 'raw' ELSE 'hybrid' END)""",
        "schedule",
    ),
)
def resume_remaining(spark, sf):
    """Cells with no finished record; events stand for the finished ones."""
    e = corpus.table(spark, sf, "events")
    flow = F.when(F.col("event_type") == "click", "simple").when(F.col("event_type") == "view", "reranked").when(F.col("event_type") == "error", "agentic")
    done = e.select(
        F.col("user_id").cast("string").alias("qid"), flow.alias("flow"),
        F.when(F.col("event_id") % 2 == 0, "raw").otherwise("hybrid").alias("condition"),
    ).filter("flow is not null")
    return experiment.remaining(schedule(spark, sf), done, ["qid", "flow", "condition"])


TYPES = ["signup", "view", "click", "purchase", "error"]


@query(
    "grid_violations",
    compose(
        f"""SELECT CASE WHEN c.flow IS NULL THEN 'missing' WHEN c.answer_correctness IS NULL THEN 'not_finite' END AS rule,
        x.flow, x.qid, x.arm FROM (SELECT f.flow, u.qid, a.arm FROM (SELECT DISTINCT user_id AS qid FROM events) u,
          (VALUES {values(TYPES)}) f(flow), (VALUES ('raw'), ('treated')) a(arm)) x
        LEFT JOIN cells c USING (flow, qid, arm) WHERE c.flow IS NULL OR c.answer_correctness IS NULL""",
        "cells",
    ),
)
def grid_violations(spark, sf):
    users = corpus.table(spark, sf, "events").select(F.col("user_id").alias("qid")).distinct()
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    grid = users.select("qid", F.explode(lit(TYPES)).alias("flow")).select("qid", "flow", F.explode(lit(["raw", "treated"])).alias("arm"))
    return stats.missing_and_extra(cells(spark, sf), ["flow", "qid", "arm"], grid, "answer_correctness")


@query(
    "upsert_latest",
    """SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props
    FROM events GROUP BY user_id, event_type""",
)
def upsert_latest(spark, sf):
    e = corpus.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "props")
    return experiment.latest(e, ["user_id", "event_type"], "event_id")


@query(
    "joined_export",
    """SELECT o.o_orderkey, o.o_custkey, l.n_lines, round(l.cost, 4) AS cost FROM orders o LEFT JOIN (
      SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS cost FROM lineitem WHERE l_returnflag = 'R'
      GROUP BY l_orderkey) l USING (o_orderkey)""",
)
def joined_export(spark, sf):
    """Every order with the summary of its returned lines, if any."""
    judged = (
        corpus.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 4).alias("cost"))
    )
    answers = corpus.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return experiment.joined_export(answers, judged, ["o_orderkey"])


@query(
    "usage_costs",
    compose(
        "SELECT flow, arm, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, "
        "round(sum(cost), 6) AS cost_usd FROM trials GROUP BY ALL", "trials",
    ),
)
def usage_costs(spark, sf):
    return trials(spark, sf).groupBy("flow", "arm", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum("cost"), 6).alias("cost_usd"),
    )


QSET = """SELECT d.doc_id AS ord, d.lang || '-' || d.doc_id AS qid, d.source AS category, l.quality = 1 AS answerable,
  d.lang AS corpus, d.text AS question, CASE WHEN l.toxic = 1 THEN [] ELSE [(d.doc_id // 4 + 1)::INT] END AS expected_pages
  FROM documents d JOIN labels l USING (doc_id)"""


def question_set(spark, sf):
    """Labelled passages as a gold set: answerable = quality, no pages if toxic."""
    d = corpus.table(spark, sf, "documents").join(corpus.table(spark, sf, "labels"), "doc_id")
    page = F.expr("cast(doc_id div 4 + 1 as int)")
    return d.select(
        F.col("doc_id").alias("ord"), F.concat_ws("-", "lang", "doc_id").alias("qid"), F.col("source").alias("category"),
        (F.col("quality") == 1).alias("answerable"), F.col("lang").alias("corpus"), F.col("text").alias("question"),
        F.col("text").alias("reference_answer"),
        F.when(F.col("toxic") == 1, F.array().cast("array<int>")).otherwise(F.array(page)).alias("expected_pages"),
    )


@query(
    "benchmark_violations",
    f"""WITH q AS ({QSET}) SELECT rule, qid FROM (
      SELECT 'answerable_without_pages' AS rule, qid FROM q WHERE answerable AND len(expected_pages) = 0 UNION ALL
      SELECT 'control_with_pages', qid FROM q WHERE NOT answerable AND len(expected_pages) > 0 UNION ALL
      SELECT 'empty_question', qid FROM q WHERE trim(question) = '' UNION ALL
      SELECT 'empty_reference', qid FROM q WHERE trim(question) = '' UNION ALL
      SELECT 'foreign_tenant', qid FROM q WHERE corpus <> 'en')""",
)
def benchmark_violations(spark, sf):
    return experiment.benchmark_violations(question_set(spark, sf), "en")


@query(
    "benchmark_counts",
    f"""WITH q AS ({QSET}) SELECT count(*) AS total, count(*) FILTER (answerable) AS answerable,
    count(*) FILTER (NOT answerable) AS negative_or_control, count(*) FILTER (len(expected_pages) > 0) AS with_expected_pages FROM q""",
)
def benchmark_counts(spark, sf):
    return experiment.benchmark_counts(question_set(spark, sf))


@query(
    "pilot_sample",
    f"""WITH q AS ({QSET}), c AS (SELECT ord, category FROM q WHERE NOT answerable ORDER BY ord LIMIT 1),
      h AS (SELECT category, min(ord) AS ord FROM q WHERE answerable AND category NOT IN (SELECT category FROM c) GROUP BY category)
    SELECT qid, category, answerable, turn FROM (SELECT q.*, CASE WHEN q.ord IN (SELECT ord FROM c) THEN 0
      WHEN q.ord IN (SELECT ord FROM h) THEN 1 ELSE 2 END AS turn FROM q) ORDER BY turn, ord LIMIT 30""",
)
def pilot_sample(spark, sf):
    return experiment.pilot_sample(question_set(spark, sf).select("ord", "qid", "category", "answerable"), 30)


@query(
    "stratified_pilot",
    f"""WITH q AS ({QSET}) SELECT corpus, answerable, qid, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY corpus, answerable ORDER BY md5('42|' || qid), qid) AS rank FROM q) WHERE rank <= 2""",
)
def stratified_pilot(spark, sf):
    q = question_set(spark, sf).select("corpus", "answerable", "qid")
    return experiment.stratified_pilot(q, ["corpus", "answerable"], 2)


@query(
    "benchmark_assembly",
    """WITH u AS (SELECT 'b-' || item_id AS qid, text AS question, 'golden' AS source_set, 3 AS difficulty, item_id AS key FROM benchmark UNION ALL
      SELECT 'c-' || conv_id, text, 'harmonized', CASE role WHEN 'user' THEN 1 ELSE 2 END, conv_id FROM conversations WHERE turn = 0)
    SELECT u.qid, u.source_set, CASE WHEN l.quality = 0 THEN 0 ELSE u.difficulty END AS difficulty, length(u.question)::INT AS n_chars
    FROM u LEFT JOIN labels l ON l.doc_id = u.key WHERE coalesce(l.toxic, 0) <> 1""",
)
def benchmark_assembly(spark, sf):
    """Two sources in one schema, minus exclusions, with row patches."""
    b = corpus.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b-"), F.col("item_id")).alias("qid"), F.col("text").alias("question"),
        F.lit("golden").alias("source_set"), F.lit(3).alias("difficulty"), F.col("item_id").alias("key"),
    )
    level = F.coalesce(F.try_element_at(F.create_map(F.lit("user"), F.lit(1)), F.col("role")), F.lit(2))
    c = corpus.table(spark, sf, "conversations").filter("turn = 0").select(
        F.concat(F.lit("c-"), F.col("conv_id")).alias("qid"), F.col("text").alias("question"),
        F.lit("harmonized").alias("source_set"), level.alias("difficulty"), F.col("conv_id").alias("key"),
    )
    labels = corpus.table(spark, sf, "labels").withColumnRenamed("doc_id", "key")
    kept = experiment.excluded(b.unionByName(c), labels.filter("toxic = 1"), "key")
    patches = labels.filter("quality = 0").select("key", F.lit(0).alias("difficulty"))
    return experiment.patched(kept, patches, "key", ["difficulty"]).select(
        "qid", "source_set", "difficulty", F.length("question").alias("n_chars")
    )


@query(
    "question_filter",
    f"""WITH q AS ({QSET}) SELECT qid, category, corpus FROM q WHERE corpus IN ('en', 'fr') AND category IN ('src1', 'src2', 'src3')
    AND answerable AND len(expected_pages) > 0""",
)
def question_filter(spark, sf):
    """Filter by tenant and category, then the scored-question rule."""
    q = question_set(spark, sf)
    keep = F.col("corpus").isin("en", "fr") & F.col("category").isin("src1", "src2", "src3")
    return q.filter(keep & F.col("answerable") & (F.size("expected_pages") > 0)).select("qid", "category", "corpus")


@query(
    "answer_predicates",
    f"""SELECT conv_id, turn, {sql.any_of('text', T.REFUSAL_MARKERS)} AS refused, {sql.any_of('text', T.JUDGE_REFUSAL_MARKERS)} AS refused_judge,
    {sql.any_of('text', T.LOW_CONFIDENCE_MARKERS)} AS low_confidence, {sql.tokens_of('text')} AS tokens FROM conversations""",
)
def answer_predicates(spark, sf):
    t = F.col("text")
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.refused(t).alias("refused"), T.refused_judge(t).alias("refused_judge"),
        T.low_confidence(t).alias("low_confidence"), T.token_count(t).alias("tokens"),
    )


cte(
    "audit", ("questions", "expected", "chunks"),
    f"""SELECT q.qid, g.n > 0 AS answerable, f.n / g.n::DOUBLE AS page_coverage,
      CASE WHEN len(q.terms) > 0 AND f.n IS NOT NULL THEN len(list_filter(q.terms, lambda t: list_contains(f.terms, t))) / len(q.terms)::DOUBLE END AS token_coverage
    FROM (SELECT qid, {sql.audit_terms('text')} AS terms FROM questions) q
    LEFT JOIN (SELECT qid, count(*) AS n FROM expected GROUP BY qid) g USING (qid)
    LEFT JOIN (SELECT e.qid, count(DISTINCT e.page) AS n, list_distinct(flatten(list({sql.audit_terms('c.text')}))) AS terms
       FROM expected e JOIN chunks c ON list_contains(c.pages, e.page) GROUP BY e.qid) f USING (qid)""",
)


def audited(spark, sf):
    expected = corpus.expected_pages(spark, sf)
    gold = expected.select("qid").distinct().withColumn("_g", F.lit(True))
    q = corpus.questions(spark, sf).join(gold, "qid", "left").select(
        "qid", F.col("text").alias("reference"), F.coalesce("_g", F.lit(False)).alias("answerable")
    )
    return audit.lexical_audit(q, expected, corpus.chunks(spark, sf).select("doc_id", "pages", "text"))


@query(
    "lexical_audit",
    compose(
        """SELECT qid, coalesce(answerable, false) AS answerable, round(page_coverage, 6) AS page_coverage, round(token_coverage, 6) AS token_coverage,
        CASE WHEN answerable AND token_coverage < 0.25 THEN 'low_reference_token_coverage_manual_review' ELSE '' END AS flags FROM audit""",
        "audit",
    ),
)
def lexical_audit(spark, sf):
    return rounded(audited(spark, sf), "page_coverage", "token_coverage").withColumn("flags", F.array_join("flags", ","))


@query(
    "audit_summary",
    compose(
        """SELECT count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (page_coverage = 1.0) AS full_page_coverage,
        count(*) FILTER (answerable AND token_coverage < 0.25) AS flagged, round(avg(token_coverage), 6) AS mean_token_coverage FROM audit""",
        "audit",
    ),
)
def audit_summary(spark, sf):
    return rounded(audit.audit_summary(audited(spark, sf)), "mean_token_coverage")


cte(
    "ge_overlap", ("expected", "chunks", "questions"),
    f"""SELECT qid, doc_id, len(list_intersect(r, b)) / greatest(len(r), 1)::DOUBLE AS overlap FROM (
      SELECT DISTINCT e.qid, c.doc_id, list_distinct({sql.toks('q.text')}) AS r, list_distinct({sql.toks('c.text')}) AS b
      FROM expected e JOIN chunks c ON list_contains(c.pages, e.page) JOIN questions q ON q.qid = e.qid)""",
)
cte(
    "ge_pages", ("ge_overlap", "expected", "chunks"),
    """SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY page) AS i, docs FROM (
      SELECT e.qid, e.page, list(o.doc_id ORDER BY round(o.overlap, 9) DESC, o.doc_id) AS docs FROM expected e JOIN chunks c ON list_contains(c.pages, e.page)
      JOIN ge_overlap o ON o.qid = e.qid AND o.doc_id = c.doc_id GROUP BY e.qid, e.page)""",
)
cte(
    "ge_walk", ("ge_pages",),
    """SELECT qid, 0::BIGINT AS i, []::BIGINT[] AS chosen FROM (SELECT DISTINCT qid FROM ge_pages)
    UNION ALL SELECT w.qid, p.i, list_concat(w.chosen, list_filter(p.docs, lambda d: NOT list_contains(w.chosen, d))[1:1]) FROM ge_walk w JOIN ge_pages p ON p.qid = w.qid AND p.i = w.i + 1""",
)


@query(
    "gold_evidence",
    compose(
        """SELECT qid, unnest(taken) AS doc_id, generate_subscripts(taken, 1)::INT AS position FROM (
          SELECT qid, list_concat(chosen, list_filter(docs, lambda d: NOT list_contains(chosen, d)))[1:6] AS taken FROM (
            SELECT w.qid, w.chosen, o.docs FROM ge_walk w JOIN (SELECT qid, max(i) AS i FROM ge_pages GROUP BY qid) m ON m.qid = w.qid AND m.i = w.i
            JOIN (SELECT qid, list(doc_id ORDER BY round(overlap, 9) DESC, doc_id) AS docs FROM ge_overlap GROUP BY qid) o ON o.qid = w.qid))""",
        "ge_walk", "ge_pages", "ge_overlap",
    ),
)
def gold_evidence(spark, sf):
    """Sequential choice: one best unused passage a page, then the best rest."""
    expected = corpus.expected_pages(spark, sf)
    chunks = corpus.chunks(spark, sf).select("doc_id", "pages", "text")
    on = audit.page_overlap(expected, chunks)
    refs = corpus.questions(spark, sf).select("qid", F.col("text").alias("reference"))
    return audit.gold_evidence(audit.evidence_overlap(on, refs, chunks), on)


@query(
    "record_violations",
    """WITH r AS (SELECT event_id, event_type, user_id, (props::JSON->>'k')::BIGINT AS k FROM events)
    SELECT rule, event_id, event_type FROM (
      SELECT 'unknown_cell' AS rule, event_id, event_type FROM r WHERE event_type = 'error' UNION ALL
      SELECT 'answer_digest', event_id, event_type FROM r WHERE k = 7 UNION ALL
      SELECT 'token_accounting', event_id, event_type FROM r WHERE k > 90)""",
)
def record_violations(spark, sf):
    """Events as stored answers: k = 7 got a stale digest, k > 90 lost a call."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = corpus.table(spark, sf, "events").withColumn("k", k)
    call = lambda n: F.struct(n.alias("tokens"))
    records = e.select(
        "event_id", "event_type", F.col("props").alias("answer"),
        F.when(F.col("k") == 7, F.sha2(F.lit(""), 256)).otherwise(F.sha2("props", 256)).alias("answer_sha256"),
        (F.col("k") * 3).alias("tokens_total"),
        F.when(F.col("k") > 90, F.array(call(F.col("k")))).otherwise(F.array(call(F.col("k")), call(F.col("k") * 2))).alias("invocations"),
    )
    planned = e.filter("event_type <> 'error'").select("event_id", "event_type")
    return experiment.record_violations(records, planned, ["event_id", "event_type"])


@query(
    "formatted_statistics",
    compose(
        """SELECT trial, printf('%.1f%%', (k / 7.0::DOUBLE) * 100.0::DOUBLE) AS percent, printf('%+.3f [%+.3f, %+.3f]', k / 7.0::DOUBLE - 5, k / 7.0::DOUBLE - 6, k / 7.0::DOUBLE) AS interval,
        CASE WHEN k % 5 = 0 THEN 'n/a' WHEN (k % 13) / 7000.0::DOUBLE < 0.001 THEN '< 0.001' ELSE printf('%.3f', (k % 13) / 7000.0::DOUBLE) END AS p FROM trials""",
        "trials",
    ),
)
def formatted_statistics(spark, sf):
    """Shares, intervals and p-values as a report prints them."""
    x, k = F.col("k") / F.lit(7.0), F.col("k")
    p = F.when(k % 5 != 0, (k % 13) / F.lit(7000.0))
    return trials(spark, sf).select("trial", T.format_percent(x).alias("percent"), T.format_interval(x - 5, x - 6, x).alias("interval"), T.format_p(p).alias("p"))


@query(
    "normalised_times",
    compose(
        """SELECT trial, CASE trial % 5 WHEN 0 THEN d || 'T10:11:12Z' WHEN 1 THEN d || 'T08:11:12Z' WHEN 2 THEN d || 'T15:41:12Z' END AS utc, CASE WHEN trial % 4 = 0 THEN d END AS day
        FROM (SELECT trial, strftime(DATE '2020-01-01' + (trial % 2000)::INT, '%Y-%m-%d') AS d FROM trials)""",
        "trials",
    ),
)
def normalised_times(spark, sf):
    """Timestamps with a zone in UTC, others refused; dates only in their strict form."""
    d = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("trial") % 2000).cast("int")), "yyyy-MM-dd")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("T10:11:12Z", "T10:11:12+02:00", "T10:11:12.5-0530", "T10:11:12", " 10:11:12Z")]), (F.col("trial") % 5 + 1).cast("int"))
    day = F.element_at(F.array(d, F.concat(d, F.lit(" ")), F.concat(F.lit("x"), d), F.replace(d, F.lit("-"), F.lit("/"))), (F.col("trial") % 4 + 1).cast("int"))
    return trials(spark, sf).select("trial", T.utc_timestamp(F.concat(d, tail)).alias("utc"), F.date_format(T.iso_date(day), "yyyy-MM-dd").alias("day"))


@query(
    "sibling_names",
    """SELECT c_custkey AS ord, c_nationkey AS parent, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
      SELECT *, row_number() OVER (PARTITION BY c_nationkey, base ORDER BY c_custkey) AS n FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'north' WHEN c_custkey % 7 = 0 THEN 'south' ELSE 'east' END AS base FROM customer))""",
)
def sibling_names(spark, sf):
    """Customers of a nation under three names, numbered where a name is taken."""
    k = F.col("c_custkey")
    base = F.when(k % 3 == 0, "north").when(k % 7 == 0, "south").otherwise("east")
    nodes = corpus.table(spark, sf, "customer").select(F.lit(1).alias("doc"), k.alias("ord"), F.col("c_nationkey").alias("parent"), base.alias("base"))
    return tree.sibling_suffix(nodes, ["doc"], "base").select("ord", "parent", "slug")
