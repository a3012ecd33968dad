"""Catalogue: retrieval metrics, packing, paired statistics, judging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import jsonx, numeric
from evispark.functions import text as T
from evispark.operators import graph, judging, metrics, packing, ranking, stats
from evispark.operators.ranking import by_score, linear, lower_index, top_k, upper_median
from evispark.plans import corpus, sql
from evispark.plans.q_retrieval import arm_adjacent, arm_bm25, arm_dense, arm_native
from evispark.plans.registry import query
from evispark.plans.sql import compose, cte
from evispark.session import broadcast_if, fits_broadcast, settle, spread


def with_text(spark, sf, hits):
    """Attach passage columns to ranked hits; the ranked side is the small one."""
    small = fits_broadcast(corpus.table(spark, sf, "benchmark"), 50)
    chunks = spread(corpus.chunks(spark, sf).select("tenant", "doc_id", "page_number", "pages", "text"))
    return chunks.join(broadcast_if(hits, small), ["tenant", "doc_id"]).withColumn("chunk_id", corpus.chunk_name())


def with_pages(spark, sf, hits):
    small = fits_broadcast(corpus.table(spark, sf, "benchmark"), 50)
    chunks = corpus.chunks(spark, sf).select("tenant", "doc_id", "pages")
    return chunks.join(broadcast_if(hits, small), ["tenant", "doc_id"])


# --- metrics ----------------------------------------------------------------


def metrics_cte(name: str, hits: str, depth: str = "0") -> None:
    """Metrics a question over the hits CTE (qid, doc_id, rank)."""
    cte(
        name, (hits, "questions", "expected", "chunks"),
        f"""SELECT q.qid, coalesce(h.n, 0) AS retrieved, coalesce(g.n_expected, 0) > 0 AS answerable,
          CASE WHEN g.n_expected > 0 THEN coalesce(s.n_found, 0) > 0 END AS page_hit,
          CASE WHEN g.n_expected > 0 THEN coalesce(s.n_found, 0) / g.n_expected::DOUBLE END AS recall,
          CASE WHEN g.n_expected > 0 THEN coalesce(1.0::DOUBLE / s.best_rank, 0.0) END AS reciprocal_rank,
          CASE WHEN g.n_expected > 0 AND h.n > 0 THEN coalesce(s.dcg, 0.0) / (SELECT sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE))
            FROM generate_series(1, least(g.n_expected, h.n)::BIGINT) t(i)) ELSE 0.0 END AS ndcg,
          coalesce(h.linked, 0) AS linked,
          CASE WHEN h.n > 0 THEN h.linked / h.n::DOUBLE ELSE 0.0 END AS linked_share
        FROM questions q
        LEFT JOIN (SELECT qid, count(*) AS n, count(*) FILTER ({depth} > 0) AS linked FROM {hits} GROUP BY qid) h USING (qid)
        LEFT JOIN (SELECT qid, count(*) AS n_expected FROM expected GROUP BY qid) g USING (qid)
        LEFT JOIN (SELECT qid, sum(np)::BIGINT AS n_found, min(first_rank) AS best_rank,
                     sum(1.0::DOUBLE / log2(first_rank + 1.0::DOUBLE)) AS dcg
                   FROM (SELECT qid, first_rank, count(*) AS np FROM (
                           SELECT h.qid, e.page, min(h.rank) AS first_rank FROM {hits} h
                           JOIN chunks c ON c.doc_id = h.doc_id JOIN expected e ON e.qid = h.qid
                           WHERE list_contains(c.pages, e.page) GROUP BY ALL) GROUP BY ALL) GROUP BY qid) s USING (qid)""",
    )


metrics_cte("m_bm25", "bm25_10")
metrics_cte("m_native", "native_10", "link_depth")
metrics_cte("m_dense", "dense_10")
METRIC_COLS = (
    "qid, retrieved, answerable, page_hit, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, "
    "round(ndcg, 6) AS ndcg, linked, round(linked_share, 6) AS linked_share"
)


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def arm_metrics(spark, sf, hits):
    return metrics.page_metrics(
        with_pages(spark, sf, hits), corpus.questions(spark, sf), corpus.expected_pages(spark, sf)
    )


@query("gold_documents", compose("SELECT qid, doc_id, page_number FROM gold", "gold"))
def gold_documents(spark, sf):
    return corpus.gold_documents(spark, sf).select("qid", "doc_id", "page_number")


@query("retrieval_metrics", compose(f"SELECT {METRIC_COLS} FROM m_bm25", "m_bm25"))
def retrieval_metrics(spark, sf):
    return rounded(arm_metrics(spark, sf, arm_bm25(spark, sf, 10)), "recall", "reciprocal_rank", "ndcg", "linked_share")


@query("retrieval_metrics_linked", compose(f"SELECT {METRIC_COLS} FROM m_native", "m_native"))
def retrieval_metrics_linked(spark, sf):
    return rounded(arm_metrics(spark, sf, arm_native(spark, sf, 10)), "recall", "reciprocal_rank", "ndcg", "linked_share")


def three_arms(spark, sf) -> DataFrame:
    """Hits of three arms in one relation, so metrics run once over all."""
    arms = {"bm25": arm_bm25(spark, sf, 10), "links": arm_native(spark, sf, 10), "dense": arm_dense(spark, sf, 10)}
    hits = [
        d.select("qid", "tenant", "doc_id", "rank", F.lit(a).alias("arm")) for a, d in arms.items()
    ]
    asked = corpus.questions(spark, sf).select("qid", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    return metrics.page_metrics(
        with_pages(spark, sf, reduce(DataFrame.unionByName, hits)), asked, corpus.expected_pages(spark, sf),
        ["qid", "arm"],
    )


THREE = (
    "(SELECT 'bm25' AS arm, * FROM m_bm25 UNION ALL SELECT 'links', * FROM m_native UNION ALL SELECT 'dense', * FROM m_dense)"
)


@query(
    "arm_summary",
    compose(
        f"""SELECT arm, count(*) AS n, round(avg(page_hit::INT), 6) AS page_hit, round(avg(recall), 6) AS recall,
        round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM {THREE} WHERE answerable GROUP BY arm""",
        "m_bm25", "m_native", "m_dense",
    ),
)
def arm_summary(spark, sf):
    return rounded(metrics.arm_summary(three_arms(spark, sf)), "page_hit", "recall", "mrr", "ndcg")


def p_rounded():
    """Powers of two end on rounding ties; the nudge keeps engines on one side."""
    return {c: F.round(F.col(c) + F.lit(1e-13), 9) for c in ("p", "p_holm")}


CONTRASTS = [("links_vs_bm25", "bm25", "links"), ("dense_vs_bm25", "bm25", "dense"), ("dense_vs_links", "links", "dense")]


def mcnemar_sql(counts: str, keys: str, family: str = "1") -> str:
    """Holm-corrected exact McNemar over counts (keys, n, baseline_only, treatment_only)."""
    return f"""SELECT {keys}, n, baseline_only, treatment_only, discordant, round(p + 1e-13::DOUBLE, 9) AS p, round(p_holm + 1e-13::DOUBLE, 9) AS p_holm
    FROM (SELECT *, max(least(1.0::DOUBLE, (m - rn + 1) * p)) OVER (ORDER BY rn) AS p_holm
      FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p, 12), {keys}) AS rn
        FROM (SELECT *, baseline_only + treatment_only AS discordant,
            CASE WHEN baseline_only + treatment_only = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * (
              SELECT sum(exp(lgamma(baseline_only + treatment_only + 1) - lgamma(i + 1)
                - lgamma(baseline_only + treatment_only - i + 1) - (baseline_only + treatment_only) * ln(2.0::DOUBLE)))
              FROM generate_series(0, least(baseline_only, treatment_only)) t(i))) END AS p
          FROM {counts})))"""


@query(
    "arm_contrasts",
    compose(
        mcnemar_sql(
            """(SELECT c.label, count(*) AS n, count(*) FILTER (a.page_hit AND NOT b.page_hit) AS baseline_only,
            count(*) FILTER (NOT a.page_hit AND b.page_hit) AS treatment_only
            FROM (VALUES ('links_vs_bm25', 'bm25', 'links'), ('dense_vs_bm25', 'bm25', 'dense'),
              ('dense_vs_links', 'links', 'dense')) c(label, ba, ta)
            JOIN three a ON a.arm = c.ba JOIN three b ON b.arm = c.ta AND b.qid = a.qid
            WHERE a.answerable GROUP BY c.label)""",
            "label",
        ),
        "three", extra={"three": (("m_bm25", "m_native", "m_dense"), f"SELECT * FROM {THREE}")},
    ),
)
def arm_contrasts(spark, sf):
    """Named arm pairs on page hits, Holm-corrected as one family."""
    wide = three_arms(spark, sf).filter("answerable").groupBy("qid").agg(
        *[F.max(F.when(F.col("arm") == a, F.col("page_hit"))).alias(a) for a in ("bm25", "links", "dense")]
    )
    pairs = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("label"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in CONTRASTS])
        ).alias("c")
    ).select("c.*")
    tests = stats.mcnemar(pairs, ["label"], F.col("a"), F.col("b"))
    done = stats.holm(tests.withColumn("family", F.lit("diagnostic")), ["family"], "label").drop("family")
    return done.withColumns(p_rounded())


# --- packing ----------------------------------------------------------------

BLOCK_SQL = (
    f"'[' || {sql.CHUNK_NAME.replace('tenant', 'h.tenant').replace('doc_id', 'h.doc_id')} || ' | p.' || c.page_number || ']' || chr(10) || c.text"
)
cte(
    "blocks", ("bm25_40", "chunks"),
    f"SELECT *, {sql.tokens_of('block')} AS tokens FROM (SELECT h.qid, h.tenant, h.doc_id, h.rank, c.pages, {BLOCK_SQL} AS block "
    "FROM bm25_40 h JOIN chunks c ON c.doc_id = h.doc_id)",
)
cte(
    "packed_prefix", ("blocks",),
    "SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS running_tokens FROM blocks) "
    "WHERE rank = 1 OR running_tokens <= 2200",
)


def skip_cte(name: str, units: str) -> None:
    """Recursive fold in rank order: take what fits, skip what does not."""
    cte(
        f"{name}_walk", (units,),
        f"""SELECT qid, 0::BIGINT AS rank, 2200::BIGINT AS remaining, false AS taken FROM (SELECT DISTINCT qid FROM {units})
        UNION ALL
        SELECT u.qid, u.rank, CASE WHEN w.remaining > 0 AND u.tokens <= w.remaining THEN w.remaining - u.tokens ELSE w.remaining END,
          w.remaining > 0 AND u.tokens <= w.remaining
        FROM {name}_walk w JOIN {units} u ON u.qid = w.qid AND u.rank = w.rank + 1""",
    )
    cte(name, (f"{name}_walk", units),
        f"SELECT u.* FROM {units} u JOIN {name}_walk w ON w.qid = u.qid AND w.rank = u.rank AND w.taken")


cte(
    "units_40", ("bm25_40", "chunks"),
    f"SELECT h.qid, h.tenant, h.doc_id, h.rank, c.pages, c.page_number, 0 AS link_depth, {sql.tokens_of('c.text')} AS tokens "
    "FROM bm25_40 h JOIN chunks c ON c.doc_id = h.doc_id",
)
skip_cte("packed_skip", "units_40")
cte(
    "linked_40", ("native_40", "chunks"),
    f"SELECT h.qid, h.tenant, h.doc_id, h.rank, c.pages, c.page_number, h.link_depth, {sql.tokens_of('c.text')} AS tokens "
    "FROM native_40 h JOIN chunks c ON c.doc_id = h.doc_id",
)
skip_cte("packed_linked", "linked_40")


def units_40(spark, sf, hits=None):
    hits = arm_bm25(spark, sf, 40) if hits is None else hits
    return with_text(spark, sf, hits).withColumn("tokens", T.token_count(F.col("text")))


@query(
    "pack_prefix_context",
    compose("SELECT qid, rank::INT AS rank, doc_id, tokens, running_tokens, sha256(block) AS block_sha FROM packed_prefix", "packed_prefix"),
)
def pack_prefix_context(spark, sf):
    packed = packing.pack_prefix(packing.context_blocks(with_text(spark, sf, arm_bm25(spark, sf, 40))))
    return packed.select("qid", "rank", "doc_id", "tokens", "running_tokens", F.sha2("block", 256).alias("block_sha"))


@query("pack_skip_units", compose("SELECT qid, rank::INT AS rank, doc_id, tokens FROM packed_skip", "packed_skip"))
def pack_skip_units(spark, sf):
    return packing.pack_skip(units_40(spark, sf).select("qid", "rank", "doc_id", "tokens"))


REDUNDANCY = """SELECT qid, CASE WHEN sum(tokens) > 0 THEN sum(CASE WHEN dup THEN tokens ELSE 0 END) / sum(tokens)::DOUBLE ELSE 0.0 END AS redundancy
  FROM (SELECT p.qid, p.rank, p.tokens, (SELECT bool_and(EXISTS (SELECT 1 FROM {0} o WHERE o.qid = p.qid AND o.rank < p.rank
     AND list_contains(o.pages, x.pg))) FROM (SELECT unnest(p.pages) AS pg) x) AS dup FROM {0} p) GROUP BY qid"""
metrics_cte("m_packed", "packed_skip")


@query(
    "context_metrics",
    compose(
        f"""SELECT m.qid, coalesce(s.n_units, 0) AS n_units, coalesce(s.n_tokens, 0) AS n_tokens, coalesce(s.n_pages, 0) AS n_pages,
        coalesce(m.page_hit, false) AS page_hit, round(m.recall, 6) AS recall,
        round(coalesce(m.reciprocal_rank, 0.0), 6) AS reciprocal_rank, round(r.redundancy, 6) AS redundancy
        FROM m_packed m LEFT JOIN (SELECT qid, count(*) AS n_units, sum(tokens)::BIGINT AS n_tokens,
          len(list_distinct(flatten(list(pages))))::BIGINT AS n_pages FROM packed_skip GROUP BY qid) s USING (qid)
        LEFT JOIN ({REDUNDANCY.format('packed_skip')}) r USING (qid)""",
        "m_packed", "packed_skip",
    ),
)
def context_metrics(spark, sf):
    packed = packing.pack_skip(units_40(spark, sf).select("qid", "rank", "tokens", "pages"))
    m = metrics.context_metrics(packed, corpus.questions(spark, sf), corpus.expected_pages(spark, sf))
    return rounded(m, "recall", "reciprocal_rank", "redundancy")


@query(
    "link_mechanism",
    compose(
        """SELECT p.qid, count(*) AS packed, count(*) FILTER (p.link_depth > 0) AS traversed,
        coalesce(any_value(o.n), 0) AS pages_only_by_links FROM packed_linked p
        LEFT JOIN (SELECT qid, count(*) AS n FROM (SELECT l.qid, e.page, min(l.link_depth) AS nearest FROM packed_linked l
          JOIN expected e ON e.qid = l.qid AND list_contains(l.pages, e.page) GROUP BY ALL) WHERE nearest > 0 GROUP BY qid) o
        ON o.qid = p.qid GROUP BY p.qid""",
        "packed_linked", "expected",
    ),
)
def link_mechanism(spark, sf):
    hits = arm_native(spark, sf, 40, seed_k=20)
    packed = packing.pack_skip(units_40(spark, sf, hits).select("qid", "rank", "tokens", "pages", "link_depth"))
    return metrics.link_mechanism(packed, corpus.questions(spark, sf), corpus.expected_pages(spark, sf))


def sized(spark, sf):
    return corpus.chunks(spark, sf).select("doc_id", "tenant", T.token_count(F.col("text")).alias("tokens"))


@query(
    "oversized_units",
    compose(f"SELECT doc_id, tenant, {sql.tokens_of('text')} AS tokens FROM chunks WHERE {sql.tokens_of('text')} > 2200", "chunks"),
)
def oversized_units(spark, sf):
    return packing.oversized(sized(spark, sf))


@query(
    "unit_size_statistics",
    compose(
        """SELECT tenant, count(*) AS n, max(tokens) AS largest, min(tokens) AS smallest,
        floor(sum(tokens) / count(*))::BIGINT AS integer_mean,
        (list_sort(list(tokens))[(count(*) // 2)::INT + 1])::DOUBLE AS upper_median,
        (list_sort(list(tokens))[floor((count(*) - 1) * 0.9::DOUBLE)::INT + 1])::DOUBLE AS p90_lower,
        quantile_cont(tokens::DOUBLE, 0.5) AS median, round(avg((tokens > 256)::INT), 6) AS truncated_share,
        round(avg(least(1.0::DOUBLE, 256.0::DOUBLE / tokens)), 6) AS mean_retained FROM sizes GROUP BY tenant""",
        "sizes", extra={"sizes": (("chunks",), f"SELECT doc_id, tenant, {sql.tokens_of('text')} AS tokens FROM chunks")},
    ),
)
def unit_size_statistics(spark, sf):
    s = settle(sized(spark, sf))  # three passes read the counts
    plain = s.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest"), F.min("tokens").alias("smallest"),
        F.floor(F.sum("tokens") / F.count(F.lit(1))).alias("integer_mean"),
        F.round(F.avg((F.col("tokens") > 256).cast("double")), 6).alias("truncated_share"),
        F.round(F.avg(F.least(F.lit(1.0), F.lit(256.0) / F.col("tokens"))), 6).alias("mean_retained"),
    )
    order = ranking.exact_percentiles(
        s, ["tenant"], "tokens", {"upper_median": upper_median(), "p90_lower": lower_index(0.9), "median": linear(0.5)}
    )
    return plain.join(order, "tenant")


# --- cells derived from events ----------------------------------------------
# pipeline -> event type, question -> user, arm -> parity, trial -> event.

# Models of the price table, dearest first, as test values.
DEAR, MIDDLE, CHEAP = (next(m for m in numeric.PRICES if name in m) for name in ("sonnet", "haiku", "4o-mini"))
TRIAL_SQL = f"""SELECT event_type AS flow, user_id AS qid, CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'treated' END AS arm,
  event_id AS trial, user_id % 5 <> 0 AS answerable,
  CASE WHEN k % 4 = 0 THEN 'refusal' ELSE 'substantive_answer' END AS disposition,
  1 + k % 5 AS correctness, 1 + (k // 5) % 5 AS completeness, 1 + (k // 7) % 5 AS groundedness, 1 + (k // 3) % 5 AS citation_quality,
  1 + k % 3 AS attempts, value AS latency, k * 100 AS tokens_in, k * 10 AS tokens_out,
  CASE event_type WHEN 'click' THEN '{CHEAP}' WHEN 'view' THEN '{MIDDLE}'
    WHEN 'error' THEN 'unlisted' WHEN 'signup' THEN 'mock' ELSE '{DEAR}' END AS model, k
FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events)"""
PRICE_SQL = "CASE model " + " ".join(
    f"WHEN '{m}' THEN tokens_in / 1e6::DOUBLE * {i}::DOUBLE + tokens_out / 1e6::DOUBLE * {o}::DOUBLE"
    for m, (i, o) in numeric.PRICES.items()
) + " ELSE 0.0 END"
cte("trials0", (), TRIAL_SQL)
cte(
    "trials", ("trials0",),
    f"""SELECT *, {PRICE_SQL} AS cost,
    CASE WHEN answerable THEN CASE WHEN disposition = 'refusal' THEN 1.0 ELSE correctness::DOUBLE END END AS answer_correctness,
    CASE WHEN answerable THEN CASE WHEN disposition = 'refusal' THEN 1.0 ELSE completeness::DOUBLE END END AS answer_completeness,
    CASE WHEN answerable AND disposition <> 'refusal' THEN groundedness::DOUBLE END AS o_groundedness,
    CASE WHEN answerable AND disposition <> 'refusal' THEN citation_quality::DOUBLE END AS o_citation_quality,
    CASE WHEN NOT answerable THEN (disposition = 'refusal')::INT::DOUBLE END AS negative_refusal_correct FROM trials0""",
)
CELL = "flow, qid, arm"
cte(
    "cells", ("trials",),
    f"""SELECT {CELL}, bool_or(answerable) AS answerable, avg(answer_correctness) AS answer_correctness,
    avg(answer_completeness) AS answer_completeness, avg(o_groundedness) AS groundedness, avg(o_citation_quality) AS citation_quality,
    avg(negative_refusal_correct) AS negative_refusal_correct, avg((disposition = 'refusal')::INT) AS refusal_fraction,
    count(*) AS judge_trials, sum(attempts)::BIGINT AS judge_attempts, sum(cost) AS judge_cost_usd FROM trials GROUP BY ALL""",
)


def trials(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = corpus.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))
    kk = F.col("k")
    part = lambda d: (F.expr(f"cast(k div {d} as int)") % 5 + 1)
    model = (
        F.when(F.col("event_type") == "click", CHEAP)
        .when(F.col("event_type") == "view", MIDDLE)
        .when(F.col("event_type") == "error", "unlisted")
        .when(F.col("event_type") == "signup", "mock")
        .otherwise(DEAR)
    )
    t = e.select(
        F.col("event_type").alias("flow"), F.col("user_id").alias("qid"),
        F.when(F.col("event_id") % 2 == 0, F.lit("raw")).otherwise(F.lit("treated")).alias("arm"),
        F.col("event_id").alias("trial"), (F.col("user_id") % 5 != 0).alias("answerable"),
        F.when(kk % 4 == 0, F.lit("refusal")).otherwise(F.lit("substantive_answer")).alias("disposition"),
        (kk % 5 + 1).alias("correctness"), part(5).alias("completeness"), part(7).alias("groundedness"),
        part(3).alias("citation_quality"), (kk % 3 + 1).alias("attempts"), F.col("value").alias("latency"),
        (kk * 100).alias("tokens_in"), (kk * 10).alias("tokens_out"), model.alias("model"), "k",
    )
    o = judging.outcomes(F.col("answerable"), F.col("disposition"), {s: F.col(s) for s in jsonx.SCORES})
    cost = numeric.usage_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    # The outcome columns replace two raw scores of the same name.
    kept = {f"raw_{s}": F.col(s) for s in jsonx.SCORES}
    return t.withColumn("cost", cost).withColumns(kept).withColumns(o)


CELL_KEYS = ["flow", "qid", "arm", "answerable"]


def cells(spark, sf):
    return judging.answer_scores(trials(spark, sf), CELL_KEYS)


@query(
    "derived_outcomes",
    compose(
        "SELECT trial, answer_correctness, answer_completeness, o_groundedness AS groundedness, "
        "o_citation_quality AS citation_quality, negative_refusal_correct, round(cost, 9) AS cost FROM trials", "trials",
    ),
)
def derived_outcomes(spark, sf):
    return trials(spark, sf).select(
        "trial", *judging.OUTCOMES, "negative_refusal_correct", F.round("cost", 9).alias("cost")
    )


SCORE_COLS = ("answer_correctness", "answer_completeness", "groundedness", "citation_quality",
              "negative_refusal_correct", "refusal_fraction", "judge_cost_usd")


@query(
    "answer_scores",
    compose(
        f"SELECT {CELL}, answerable, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS)
        + ", judge_trials, judge_attempts FROM cells", "cells",
    ),
)
def answer_scores(spark, sf):
    return rounded(cells(spark, sf), *SCORE_COLS)


@query(
    "judge_reliability",
    compose(
        f"""SELECT count(*) AS answer_cells, sum(n)::BIGINT AS trial_records, sum(retries)::BIGINT AS schema_retry_count,
        round(sum(retried) / sum(n)::DOUBLE, 6) AS schema_retry_rate, count(*) FILTER (answerable) AS positive_answer_cells,
        round(avg(CASE WHEN answerable THEN (hi = lo)::INT END), 6) AS exact_agreement,
        round(avg(CASE WHEN answerable THEN hi - lo END), 6) AS mean_range
        FROM (SELECT {CELL}, bool_or(answerable) AS answerable, count(*) AS n, count(*) FILTER (attempts > 1) AS retried,
          sum(attempts - 1) AS retries, max(answer_correctness) AS hi, min(answer_correctness) AS lo FROM trials GROUP BY ALL)""",
        "trials",
    ),
)
def judge_reliability(spark, sf):
    r = judging.reliability(trials(spark, sf), ["flow", "qid", "arm"])
    return rounded(r, "schema_retry_rate", "exact_agreement", "mean_range")


@query(
    "rubric_saturation",
    compose(
        """SELECT arm, dimension, count(*) AS trials_scored, round(avg(v), 6) AS mean, round(avg((v >= 5)::INT), 6) AS at_ceiling,
        array_to_string(list_sort(list_distinct(list(v::INT))), ',') AS distinct_values, avg((v >= 5)::INT) < 0.98 AS discriminating
        FROM (SELECT arm, 'answer_correctness' AS dimension, answer_correctness AS v FROM trials UNION ALL
          SELECT arm, 'answer_completeness', answer_completeness FROM trials UNION ALL
          SELECT arm, 'groundedness', o_groundedness FROM trials UNION ALL
          SELECT arm, 'citation_quality', o_citation_quality FROM trials) WHERE v IS NOT NULL GROUP BY ALL""",
        "trials",
    ),
)
def rubric_saturation(spark, sf):
    return rounded(judging.saturation(trials(spark, sf), ["arm"]), "mean", "at_ceiling")


RUBRIC_SQL = {n: f"(1 + (k // {d}) % 5)::DOUBLE" for n, d in zip(judging.RUBRIC, (1, 2, 3, 5, 7, 11))}


@query(
    "rubric_summary",
    compose(
        "SELECT flow, qid, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in judging.RUBRIC)
        + ", round(stddev_pop((r1 + r2 + r3 + g1 + g2 + g3) / 6), 6) AS overall_std, round(sum(cost), 6) AS total_cost, "
        "count(*) AS n_trials, round((avg(r1) + avg(r2) + avg(r3)) / 3, 6) AS retrieval_mean, "
        "round((avg(g1) + avg(g2) + avg(g3)) / 3, 6) AS generation_mean, "
        "round((avg(r1) + avg(r2) + avg(r3) + avg(g1) + avg(g2) + avg(g3)) / 6, 6) AS overall_mean "
        "FROM (SELECT flow, qid, cost, " + ", ".join(f"{e} AS {n}" for n, e in RUBRIC_SQL.items()) + " FROM trials) GROUP BY ALL",
        "trials",
    ),
)
def rubric_summary(spark, sf):
    t = trials(spark, sf)
    for n, d in zip(judging.RUBRIC, (1, 2, 3, 5, 7, 11)):
        t = t.withColumn(n, (F.expr(f"k div {d}") % 5 + 1).cast("double"))
    r = judging.rubric_summary(t, ["flow", "qid"])
    return rounded(r, *judging.RUBRIC, "overall_std", "total_cost", "retrieval_mean", "generation_mean", "overall_mean")


@query(
    "descriptive_table",
    compose(
        """SELECT flow, arm, count(*) AS n, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_controls,
        round(avg(answer_correctness), 6) AS answer_correctness, round(avg(groundedness), 6) AS groundedness,
        round(avg(CASE WHEN answerable THEN refusal_fraction END), 6) AS positive_refusal_rate,
        round(avg(negative_refusal_correct), 6) AS control_refusal_accuracy, round(avg(judge_cost_usd), 6) AS mean_judge_cost_usd,
        round(any_value(l.median), 6) AS median_latency_ms, round(any_value(l.p95), 6) AS p95_latency_ms
        FROM cells JOIN (SELECT flow, arm, quantile_cont(latency, 0.5) AS median, quantile_cont(latency, 0.95) AS p95
          FROM trials GROUP BY ALL) l USING (flow, arm) GROUP BY flow, arm""",
        "cells", "trials",
    ),
)
def descriptive_table(spark, sf):
    positive = F.col("answerable")
    means = cells(spark, sf).groupBy("flow", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_answerable"), F.count_if(~positive).alias("n_controls"),
        F.avg("answer_correctness").alias("answer_correctness"), F.avg("groundedness").alias("groundedness"),
        F.avg(F.when(positive, F.col("refusal_fraction"))).alias("positive_refusal_rate"),
        F.avg("negative_refusal_correct").alias("control_refusal_accuracy"),
        F.avg("judge_cost_usd").alias("mean_judge_cost_usd"),
    )
    latency = ranking.exact_percentiles(
        trials(spark, sf), ["flow", "arm"], "latency", {"median_latency_ms": linear(0.5), "p95_latency_ms": linear(0.95)}
    )
    return rounded(
        means.join(latency, ["flow", "arm"]), "answer_correctness", "groundedness", "positive_refusal_rate",
        "control_refusal_accuracy", "mean_judge_cost_usd", "median_latency_ms", "p95_latency_ms",
    )


cte(
    "pairs", ("cells",),
    """SELECT r.flow, r.qid, r.answer_correctness AS raw, t.answer_correctness AS treated,
    t.answer_correctness - r.answer_correctness AS difference FROM cells r JOIN cells t ON t.flow = r.flow AND t.qid = r.qid
    WHERE r.arm = 'raw' AND t.arm = 'treated' AND r.answer_correctness IS NOT NULL AND t.answer_correctness IS NOT NULL""",
)


def pairs(spark, sf):
    return stats.paired(cells(spark, sf), ["flow", "qid"], "arm", "raw", "treated", "answer_correctness")


@query(
    "paired_differences",
    compose("SELECT flow, qid, round(raw, 6) AS raw, round(treated, 6) AS treated, round(difference, 6) AS difference FROM pairs", "pairs"),
)
def paired_differences(spark, sf):
    return rounded(pairs(spark, sf), "raw", "treated", "difference")


WILCOXON_SQL = """SELECT flow, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN rk END) AS w_plus,
    (sum(CASE WHEN d > 0 THEN rk ELSE 0 END) - count(*) * (count(*) + 1) / 4.0::DOUBLE)
      / sqrt(count(*) * (count(*) + 1.0::DOUBLE) * (2 * count(*) + 1) / 24 - sum((c * c - 1)) / 48.0::DOUBLE) AS z
  FROM (SELECT flow, d, rank() OVER (PARTITION BY flow ORDER BY abs(d)) + (count(*) OVER (PARTITION BY flow, abs(d)) - 1) / 2.0::DOUBLE AS rk,
     count(*) OVER (PARTITION BY flow, abs(d)) AS c FROM (SELECT flow, round(difference, 12) AS d FROM pairs) WHERE d <> 0) GROUP BY flow"""


@query(
    "paired_comparison",
    compose(
        f"""SELECT p.flow, count(*) AS n, round(avg(raw), 6) AS raw_mean, round(avg(treated), 6) AS treated_mean,
        round(avg(difference), 6) AS mean_delta, round(quantile_cont(difference, 0.5), 6) AS median_delta,
        count(*) FILTER (round(difference, 12) > 0) AS wins, count(*) FILTER (round(difference, 12) = 0) AS ties,
        count(*) FILTER (round(difference, 12) < 0) AS losses, any_value(w.n_nonzero) AS n_nonzero,
        round(any_value(w.w_plus), 6) AS w_plus, round(any_value(w.z), 6) AS z
        FROM pairs p LEFT JOIN ({WILCOXON_SQL}) w USING (flow) GROUP BY p.flow""",
        "pairs",
    ),
)
def paired_comparison(spark, sf):
    p = pairs(spark, sf)
    d = F.round("difference", 12)
    plain = p.groupBy("flow").agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw_mean"), F.avg("treated").alias("treated_mean"),
        F.avg("difference").alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"),
        F.count_if(d < 0).alias("losses"),
    )
    median = ranking.exact_percentiles(p, ["flow"], "difference", {"median_delta": linear(0.5)})
    w = stats.wilcoxon(p, ["flow"]).select("flow", "n_nonzero", "w_plus", "z")
    return rounded(
        plain.join(median, "flow").join(w, "flow"), "raw_mean", "treated_mean", "mean_delta", "median_delta", "w_plus", "z"
    )


sql.wilcoxon("wx", "flow", "pairs")
TEST_COLS = "n_nonzero, round(w_plus, 6) AS w_plus, round(z, 6) AS z, round(p, 6) AS p, round(p_exact, 6) AS p_exact, method"


@query(
    "wilcoxon_p_values",
    compose(f"SELECT flow, {TEST_COLS}, round(p_holm, 6) AS p_holm FROM ({sql.holm('SELECT *, 1 AS family FROM wx', 'family', 'flow')})", "wx"),
)
def wilcoxon_p_values(spark, sf):
    tests = stats.wilcoxon(pairs(spark, sf), ["flow"]).withColumn("family", F.lit("confirmatory"))
    return rounded(stats.holm(tests, ["family"], "flow").drop("family"), "w_plus", "z", "p", "p_exact", "p_holm")


cte(
    "latency_pairs", ("trials",),
    """SELECT r.qid, r.flow, t.latency - r.latency AS difference FROM (SELECT flow, qid, avg(latency) AS latency FROM trials WHERE arm = 'raw' GROUP BY ALL) r
    JOIN (SELECT flow, qid, avg(latency) AS latency FROM trials WHERE arm = 'treated' GROUP BY ALL) t USING (flow, qid)""",
)
sql.wilcoxon("wx_question", "qid", "latency_pairs")


@query("wilcoxon_by_question", compose(f"SELECT qid, {TEST_COLS} FROM wx_question", "wx_question"))
def wilcoxon_by_question(spark, sf):
    """Latencies of the two arms over the flows of each question: small groups, exact p."""
    mean = trials(spark, sf).groupBy("flow", "qid", "arm").agg(F.avg("latency").alias("latency"))
    p = stats.paired(mean, ["flow", "qid"], "arm", "raw", "treated", "latency")
    return rounded(stats.wilcoxon(p, ["qid"]), "w_plus", "z", "p", "p_exact")


BOOT = 10000
DRAWN = {"cl": (("pairs",), "SELECT row_number() OVER (ORDER BY qid) - 1 AS i, qid, sum(difference) AS s, count(*) AS n FROM pairs GROUP BY qid")}
DRAWN_BY_FLOW = {
    "cl_flow": (("pairs",), "SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY qid) - 1 AS i, qid, sum(difference) AS s, count(*) AS n FROM pairs GROUP BY flow, qid"),
    "ci_flow": (("cl_flow",), f"SELECT flow, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM ({sql.drawn('cl_flow', ('flow',), BOOT, 42, stats.BLOCK_CLUSTERS)}) GROUP BY flow"),
}
CI_COLS = ("mean_difference", "ci_low", "ci_high")


@query(
    "cluster_bootstrap",
    compose(
        f"""SELECT (SELECT count(*) FROM cl) AS n_clusters, (SELECT count(difference) FROM pairs) AS n_differences,
        round((SELECT sum(difference) / count(*) FROM pairs), 6) AS mean_difference,
        round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
        FROM ({sql.drawn('cl', (), BOOT, 42, stats.BLOCK_CLUSTERS)})""",
        "cl", extra=DRAWN,
    ),
)
def cluster_bootstrap(spark, sf):
    block = F.floor(F.col("qid") / corpus.BLOCK)
    return rounded(stats.cluster_bootstrap(pairs(spark, sf), "qid", block, repetitions=BOOT), *CI_COLS)


@query(
    "bootstrap_by_flow",
    compose(
        """SELECT flow, count(*) AS n_clusters, sum(n)::BIGINT AS n_differences, round(sum(s) / sum(n), 6) AS mean_difference,
        round(any_value(ci_low), 6) AS ci_low, round(any_value(ci_high), 6) AS ci_high FROM cl_flow JOIN ci_flow USING (flow) GROUP BY flow""",
        "cl_flow", "ci_flow", extra=DRAWN_BY_FLOW,
    ),
)
def bootstrap_by_flow(spark, sf):
    """Row bootstrap of every flow: one difference a question."""
    block = F.floor(F.col("qid") / corpus.BLOCK)
    return rounded(stats.cluster_bootstrap(pairs(spark, sf), "qid", block, repetitions=BOOT, keys=["flow"]), *CI_COLS)


@query(
    "comparison_table",
    compose(
        f"""SELECT flow, 'treated' AS treatment, n_pairs, round(raw_mean, 6) AS raw_mean, round(treatment_mean, 6) AS treatment_mean,
        round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
        improved, tied, worse, round(p, 6) AS wilcoxon_p, round(p_holm, 6) AS holm_p, family AS multiplicity_family, m AS multiplicity_family_size
        FROM (SELECT flow, count(*) AS n_pairs, avg(raw) AS raw_mean, avg(treated) AS treatment_mean, avg(difference) AS mean_delta,
            quantile_cont(difference, 0.5) AS median_delta, count(*) FILTER (round(difference, 12) > 0) AS improved,
            count(*) FILTER (round(difference, 12) = 0) AS tied, count(*) FILTER (round(difference, 12) < 0) AS worse FROM pairs GROUP BY flow)
        JOIN ci_flow USING (flow) JOIN ({sql.holm("SELECT flow, p, 'treated' AS family FROM wx", 'family', 'flow')}) USING (flow)""",
        "pairs", "ci_flow", "wx", extra=DRAWN_BY_FLOW,
    ),
)
def comparison_table(spark, sf):
    """Every flow's paired comparison with its interval, exact or normal p, and the p adjusted within the treatment's family."""
    block = F.floor(F.col("qid") / corpus.BLOCK)
    table = stats.comparison_table(pairs(spark, sf), "flow", "qid", block, "treated", repetitions=BOOT)
    return rounded(table, "raw_mean", "treatment_mean", "mean_delta", "median_delta", "ci_low", "ci_high", "wilcoxon_p", "holm_p")


cte(
    "whole_pairs", ("pairs",),
    "SELECT * FROM pairs WHERE qid IN (SELECT qid FROM pairs GROUP BY qid HAVING count(*) = (SELECT count(DISTINCT flow) FROM pairs))",
)


@query(
    "pooled_cluster_interval",
    compose(
        f"""SELECT (SELECT count(*) FROM cl_whole) AS n_clusters, (SELECT count(difference) FROM whole_pairs) AS n_differences,
        round((SELECT sum(difference) / count(*) FROM whole_pairs), 6) AS mean_difference,
        round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
        FROM ({sql.drawn('cl_whole', (), BOOT, 42, stats.BLOCK_CLUSTERS)})""",
        "cl_whole", "whole_pairs",
        extra={"cl_whole": (("whole_pairs",), "SELECT row_number() OVER (ORDER BY qid) - 1 AS i, qid, sum(difference) AS s, count(*) AS n FROM whole_pairs GROUP BY qid")},
    ),
)
def pooled_cluster_interval(spark, sf):
    """All flows pooled over the questions that every flow has answered twice."""
    p = pairs(spark, sf)
    flows = p.agg(F.count_distinct("flow").alias("flows"))
    whole = ranking.attach_row(p.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), flows).filter("n = flows").select("qid")
    kept = settle(p.join(whole, "qid"))
    block = F.floor(F.col("qid") / corpus.BLOCK)
    return rounded(stats.pooled_bootstrap(kept, "qid", "flow", block, repetitions=BOOT), *CI_COLS)


@query(
    "pooled_matrix_gaps",
    compose("SELECT q.qid, f.flow, 'missing' AS rule FROM (SELECT DISTINCT qid FROM pairs) q, (SELECT DISTINCT flow FROM pairs) f "
            "WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.qid = q.qid AND p.flow = f.flow)", "pairs"),
)
def pooled_matrix_gaps(spark, sf):
    """What keeps the pooled matrix from being complete."""
    return stats.matrix_gaps(pairs(spark, sf), "qid", "flow")


DIMENSIONS = ("answer_correctness", "answer_completeness", "groundedness", "citation_quality", "refusal_fraction")
cte(
    "dimension_pairs", ("cells",),
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, r.flow, r.qid, r.{d} AS raw, t.{d} AS treated, t.{d} - r.{d} AS difference FROM cells r JOIN cells t ON t.flow = r.flow AND t.qid = r.qid "
        f"WHERE r.arm = 'raw' AND t.arm = 'treated' AND r.{d} IS NOT NULL AND t.{d} IS NOT NULL" for d in DIMENSIONS
    ),
)
sql.wilcoxon("wx_dimension", "dimension", "dimension_pairs")


@query(
    "dimension_deltas",
    compose(
        f"""SELECT dimension, n_pairs, round(raw_mean, 6) AS raw_mean, round(treatment_mean, 6) AS treatment_mean, round(delta, 6) AS delta, round(p, 6) AS p, round(p_holm, 6) AS p_holm
        FROM (SELECT dimension, count(*) AS n_pairs, avg(raw) AS raw_mean, avg(treated) AS treatment_mean, avg(difference) AS delta FROM dimension_pairs GROUP BY 1)
        JOIN ({sql.holm('SELECT dimension, p, 1 AS family FROM wx_dimension', 'family', 'dimension')}) USING (dimension)""",
        "dimension_pairs", "wx_dimension",
    ),
)
def dimension_deltas(spark, sf):
    d = stats.dimension_deltas(cells(spark, sf), ["flow", "qid"], "arm", "raw", "treated", DIMENSIONS)
    return rounded(d, "raw_mean", "treatment_mean", "delta", "p", "p_holm")


cte(
    "described", ("trials",),
    """SELECT *, k % 3 <> 0 AS page_hit, (k % 5) / 4.0::DOUBLE AS page_recall, 1 + k % 4 AS calls, (k % 7) / 100.0::DOUBLE AS generation_cost FROM trials""",
)
FULL_MEANS = {
    "answer_correctness": "avg(answer_correctness)", "answer_completeness": "avg(answer_completeness)", "groundedness": "avg(o_groundedness)", "citation_quality": "avg(o_citation_quality)",
    "positive_refusal_rate": "avg((disposition = 'refusal')::INT) FILTER (answerable)", "control_refusal_accuracy": "avg(negative_refusal_correct)",
    "page_hit_at_context": "avg(page_hit::INT) FILTER (answerable)", "expected_page_recall_at_context": "avg(page_recall) FILTER (answerable)", "mean_generator_calls": "avg(calls)",
    "median_latency_ms": "quantile_cont(latency, 0.5)", "p95_latency_ms": "quantile_cont(latency, 0.95)", "mean_generation_cost_usd": "avg(generation_cost)", "mean_judge_cost_usd": "avg(cost)",
    "mean_total_cost_usd": "avg(generation_cost + cost)",
}


@query(
    "descriptive_table_full",
    compose(
        "SELECT flow, arm, count(*) AS n, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_controls, "
        + ", ".join(f"round({e}, 6) AS {n}" for n, e in FULL_MEANS.items()) + " FROM described GROUP BY flow, arm", "described",
    ),
)
def descriptive_table_full(spark, sf):
    """All nineteen columns of a condition's description, over its answers."""
    k = F.col("k")
    t = trials(spark, sf).withColumns({
        "page_hit": k % 3 != 0, "page_recall": (k % 5) / 4.0, "calls": 1 + k % 4, "generation_cost": (k % 7) / 100.0, "refused": (F.col("disposition") == "refusal").cast("double"),
    })
    table = metrics.describe(t, ["flow", "arm"], latency="latency", judge_cost="cost")
    return rounded(table, *FULL_MEANS)


@query(
    "range_violations",
    compose(
        "SELECT 'attempts' AS rule, trial, attempts::DOUBLE AS value FROM trials WHERE attempts > 2 UNION ALL SELECT 'correctness', trial, correctness FROM trials WHERE correctness < 2 "
        "UNION ALL SELECT 'net_calls', trial, (k % 6 - 1)::DOUBLE FROM trials WHERE k % 6 - 1 < 0", "trials",
    ),
)
def range_violations(spark, sf):
    """Numbers outside their range, under ranges that some of the given ones break."""
    t = trials(spark, sf).withColumn("net_calls", F.col("k") % 6 - 1).withColumn("correctness", F.col("raw_correctness"))
    return judging.range_violations(t, ["trial"], {"attempts": (0, 2), "correctness": (2, 5), "net_calls": (0, None)})


@query(
    "control_table",
    compose(
        mcnemar_sql(
            """(SELECT r.flow, count(*) AS n, count(*) FILTER (r.negative_refusal_correct >= 2.0::DOUBLE / 3 AND t.negative_refusal_correct < 2.0::DOUBLE / 3) AS baseline_only,
            count(*) FILTER (r.negative_refusal_correct < 2.0::DOUBLE / 3 AND t.negative_refusal_correct >= 2.0::DOUBLE / 3) AS treatment_only
            FROM cells r JOIN cells t ON t.flow = r.flow AND t.qid = r.qid AND r.arm = 'raw' AND t.arm = 'treated'
            WHERE r.negative_refusal_correct IS NOT NULL AND t.negative_refusal_correct IS NOT NULL GROUP BY r.flow)""",
            "flow",
        ),
        "cells",
    ),
)
def control_table(spark, sf):
    p = stats.paired(cells(spark, sf), ["flow", "qid"], "arm", "raw", "treated", "negative_refusal_correct")
    yes = lambda c: F.col(c) >= F.lit(2.0 / 3)
    t = stats.mcnemar(p, ["flow"], yes("raw"), yes("treated")).withColumn("family", F.lit("controls"))
    return stats.holm(t, ["family"], "flow").drop("family").withColumns(p_rounded())


@query(
    "mcnemar_labels",
    mcnemar_sql(
        """(SELECT d.lang || '/' || d.source AS label, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS baseline_only,
        count(*) FILTER (quality = 0 AND toxic = 1) AS treatment_only FROM labels JOIN documents d USING (doc_id) GROUP BY ALL)""",
        "label",
    ),
)
def mcnemar_labels(spark, sf):
    d = corpus.table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("label"))
    j = corpus.table(spark, sf, "labels").join(d, "doc_id")
    t = stats.mcnemar(j, ["label"], F.col("quality") == 1, F.col("toxic") == 1).withColumn("family", F.lit("labels"))
    return stats.holm(t, ["family"], "label").drop("family").withColumns(p_rounded())


def judge_raw(t: DataFrame) -> DataFrame:
    """Judge replies spelled out from the trials, spoiled in ten known ways."""
    blind = judging.evaluation_id(F.col("flow"), F.col("arm"), F.col("qid"), F.col("trial"))
    t = t.withColumn("evaluation_id", blind).withColumn("spoil", F.col("k") % 11)
    scored = F.col("answerable") & (F.col("disposition") != "refusal")
    number = lambda c: F.when(scored, F.col(f"raw_{c}").cast("string")).otherwise(F.lit("null"))
    first = (
        F.when(F.col("spoil") == 4, F.concat(F.lit('"'), F.col("correctness"), F.lit('"')))
        .when(F.col("spoil") == 5, F.lit("true"))
        .when(F.col("spoil") == 6, F.lit("9"))
        .when(F.col("spoil") == 10, F.lit("NaN"))
        .otherwise(number("correctness"))
    )
    name = F.when(F.col("spoil") == 8, F.lit("blind-other")).otherwise(F.col("evaluation_id"))
    more = F.when(F.col("spoil") == 3, F.lit(', "extra": 1')).when(F.col("spoil") == 7, F.lit(', "explanation": "again"')).otherwise(F.lit(""))
    body = F.concat(
        F.lit('{"schema_version": "1.0", "evaluation_id": "'), name, F.lit('", "response_disposition": "'), F.col("disposition"),
        F.lit('", "correctness": '), first, F.lit(', "completeness": '), number("completeness"), F.lit(', "groundedness": '),
        number("groundedness"), F.lit(', "citation_quality": '), number("citation_quality"), F.lit(', "explanation": "ok"'), more, F.lit("}"),
    )
    raw = (
        F.when(F.col("spoil") == 1, F.concat(F.lit("Here it is: "), body))
        .when(F.col("spoil") == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("spoil") == 9, F.concat(body, F.lit(" done")))
        .otherwise(body)
    )
    return t.withColumn("raw", raw)


@query(
    "strict_judge_parse",
    compose(
        """SELECT trial, k % 11 = 0 AS valid, CASE WHEN k % 11 = 0 THEN disposition END AS response_disposition,
        CASE WHEN k % 11 = 0 AND answerable AND disposition <> 'refusal' THEN correctness END AS correctness,
        CASE WHEN k % 11 = 0 AND answerable AND disposition <> 'refusal' THEN citation_quality END AS citation_quality FROM trials""",
        "trials",
    ),
)
def strict_judge_parse(spark, sf):
    r = judge_raw(trials(spark, sf))
    p = r.select("trial", jsonx.parse_judge("raw", "evaluation_id", "answerable").alias("p"))
    return p.select("trial", "p.valid", "p.response_disposition", "p.correctness", "p.citation_quality")
