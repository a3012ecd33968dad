"""Catalogue: text statistics and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import lexical, wordpiece
from evispark.plans import corpus, sql
from evispark.plans.registry import query
from evispark.plans.sql import audit_terms, compose, cte, fold, query_terms
from evispark.session import settle, spread


@query(
    "token_statistics",
    compose(
        """SELECT tenant, count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, avg(dl) AS mean_length,
        (SELECT count(DISTINCT t.term) FROM tf_plain t WHERE t.tenant = d.tenant) AS n_terms
        FROM dl_plain d GROUP BY tenant""",
        "dl_plain", "tf_plain",
    ),
)
def token_statistics(spark, sf):
    rows = lexical.postings(corpus.chunks(spark, sf))
    lengths = rows.filter("term = ''").groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("dl").cast("bigint").alias("n_tokens"),
        F.avg("dl").alias("mean_length"),
    )
    # Two steps, so no single task holds a tenant's whole vocabulary.
    terms = (
        rows.filter("term <> ''").groupBy("tenant", "term").agg(F.lit(1).alias("one"))
        .groupBy("tenant").agg(F.count("one").alias("n_terms"))
    )
    return lengths.join(terms, "tenant", "left").select(
        "tenant", "n_docs", "n_tokens", "mean_length", F.coalesce("n_terms", F.lit(0)).alias("n_terms")
    )


@query(
    "question_terms",
    f"SELECT item_id, array_to_string({query_terms('text')}, ' ') AS terms, "
    f"len({query_terms('text')})::INT AS n_terms, len({audit_terms('text')})::INT AS n_audit_terms FROM benchmark",
)
def question_terms(spark, sf):
    b = corpus.table(spark, sf, "benchmark")
    terms = T.query_terms(F.col("text"))
    return b.select(
        "item_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n_terms"),
        F.size(T.audit_terms(F.col("text"))).alias("n_audit_terms"),
    )


@query(
    "document_frequency",
    compose(
        """SELECT q.tenant, q.term, count(t.doc_id) AS df, any_value(s.n) AS n_docs,
        round(any_value(s.avgdl), 6) AS avgdl
        FROM (SELECT DISTINCT tenant, term FROM q_term) q
        JOIN tf_plain t ON t.tenant = q.tenant AND t.term = q.term
        JOIN (SELECT tenant, count(*) AS n, avg(dl) AS avgdl FROM dl_plain GROUP BY ALL) s ON s.tenant = q.tenant
        GROUP BY q.tenant, q.term""",
        "q_term", "tf_plain", "dl_plain",
    ),
)
def document_frequency(spark, sf):
    hits = lexical.term_hits(corpus.chunks(spark, sf), corpus.questions(spark, sf))
    stats = lexical.term_statistics(hits).filter(F.col("term") != "")
    return stats.select("tenant", "term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(
    "bm25_top_10",
    compose("SELECT qid, tenant, doc_id, rank::INT AS rank, round(score, 6) AS score FROM bm25_10", "bm25_10"),
)
def bm25_top_10(spark, sf):
    top = lexical.bm25_top_k(corpus.chunks(spark, sf), corpus.questions(spark, sf), 10)
    return top.select("qid", "tenant", "doc_id", "rank", F.round("score", 6).alias("score"))


# --- word pieces --------------------------------------------------------------
# The vocabulary is a relation: the words of the benchmark, its short words as continuations, and its letters.

cte("pieces_words", (), f"SELECT DISTINCT unnest({sql.toks('text')}) AS w FROM benchmark")
cte(
    "pieces", ("pieces_words",),
    """SELECT w AS piece FROM pieces_words UNION SELECT '##' || w FROM pieces_words WHERE length(w) <= 4
    UNION SELECT unnest(string_split(w, '')) FROM pieces_words WHERE length(w) > 3 UNION SELECT '##' || unnest(string_split(w, '')) FROM pieces_words WHERE length(w) > 3""",
)
cte("piece_tokens", ("chunks",), f"SELECT doc_id, tenant, unnest({sql.toks('text')}) AS w FROM chunks")
cte(
    "piece_walk", ("piece_tokens", "pieces"),
    """SELECT w, 0 AS pos, 0 AS n, false AS lost FROM (SELECT DISTINCT w FROM piece_tokens)
    UNION ALL
    SELECT w, pos + coalesce(best, length(w)), n + 1, best IS NULL FROM (
      SELECT a.w, a.pos, a.n, max(l.len) AS best FROM piece_walk a LEFT JOIN (SELECT piece, starts_with(piece, '##') AND length(piece) > 2 AS later,
        CASE WHEN starts_with(piece, '##') AND length(piece) > 2 THEN length(piece) - 2 ELSE length(piece) END AS len FROM pieces) l
      ON (l.later = (a.pos > 0)) AND l.piece = CASE WHEN a.pos > 0 THEN '##' ELSE '' END || substr(a.w, a.pos + 1, l.len) AND a.pos + l.len <= length(a.w)
      WHERE a.pos < length(a.w) AND NOT a.lost GROUP BY a.w, a.pos, a.n)""",
)
cte(
    "piece_sizes", ("piece_walk",),
    "SELECT w, CASE WHEN bool_or(lost) OR length(w) > 100 THEN 1 ELSE max(n) END AS n, bool_or(lost) OR length(w) > 100 AS unknown FROM piece_walk GROUP BY w",
)
cte(
    "piece_counts", ("chunks", "piece_tokens", "piece_sizes"),
    """SELECT c.doc_id, c.tenant, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_pieces, 0) AS n_pieces, coalesce(s.n_unknown, 0) AS n_unknown FROM chunks c
    LEFT JOIN (SELECT t.doc_id, count(*) AS n_words, sum(z.n)::BIGINT AS n_pieces, count(*) FILTER (z.unknown) AS n_unknown
      FROM piece_tokens t JOIN piece_sizes z ON z.w = t.w GROUP BY t.doc_id) s ON s.doc_id = c.doc_id""",
)


def piece_vocabulary(spark, sf):
    w = corpus.table(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    short, letters = F.length("w") <= 4, F.split("w", "")
    pieces = F.concat(
        F.array("w"), F.when(short, F.array(F.concat(F.lit("##"), "w"))).otherwise(F.array().cast("array<string>")),
        F.when(F.length("w") > 3, F.concat(letters, F.transform(letters, lambda c: F.concat(F.lit("##"), c)))).otherwise(F.array().cast("array<string>")),
    )
    return w.select(F.explode(pieces).alias("piece")).distinct()


def pieces_of(spark, sf):
    return wordpiece.piece_counts(spread(corpus.chunks(spark, sf).select("doc_id", "tenant", "text")), piece_vocabulary(spark, sf), keep=("doc_id", "tenant"))


@query("wordpiece_counts", compose("SELECT doc_id, tenant, n_words, n_pieces, n_unknown FROM piece_counts", "piece_counts"))
def wordpiece_counts(spark, sf):
    return pieces_of(spark, sf)


@query(
    "wordpiece_truncation",
    compose(
        """SELECT tenant, count(*) AS n, round(avg(n_pieces), 6) AS mean_pieces, max(n_pieces) AS largest, min(n_pieces) AS smallest,
        round(avg((n_pieces > 256)::INT), 6) AS truncated_share, round(avg(kept), 6) AS mean_retained, quantile_cont(n_pieces::DOUBLE, 0.5) AS median_pieces,
        (list_sort(list(n_pieces))[floor((count(*) - 1) * 0.9::DOUBLE)::INT + 1])::DOUBLE AS p90_pieces, round(quantile_cont(kept, 0.5), 6) AS median_retained
        FROM (SELECT *, CASE WHEN n_pieces > 256 THEN 256.0::DOUBLE / n_pieces ELSE 1.0::DOUBLE END AS kept FROM piece_counts) GROUP BY tenant""",
        "piece_counts",
    ),
)
def wordpiece_truncation(spark, sf):
    """How much of each passage a window of 256 pieces retains, by tenant; the counts are settled, as three passes read them."""
    r = wordpiece.truncation_statistics(settle(pieces_of(spark, sf)), ["tenant"])
    for c in ("mean_pieces", "truncated_share", "mean_retained", "median_retained"):
        r = r.withColumn(c, F.round(c, 6))
    return r
