"""Postings and tenant-scoped BM25.

Shape of the plan: documents are tokenised in place, the occurrences of query
terms (a broadcast vocabulary) are shuffled once by doc_id and counted there. Term statistics and scores both read that one exchange (Spark
reuses it), scoring needs no further shuffle because (qid, doc_id) groups are
already co-located, and each task keeps k rows for each question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import numeric, text
from evispark.operators.ranking import by_score, check_limits, top_k
from evispark.session import broadcast_if, fits_broadcast, parts_for, settle, spread

PLAIN = (("text", 1.0),)
SALTS = 16
# Input, passages and (question, passage) pairs behind a task that counts and scores hits: a passage can match every question of its tenant.
PART_BYTES, PART_ROWS, PART_PAIRS = 8 << 20, 4096, 800_000


def term_rows(docs: DataFrame, fields=PLAIN) -> DataFrame:
    """(tenant, doc_id, dl, term, w): one row a token occurrence.

    dl, the document length, and w are weighted by field; NULL fields add
    nothing. Each document also has one row with the empty term and w = dl, so
    that documents matching no query still reach the corpus statistics.

    explode_outer, not explode: for explode Spark infers a size filter and
    pushes it below the projection, which tokenises every text twice.
    """
    n = range(len(fields))
    d = spread(docs.select("tenant", "doc_id", *[F.col(c).alias(f"_x{i}") for i, (c, _) in enumerate(fields)]))
    d = d.select("tenant", "doc_id", *[text.tokens(F.coalesce(F.col(f"_x{i}"), F.lit(""))).alias(f"_t{i}") for i in n])
    dl = sum((F.lit(float(w)) * F.size(f"_t{i}") for i, (_, w) in enumerate(fields)), F.lit(0.0))
    d = d.select("tenant", "doc_id", dl.alias("dl"), *[f"_t{i}" for i in n])
    part = lambda w, t: F.struct(w.alias("w"), t.alias("t"))
    parts = [part(F.col("dl"), F.array(F.lit("")))]
    parts += [part(F.lit(float(w)), F.col(f"_t{i}")) for i, (_, w) in enumerate(fields)]
    d = d.select("tenant", "doc_id", "dl", F.explode_outer(F.array(*parts)).alias("p"))
    return d.select("tenant", "doc_id", "dl", F.col("p.w").alias("w"), F.explode_outer("p.t").alias("term"))


def postings(docs: DataFrame, fields=PLAIN) -> DataFrame:
    """(tenant, doc_id, dl, term, tf), ready to be written as a table."""
    rows = term_rows(docs, fields).filter("term is not null")
    return rows.groupBy("tenant", "doc_id", "dl", "term").agg(F.sum("w").alias("tf"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, tenant, term, qf); the empty term asks for the statistics row."""
    q = questions.select("qid", "tenant", F.explode(text.query_terms(F.col("text"))).alias("term"))
    return q.groupBy("qid", "tenant", "term").agg(F.count(F.lit(1)).alias("qf"))


def term_hits(docs: DataFrame, questions: DataFrame, fields=PLAIN, from_postings: bool = False) -> DataFrame:
    """Postings that some question of the tenant asks for, shuffled once."""
    return _term_hits(docs, questions, fields, from_postings, _parts(docs, questions, from_postings))


def _parts(docs: DataFrame, questions: DataFrame, from_postings: bool) -> list:
    """First argument of repartition for the hits of ``docs``, if any; postings have one row a passage with the empty term."""
    asked = questions.groupBy("tenant").count().agg(F.max("count")).first()[0] or 1
    rows = max(1, min(PART_ROWS, PART_PAIRS // asked))
    n = parts_for(docs.filter("term = ''") if from_postings else docs, PART_BYTES, rows)
    return [] if n is None else [n]


def _term_hits(docs: DataFrame, questions: DataFrame, fields, from_postings: bool, n: list) -> DataFrame:
    small = fits_broadcast(questions)
    wanted = questions.select(
        "tenant", F.explode(F.concat(F.array(F.lit("")), text.query_terms(F.col("text")))).alias("term")
    ).distinct()
    rows = docs.withColumnRenamed("tf", "w") if from_postings else term_rows(docs, fields)
    keys = ["tenant", "doc_id", "dl", "term"]
    hits = rows.join(broadcast_if(wanted, small), ["tenant", "term"]).select(*keys, "w")
    if small:
        # (qid, doc_id) groups of the scoring step are co-located by this shuffle.
        hits = hits.repartition(*n, "doc_id")
    else:
        # The weights will be shuffled too: meet them on the term, with every
        # term spread over SALTS partitions, as one may be in most documents.
        keys.append("salt")
        hits = hits.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
        hits = hits.repartition(*n, "tenant", "term", "salt")
    return hits.groupBy(*keys).agg(F.sum("w").alias("tf"))


def term_statistics(hits: DataFrame) -> DataFrame:
    """(tenant, term, df, n_docs, avgdl) from the hits alone."""
    # Every column of the hits is read here, so that this reader and the scoring
    # one ask for the same columns and Spark reuses the exchange.
    stats = hits.groupBy("tenant", "term").agg(
        F.count("doc_id").alias("df"), F.sum("tf").alias("stf"), F.max("dl").alias("max_dl")
    )
    w = Window.partitionBy("tenant")
    corpus = stats.filter((F.col("term") == "") | (F.col("max_dl") > 0)).select(
        "tenant", "term", "df",
        F.max(F.when(F.col("term") == "", F.col("df"))).over(w).alias("n_docs"),
        F.max(F.when(F.col("term") == "", F.col("stf"))).over(w).alias("total_dl"),
    )
    mean = F.col("total_dl") / F.col("n_docs")
    return corpus.select(
        "tenant", "term", "df", "n_docs", F.when(mean <= 0, F.lit(1.0)).otherwise(mean).alias("avgdl")
    )


class Bm25:
    """Hits and weights of a question set; scores come from joins of the two."""

    def __init__(self, docs: DataFrame, questions: DataFrame, fields=PLAIN, k1: float = 1.2, b: float = 0.75,
                 from_postings: bool = False, keep: bool = False):
        """``keep`` settles the hits, for searches that score twice: texts are then tokenised once."""
        self.small = fits_broadcast(questions)
        n = _parts(docs, questions, from_postings)
        hits = _term_hits(docs, questions, fields, from_postings, n)
        if keep:
            hits = settle(hits)
        self.hits = self.read = hits
        self.part = F.col("w") * numeric.saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        weights = question_terms(questions).join(term_statistics(self.hits), ["tenant", "term"]).select(
            "qid", "tenant", "term",
            (F.col("qf") * numeric.idf(F.col("n_docs"), F.col("df"))).alias("w"), "avgdl",
        )
        if keep:
            weights = settle(weights)
            if self.small:
                # Every pair is scored here. What was settled has lost its partitions: meet on doc_id again, as hits are fewer than the pairs they make.
                self.hits = hits.repartition(*n, "doc_id")
        self.on = ["tenant", "term"]
        if not self.small:
            weights = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            self.on = ["tenant", "term", "salt"]
        self.weights = weights

    def scores(self) -> DataFrame:
        """(qid, tenant, doc_id, score) of every positive match."""
        return (
            self.hits.join(broadcast_if(self.weights, self.small), self.on)
            .groupBy("qid", "tenant", "doc_id")
            .agg(F.sum(self.part).alias("score"))
        )

    def scores_of(self, pairs: DataFrame, pairs_small: bool = False) -> DataFrame:
        """(qid, doc_id, score) of the given (qid, doc_id) pairs only."""
        few = (self.read if pairs_small else self.hits).join(broadcast_if(pairs.select("qid", "doc_id"), pairs_small), "doc_id")
        return few.join(broadcast_if(self.weights, self.small), [*self.on, "qid"]).groupBy("qid", "doc_id").agg(F.sum(self.part).alias("score"))


def bm25_scores(docs: DataFrame, questions: DataFrame, fields=PLAIN, **options) -> DataFrame:
    """(qid, tenant, doc_id, score) of every positive match."""
    return Bm25(docs, questions, fields, **options).scores()


def bm25_top_k(docs: DataFrame, questions: DataFrame, k: int = 10, **options) -> DataFrame:
    """(qid, tenant, doc_id, score, rank): top k by score, ties by id."""
    check_limits(k)
    return top_k(bm25_scores(docs, questions, **options), ["qid"], by_score(), k)
