"""Gold evidence, citations and the lexical audit of a question set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.ranking import top_k


def page_overlap(expected: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """(qid, doc_id, page) pairs sharing a page: exploded equi-join."""
    return expected.join(chunk_pages.select("doc_id", F.explode("pages").alias("page")), "page")


def evidence_overlap(evidence: DataFrame, references: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, doc_id, overlap): share of reference tokens found in the passage."""
    ref = references.select("qid", F.array_distinct(T.tokens(F.col("reference"))).alias("_r"))
    # only passages on expected pages are tokenised
    found = evidence.select("qid", "doc_id").distinct().join(chunks.select("doc_id", "text"), "doc_id")
    j = found.withColumn("_b", F.array_distinct(T.tokens(F.col("text")))).join(ref, "qid")
    share = F.size(F.array_intersect("_r", "_b")) / F.greatest(F.size("_r"), F.lit(1))
    return j.select("qid", "doc_id", share.alias("overlap"))


def gold_evidence(overlaps: DataFrame, on_pages: DataFrame, max_chunks: int = 6) -> DataFrame:
    """(qid, doc_id, position): one best unused passage a page, then the best rest.

    The choice is sequential, so it runs in applyInPandas, one question a group
    of bounded size. At most ``max_chunks`` passages are ever chosen: on any
    page only its best max_chunks + 1 can matter, and a page yields nothing
    only when all its passages are taken. Chosen passages take up at most
    max_chunks times the pages of the question's widest passage, so with
    max_chunks pages more the choice is settled exactly.
    """
    order = [F.round("overlap", 9).desc(), F.col("doc_id").asc()]
    ranked = on_pages.select("qid", "page", "doc_id").join(overlaps, ["qid", "doc_id"])
    pages = ranked.select("qid", "page").distinct()
    span = ranked.groupBy("qid", "doc_id").agg(F.count_distinct("page").alias("_s")).groupBy("qid").agg(F.max("_s").alias("_s"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("page"))
    first = pages.withColumn("_pr", nth).join(span, "qid").filter(F.col("_pr") <= max_chunks * (F.col("_s") + 1)).select("qid", "page")
    per_page = top_k(ranked.join(first, ["qid", "page"]), ["qid", "page"], order, max_chunks + 1, "_r").drop("_r")
    best = top_k(overlaps, ["qid"], order, 2 * max_chunks, "_r").select("qid", F.lit(None).cast("int").alias("page"), "doc_id", "overlap")
    rows = per_page.select("qid", F.col("page").cast("int").alias("page"), "doc_id", "overlap").unionByName(best)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=pdf["overlap"].round(9)).sort_values(["key", "doc_id"], ascending=[False, True])
        chosen: list[int] = []
        for _, g in pdf[pdf["page"].notna()].groupby("page", sort=True):
            chosen += [d for d in g["doc_id"] if d not in chosen][:1]
        rest = [d for d in dict.fromkeys(pdf["doc_id"]) if d not in chosen]
        taken = (chosen + rest[: max(0, max_chunks - len(chosen))])[:max_chunks]
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "doc_id": taken, "position": range(1, len(taken) + 1)})

    return rows.groupBy("qid").applyInPandas(choose, "qid string, doc_id bigint, position int")


def evidence_records(chosen: DataFrame, chunks: DataFrame, max_chars: int = 3500) -> DataFrame:
    return chosen.join(chunks, "doc_id").withColumn("evidence", F.substring("text", 1, max_chars))


def resolve_citations(answers: DataFrame, chunks: DataFrame, max_chars: int = 3500) -> DataFrame:
    """(qid, pos, chunk_id, evidence): cited ids that exist, in citation order."""
    cited = answers.select("qid", F.posexplode("citations").alias("pos", "chunk_id"))
    return cited.join(chunks.select("chunk_id", "text"), "chunk_id").select(
        "qid", "pos", "chunk_id", F.substring("text", 1, max_chars).alias("evidence")
    )


def lexical_audit(questions: DataFrame, expected: DataFrame, chunks: DataFrame, floor: float = 0.25) -> DataFrame:
    """Page coverage, reference-token coverage and flags for each question.

    ``questions`` has qid, reference, answerable; ``expected`` (qid, page).
    Coverage counts matched terms by joins on (qid, term); evidence texts are
    never concatenated.
    """
    shared = page_overlap(expected, chunks)
    pages = expected.groupBy("qid").agg(F.count("page").alias("n_pages"))
    found = shared.groupBy("qid").agg(F.count_distinct("page").alias("found_pages"))
    ref = questions.select("qid", F.explode(T.audit_terms(F.col("reference"))).alias("term"))
    n_ref = ref.groupBy("qid").agg(F.count("term").alias("n_terms"))
    evidence = shared.select("qid", "doc_id").distinct()
    needed = chunks.join(evidence.select("doc_id").distinct(), "doc_id", "left_semi")
    bodies = needed.select("doc_id", F.explode_outer(T.audit_terms(F.col("text"))).alias("term"))
    hit = bodies.join(evidence, "doc_id").join(ref, ["qid", "term"]).select("qid", "term").distinct()
    n_hit = hit.groupBy("qid").agg(F.count("term").alias("hit_terms"))
    j = questions
    for side in (pages, found, n_ref, n_hit):
        j = j.join(side, "qid", "left")
    coverage = F.when(
        (F.col("n_terms") > 0) & F.col("found_pages").isNotNull(), F.coalesce("hit_terms", F.lit(0)) / F.col("n_terms")
    )
    page_coverage = F.when(F.col("n_pages") > 0, F.coalesce("found_pages", F.lit(0)) / F.col("n_pages"))
    a, has = F.col("answerable"), F.coalesce("n_pages", F.lit(0)) > 0
    j = j.withColumn("page_coverage", page_coverage).withColumn("token_coverage", coverage)
    flags = F.array_compact(
        F.array(
            F.when(a & ~has, F.lit("answerable_without_expected_pages")),
            F.when(a & ~F.coalesce(F.col("page_coverage") == 1.0, F.lit(False)), F.lit("expected_page_missing_from_corpus")),
            F.when(a & (F.col("token_coverage") < floor), F.lit("low_reference_token_coverage_manual_review")),
            F.when(~a & has, F.lit("control_has_expected_pages")),
        )
    )
    return j.select("qid", "answerable", "page_coverage", "token_coverage", flags.alias("flags"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answerable").alias("answerable"),
        F.count_if(F.col("page_coverage") == 1.0).alias("full_page_coverage"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
        F.avg("token_coverage").alias("mean_token_coverage"),
    )
