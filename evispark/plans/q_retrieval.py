"""Catalogue: dense, fused and graph-expanded retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import arrays, numeric
from evispark.functions import text as T
from evispark.operators import dense, fusion, graph, lexical
from evispark.operators.ranking import by_score, top_k
from evispark.plans import corpus
from evispark.plans.registry import query
from evispark.plans.sql import compose
from evispark.session import fits_broadcast, settle

FIELDS = (("text", 1.0), ("title", 3.0), ("source", 2.5))
# Ranked rows of one question, relative to the question row itself.
GROWTH = 50


def titled(spark, sf):
    return corpus.chunks(spark, sf).withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))


def weighted(spark, sf, keep=False):
    return lexical.Bm25(titled(spark, sf), corpus.questions(spark, sf), FIELDS, keep=keep)


def scores_weighted(spark, sf):
    return weighted(spark, sf).scores()


def small(spark, sf) -> bool:
    return fits_broadcast(corpus.table(spark, sf, "benchmark"), GROWTH)


def arm_bm25(spark, sf, k):
    return lexical.bm25_top_k(corpus.chunks(spark, sf), corpus.questions(spark, sf), k)


def arm_dense(spark, sf, k):
    return dense.hashing_top_k(corpus.chunks(spark, sf), corpus.questions(spark, sf), k)


def chain(spark, sf):
    return graph.chain_links(corpus.chunks(spark, sf).select("tenant", "doc_id", "document"), width=corpus.BLOCK)


def edges(spark, sf):
    # prev and next already name each other, so the edges run both ways.
    return graph.chain_edges(chain(spark, sf))


def arm_native(spark, sf, k, seed_k=None):
    return graph.native_search(weighted(spark, sf, True), edges(spark, sf), k, seed_k, small=small(spark, sf))


def arm_adjacent(spark, sf, k):
    ordinals = corpus.chunks(spark, sf).select("tenant", "doc_id", F.col("doc_id").alias("ordinal"))
    return graph.adjacency_search(arm_bm25(spark, sf, k), ordinals, k, small=small(spark, sf))


def out(df, *extra):
    return df.select("qid", "tenant", "doc_id", "rank", F.round("score", 6).alias("score"), *extra)


def hits_sql(name, *extra):
    cols = "".join(f", {e}" for e in extra)
    return compose(f"SELECT qid, tenant, doc_id, rank::INT AS rank, round(score, 6) AS score{cols} FROM {name}", name)


@query("bm25_field_weighted", hits_sql("bm25w_10"))
def bm25_field_weighted(spark, sf):
    return out(top_k(scores_weighted(spark, sf), ["qid"], by_score(), 10))


@query(
    "hashing_vectors",
    compose("SELECT doc_id, count(*)::INT AS n_buckets, round(max(v), 6) AS peak, min(bucket)::INT AS first_bucket "
            "FROM d_vec GROUP BY doc_id", "d_vec"),
)
def hashing_vectors(spark, sf):
    # Not a filter on idx: Spark pushes it below the exchange of texts and makes every vector twice.
    v = dense.hashing_vectors(corpus.chunks(spark, sf).filter(T.has_words(F.col("text"))), "doc_id")
    return v.select(
        "doc_id", F.size("idx").alias("n_buckets"), F.round(F.array_max("val"), 6).alias("peak"),
        F.array_min("idx").alias("first_bucket"),
    )


@query("dense_top_10", hits_sql("dense_10"))
def dense_top_10(spark, sf):
    return out(arm_dense(spark, sf, 10))


@query(
    "cosine_prototypes",
    """WITH e AS (SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS tenant,
        list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      m AS (SELECT label, tenant, pos, avg(x) AS x FROM (
              SELECT label, tenant, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY ALL),
      q AS (SELECT label, tenant, list(x ORDER BY pos) AS v FROM m GROUP BY ALL),
      n AS (SELECT label, tenant, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM q),
      s AS (SELECT n.label AS qlabel, n.tenant, e.vec_id, e.label, list_dot_product(n.v, e.v) AS score
            FROM n JOIN e ON e.tenant = n.tenant)
    SELECT qlabel, tenant, vec_id, label, rank, round(score, 6) AS score FROM (
      SELECT *, (row_number() OVER (PARTITION BY qlabel ORDER BY round(score, 9) DESC, vec_id))::INT AS rank FROM s)
    WHERE rank <= 10""",
)
def cosine_prototypes(spark, sf):
    """Mean vector of every label as the query, searched within its tenant."""
    e = corpus.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label", "embedding",
        F.when(F.col("label") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("tenant"),
    )
    mean = (
        e.select("label", "tenant", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "tenant", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label", "tenant").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select(F.col("label").cast("string").alias("qid"), "tenant", numeric.l2_normalise(F.col("v.x")).alias("v"))
    )
    found = dense.vector_top_k(
        dense.dense_vectors(e, "doc_id", "embedding", 64), dense.dense_vectors(mean, "qid", "v", 64), 64, 10
    )
    return found.join(e.select("doc_id", "label"), "doc_id").select(
        F.col("qid").cast("int").alias("qlabel"), "tenant", F.col("doc_id").alias("vec_id"), "label", "rank",
        F.round("score", 6).alias("score"),
    )


@query("rrf_two_arms", hits_sql("rrf_10", "n_arms"))
def rrf_two_arms(spark, sf):
    return out(fusion.rrf([arm_bm25(spark, sf, 50), arm_dense(spark, sf, 50)], 10), "n_arms")


@query("rrf_three_arms", hits_sql("rrf3_25", "n_arms"))
def rrf_three_arms(spark, sf):
    concept = top_k(scores_weighted(spark, sf), ["qid"], by_score(), 25)
    return out(fusion.rrf([arm_dense(spark, sf, 50), arm_bm25(spark, sf, 50), concept], 25), "n_arms")


@query("adjacency_bm25", hits_sql("adjacent_10", "link_depth"))
def adjacency_bm25(spark, sf):
    return out(arm_adjacent(spark, sf, 10), "link_depth")


@query("chain_links", compose("SELECT doc_id, prev_id, next_id FROM chain", "chain"))
def chain_links(spark, sf):
    return chain(spark, sf).select("doc_id", "prev_id", "next_id")


@query(
    "link_neighbors",
    compose("SELECT src AS doc_id, count(*)::INT AS degree, array_to_string(list_sort(list(dst)), ',') AS neighbors "
            "FROM edges GROUP BY src", "edges"),
)
def link_neighbors(spark, sf):
    n = graph.both_ways(edges(spark, sf)).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("n"))
    return n.select(
        F.col("src").alias("doc_id"), F.size("n").alias("degree"),
        F.array_join(F.col("n").cast("array<string>"), ",").alias("neighbors"),
    )


DEPTH_2 = """SELECT qid, doc_id, min(link_depth)::INT AS link_depth, round(max(gain), 6) AS link_score,
  count(DISTINCT seed)::INT AS n_origins
FROM (SELECT *, max(gain) OVER (PARTITION BY qid, doc_id) AS top FROM gains) WHERE gain >= top * (1 - 1e-12::DOUBLE)
GROUP BY qid, doc_id"""
GAINS = {
    "hop1": (("native_10_seeds", "edges"),
             "SELECT s.qid, s.tenant, s.doc_id AS seed, s.score, e.dst AS node FROM native_10_seeds s JOIN edges e "
             "ON e.tenant = s.tenant AND e.src = s.doc_id WHERE NOT EXISTS (SELECT 1 FROM native_10_seeds o "
             "WHERE o.qid = s.qid AND o.doc_id = e.dst)"),
    "hop2": (("hop1",),
             "SELECT DISTINCT h.qid, h.tenant, h.seed, h.score, e.dst AS node FROM hop1 h JOIN edges e "
             "ON e.tenant = h.tenant AND e.src = h.node WHERE NOT EXISTS (SELECT 1 FROM native_10_seeds o "
             "WHERE o.qid = h.qid AND o.doc_id = e.dst) AND NOT EXISTS (SELECT 1 FROM hop1 v WHERE v.qid = h.qid "
             "AND v.seed = h.seed AND v.node = e.dst)"),
    "gains": (("hop1", "hop2"),
              "SELECT qid, node AS doc_id, seed, 1 AS link_depth, greatest(0.0::DOUBLE, score) * 0.35::DOUBLE AS gain "
              "FROM hop1 UNION ALL SELECT qid, node, seed, 2, greatest(0.0::DOUBLE, score) * 0.1225::DOUBLE FROM hop2"),
}


@query("link_expansion_depth_2", compose(DEPTH_2, "gains", extra=GAINS))
def link_expansion_depth_2(spark, sf):
    seeds = settle(top_k(scores_weighted(spark, sf), ["qid"], by_score(), 5))
    x = graph.expand_links(seeds, edges(spark, sf), 2, small=small(spark, sf))
    return x.select(
        "qid", "doc_id", "link_depth", F.round("link_score", 6).alias("link_score"), F.size("seed_ids").alias("n_origins")
    )


ORIGINS = "array_to_string(seed_ids, ',') AS seeds"


def origins():
    return F.array_join(F.col("seed_ids").cast("array<string>"), ",").alias("seeds")


@query("native_retrieval", hits_sql("native_10", "link_depth", ORIGINS))
def native_retrieval(spark, sf):
    return out(arm_native(spark, sf, 10), "link_depth", origins())


@query("native_evidence_only", hits_sql("evidence_10", "link_depth", ORIGINS))
def native_evidence_only(spark, sf):
    bm25 = lexical.Bm25(corpus.chunks(spark, sf), corpus.questions(spark, sf), keep=True)
    return out(graph.native_search(bm25, edges(spark, sf), 10, small=small(spark, sf)), "link_depth", origins())


@query("hybrid_retrieval", hits_sql("hybrid_10", "link_depth", ORIGINS))
def hybrid_retrieval(spark, sf):
    seeds = arm_dense(spark, sf, numeric.seed_count(10)).select("qid", "tenant", "doc_id", "score")
    return out(graph.hybrid_search(seeds, edges(spark, sf), 10, small=small(spark, sf)), "link_depth", origins())


def _wide_sql():
    from evispark.plans import sql

    sql.ranked("dense_20", "dense", 20)
    sql.cte("wide_seeds", ("dense_20",), "SELECT qid, tenant, doc_id, score FROM dense_20 WHERE rank <= 5")
    sql.expanded("wide_links", "wide_seeds")
    sql.cte(
        "wide_all", ("dense_20", "wide_links"),
        """SELECT qid, coalesce(d.tenant, l.tenant) AS tenant, doc_id, coalesce(d.score, l.link_score) AS score, coalesce(l.link_depth, 0) AS link_depth,
        coalesce(l.seed_ids, CASE WHEN d.rank <= 5 THEN [doc_id] ELSE [] END) AS seed_ids FROM dense_20 d FULL JOIN wide_links l USING (qid, doc_id)""",
    )
    sql.ranked("wide_15", "wide_all", 15, "link_depth, ")
    return hits_sql("wide_15", "link_depth", ORIGINS)


@query("hybrid_wide_seeds", _wide_sql())
def hybrid_wide_seeds(spark, sf):
    """Twenty vector seeds, of which the best five are followed."""
    seeds = arm_dense(spark, sf, 20).select("qid", "tenant", "doc_id", "score")
    return out(graph.hybrid_search(seeds, edges(spark, sf), 15, small=small(spark, sf), seed_k=5), "link_depth", origins())


ALL_FIELDS = (("text", 1.0), ("title", 3.0), ("description", 2.0), ("type", 1.0), ("section", 1.5), ("tags", 2.5))


def _six_sql():
    from evispark.plans import sql

    label = "CASE WHEN len(pages) = 1 THEN 'page ' ELSE 'pages ' END || array_to_string(pages, ', ')"
    name = sql.CHUNK_NAME
    sql.cte(
        "six_fields", ("chunks",),
        f"""SELECT tenant, doc_id, text, {name} || ' — ' || replace({label}, 'page', 'Page') AS title, 'Source chunk ' || {name} || ' from ' || document || ', ' || {label} || '.' AS description,
        'Source Passage' AS type, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id % 7 END AS section, 'source-passage corpus-' || tenant AS tags FROM chunks""",
    )
    parts = " UNION ALL ".join(f"SELECT tenant, doc_id, unnest({sql.toks(f)}) AS term, {w}::DOUBLE AS w FROM six_fields" for f, w in ALL_FIELDS)
    sql.cte("tf_six", ("six_fields",), f"SELECT tenant, doc_id, term, sum(w) AS tf FROM ({parts}) GROUP BY ALL")
    sql.cte("dl_six", ("chunks", "tf_six"), "SELECT c.tenant, c.doc_id, coalesce(sum(t.tf), 0.0) AS dl FROM chunks c LEFT JOIN tf_six t USING (tenant, doc_id) GROUP BY ALL")
    sql.bm25("bm25six", "tf_six", "dl_six")
    sql.ranked("bm25six_10", "bm25six", 10)
    return hits_sql("bm25six_10")


@query("bm25_all_fields", _six_sql())
def bm25_all_fields(spark, sf):
    """The six fields of a concept, each with its weight."""
    c = corpus.chunks(spark, sf).withColumn("chunk_id", corpus.chunk_name())
    none = F.lit(None).cast("string")
    d = c.select(
        "tenant", "doc_id", "text", T.passage_title(F.col("chunk_id"), none, F.col("pages")).alias("title"),
        T.passage_description(F.col("chunk_id"), F.col("document"), F.col("pages")).alias("description"), F.lit("Source Passage").alias("type"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string"))).alias("section"),
        F.concat(F.lit("source-passage corpus-"), "tenant").alias("tags"),
    )
    return out(lexical.bm25_top_k(d, corpus.questions(spark, sf), 10, fields=ALL_FIELDS))


FILTERED = {
    "eligible": (("chunks",),
                 "SELECT c.* FROM chunks c LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1 "
                 "AND coalesce(l.quality, 1) IN (1, 2) AND c.source NOT IN ('src0', 'src1')"),
    "tf_e": (("tf_plain", "eligible"), "SELECT t.* FROM tf_plain t JOIN eligible e USING (tenant, doc_id)"),
    "dl_e": (("dl_plain", "eligible"), "SELECT d.* FROM dl_plain d JOIN eligible e USING (tenant, doc_id)"),
}


def _filtered_sql():
    from evispark.plans import sql

    sql.bm25("bm25_eligible", "tf_e", "dl_e")
    sql.ranked("bm25_eligible_10", "bm25_eligible", 10)
    sql.CTES.update(FILTERED)
    return hits_sql("bm25_eligible_10")


@query("bm25_metadata_filtered", _filtered_sql())
def bm25_metadata_filtered(spark, sf):
    """Corpus statistics follow the eligible set, not the whole corpus."""
    labels = corpus.table(spark, sf, "labels")
    d = corpus.chunks(spark, sf).join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, F.lit("deprecated"))
    keep = arrays.eligible(
        F.col("tenant"), None, status,
        [
            arrays.matches(F.coalesce("quality", F.lit(1)), [1, 2]),
            ~arrays.matches(F.array("source"), "src0", actual_is_list=True),
            ~arrays.matches(F.array("source"), ["src1"], actual_is_list=True),
        ],
    )
    return out(lexical.bm25_top_k(d.filter(keep), corpus.questions(spark, sf), 10))
