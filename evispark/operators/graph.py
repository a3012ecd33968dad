"""Link graph: chains, neighbours, bounded expansion, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions import numeric
from evispark.operators.lexical import Bm25
from evispark.operators.ranking import by_score, check_limits, previous_and_next, top_k
from evispark.session import broadcast_if, settle


def chain_links(chunks: DataFrame, order: str = "doc_id", document: str = "document", width: int = 65536) -> DataFrame:
    """chunks with prev_id and next_id of the same document.

    The neighbour is the one in tenant order; it is linked only if it belongs
    to the same document, so non-contiguous repeats stay unlinked.
    """
    here = F.struct(F.col(order).alias("id"), F.col(document).alias("doc"))
    both = previous_and_next(chunks, ["tenant"], order, width, here)
    same = lambda c: F.when(F.col(f"{c}.doc").eqNullSafe(F.col(document)), F.col(f"{c}.id"))
    return both.select(
        *chunks.columns, same("prev_value").alias("prev_id"), same("next_value").alias("next_id")
    )


def chain_edges(linked: DataFrame, order: str = "doc_id") -> DataFrame:
    """(tenant, src, dst) from prev_id and next_id."""
    ends = F.array_compact(F.array("prev_id", "next_id"))
    return linked.select("tenant", F.col(order).alias("src"), F.explode(ends).alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming neighbours, no loops, no duplicates."""
    back = edges.select("tenant", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("tenant", "src", "dst").unionByName(back).filter("src <> dst").distinct()


def expand_links(
    seeds: DataFrame, edges: DataFrame, max_depth: int = 1, decay: float = 0.35,
    eligible: DataFrame | None = None, small: bool = False,
) -> DataFrame:
    """(qid, tenant, doc_id, link_score, link_depth, seed_ids) reached from seeds.

    ``seeds`` is (qid, tenant, doc_id, score), ``edges`` (tenant, src, dst).
    Every seed walks by itself; other seeds and ineligible nodes are neither
    scored nor walked through. The depth is fixed, so the plan is unrolled:
    one join with the edges for each hop. ``small`` says that the seeds' size
    was checked, and they may then be broadcast to the edges.
    """
    own = seeds.select("qid", F.col("doc_id").alias("node")).distinct()
    walk = seeds.select("qid", "tenant", F.col("doc_id").alias("seed"), "score", F.col("doc_id").alias("node"))
    visited = walk.select("qid", "seed", "node")
    reached = []
    for depth in range(1, max_depth + 1):
        nxt = (
            edges.join(broadcast_if(walk.withColumnRenamed("node", "src"), small), ["tenant", "src"])
            .select("qid", "tenant", "seed", "score", F.col("dst").alias("node"))
            .join(broadcast_if(own, small), ["qid", "node"], "left_anti")
        )
        if eligible is not None:
            nxt = nxt.join(
                eligible.select("tenant", F.col("doc_id").alias("node")), ["tenant", "node"], "left_semi"
            )
        if depth > 1:
            nxt = nxt.join(visited, ["qid", "seed", "node"], "left_anti")
        nxt = nxt.select("qid", "tenant", "seed", "score", "node").distinct()
        reached.append(
            nxt.select(
                "qid", "tenant", "node", "seed", F.lit(depth).alias("depth"),
                numeric.link_decay(F.col("score"), depth, decay).alias("gain"),
            )
        )
        if depth < max_depth:
            visited = visited.unionByName(nxt.select("qid", "seed", "node"))
            walk = nxt
    gains = reached[0]
    for r in reached[1:]:
        gains = gains.unionByName(r)
    # Best gain first; the origins are the seeds within rounding of it.
    best = gains.groupBy("qid", "tenant", "node").agg(
        F.max("gain").alias("link_score"),
        F.collect_list(F.struct("seed", "depth", "gain")).alias("_all"),
    )
    tied = F.filter("_all", lambda g: numeric.is_close(g["gain"], F.col("link_score")))
    return best.select(
        "qid", "tenant", F.col("node").alias("doc_id"), "link_score",
        F.array_min(F.transform(tied, lambda g: g["depth"])).alias("link_depth"),
        F.array_sort(F.array_distinct(F.transform(tied, lambda g: g["seed"]))).alias("seed_ids"),
    )



def hit_order():
    """Score, then link depth, then id."""
    return [F.round("score", 9).desc(), F.col("link_depth").asc(), F.col("doc_id").asc()]


def native_search(bm25: Bm25, edges: DataFrame, k: int, seed_k: int | None = None, max_depth: int = 1,
                  decay: float = 0.35, eligible: DataFrame | None = None, small: bool = False) -> DataFrame:
    """Lexical seeds plus their links; every candidate keeps its better score.

    Seeds and links hold a few rows a question and feed several joins, so both
    are settled; only the linked pairs are scored a second time.
    """
    check_limits(k, seed_k, max_depth, decay)
    if seed_k is None:
        seed_k = k if max_depth == 0 else max(1, (k + 1) // 2)
    seeds = top_k(bm25.scores(), ["qid"], by_score(), seed_k).drop("rank")
    if max_depth > 0 and decay != 0:
        seeds = settle(seeds)
    direct = seeds.select(
        "qid", "tenant", "doc_id", "score", F.col("score").alias("lexical_score"),
        F.lit(0.0).alias("link_score"), F.lit(0).alias("link_depth"), F.array("doc_id").alias("seed_ids"),
    )
    if max_depth == 0 or decay == 0:
        return top_k(direct, ["qid"], hit_order(), k)
    linked = settle(expand_links(seeds, edges, max_depth, decay, eligible, small))
    own = bm25.scores_of(linked, small).withColumnRenamed("score", "lexical_score")
    via = linked.join(own, ["qid", "doc_id"], "left").withColumn(
        "lexical_score", F.coalesce("lexical_score", F.lit(0.0))
    )
    via = via.withColumn("score", F.greatest("lexical_score", "link_score")).select(*direct.columns)
    return top_k(direct.unionByName(via), ["qid"], hit_order(), k)


def hybrid_search(seeds: DataFrame, edges: DataFrame, k: int, max_depth: int = 1, decay: float = 0.35,
                  eligible: DataFrame | None = None, small: bool = False, seed_k: int | None = None) -> DataFrame:
    """Vector seeds keep their raw similarity, others the decayed link score.

    With ``seed_k`` only the best so many seeds of a question are followed; the
    others are results of their own, and one that a link reaches as well keeps
    its similarity and takes the link's score, depth and seeds along.
    """
    check_limits(k, seed_k, max_depth, decay)
    best = seeds.groupBy("qid", "tenant", "doc_id").agg(F.max("score").alias("score"))
    if eligible is not None:
        best = best.join(eligible.select("tenant", "doc_id"), ["tenant", "doc_id"], "left_semi")
    best = settle(best)
    direct = best.select(
        "qid", "tenant", "doc_id", "score", F.col("score").alias("vector_score"),
        F.lit(0.0).alias("link_score"), F.lit(0).alias("link_depth"), F.array("doc_id").alias("seed_ids"),
    )
    if max_depth == 0 or decay == 0:
        return top_k(direct, ["qid"], hit_order(), k)
    from_ = best if seed_k is None else settle(top_k(best, ["qid"], by_score(), seed_k).drop("rank"))
    via = expand_links(from_, edges, max_depth, decay, eligible, small).select(
        "qid", "tenant", "doc_id", F.col("link_score").alias("score"), F.lit(0.0).alias("vector_score"),
        "link_score", "link_depth", "seed_ids",
    )
    if seed_k is None:
        return top_k(direct.unionByName(via), ["qid"], hit_order(), k)
    # A seed that is not followed may be reached by a link.
    followed = from_.select("qid", "doc_id", F.lit(True).alias("_f"))
    own = direct.join(followed, ["qid", "doc_id"], "left").withColumn("seed_ids", F.when(F.col("_f"), F.col("seed_ids")).otherwise(F.array().cast(direct.schema["seed_ids"].dataType))).drop("_f")
    linked = via.select("qid", "doc_id", F.col("tenant").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("link_score", "link_depth", "seed_ids")])
    both = own.join(linked, ["qid", "doc_id"], "full_outer").select(
        "qid", F.coalesce("tenant", "_t").alias("tenant"), "doc_id", F.coalesce("score", "_link_score").alias("score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        *[F.coalesce(f"_{c}", c).alias(c) for c in ("link_score", "link_depth", "seed_ids")],
    )
    return top_k(both, ["qid"], hit_order(), k)


def adjacency_search(ranked: DataFrame, ordinals: DataFrame, k: int, fraction: float = 0.5, decay: float = 0.35,
                     small: bool = False) -> DataFrame:
    """Half the budget for seeds, then passages one ordinal before and after.

    ``ordinals`` is (tenant, doc_id, ordinal); a NULL ordinal has no neighbours.
    The band join is an equi-join on the two shifted ordinals.
    """
    check_limits(k, None, 0, decay)
    seeds = ranked.filter(F.col("rank") <= numeric.seed_count(k, fraction)).select("qid", "tenant", "doc_id", "score", "rank")
    seeds = settle(seeds)
    placed = ordinals.filter("ordinal is not null")
    at = placed.join(broadcast_if(seeds, small), ["tenant", "doc_id"])
    shifted = at.select(
        "qid", "tenant", "score", "rank", F.explode(F.array(F.lit(-1), F.lit(1))).alias("delta"), "ordinal"
    ).select("qid", "tenant", "score", "rank", "delta", (F.col("ordinal") + F.col("delta")).alias("ordinal"))
    near = placed.join(broadcast_if(shifted, small), ["tenant", "ordinal"]).join(
        broadcast_if(seeds.select("qid", "doc_id"), small), ["qid", "doc_id"], "left_anti"
    )
    # The first seed reaching a passage sets its score.
    first = near.groupBy("qid", "tenant", "doc_id").agg(F.min_by("score", F.struct("rank", "delta")).alias("score"))
    extra = first.select("qid", "tenant", "doc_id", numeric.link_decay(F.col("score"), 1, decay).alias("score"), F.lit(1).alias("link_depth"))
    both = seeds.select("qid", "tenant", "doc_id", "score", F.lit(0).alias("link_depth")).unionByName(extra)
    return top_k(both, ["qid"], by_score(), k)
