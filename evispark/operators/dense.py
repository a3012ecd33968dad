"""Exact vector search: blocked matrix products with per-task top-k."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions import arrays, numeric
from evispark.operators.ranking import by_score, check_limits, top_k
from evispark.session import spread

BLOCK_BYTES = 64 << 20
# Scores a task holds at once.
SCORES_AT_ONCE = 4 << 20
# Rows a task turns into vectors at once, and words whose bucket it remembers.
ROWS_AT_ONCE, KEPT_WORDS = 2048, 100_000
RESULT = "qid string, tenant string, doc_id bigint, score double"


def hashing_vectors(df: DataFrame, ident: str, dim: int = 384) -> DataFrame:
    """(ident, tenant, idx, val): unit-length bag of hashed words, sparse.

    The offline embedder: word counts by md5 bucket, counted inside the row and
    L2-normalised; a text without words keeps the zero vector.
    """
    d = spread(df.select(ident, "tenant", "text"))
    counts = arrays.counted(numeric.hash_buckets(F.coalesce("text", F.lit("")), dim))
    unit = arrays.let(
        counts, lambda r: F.struct(r["term"].alias("idx"), numeric.l2_normalise(r["tf"]).alias("val"))
    )
    return d.select(ident, "tenant", unit.alias("_v")).select(ident, "tenant", "_v.idx", "_v.val")


def dense_vectors(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(ident, tenant, idx, val) from array<float> vectors of one dimension.

    A vector of another dimension, or a null one, fails the job with its id;
    ``dimension_violations`` lists all of them.
    """
    told = F.concat(F.lit(f"vector without {dim} components: "), F.coalesce(F.col(ident).cast("string"), F.lit("null")))
    checked = F.when(F.coalesce(F.size(vector) == dim, F.lit(False)), F.col(vector).cast("array<double>")).otherwise(F.raise_error(told))
    return df.select(ident, "tenant", F.sequence(F.lit(0), F.lit(dim - 1)).alias("idx"), checked.alias("val"))


def dimension_violations(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(ident, size) of vectors that do not have ``dim`` components; size is null for a null vector."""
    size = F.when(F.col(vector).isNotNull(), F.size(vector))
    return df.select(ident, size.alias("size")).filter(~size.eqNullSafe(F.lit(dim)))


def _matrix(idx, val, dim: int) -> np.ndarray:
    out = np.zeros((len(idx), dim))
    for row, (i, v) in enumerate(zip(idx, val)):
        out[row, np.asarray(i, dtype=np.int64)] = v
    return out


def hashing_encode(dim: int = 384):
    """The offline embedder for batches of texts: md5 buckets of lowered words."""
    known: dict[str, int] = {}

    def encode(texts) -> np.ndarray:
        if len(known) > KEPT_WORDS:
            known.clear()
        out = np.zeros((len(texts), dim))
        for row, t in enumerate(texts):
            for w in (t or "").lower().split():
                at = known.get(w)
                if at is None:
                    at = known[w] = int(hashlib.md5(w.encode()).hexdigest(), 16) % dim
                out[row, at] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)

    return encode


def _best(keyed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ids breaking ties."""
    at = np.arange(len(keyed))
    if len(keyed) > k:
        kth = np.partition(keyed, len(keyed) - k)[len(keyed) - k]
        at = np.flatnonzero(keyed >= kth)
    return at[np.lexsort((ids[at], -keyed[at]))][:k]


def _search(block, matrix, k: int):
    """Task body: keep k rows for each question over all batches of the task."""

    def run(batches):
        by_tenant, best = block.value, {}
        for pdf in batches:
            for tenant, group in pdf.groupby("tenant", sort=False):
                if tenant not in by_tenant:
                    continue
                qids, q = by_tenant[tenant]
                kept = best.setdefault(tenant, [(np.empty(0, np.int64), np.empty(0))] * len(qids))
                step = max(k, min(ROWS_AT_ONCE, SCORES_AT_ONCE // len(qids)))
                for lo in range(0, len(group), step):
                    part = group.iloc[lo : lo + step]
                    ids = part["doc_id"].to_numpy()
                    scores = q @ matrix(part).T
                    for j in range(len(qids)):
                        i, s = np.concatenate([kept[j][0], ids]), np.concatenate([kept[j][1], scores[j]])
                        at = _best(np.round(s, 9), i, k)
                        kept[j] = (i[at], s[at])
        for tenant, kept in best.items():
            qids = by_tenant[tenant][0]
            yield pd.DataFrame(
                {
                    "qid": np.repeat(np.array(qids, dtype=object), [len(i) for i, _ in kept]), "tenant": tenant,
                    "doc_id": np.concatenate([i for i, _ in kept]), "score": np.concatenate([s for _, s in kept]),
                }
            )

    return run


def _top_k(rows: DataFrame, columns, matrix, queries: DataFrame, dim: int, k: int) -> DataFrame:
    check_limits(k)
    spark = rows.sparkSession
    limit = max(1, BLOCK_BYTES // (8 * dim))
    queries = queries.select("qid", "tenant", "idx", "val")
    head = queries.limit(limit + 1).toPandas()
    if len(head) <= limit:
        blocks = [head]
    else:
        n = queries.count() * 2 // limit + 1
        part = F.pmod(F.xxhash64("qid"), F.lit(n))
        blocks = (queries.filter(part == i).toPandas() for i in range(n))
    found = None
    for pdf in blocks:
        packed = {t: (g["qid"].tolist(), _matrix(g["idx"], g["val"], dim)) for t, g in pdf.groupby("tenant")}
        block = spark.sparkContext.broadcast(packed)
        wanted = rows.filter(F.col("tenant").isin(list(packed))) if len(packed) < 1000 else rows
        hits = wanted.select("doc_id", "tenant", *columns).mapInPandas(_search(block, matrix, k), RESULT)
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, ["qid"], by_score(), k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """(qid, tenant, doc_id, score, rank) by inner product within the tenant.

    ``vectors`` (doc_id, tenant, idx, val) stay where they are. Query vectors
    travel in blocks of at most BLOCK_BYTES; more queries mean more blocks,
    each one pass over the vectors, and no pair of rows is ever materialised.
    Each block is bounded; all blocks of a query set stay until the result is
    read, so their sum grows with the number of queries.
    """
    return _top_k(vectors, ["idx", "val"], lambda p: _matrix(p["idx"], p["val"], dim), queries, dim, k)


def text_top_k(docs: DataFrame, queries: DataFrame, encode, dim: int, k: int = 10) -> DataFrame:
    """As vector_top_k, embedding each batch of texts with ``encode`` on the fly."""
    rows = spread(docs.select("doc_id", "tenant", "text"))
    return _top_k(rows, ["text"], lambda p: np.asarray(encode(p["text"].tolist()), dtype=np.float64), queries, dim, k)


def hashing_top_k(docs: DataFrame, questions: DataFrame, k: int = 10, dim: int = 384) -> DataFrame:
    """Dense arm over texts with the offline embedder."""
    return text_top_k(docs, hashing_vectors(questions, "qid", dim), hashing_encode(dim), dim, k)


def embed_with(df: DataFrame, ident: str, encode, dim: int) -> DataFrame:
    """(ident, tenant, idx, val) from an injected ``encode(list[str]) -> matrix``."""
    schema = T.StructType(
        [
            T.StructField(ident, df.schema[ident].dataType),
            T.StructField("tenant", T.StringType()),
            T.StructField("idx", T.ArrayType(T.IntegerType())),
            T.StructField("val", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches):
        for pdf in batches:
            m = np.asarray(encode(pdf["text"].tolist()), dtype=np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norm == 0, 1.0, norm)
            yield pd.DataFrame(
                {ident: pdf[ident], "tenant": pdf["tenant"], "idx": [list(range(dim))] * len(pdf), "val": list(m)}
            )

    return df.select(ident, "tenant", "text").mapInPandas(run, schema)


def seeds_from(results: DataFrame) -> DataFrame:
    """Usable dense seeds: an id under either name and a finite score."""
    ident = F.coalesce(*[F.col(c) for c in ("chunk_id", "source_chunk_id") if c in results.columns])
    score = F.expr("try_cast(score as double)")
    return results.withColumn("_id", ident).withColumn("_s", score).filter(
        F.col("_id").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") < float("inf"))
    ).select("qid", F.col("_id").alias("chunk_id"), F.col("_s").alias("score"))
