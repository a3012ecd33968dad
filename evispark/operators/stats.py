"""Paired statistics over complete grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evispark.functions import numeric
from evispark.errors import PairingError
from evispark.operators.experiment import require_empty
from evispark.operators.ranking import attach_row, dense_index, exact_percentiles, linear


def binomial_tail_p(b: int, c: int) -> float:
    """Two-sided exact p of a (b, c) split under a fair coin."""
    n, m = b + c, min(b, c)
    if n == 0:
        return 1.0
    if n <= 2000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
    # Sum down from the largest term; the rest is below rounding.
    log_top = math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) - n * math.log(2)
    term, total, k = 1.0, 0.0, m
    while k >= 0 and term > total * 1e-18:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total * math.exp(log_top))


@F.pandas_udf(DoubleType())
def exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail_p(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def mcnemar(pairs: DataFrame, keys, baseline: Column, treatment: Column) -> DataFrame:
    """(keys, n, baseline_only, treatment_only, discordant, p) from paired flags.

    The rows are counted first; the exact p sees one row for each contrast.
    """
    counted = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(baseline & ~treatment).alias("baseline_only"),
        F.count_if(~baseline & treatment).alias("treatment_only"),
    )
    return counted.withColumn("discordant", F.col("baseline_only") + F.col("treatment_only")).withColumn(
        "p", exact_p("baseline_only", "treatment_only")
    )


def holm(tests: DataFrame, family, label: str, p: str = "p") -> DataFrame:
    """Step-down adjusted p within each family of tests."""
    order = [F.round(p, 12), F.col(label)]
    w = Window.partitionBy(*family)
    step = w.orderBy(*order)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(step) + 1) * F.col(p))
    running = step.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_scaled", scaled).withColumn("p_holm", F.max("_scaled").over(running)).drop("_scaled")


def paired(cells: DataFrame, keys, arm: str, baseline: str, treatment: str, metric: str) -> DataFrame:
    """(keys, raw, treated, difference) where both arms have a value."""
    wide = cells.filter(F.col(arm).isin(baseline, treatment)).groupBy(*keys).agg(
        F.max(F.when(F.col(arm) == baseline, F.col(metric))).alias("raw"),
        F.max(F.when(F.col(arm) == treatment, F.col(metric))).alias("treated"),
    )
    return wide.filter("raw is not null and treated is not null").withColumn(
        "difference", F.col("treated") - F.col("raw")
    )


# Groups of up to this many differences that are not zero have an exact p.
EXACT_UPTO = 50


def rank_sum_counts(doubled_ranks) -> np.ndarray:
    """How many of the 2 ** n choices of signs give each doubled rank sum.

    The product of (1 + x ** r) over the ranks, one factor a step; counts stay
    below 2 ** 50, so they are exact.
    """
    counts = np.zeros(int(sum(doubled_ranks)) + 1, dtype=np.int64)
    counts[0] = 1
    for r in doubled_ranks:
        more = counts.copy()
        more[r:] += counts[: len(counts) - r]
        counts = more
    return counts


@F.pandas_udf(DoubleType())
def signed_rank_p(ranks: pd.Series, w_plus: pd.Series) -> pd.Series:
    """Two-sided exact p of a rank sum; ``ranks`` holds (doubled rank, how many) of one group."""

    def p(groups, w):
        if groups is None:
            return None
        counts = rank_sum_counts([g["r"] for g in groups for _ in range(g["n"])])
        at = int(round(2 * w))
        tail = min(int(counts[: at + 1].sum()), int(counts[at:].sum()))
        return min(1.0, 2 * tail / int(counts.sum()))

    return pd.Series([p(g, w) for g, w in zip(ranks, w_plus)], dtype="float64")


def wilcoxon(pairs: DataFrame, keys, difference: str = "difference") -> DataFrame:
    """(keys, n_nonzero, w_plus, z, p, p_exact, method): signed ranks, zeros dropped.

    ``p_exact`` is there for groups of at most ``EXACT_UPTO`` differences that
    are not zero, equal ones sharing their rank. ``p`` is the exact one where
    no difference is zero and no two are equal, else the normal one, which
    ``method`` names. A group without any difference has p 1.

    Equal magnitudes are counted before anything is ranked, so the window runs
    over distinct magnitudes; their average ranks follow from the counts.
    """
    keys = list(keys)
    d = F.round(difference, 12)
    nonzero = pairs.select(*keys, F.abs(d).alias("_m"), (d > 0).alias("_up")).filter("_m > 0")
    ties = nonzero.groupBy(*keys, "_m").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_up").alias("_u"))
    upto = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0))
    n = F.sum("_n")
    first = F.when(F.col("_upto") <= EXACT_UPTO, F.struct((2 * F.col("_rank")).cast("int").alias("r"), F.col("_n").cast("int").alias("n")))
    sums = ranked.groupBy(*keys).agg(
        n.alias("n_nonzero"), F.sum(F.col("_u") * F.col("_rank")).alias("w_plus"),
        F.sum(F.col("_n").cast("double") * F.col("_n") * F.col("_n") - F.col("_n")).alias("_t"),
        # at most EXACT_UPTO entries, whatever the group
        F.when(n <= EXACT_UPTO, F.collect_list(first)).alias("_ranks"), F.max("_n").alias("_most"),
    )
    k = F.col("n_nonzero").cast("double")
    mean = k * (k + 1) / 4
    var = k * (k + 1) * (2 * k + 1) / 24 - F.col("_t") / 48
    every = pairs.groupBy(*keys).agg(F.count(difference).alias("_pairs")).join(sums, keys, "left")
    z = F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var)).otherwise(F.lit(0.0))
    exact = F.col("_ranks").isNotNull() & (F.col("_most") == 1) & (F.col("_pairs") == F.col("n_nonzero"))
    told = every.select(
        *keys, F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
        F.coalesce(z, F.lit(0.0)).alias("z"), signed_rank_p("_ranks", "w_plus").alias("p_exact"),
        F.when(exact, F.lit("exact")).otherwise(F.lit("normal")).alias("method"),
    )
    p = F.when(F.col("method") == "exact", F.col("p_exact")).otherwise(normal_two_sided("z"))
    return told.select(*keys, "n_nonzero", "w_plus", "z", p.alias("p"), "p_exact", "method")


# Clusters of a block meet in one task of the bootstrap; so many repetitions or draws are one row of its work list.
BLOCK_CLUSTERS, REPETITIONS_A_ROW, DRAWS_A_ROW = 4096, 64, 1 << 22


def cluster_bootstrap(
    pairs: DataFrame, cluster: str, block: Column, repetitions: int = 10000, seed: int = 42,
    confidence: float = 0.95, difference: str = "difference", keys=(), width: int = BLOCK_CLUSTERS,
) -> DataFrame:
    """Mean difference and its percentile interval over clusters, for each key.

    Each repetition draws as many clusters as there are, with replacement, and
    pools all their differences. Draws are made in two levels: first only how
    many fall on each block of ``width`` clusters, then, inside the block, which
    clusters they take. What moves is a number for each repetition and block on
    the way in and a partial (sum, count) on the way out; draws never do, and
    clusters move once. With one row a cluster this is the plain row bootstrap.
    A key may have up to 2 ** 32 clusters.
    """
    keys = list(keys)
    link = lambda many, one: many.join(one, keys) if keys else attach_row(many, one)
    sums = pairs.groupBy(*keys, cluster).agg(F.sum(difference).alias("_s"), F.count(difference).alias("_c"))
    placed = dense_index(sums, block, [cluster], "_i", keys)
    placed = placed.select(*keys, F.expr(f"_i div {width}").alias("_b"), (F.col("_i") % width).alias("_in"), F.col("_s").cast("double").alias("_s"), "_c")
    total = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc")
    )
    steps = lambda end, step: F.explode(F.sequence(F.lit(0).cast("bigint"), end, F.lit(step).cast("bigint")))
    work = total.select(*keys, "_n", steps(F.lit(repetitions - 1).cast("bigint"), REPETITIONS_A_ROW).alias("_rep"))
    work = work.select("*", steps(F.col("_n") - 1, DRAWS_A_ROW).alias("_first")).repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    fields = [total.schema[k] for k in keys]
    schema = lambda *more: StructType([*fields, *[StructField(n, t) for n, t in more]])
    repeated = lambda rows, i: [rows.column(k).take(pa.array(i)) for k in keys]

    def fall(batches):
        for rows in batches:
            for i, (n, rep, first) in enumerate(zip(*[rows.column(c).to_pylist() for c in ("_n", "_rep", "_first")])):
                for r in range(rep, min(rep + REPETITIONS_A_ROW, repetitions)):
                    at = numeric.draws(n, numeric.stream(seed, r, 0), first, min(DRAWS_A_ROW, n - first))
                    count = np.bincount((at // width).astype(np.int64))
                    hit = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([*repeated(rows, np.full(len(hit), i)), pa.array(hit), pa.array(np.full(len(hit), r)), pa.array(count[hit])], [*keys, "_b", "_rep", "_k"])

    many = [(n, LongType()) for n in ("_b", "_rep", "_k")]
    times = work.mapInArrow(fall, schema(*many)).groupBy(*keys, "_b", "_rep").agg(F.sum("_k").alias("_k"))

    def pick(clusters, asked):
        order = np.argsort(clusters.column("_in").to_numpy())
        s, c = (clusters.column(n).to_numpy()[order].astype(float) for n in ("_s", "_c"))
        b = clusters.column("_b")[0].as_py()
        reps, k = asked.column("_rep").to_numpy(), asked.column("_k").to_numpy()
        ss, cc = np.zeros(len(reps)), np.zeros(len(reps))
        part = np.cumsum(k) // (1 << 20)
        for p in np.unique(part):
            here = np.flatnonzero(part == p)
            kk = k[here]
            owner = np.repeat(np.arange(len(here)), kk)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(kk) - kk, kk)
            at = numeric.draws(len(s), numeric.stream(seed, reps[here], b + 1)[owner], nth)
            ss[here] = np.bincount(owner, s[at], len(here))
            cc[here] = np.bincount(owner, c[at], len(here))
        return pa.Table.from_arrays([*repeated(clusters, np.zeros(len(reps), int)), pa.array(reps), pa.array(ss), pa.array(cc)], [*keys, "_rep", "_s", "_c"])

    drawn = placed.groupBy(*keys, "_b").cogroup(times.groupBy(*keys, "_b")).applyInArrow(pick, schema(("_rep", LongType()), ("_s", DoubleType()), ("_c", DoubleType())))
    means = drawn.groupBy(*keys, "_rep").agg((F.sum("_s") / F.sum("_c")).alias("_mean"))
    tail = (1 - confidence) / 2
    # At most ``repetitions`` values a key, whatever the data.
    spread = means.groupBy(*keys).agg(
        F.percentile("_mean", F.lit(tail)).alias("ci_low"), F.percentile("_mean", F.lit(1 - tail)).alias("ci_high")
    )
    return link(total, spread).select(
        *keys, F.col("_n").alias("n_clusters"), F.col("_tc").alias("n_differences"),
        (F.col("_ts") / F.col("_tc")).alias("mean_difference"), "ci_low", "ci_high",
    )


def matrix_gaps(pairs: DataFrame, cluster: str, arm: str) -> DataFrame:
    """(cluster, arm, rule) where the matrix of clusters and arms lacks a cell or has it twice.

    Each cluster is compared with the list of all arms, which is short; clusters are never crossed with arms in a join.
    """
    have = pairs.groupBy(cluster).agg(F.collect_list(arm).alias("_have"))
    every = pairs.agg(F.collect_set(arm).alias("_all"))
    told = attach_row(have, every).select(
        cluster,
        F.explode(
            F.concat(
                F.transform(F.array_except("_all", "_have"), lambda a: F.struct(a.alias("a"), F.lit("missing").alias("r"))),
                F.transform(
                    F.filter("_all", lambda a: F.size(F.filter("_have", lambda h: h == a)) > 1), lambda a: F.struct(a.alias("a"), F.lit("duplicate").alias("r"))
                ),
            )
        ).alias("_g"),
    )
    return told.select(cluster, F.col("_g.a").alias(arm), F.col("_g.r").alias("rule"))


def pooled_bootstrap(pairs: DataFrame, cluster: str, arm: str, block: Column, clusters: int | None = None, **how) -> DataFrame:
    """`cluster_bootstrap` over all arms at once; a matrix that is not complete is refused.

    Every cluster must have one difference in every arm, and, where ``clusters`` says how many there must be, none may lack.
    """
    require_empty(matrix_gaps(pairs, cluster, arm), PairingError, "pooled matrix")
    if clusters is not None:
        n = pairs.select(cluster).distinct().count()
        if n != clusters:
            raise PairingError(f"pooled matrix: {n} clusters where {clusters} are due")
    return cluster_bootstrap(pairs, cluster, block, **how)


def comparison_table(pairs: DataFrame, arm: str, cluster: str, block: Column, treatment: str, repetitions: int = 10000, expected: int | None = None) -> DataFrame:
    """One row for each ``arm`` of paired differences: means, median, interval, counts, p, and p adjusted over all arms.

    ``expected`` is the number of pairs that each arm must have; another number is refused.
    """
    if expected is not None:
        short = pairs.groupBy(arm).agg(F.count(F.lit(1)).alias("n_pairs")).filter(F.col("n_pairs") != expected)
        require_empty(short, PairingError, f"complete pairs of {treatment}")
    d = F.round("difference", 12)
    plain = pairs.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("raw").alias("raw_mean"), F.avg("treated").alias("treatment_mean"),
        F.avg("difference").alias("mean_delta"), F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("tied"), F.count_if(d < 0).alias("worse"),
    )
    median = exact_percentiles(pairs, [arm], "difference", {"median_delta": linear(0.5)})
    interval = cluster_bootstrap(pairs, cluster, block, repetitions=repetitions, keys=[arm]).select(arm, "ci_low", "ci_high")
    tests = wilcoxon(pairs, [arm]).select(arm, "p").withColumn("multiplicity_family", F.lit(treatment))
    adjusted = holm(tests, ["multiplicity_family"], arm).withColumn("multiplicity_family_size", F.count(F.lit(1)).over(Window.partitionBy("multiplicity_family")))
    return (
        plain.join(median, arm).join(interval, arm).join(adjusted, arm).withColumnsRenamed({"p": "wilcoxon_p", "p_holm": "holm_p"})
        .select(
            arm, F.lit(treatment).alias("treatment"), "n_pairs", "raw_mean", "treatment_mean", "mean_delta", "median_delta", "ci_low", "ci_high",
            "improved", "tied", "worse", "wilcoxon_p", "holm_p", "multiplicity_family", "multiplicity_family_size",
        )
    )


def dimension_deltas(cells: DataFrame, keys, arm: str, baseline: str, treatment: str, dimensions) -> DataFrame:
    """(dimension, n_pairs, raw_mean, treatment_mean, delta, p, p_holm): each graded dimension compared over the cells both arms have.

    All dimensions are one family; they are compared in one pass over long rows, not in one job each.
    """
    keys, dimensions = list(keys), list(dimensions)
    long = cells.select(*keys, arm, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in dimensions])).alias("s"))
    p = paired(long.select(*keys, arm, "s.dimension", "s.v"), [*keys, "dimension"], arm, baseline, treatment, "v")
    means = p.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("raw").alias("raw_mean"), F.avg("treated").alias("treatment_mean"), F.avg("difference").alias("delta")
    )
    tests = wilcoxon(p, ["dimension"]).select("dimension", "p").withColumn("_family", F.lit(treatment))
    return means.join(holm(tests, ["_family"], "dimension").drop("_family"), "dimension")


def missing_and_extra(cells: DataFrame, keys, expected: DataFrame, metric: str) -> DataFrame:
    """(rule, keys) of every breach of a complete grid: missing, extra,
    duplicate, or not a finite number."""
    keys = list(keys)
    have = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(metric).isNull() | F.isnan(metric) | (F.abs(metric) == float("inf"))).alias("_bad"),
    )
    want = expected.select(*keys).distinct().withColumn("_want", F.lit(True))
    j = want.join(have, keys, "full_outer")
    rules = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), F.lit("missing")),
            F.when(F.col("_want").isNull(), F.lit("extra")),
            F.when(F.col("_n") > 1, F.lit("duplicate")),
            F.when(F.col("_bad") > 0, F.lit("not_finite")),
        )
    )
    return j.select(F.explode(rules).alias("rule"), *keys)
