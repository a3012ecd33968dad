"""Exact signed ranks, two-level bootstrap draws and the comparison table against plain Python models."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.errors import PairingError
from evispark.functions import numeric
from evispark.operators import stats


def enumerated_p(differences):
    d = [x for x in differences if x]
    size = sorted(map(abs, d))
    rank = {m: np.mean([i + 1 for i, y in enumerate(size) if y == m]) for m in size}
    w = sum(rank[abs(x)] for x in d if x > 0)
    sums = [sum(r for r, up in zip((rank[abs(x)] for x in d), signs) if up) for signs in itertools.product((0, 1), repeat=len(d))]
    low, high = sum(s <= w for s in sums), sum(s >= w for s in sums)
    return min(1.0, 2 * min(low, high) / len(sums))


def test_exact_signed_rank_p(spark):
    rng = random.Random(4)
    groups = {f"free{n}": [rng.choice([-1, 1]) * (i + 1.5) for i in rng.sample(range(40), n)] for n in (1, 2, 3, 6, 10)}
    groups |= {f"tied{n}": [float(rng.choice([-2, -1, 1, 2, 3])) for _ in range(n)] for n in (2, 5, 9)}
    groups |= {"zero": [0.0, 0.0], "some": [0.0, 1.0, -2.0, 4.0], "many": [float(x) for x in range(1, 60)], "fifty": [float(x) * (-1) ** x for x in range(1, 51)]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, difference double")
    got = {r.k: r for r in stats.wilcoxon(df, ["k"]).collect()}
    for k, xs in groups.items():
        if k in ("many", "zero"):
            assert got[k].p_exact is None and got[k].method == "normal"
        elif k != "fifty":
            assert got[k].p_exact == pytest.approx(enumerated_p(xs))
            assert got[k].method == ("exact" if k.startswith("free") or k == "tied2" and len(set(map(abs, xs))) == 2 else "normal")
        assert got[k].p == got[k].p_exact if got[k].method == "exact" else got[k].p is not None
    assert got["zero"].p == 1.0 and got["fifty"].method == "exact" and 0 < got["fifty"].p <= 1
    assert sum(stats.rank_sum_counts(range(2, 101, 2))) == 2**50


def mix32(h):
    h ^= h >> 16
    h = h * numeric.MIX_1 % 2**32
    h ^= h >> 13
    h = h * numeric.MIX_2 % 2**32
    return h ^ h >> 16


def plain_bootstrap(clusters, repetitions, seed, width):
    """Clusters (sum, count) in order; the draws as the docstring tells them."""
    n, means = len(clusters), []
    start = lambda r, part: mix32(mix32((seed + r * numeric.STRIDE) % 2**32) ^ part)
    draw = lambda s, j, m: mix32((s + j * numeric.STRIDE) % 2**32) * m >> 32
    for r in range(repetitions):
        hits = [0] * -(-n // width)
        for j in range(n):
            hits[draw(start(r, 0), j, n) // width] += 1
        taken = []
        for b, m in enumerate(hits):
            size = min(width, n - b * width)
            taken += [clusters[b * width + draw(start(r, b + 1), j, size)] for j in range(m)]
        means.append(sum(s for s, _ in taken) / sum(c for _, c in taken))
    return np.percentile(means, [2.5, 97.5])


@pytest.mark.parametrize("width", [7, 4096])
def test_bootstrap_draws_in_two_levels(spark, monkeypatch, width):
    monkeypatch.setattr(stats, "DRAWS_A_ROW", 10)
    rng = random.Random(3)
    rows = [(k, q, rng.gauss(0.1, 1)) for k in ("a", "b", None) for q in range({"a": 23, "b": 1, None: 9}[k]) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "k string, qid bigint, difference double")
    one = {k: [(sum(v), len(v)) for v in ([d for kk, q, d in rows if kk == k and q == i] for i in range(30)) if v] for k in ("a", "b")}
    got = {r.k: r for r in stats.cluster_bootstrap(df.filter("k is not null"), "qid", F.floor(F.col("qid") / 5), repetitions=150, seed=9, keys=["k"], width=width).collect()}
    for k, clusters in one.items():
        low, high = plain_bootstrap(clusters, 150, 9, width)
        assert got[k].n_clusters == len(clusters) and got[k].ci_low == pytest.approx(low) and got[k].ci_high == pytest.approx(high)


def test_bootstrap_interval_is_the_known_one(spark):
    """The spread of means of n draws is that of the data over the root of n."""
    rng = np.random.default_rng(1)
    x = rng.normal(2.0, 3.0, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "qid bigint, difference double")
    r = stats.cluster_bootstrap(df, "qid", F.floor(F.col("qid") / 100), repetitions=4000, width=64).collect()[0]
    half = 1.96 * x.std() / 20
    assert r.ci_low == pytest.approx(x.mean() - half, abs=0.06) and r.ci_high == pytest.approx(x.mean() + half, abs=0.06)


def test_comparison_table_and_gates(spark):
    rows = [(f, q, 1.0, 1.0 + d) for f, ds in {"x": [0.5, 1.5, -1.0, 2.5, 3.5], "y": [0.0, 0.0, 1.0, 1.0, 1.0]}.items() for q, d in enumerate(ds)]
    pairs = spark.createDataFrame(rows, "flow string, qid bigint, raw double, treated double").withColumn("difference", F.col("treated") - F.col("raw"))
    got = {r.flow: r for r in stats.comparison_table(pairs, "flow", "qid", F.lit(0), "treated", repetitions=200, expected=5).collect()}
    assert (got["x"].improved, got["x"].tied, got["x"].worse, got["y"].improved, got["y"].tied) == (4, 0, 1, 3, 2)
    assert got["x"].wilcoxon_p == pytest.approx(enumerated_p([0.5, 1.5, -1.0, 2.5, 3.5])) and got["x"].median_delta == 1.5
    assert got["x"].multiplicity_family_size == 2 and got["x"].holm_p >= got["x"].wilcoxon_p
    assert got["x"].ci_low <= got["x"].mean_delta <= got["x"].ci_high
    with pytest.raises(PairingError):
        stats.comparison_table(pairs, "flow", "qid", F.lit(0), "treated", expected=6)
    assert stats.pooled_bootstrap(pairs, "qid", "flow", F.lit(0), clusters=5, repetitions=20).collect()[0].n_clusters == 5
    with pytest.raises(PairingError):
        stats.pooled_bootstrap(pairs, "qid", "flow", F.lit(0), clusters=6)
    short = pairs.filter("not (flow = 'y' and qid = 3)").union(pairs.filter("flow = 'x' and qid = 0"))
    assert sorted((r.qid, r.flow, r.rule) for r in stats.matrix_gaps(short, "qid", "flow").collect()) == [(0, "x", "duplicate"), (3, "y", "missing")]
    with pytest.raises(PairingError):
        stats.pooled_bootstrap(short, "qid", "flow", F.lit(0))
