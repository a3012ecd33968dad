"""Gates over runs: reconciliation against a plain comparison, digest joins, rewritten digests, index gaps."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evispark.errors import EvidenceError
from evispark.operators import experiment, gates

DDL = "k string, n bigint, flag boolean, sha string"


def plain(expected, actual):
    out = []
    counts = Counter((k, n) for k, n, *_ in actual)
    e = {r[:2]: r[2:] for r in expected}
    a = {r[:2]: max(x[2:] for x in actual if x[:2] == r[:2]) for r in actual}
    for key in e.keys() | a.keys():
        if key not in a:
            out.append(("missing", *key))
        elif key not in e:
            out.append(("extra", *key))
        else:
            out += [(f"{c}_differs", *key) for c, x, y in zip(("flag", "sha"), e[key], a[key]) if x != y]
        if counts[key] > 1:
            out.append(("duplicate", *key))
    return sorted(out, key=repr)


def test_reconcile_against_a_plain_comparison(spark):
    rng = random.Random(6)
    expected = [(rng.choice(["a", "b", "é", None]), i, i % 3 == 0, f"s{i}") for i in range(300)]
    actual = [r for r in expected if r[1] % 50 != 7] + [("new", 900, True, "x"), (None, 901, None, None)]
    actual = [(k, n, not f if n == 11 else f, "other" if n == 12 else s) for k, n, f, s in actual]
    actual += [actual[5], actual[5], actual[40]]
    e, a = spark.createDataFrame(expected, DDL), spark.createDataFrame(actual, DDL)
    got = sorted(((r.rule, r.k, r.n) for r in gates.reconcile(e, a, ["k", "n"], ["flag", "sha"]).collect()), key=repr)
    assert got == plain(expected, actual)
    assert gates.reconcile(a, a.repartition(3), ["k", "n"], ["flag", "sha"]).filter("rule <> 'duplicate'").count() == 0
    assert gates.reconcile(e, e, ["k", "n"]).count() == 0
    assert gates.reconcile(e.limit(0), e.limit(0), ["k", "n"]).count() == 0
    # two copies of one row instead of two of another: counts agree, sums do not
    two = [("a", 1, True, "s"), ("a", 1, True, "s")]
    other = [("a", 2, True, "s"), ("a", 2, True, "s")]
    assert gates.reconcile(spark.createDataFrame(two, DDL), spark.createDataFrame(other, DDL), ["k", "n"]).count() == 3


def test_only_ranges_that_differ_are_read_by_row(spark, monkeypatch):
    seen = []
    real = gates.settle

    def spy(df):
        out = real(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(gates, "settle", spy)
    e = spark.range(5000).select(F.col("id").alias("n"), F.lit("x").alias("sha"))
    gates.reconcile(e, e.repartition(7), ["n"], ["sha"]).count()
    gates.reconcile(e, e.withColumn("sha", F.when(F.col("n") == 77, "y").otherwise("x")), ["n"], ["sha"]).count()
    assert seen == [0, 1]


def test_index_and_fields(spark):
    s = spark.createDataFrame([(i,) for i in (0, 1, 1, 3, 9, None)], "schedule_index bigint")
    assert sorted((r.rule, r["index"] or -1) for r in gates.index_gaps(s, "schedule_index").collect()) == [("index_duplicate", 1), ("index_out_of_range", -1), ("index_out_of_range", 9)]
    declared = spark.createDataFrame([(3, "x")], "n bigint, sha string")
    actual = spark.createDataFrame([(4, "x", None, 1)], "n bigint, sha string, empty string, more int")
    assert sorted(tuple(r) for r in gates.field_mismatches(declared, actual).collect()) == [("more", None, "1"), ("n", "3", "4")]


def test_complete_run_has_no_violation(spark):
    cells = spark.createDataFrame([(f, a, q, q % 2 == 0) for f in "xy" for a in "rt" for q in range(4)], "flow string, arm string, qid bigint, answerable boolean")
    keys = ["flow", "arm", "qid"]
    made = cells.withColumn("answer_sha256", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256))
    schedule = cells.select(*keys, (F.col("qid") * 4 + F.when(F.col("flow") == "x", 0).otherwise(2) + F.when(F.col("arm") == "r", 0).otherwise(1)).alias("schedule_index"))
    scores = made.withColumn("judge_trials", F.lit(2).cast("bigint"))
    trials = made.select("*", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("trial_index"))
    assert gates.run_violations(cells, schedule, made, scores, trials, keys, 2, 4).count() == 0
    got = gates.run_violations(cells, schedule, made.filter("qid <> 3"), scores, trials.filter("not (qid = 1 and trial_index = 2 and flow = 'x' and arm = 'r')"), keys, 2, 4).collect()
    assert Counter((r.source, r.rule) for r in got) == {("generation", "missing"): 4, ("score", "answer_sha256_differs"): 4, ("trial", "answer_sha256_differs"): 8, ("trial", "missing"): 1}
    with pytest.raises(EvidenceError):
        experiment.require_empty(gates.run_violations(cells.filter("not (qid = 1 and flow = 'x')"), schedule, made, scores, trials, keys, 2, 4))


def test_scores_join_only_their_own_answer(spark):
    made = spark.createDataFrame([("a", 1, "h1", False), ("b", 2, "h2", False)], "k string, latency int, answer_sha256 string, answerable boolean")
    score = lambda *rows: spark.createDataFrame(rows, "k string, answer_sha256 string, answerable boolean, points int")
    got = gates.digest_join(made, score(("a", "h1", True, 5)), ["k"]).collect()
    assert [r.asDict() for r in got] == [{"k": "a", "latency": 1, "answer_sha256": "h1", "answerable": True, "points": 5}]
    for bad in (("c", "h1", True, 5), ("a", "h2", True, 5), ("a", None, True, 5)):
        with pytest.raises(Exception, match="no generation record|digest mismatch"):
            gates.digest_join(made, score(bad), ["k"]).collect()


def test_rewritten_digests_are_carried_on(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = spark.createDataFrame([("a", "me", sha("a|me")), ("b", "me", sha("b|me"))], "text string, account string, sha string")
    clean = gates.scrubbed(made, ["account"], "sha", F.sha2("text", 256))
    assert {r.text: (r.sha, r.old_sha) for r in clean.collect()} == {x: (sha(x), sha(f"{x}|me")) for x in "ab"} and "account" not in clean.columns
    rows = spark.createDataFrame([(1, sha("a|me")), (2, sha("a|me")), (3, "unknown"), (4, None)], "i int, sha string")
    assert {r.i: r.sha for r in gates.carried(rows, clean, "sha").collect()} == {1: sha("a"), 2: sha("a"), 3: "unknown", 4: None}
    torn = spark.createDataFrame([("a", "x", "same"), ("b", "x", "same")], "text string, account string, sha string")
    with pytest.raises(Exception, match="one digest, two records"):
        gates.carried(spark.createDataFrame([(1, "same")], "i int, sha string"), gates.scrubbed(torn, ["account"], "sha", F.sha2("text", 256)), "sha").collect()
