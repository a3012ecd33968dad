import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.errors import EvidenceError
from evispark.functions import jsonx
from evispark.operators import audit, experiment, judging, metrics, packing, ranking, stats, tree


def test_carry_forward_and_index_across_blocks(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice("aab"), i, rnd.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {r.o: r for r in ranking.carry_forward(df, ["k"], F.floor(F.col("o") / 7), ["o"], {"last": F.col("v")}).collect()}
    last = {}
    for k, o, v in rows:
        assert got[o].last == last.get(k)
        last[k] = v if v is not None else last.get(k)
    idx = {r.o: r.i for r in ranking.dense_index(df, F.floor(F.col("o") / 7), ["o"], "i", ["k"]).collect()}
    seen = {}
    for k, o, _ in rows:
        assert idx[o] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_exact_percentiles_small_and_bracketed(spark):
    rnd = random.Random(1)
    rows = [("small", float(rnd.randrange(9))) for _ in range(11)]
    rows += [("big", rnd.choice([1.0, 1.0, rnd.random() * 50])) for _ in range(9000)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {"p50": 0.5, "p95": 0.95, "p999": 0.999, "p1": 0.01}
    got = ranking.exact_percentiles(df, ["k"], "v", {n: ranking.linear(p) for n, p in want.items()} | {"um": ranking.upper_median(), "lo": ranking.lower_index(0.9)})
    for r in got.collect():
        x = sorted(v for k, v in rows if k == r.k)
        for n, p in want.items():
            assert math.isclose(r[n], np.quantile(x, p), rel_tol=1e-12), (r.k, n)
        assert r.um == x[len(x) // 2] and r.lo == x[int(0.9 * (len(x) - 1))]


def test_known_p_values():
    assert stats.binomial_tail_p(3, 23) == pytest.approx(8.797645568847656e-05, rel=1e-12)
    assert stats.binomial_tail_p(5, 3) == 0.7265625
    assert stats.binomial_tail_p(0, 25) == pytest.approx(5.960464477539063e-08, rel=1e-12)
    assert stats.binomial_tail_p(0, 4) == 0.125 and stats.binomial_tail_p(0, 0) == 1.0
    exact = min(1.0, 2 * sum(math.comb(2100, i) for i in range(1001)) / 2**2100)
    assert stats.binomial_tail_p(1000, 1100) == pytest.approx(exact, rel=1e-9)


def test_holm_and_mcnemar(spark):
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.25), ("g", "e", 1.0)], "fam string, l string, p double")
    got = {r.l: round(r.p_holm, 12) for r in stats.holm(t, ["fam"], "l").collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.5, "e": 1.0}
    pairs = spark.createDataFrame([("c", False, True)] * 4 + [("c", True, True)] * 3, "k string, a boolean, b boolean")
    r = stats.mcnemar(pairs, ["k"], F.col("a"), F.col("b")).collect()[0]
    assert (r.n, r.baseline_only, r.treatment_only, r.discordant, r.p) == (7, 0, 4, 4, 0.125)


def test_wilcoxon_against_model(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([-2.0, -1.0, 0.0, 1.0, 1.0, 3.0])) for k in "aaaab" for _ in range(8)] + [("z", 0.0)] * 3
    got = {r.k: r for r in stats.wilcoxon(spark.createDataFrame(rows, "k string, difference double"), ["k"]).collect()}
    assert got["z"].p == 1.0 and got["z"].n_nonzero == 0
    for k in "ab":
        d = [x for g, x in rows if g == k and x]
        ranks = {m: np.mean([i + 1 for i, y in enumerate(sorted(map(abs, d))) if y == m]) for m in set(map(abs, d))}
        w = sum(ranks[abs(x)] for x in d if x > 0)
        n, ties = len(d), [sum(1 for y in d if abs(y) == m) for m in ranks]
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
        z = (w - n * (n + 1) / 4) / math.sqrt(var)
        assert got[k].w_plus == w and got[k].z == pytest.approx(z) and got[k].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_bootstrap_constant_difference_is_a_point(spark):
    p = spark.createDataFrame([(i % 7, 0.25) for i in range(30)], "qid bigint, difference double")
    r = stats.cluster_bootstrap(p, "qid", F.floor(F.col("qid") / 3), repetitions=50).collect()[0]
    assert (r.n_clusters, r.n_differences, r.mean_difference, r.ci_low, r.ci_high) == (7, 30, 0.25, 0.25, 0.25)


def test_grid_gate(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", float("nan")), ("x", 2.0)], "q string, m double")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    got = sorted((r.rule, r.q) for r in stats.missing_and_extra(cells, ["q"], want, "m").collect())
    assert got == [("duplicate", "a"), ("extra", "x"), ("missing", "c"), ("not_finite", "b")]
    with pytest.raises(EvidenceError):
        experiment.require_empty(stats.missing_and_extra(cells, ["q"], want, "m"))


def judge(**over):
    d = dict(schema_version="1.0", evaluation_id="e", response_disposition="substantive_answer", correctness=5,
             completeness=4, groundedness=3, citation_quality=2, explanation=" fine ")
    return d | over


NULLS = dict(correctness=None, completeness=None, groundedness=None, citation_quality=None)
BAD = [
    "", "prose " + json.dumps(judge()), "```json\n" + json.dumps(judge()) + "\n```", json.dumps(judge()) + " tail",
    json.dumps(judge(extra=1)), json.dumps(judge(correctness="5")), json.dumps(judge(correctness=True)),
    json.dumps(judge(correctness=6)), json.dumps(judge(correctness=5.0)), json.dumps(judge(evaluation_id="other")),
    json.dumps(judge())[:-1] + ', "correctness": 5}', json.dumps(judge()).replace("5", "NaN", 1), json.dumps(judge(explanation="x" * 1001)),
    json.dumps(judge(explanation=" ")), json.dumps(judge(**NULLS)), json.dumps(judge(response_disposition="maybe")), "[1]",
    json.dumps(judge(response_disposition="refusal")),
]


BAD += [json.dumps(judge()) + "] x", json.dumps(judge()) + ", 0] x", json.dumps(judge()) + "," + json.dumps(judge()), json.dumps(judge(explanation=None))]


def test_judge_rejects_accepts_and_controls(spark):
    good = json.dumps(judge())
    refusal = json.dumps(judge(response_disposition="refusal", **NULLS))
    rows = [(i, raw, True, False) for i, raw in enumerate(BAD)] + [(100, None, True, False), (101, good, True, True), (102, f" {good}\n", True, True)]
    rows += [(103, refusal, True, True), (104, good, False, False), (105, json.dumps(judge(**NULLS)), False, True)]
    df = spark.createDataFrame(rows, "k int, raw string, answerable boolean, want boolean").withColumn("e", F.lit("e"))
    got = {r["k"]: r for r in df.select("k", "want", "raw", jsonx.parse_judge("raw", "e", "answerable").alias("p")).collect()}
    assert not [(r["k"], r["raw"], r["p"]) for r in got.values() if r["p"]["valid"] != r["want"]]
    assert got[101]["p"]["correctness"] == 5 and got[0]["p"]["correctness"] is None and got[0]["p"]["error"] == "document"


def test_judge_loop_retries_and_keeps_attempts(spark):
    good, bad = json.dumps(judge()), "nonsense"

    def call(prompt, attempt):
        if prompt == "raise":
            raise RuntimeError("down")
        told = prompt.startswith("later") and "Wrong in it: document" in prompt
        return good if prompt == "now" or (told and attempt == 1) else bad

    tasks = spark.createDataFrame([("e", True, p) for p in ("now", "later", "never", "raise")], "evaluation_id string, answerable boolean, prompt string")
    got = sorted(((r.attempts, r.valid, r.correctness) for r in judging.run_judge(tasks, call).collect()), key=str)
    assert got == sorted([(1, True, 5), (2, True, 5), (3, False, None), (3, False, None)], key=str)


def test_lenient_json(spark):
    df = spark.createDataFrame([('x {"sufficient": true} y',), ("none",), ("{bad}",)], "t string")
    v = F.try_variant_get(jsonx.lenient_object(F.col("t")), "$.sufficient", "boolean")
    assert [r[0] for r in df.select(v).collect()] == [True, None, None]


def test_packers_and_redundancy_against_model(spark):
    rnd = random.Random(3)
    rows = [(q, r, rnd.randint(1, 60), sorted({rnd.randint(1, 4) for _ in range(rnd.randint(0, 2))})) for q in "abc" for r in range(1, 15)]
    df = spark.createDataFrame(rows, "qid string, rank int, tokens int, pages array<int>")
    pre = {(r.qid, r["rank"]) for r in packing.pack_prefix(df, 100).collect()}
    skip = {(r.qid, r["rank"]) for r in packing.pack_skip(df, 100).collect()}
    red = {r.qid: r.redundancy for r in packing.redundancy(df).collect()}
    for q in "abc":
        used, kept, left, taken, seen, dup, total = 0, [], 100, [], set(), 0, 0
        stopped = False
        for _, r, t, p in (x for x in rows if x[0] == q):
            if not stopped and (not kept or used + t <= 100):
                used += t
                kept.append(r)
            else:
                stopped = True
            if left > 0 and t <= left:
                left -= t
                taken.append(r)
            dup += t if p and set(p) <= seen else 0
            seen |= set(p)
            total += t
        assert {r for k, r in pre if k == q} == set(kept) and {r for k, r in skip if k == q} == set(taken)
        assert red[q] == pytest.approx(dup / total)


def test_page_metrics(spark):
    hits = spark.createDataFrame(
        [("a", 1, [1]), ("a", 2, [2]), ("b", 1, [9]), ("c", 1, [5]), ("d", 1, [9]), ("d", 2, [7, 8]), ("d", 3, [7])],
        "qid string, rank int, pages array<int>",
    )
    exp = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("d", 7), ("d", 8), ("e", 1)], "qid string, page int")
    q = spark.createDataFrame([(x,) for x in "abcde"], "qid string")
    got = {r.qid: r for r in metrics.page_metrics(hits, q, exp).collect()}
    assert (got["a"].ndcg, got["a"].recall, got["a"].reciprocal_rank, got["a"].page_hit) == (1.0, 1.0, 1.0, True)
    assert (got["b"].ndcg, got["b"].page_hit, got["b"].reciprocal_rank) == (0.0, False, 0.0)
    assert (got["c"].page_hit, got["c"].recall, got["c"].ndcg, got["c"].retrieved) == (None, None, 0.0, 1)
    assert got["d"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["d"].recall == 1.0
    assert (got["e"].page_hit, got["e"].recall, got["e"].retrieved) == (False, 0.0, 0)


def test_gold_evidence_against_model(spark):
    rnd = random.Random(5)
    chunks = {i: sorted({rnd.randint(1, 12), rnd.randint(1, 12)}) for i in range(60)}
    expected = {q: sorted(rnd.sample(range(1, 13), rnd.randint(1, 9))) for q in ("a", "b", "c", "d")}
    over = {(q, i): rnd.choice([0.0, 0.25, 0.5, 1.0]) for q in expected for i in chunks if set(chunks[i]) & set(expected[q])}
    exp = spark.createDataFrame([(q, p) for q, ps in expected.items() for p in ps], "qid string, page int")
    cs = spark.createDataFrame([(i, p) for i, p in chunks.items()], "doc_id bigint, pages array<int>")
    ov = spark.createDataFrame([(q, i, v) for (q, i), v in over.items()], "qid string, doc_id bigint, overlap double")
    got = {}
    for r in audit.gold_evidence(ov, audit.page_overlap(exp, cs)).orderBy("qid", "position").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    for q, pages in expected.items():
        order = sorted((i for k, i in over if k == q), key=lambda i: (-over[q, i], i))
        chosen = []
        for p in pages:
            chosen += [i for i in order if p in chunks[i] and i not in chosen][:1]
        chosen += [i for i in order if i not in chosen][: max(0, 6 - len(chosen))]
        assert got[q] == chosen[:6]


def test_outline_against_stack_model(spark):
    rnd = random.Random(6)
    levels = [1] + [rnd.randint(1, 4) for _ in range(50)]
    df = spark.createDataFrame([(1, i, l, f"n{i}") for i, l in enumerate(levels)], "doc int, ord bigint, level int, title string")
    n = tree.outline_parents(df, ["doc"], 4, width=5)
    n = tree.siblings(tree.child_counts(tree.outline_paths(n, ["doc"], 4), ["doc"]), ["doc"], width=5)
    got = {r.ord: r for r in n.collect()}
    stack, parent = [], {}
    for i, l in enumerate(levels):
        while stack and levels[stack[-1]] >= l:
            stack.pop()
        parent[i] = stack[-1] if stack else None
        stack.append(i)
    for i in parent:
        kids = [j for j in parent if parent[j] == parent[i]]
        at = kids.index(i)
        path, up = [], i
        while up is not None:
            path.insert(0, f"n{up}")
            up = parent[up]
        assert got[i].parent == parent[i] and got[i].title_path == " > ".join(path)
        assert got[i].child_count == sum(1 for j in parent if parent[j] == i)
        assert got[i].prev_sibling == (kids[at - 1] if at else None)
        assert got[i].next_sibling == (kids[at + 1] if at + 1 < len(kids) else None)


def test_as_of_join(spark):
    rows = spark.createDataFrame([("u", 5, 1), ("u", 10, 2), ("u", 1, 3), ("v", 9, 4)], "k string, t bigint, id int")
    marks = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("w", 1, "c")], "k string, t bigint, m string")
    got = {r.id: r.m for r in tree.as_of(rows, marks, ["k"], ["t"], F.floor(F.col("t") / 3), "m").collect()}
    assert got == {1: "b", 2: "b", 3: None, 4: None}


def test_tree_digest_follows_its_definition_at_every_size(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (1, 5, 300):
        rows = [("x", f"p{i}", sha(str(i))) for i in range(n)]
        level = {sha(p) + p: (p, d) for _, p, d in rows}
        for digits in (9, 6, 3, 0):
            nodes = {}
            for h, (p, d) in sorted(level.items(), key=lambda x: x[1][0]):
                nodes[h[:digits]] = nodes.get(h[:digits], "") + f"{p}\0{d}\n"
            level = {h: (h, sha(text)) for h, text in nodes.items()}
        df = spark.createDataFrame(rows, "k string, p string, s string").repartition(3)
        one = experiment.tree_digest(df, ["k"], "p", "s").collect()[0]
        assert (one.n_files, one.digest) == (n, level[""][1])


def test_gold_evidence_walks_past_wide_passages(spark):
    ov = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5)], "qid string, doc_id bigint, overlap double")
    on = spark.createDataFrame([("q", p, 1) for p in range(1, 21)] + [("q", 21, 2)], "qid string, page int, doc_id bigint")
    assert [(r.doc_id, r.position) for r in audit.gold_evidence(ov, on).orderBy("position").collect()] == [(1, 1), (2, 2)]


def test_vectors_of_another_dimension_fail_with_their_id(spark):
    from evispark.operators import dense

    df = spark.createDataFrame([(1, "t", [1.0, 2.0]), (2, "t", [1.0]), (3, "t", None)], "vec_id int, tenant string, e array<float>")
    assert sorted((r["vec_id"], r["size"]) for r in dense.dimension_violations(df, "vec_id", "e", 2).collect()) == [(2, 1), (3, None)]
    with pytest.raises(Exception, match="vector without 2 components: [23]"):
        dense.dense_vectors(df, "vec_id", "e", 2).collect()


def test_pilot_patch_exclude_latest(spark):
    q = spark.createDataFrame([(0, "a", "c1", True), (1, "b", "c2", False), (2, "c", "c2", True), (3, "d", "c3", True), (4, "e", "c1", True)], "ord int, qid string, category string, answerable boolean")
    assert [r.qid for r in experiment.pilot_sample(q, 4).orderBy("turn", "qid").collect()] == ["b", "a", "d", "c"]
    p = spark.createDataFrame([("a", False)], "qid string, answerable boolean")
    assert {r.qid: r.answerable for r in experiment.patched(q, p, "qid", ["answerable"]).collect()}["a"] is False
    assert experiment.excluded(q, p, "qid").count() == 4
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "k string, s int, v string")
    assert {r.k: r.v for r in experiment.latest(rows, ["k"], "s").collect()} == {"k": "new", "j": "x"}


def test_cross_references_take_the_last_topic(spark):
    rows = [(0, "1.1", "see Section 2.2 and Section 1.1"), (1, "2.2", ""), (2, "2.2", "Sections 1.1 then Section 9.9"), (3, None, "Section 2.2")]
    df = spark.createDataFrame(rows, "ord bigint, section_number string, text string")
    assert sorted((r.ord, r.target) for r in tree.cross_references(df).collect()) == [(0, 2), (2, 0), (3, 2)]


def test_joined_export_encodes_nested_columns(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "k int, ids array<string>")
    j = spark.createDataFrame([(1, {"s": 5})], "k int, scores map<string,int>")
    got = {r["k"]: (r["ids"], r["scores"]) for r in experiment.joined_export(a, j, ["k"]).collect()}
    assert got == {1: ('["x","y"]', '{"s":5}'), 2: (None, None)}


def test_unit_sizes_are_counted_once(spark):
    from evispark.plans import q_evaluation

    got = q_evaluation.unit_size_statistics(spark, "/root/testdata/sf0.001")
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()  # the texts were read three times
