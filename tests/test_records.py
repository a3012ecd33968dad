"""Search arguments, dotted keys, followed seeds, canonical JSON, stored hits, ranges and key reports."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from evispark.functions import arrays, jsonx
from evispark.operators import dense, graph, judging, lexical, metrics
from evispark.operators.ranking import check_limits
from evispark.sources import sinks


@pytest.mark.parametrize("bad", [dict(k=0), dict(k=-1), dict(k=True), dict(k=1.0), dict(k=1, seed_k=0), dict(k=1, seed_k=True), dict(k=1, max_depth=-1), dict(k=1, max_depth=1.5), dict(k=1, decay=-0.1), dict(k=1, decay=2), dict(k=1, decay=True)])
def test_search_arguments_are_refused(bad):
    with pytest.raises(ValueError):
        check_limits(**bad)


def test_searches_check_their_arguments(spark):
    docs = spark.createDataFrame([("t", 1, "a b")], "tenant string, doc_id bigint, text string")
    q = spark.createDataFrame([("q", "t", "a")], "qid string, tenant string, text string")
    edges = spark.createDataFrame([], "tenant string, src bigint, dst bigint, pos int")
    seeds = spark.createDataFrame([("q", "t", 1, 0.5)], "qid string, tenant string, doc_id bigint, score double")
    for call in (
        lambda: lexical.bm25_top_k(docs, q, 0), lambda: dense.hashing_top_k(docs, q, 0), lambda: graph.hybrid_search(seeds, edges, 5, seed_k=0),
        lambda: graph.native_search(lexical.Bm25(docs, q), edges, 5, max_depth=-1), lambda: graph.adjacency_search(seeds, docs, True),
    ):
        with pytest.raises(ValueError):
            call()


def test_only_the_best_seeds_are_followed(spark):
    seeds = [("q", "t", d, s) for d, s in [(1, 0.9), (2, 0.8), (3, -0.2), (4, 0.1)]]
    edges = spark.createDataFrame([("t", 1, 10, 0), ("t", 1, 3, 1), ("t", 3, 11, 0), ("t", 4, 12, 0)], "tenant string, src bigint, dst bigint, pos int")
    s = spark.createDataFrame(seeds, "qid string, tenant string, doc_id bigint, score double")
    got = {r.doc_id: r for r in graph.hybrid_search(s, edges, 10, seed_k=2).collect()}
    assert set(got) == {1, 2, 3, 4, 10}  # 11 and 12 hang on seeds that are not followed
    assert got[3].score == -0.2 and got[3].link_depth == 1 and got[3].seed_ids == [1] and got[3].link_score == pytest.approx(0.9 * 0.35)
    assert got[4].seed_ids == [] and got[1].seed_ids == [1] and got[10].score == pytest.approx(0.9 * 0.35)
    assert set(r.doc_id for r in graph.hybrid_search(s, edges, 10).collect()) == {1, 2, 3, 4, 10, 11, 12}


def test_dotted_keys(spark):
    ddl = "id int, source struct<kind: string, tags: array<string>, more: map<string, struct<n: int>>>, flat string, `a.b` string"
    df = spark.createDataFrame([(1, ("pdf", ["x", "y"], {"m": (3,)}), "f", "z"), (2, None, None, None), (3, ("web", None, {}), "f", "z")], ddl)
    hit = lambda key, want: [r.id for r in df.filter(arrays.path_matches(df, key, want)).orderBy("id").collect()]
    assert hit("source.kind", "pdf") == [1] and hit("source.kind", ["pdf", "web"]) == [1, 3] and hit("flat", "f") == [1, 3]
    assert hit("source.tags", "x") == [1] and hit("source.tags", ["x", "y"]) == [1] and hit("source.tags", ["x", "q"]) == []
    assert hit("source.more.m.n", 3) == [1] and hit("source.more.none.n", 3) == []
    for key in ("missing", "source.missing", "flat.deeper", "source.kind.deeper", "a.b"):
        assert hit(key, "z") == []


def test_canonical_json_at_every_depth(spark):
    ddl = "b int, a struct<z: int, y: array<struct<d: string, c: int>>>, m map<string, struct<q: int, p: int>>"
    df = spark.createDataFrame([(1, (2, [("é", None), ("x", 4)]), {"k2": (1, 2), "k1": (3, 4)}), (None, None, None)], ddl)
    got = [r[0] for r in df.select(sinks.canonical_json(df.columns, df.schema)).collect()]
    want = [{"b": 1, "a": {"z": 2, "y": [{"d": "é", "c": None}, {"d": "x", "c": 4}]}, "m": {"k2": {"q": 1, "p": 2}, "k1": {"q": 3, "p": 4}}}, {"b": None, "a": None, "m": None}]
    assert got == [json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for w in want]


def plain_ndcg(hits, expected):
    left, dcg = set(expected), 0.0
    for rank, (number, numbers) in enumerate(hits, 1):
        shown = ({number} if number is not None else set()) | set(numbers or [])
        if shown & left:
            dcg += 1 / math.log2(rank + 1)
            left -= shown
    n = min(len(set(expected)), len(hits))
    return dcg / sum(1 / math.log2(i + 1) for i in range(1, n + 1)) if n else 0.0


def test_ndcg_of_stored_hits(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        hits = [(rng.choice([None, 1, 2, 3, 4, 9]), rng.choice([None, [], [1], [2, 5], [3, 3]])) for _ in range(rng.randrange(0, 6))]
        rows.append(("c", f"q{i}", rng.choice([None, 5, 10]), ("m",), hits, [rng.randrange(1, 7) for _ in range(rng.randrange(0, 4))]))
    df = spark.createDataFrame(rows, "condition string, qid string, top_k int, metrics struct<x: string>, hits array<struct<page_number: int, page_numbers: array<int>>>, expected_pages array<int>")
    got = {r.qid: r.ndcg for r in metrics.frozen_arms(df, 10).collect()}
    assert set(got) == {r[1] for r in rows if r[2] in (None, 10)}
    for r in rows:
        if r[1] in got:
            assert got[r[1]] == pytest.approx(plain_ndcg(r[4], r[5]))


def test_ranges_and_keys(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, -1, 5.1), (3, None, None), (4, 7, float("nan")), (5, 2, 0.9)], "id int, calls int, grade double")
    got = sorted((r.rule, r.id) for r in judging.range_violations(df, ["id"], {"calls": (0, None), "grade": (1, 5)}).collect())
    assert got == [("calls", 2), ("grade", 2), ("grade", 4), ("grade", 5)]
    raws = ['{"a": 1, "c": {"b": 2}}', '{"b": 1, "a": 2}', "{}", "[1]", "{} x", None, '{"a": 1, "a": 2, "b": 1}']
    k = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", jsonx.key_report(F.col("raw"), ("a", "b")).alias("k"))
    got = {r.i: (r.k.missing, r.k.extra) if r.k else None for r in k.collect()}
    assert got == {0: (["b"], ["c"]), 1: ([], []), 2: (["a", "b"], []), 3: None, 4: None, 5: None, 6: got[6]} and got[6] in (None, ([], []))
