import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.functions.text import STOP_WORDS, has_words, words
from evispark.operators import containment, dense, fusion, graph, lexical
from evispark.operators.ranking import by_score, top_k
from evispark.plans import corpus as tables
from evispark import session
from evispark.session import settle

WORDS = "alpha beta gamma delta the of pole wire grid risk fire plan".split()


def corpus(seed, n=40):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["x", "x", "y"]), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 30))), "t" + str(i % 3)) for i in range(n)]


QUESTIONS = [("q1", "x", "risk of the fire fire"), ("q2", "y", "grid plan"), ("q3", "x", "the of"), ("q4", "z", "alpha"), ("q5", "x", "  ")]


def toks(t):
    return re.findall(r"[^\W_]+", t.casefold())


def bm25(docs, tenant, text, weights=((2, 1.0),)):
    q = [t for t in toks(text) if t not in STOP_WORDS] or toks(text)
    mine = {}
    for d in docs:
        if d[1] == tenant:
            tf = Counter()
            for at, w in weights:
                for t in toks(d[at]):
                    tf[t] += w
            mine[d[0]] = tf
    if not mine:
        return {}
    n, dl = len(mine), {k: sum(v.values()) for k, v in mine.items()}
    avg = sum(dl.values()) / n or 1.0
    out = {}
    for t, qf in Counter(q).items():
        df = sum(1 for v in mine.values() if v[t] > 0)
        for k, v in mine.items():
            if v[t] > 0:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[k] = out.get(k, 0) + qf * idf * v[t] * 2.2 / (v[t] + 1.2 * (0.25 + 0.75 * dl[k] / avg))
    return out


def frames(spark, docs):
    return (
        spark.createDataFrame(docs, "doc_id bigint, tenant string, text string, title string"),
        spark.createDataFrame(QUESTIONS, "qid string, tenant string, text string"),
    )


@pytest.mark.parametrize("fields,weights", [(lexical.PLAIN, ((2, 1.0),)), ((("text", 1.0), ("title", 2.5)), ((2, 1.0), (3, 2.5)))])
def test_bm25_against_model(spark, fields, weights):
    docs = corpus(1)
    d, q = frames(spark, docs)
    got = {(r.qid, r.doc_id): r.score for r in lexical.bm25_scores(d, q, fields).collect()}
    want = {(i, k): s for i, t, x in QUESTIONS for k, s in bm25(docs, t, x, weights).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k[0] for k in got} <= {"q1", "q2", "q3"}


def test_bm25_from_stored_postings_and_unhinted_joins(spark, monkeypatch):
    docs = corpus(2)
    d, q = frames(spark, docs)
    a = {(r.qid, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(d, q).collect()}
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *_: False)
    b = {(r.qid, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(lexical.postings(d), q, from_postings=True).collect()}
    assert a == b


def test_bm25_scans_once_and_limits_before_the_shuffle(spark):
    from evispark.plans import corpus

    sf = "/root/testdata/sf0.001"
    df = lexical.bm25_top_k(corpus.chunks(spark, sf), corpus.questions(spark, sf))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [doc_id") == 1 and "ReusedExchange" in plan
    assert plan.count("WindowGroupLimit") == 2 and "SortMergeJoin" not in plan


def test_dense_blocks_agree_with_numpy(spark, monkeypatch):
    docs = corpus(3)
    d, q = frames(spark, docs)
    one = [tuple(r) for r in dense.hashing_top_k(d, q, 7).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(dense, "BLOCK_BYTES", 2 * 8 * 384)
    many = [tuple(r) for r in dense.hashing_top_k(d, q, 7).orderBy("qid", "rank").collect()]
    assert [r[:3] + r[4:] for r in one] == [r[:3] + r[4:] for r in many]
    from hashlib import md5

    def vec(t):
        v = np.zeros(384)
        for w in t.lower().split():
            v[int(md5(w.encode()).hexdigest(), 16) % 384] += 1
        return v / (np.linalg.norm(v) or 1)

    for qid, tenant, text in QUESTIONS:
        s = sorted(((-round(float(vec(text) @ vec(x[2])), 9), x[0]) for x in docs if x[1] == tenant))[:7]
        assert [r[2] for r in one if r[0] == qid] == [i for _, i in s]


def test_seed_rows_are_cleaned(spark):
    rows = [("q", "a", None, "0.5"), ("q", None, "b", "1"), ("q", "c", None, "NaN"), ("q", "d", None, "Infinity"), ("q", None, None, "1"), ("q", "e", None, "x")]
    df = spark.createDataFrame(rows, "qid string, chunk_id string, source_chunk_id string, score string")
    assert sorted((r.chunk_id, r.score) for r in dense.seeds_from(df).collect()) == [("a", 0.5), ("b", 1.0)]


def expand(seeds, neigh, eligible, depth, decay):
    """Independent walk: breadth-first from every seed."""
    best, at, origins = {}, {}, {}
    ids = {s for s, _ in seeds}
    for s, score in seeds:
        seen, frontier = {s}, [s]
        for d in range(1, depth + 1):
            nxt = []
            for n in frontier:
                for m in sorted(neigh.get(n, ())):
                    if m in seen:
                        continue
                    seen.add(m)
                    if m in ids or m not in eligible:
                        continue
                    nxt.append(m)
                    g = max(0, score) * decay**d
                    if g > best.get(m, -1) * (1 + 1e-12):
                        best[m], at[m], origins[m] = g, d, {s}
                    elif abs(g - best[m]) <= 1e-12 * max(g, best[m]):
                        origins[m].add(s)
            frontier = nxt
    return {m: (round(best[m], 9), at[m], sorted(origins[m])) for m in best}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_link_expansion_against_model(spark, depth):
    rnd = random.Random(depth)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)}
    edges = {(a, b) for a, b in edges if a != b}
    neigh = {}
    for a, b in edges:
        neigh.setdefault(a, set()).add(b)
        neigh.setdefault(b, set()).add(a)
    eligible = set(range(25)) - {3, 7}
    seeds = {"q1": [(0, 1.0), (5, 0.8), (9, 1.0)], "q2": [(1, -0.5), (2, 0.4)]}
    e = graph.both_ways(spark.createDataFrame([("x", a, b) for a, b in edges], "tenant string, src bigint, dst bigint"))
    s = spark.createDataFrame([(q, "x", i, v) for q, xs in seeds.items() for i, v in xs], "qid string, tenant string, doc_id bigint, score double")
    ok = spark.createDataFrame([("x", i) for i in eligible], "tenant string, doc_id bigint")
    got = {}
    for r in graph.expand_links(s, e, depth, 0.35, ok).collect():
        got.setdefault(r.qid, {})[r.doc_id] = (round(r.link_score, 9), r.link_depth, list(r.seed_ids))
    assert got == {q: expand(xs, neigh, eligible, depth, 0.35) for q, xs in seeds.items()}


def test_hybrid_keeps_raw_seed_scores_and_decays_links(spark):
    seeds = spark.createDataFrame([("q", "x", 1, 0.9), ("q", "x", 1, 0.2), ("q", "y", 8, 0.99)], "qid string, tenant string, doc_id bigint, score double")
    edges = spark.createDataFrame([("x", 1, 2), ("x", 2, 1)], "tenant string, src bigint, dst bigint")
    mine = spark.createDataFrame([("x", 1), ("x", 2)], "tenant string, doc_id bigint")
    got = graph.hybrid_search(seeds, edges, 4, decay=0.5, eligible=mine).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9), r.link_depth) for r in got] == [(1, 0.9, 0), (2, 0.45, 1)]


def test_adjacency_first_seed_wins_and_null_ordinals(spark):
    ranked = spark.createDataFrame([("q", "x", 10, 1.0, 1), ("q", "x", 12, 0.5, 2), ("q", "x", 99, 0.4, 3)], "qid string, tenant string, doc_id bigint, score double, rank int")
    ords = spark.createDataFrame([("x", i, i) for i in (9, 10, 11, 12, 13)] + [("x", 99, None), ("y", 11, 11)], "tenant string, doc_id bigint, ordinal bigint")
    got = graph.adjacency_search(ranked, ords, 6).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in got] == [(10, 1.0), (12, 0.5), (99, 0.4), (9, 0.35), (11, 0.35), (13, 0.175)]


def test_chain_links_do_not_jump_documents(spark):
    rows = [("x", i, d) for i, d in enumerate("aabba")]
    c = spark.createDataFrame(rows, "tenant string, doc_id bigint, document string")
    got = {r.doc_id: (r.prev_id, r.next_id) for r in graph.chain_links(c, width=2).collect()}
    assert got == {0: (None, 1), 1: (0, None), 2: (None, 3), 3: (2, None), 4: (None, None)}


def test_rrf_needs_two_arms_and_promotes(spark):
    a = spark.createDataFrame([("q", "x", 1, 1), ("q", "x", 2, 2)], "qid string, tenant string, doc_id bigint, rank int")
    b = spark.createDataFrame([("q", "x", 2, 1), ("q", "x", 3, 2)], "qid string, tenant string, doc_id bigint, rank int")
    with pytest.raises(ValueError):
        fusion.rrf([a], 3)
    got = fusion.rrf([a, b], 3).orderBy("rank").collect()
    assert [(r.doc_id, r.n_arms) for r in got] == [(2, 2), (1, 1), (3, 1)]


def test_verbatim_pairs_against_all_pairs(spark):
    docs = corpus(4, 60)
    items = [(0, docs[5][2][3:40]), (1, "alpha beta"), (2, "a"), (3, "zzz qqq vvv"), (4, docs[9][2]), (5, "plan."), (6, "pha be")]
    d = spark.createDataFrame([(i, t, x) for i, t, x, _ in docs], "doc_id bigint, tenant string, text string")
    it = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in containment.verbatim_pairs(d, it, "item_id").collect()}
    assert got == {(i, x[0]) for i, s in items if s for x in docs if s in x[2]}


def test_top_k_ties_break_by_id(spark):
    df = spark.createDataFrame([("q", i, 1.0) for i in (5, 3, 9)], "qid string, doc_id bigint, score double")
    assert [r.doc_id for r in top_k(df, ["qid"], by_score(), 2).orderBy("rank").collect()] == [3, 5]


def test_tenants_come_from_the_documents(spark, tmp_path):
    from evispark.plans import corpus

    spark.createDataFrame([(1, "uno", "it"), (2, "one", "en"), (3, "x", None)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "uno")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["qid"] for r in corpus.questions(spark, str(tmp_path)).collect()) == ["en-7", "it-7"]


def test_hits_get_partitions_by_the_size_of_the_input(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, asked = tables.chunks(spark, sf), tables.questions(spark, sf)
    best = lambda: sorted((r.qid, r.doc_id, r.rank, round(r.score, 9)) for r in lexical.bm25_top_k(docs, asked, 3).collect())
    want = best()
    monkeypatch.setattr(lexical, "PART_BYTES", 100_000, raising=False)
    parts = lambda d: re.findall(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", lexical.term_hits(d, asked)._jdf.queryExecution().executedPlan().toString())
    one, two = int(parts(docs)[0]), int(parts(docs.union(docs))[0])
    assert one >= 10 and abs(two - 2 * one) <= 1
    assert best() == want
    local = spark.createDataFrame([("en", 1, "a b")], "tenant string, doc_id bigint, text string")
    assert not parts(local) and not parts(settle(docs))  # no figure: left to AQE


def test_dense_search_holds_few_rows_and_words_at_once():
    import inspect
    from types import SimpleNamespace

    import pandas as pd

    rng, sizes = np.random.default_rng(5), []
    vectors, q = rng.normal(size=(9000, 4)), rng.normal(size=(3, 4))
    matrix = lambda p: sizes.append(len(p)) or vectors[p["doc_id"]]
    rows = pd.DataFrame({"doc_id": np.arange(9000), "tenant": "t"})
    got = pd.concat(dense._search(SimpleNamespace(value={"t": (["a", "b", "c"], q)}), matrix, 5)([rows]))
    for i, name in enumerate("abc"):
        assert sorted(got[got.qid == name].doc_id) == sorted(np.argsort(-(vectors @ q[i]))[:5])
    assert sum(sizes) == 9000 and max(sizes) <= 2048
    encode = dense.hashing_encode(8)
    encode([" ".join(f"w{i}" for i in range(200_000))])
    encode(["a"])
    assert len(inspect.getclosurevars(encode).nonlocals["known"]) == 1


def test_hits_get_partitions_by_rows_where_files_are_small(spark, tmp_path, monkeypatch):
    # A dictionary holds the one text of many passages in a few bytes.
    path = str(tmp_path / "docs.parquet")
    text = F.lit("pole wire grid risk " * 50)
    spark.range(0, 3000, 1, 1).select(F.lit("en").alias("tenant"), F.col("id").alias("doc_id"), text.alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    spark.createDataFrame([("q1", "en", "pole risk"), ("q2", "en", "wire")], "qid string, tenant string, text string").write.parquet(str(tmp_path / "q"))
    asked = spark.read.parquet(str(tmp_path / "q"))
    monkeypatch.setattr(lexical, "PART_ROWS", 100, raising=False)
    parts = lambda d: re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", d._jdf.queryExecution().executedPlan().toString())
    assert parts(lexical.term_hits(docs, asked)) == ["30"]
    postings = lexical.postings(docs)
    assert parts(lexical.term_hits(postings, asked, from_postings=True)) == ["30"]
    # Hits that were settled are dealt out again, before pairs are made of them.
    plain, kept = lexical.Bm25(docs, asked), lexical.Bm25(docs, asked, keep=True)
    assert set(parts(kept.scores())) == {"30"}
    rows = lambda b: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in b.scores().collect())
    assert rows(kept) == rows(plain) and len(rows(plain)) == 6000


def test_hashing_vectors_are_made_once_in_tasks_of_few_rows(spark, tmp_path, monkeypatch):
    from evispark.plans import q_retrieval

    monkeypatch.setattr(session, "SPREAD_ROWS", 100, raising=False)
    plan = q_retrieval.hashing_vectors(spark, "/root/testdata/sf0.01")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("md5(") == 1
    assert "RoundRobinPartitioning(10)" in plan.executedPlan().toString()
    # A row group with too many rows for a scan split is dealt out as well.
    path = str(tmp_path / "docs.parquet")
    spark.range(0, 1000, 1, 1).select("id", F.lit("a b").alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    monkeypatch.setattr(session, "plan_bytes", lambda df: 1 << 40)
    assert session.spread(docs) is docs
    monkeypatch.setattr(session, "SPLIT_ROWS", 500, raising=False)
    assert session.spread(docs).rdd.getNumPartitions() == 10


def test_has_words_agrees_with_words(spark):
    texts = ["", " ", "\u00a0\u2003\n\x0b\x1c\x85", "a", " \u3000x\t", "\u200b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(has_words(F.col("t")).alias("h"), F.size(words(F.coalesce("t", F.lit("")))).alias("n"))
    assert all(r.h == (r.n > 0) for r in rows.collect())


def test_texts_are_cut_once_for_both_readers_of_quotations(spark, tmp_path):
    text = F.concat(F.lit("the pole wire grid fell "), F.col("doc_id").cast("string"))
    spark.range(0, 40).select(F.col("id").alias("doc_id"), F.lit("en").alias("tenant")).withColumn("text", text).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "pole wire grid"), (2, "grid fell 7")], "item_id bigint, text string").write.parquet(str(tmp_path / "i"))
    pairs = containment.verbatim_pairs(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "i")), "item_id")
    assert len(pairs.collect()) == 41
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = re.findall(r"FileScan parquet \[doc_id#\d+L,text#\d+\]", plan)
    assert len(scans) == 1 and "ReusedExchange [doc_id#" in plan


def test_hits_get_partitions_by_the_pairs_they_can_make(spark, tmp_path, monkeypatch):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = table("docs", [("en", i, f"pole wire w{i % 7}") for i in range(600)], "tenant string, doc_id bigint, text string")
    ask = lambda n: [(f"q{i}", "en", f"pole w{i % 7}") for i in range(n)] + [("x", "de", "wire")]
    few, many = (table(f"q{n}", ask(n), "qid string, tenant string, text string") for n in (10, 40))
    best = lambda: sorted((r.qid, r.doc_id, r.rank, round(r.score, 9)) for r in lexical.bm25_top_k(docs, many, 3).collect())
    parts = lambda q: re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", lexical.term_hits(docs, q)._jdf.queryExecution().executedPlan().toString())
    want = best()
    assert not parts(many)  # one partition will do
    monkeypatch.setattr(lexical, "PART_PAIRS", 1000, raising=False)
    # 100 and 25 passages a partition: four times the questions, four times the partitions.
    assert parts(few) == ["6"] and parts(many) == ["24"]
    assert best() == want and len(want) == 120
    monkeypatch.setattr(lexical, "PART_PAIRS", 12_000, raising=False)
    assert parts(many) == ["4"]  # two would do; one a core
