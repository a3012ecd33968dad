import json

import pytest
from pyspark.sql import functions as F

from evispark.errors import BundleFormatError, EvidenceError, SourceValidationError
from evispark.operators import bundle, flows, graph
from evispark.sources import readers, sinks
from evispark.streaming.log import ingest_log

SHA = "ab" * 32


def write_corpus(root, name, rows, n=None, **manifest):
    d = root / name
    d.mkdir(parents=True)
    m = dict(corpus=name, corpus_version="v", source_pdf=f"{name}.pdf", source_sha256=SHA, n_chunks=len(rows) if n is None else n) | manifest
    (d / "manifest.json").write_text(json.dumps(m))
    (d / "chunks.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")


def chunk(i, corpus="AA", **over):
    return dict(chunk_id=f"{corpus}-{i:05d}", corpus=corpus, text=f"passage {i} ünï\n", page_number=i + 1, metadata={"pages": [i + 1]}) | over


def test_chunks_load_in_line_order(spark, tmp_path):
    write_corpus(tmp_path, "AA", [chunk(i) for i in range(5)])
    write_corpus(tmp_path, "BB", [chunk(i, "BB", section="S", document_name="d") for i in range(3)])
    got = readers.load_chunks(spark, str(tmp_path)).orderBy("corpus", "source_order").collect()
    assert [(r.corpus, r.source_order, r.chunk_id) for r in got][:6] == [("AA", i, f"AA-{i:05d}") for i in range(5)] + [("BB", 0, "BB-00000")]
    assert got[0].text == "passage 0 ünï\n" and got[0].document_name == "AA.pdf" and got[5].document_name == "d"


def test_every_chunk_rule(spark, tmp_path):
    rows = [
        chunk(0), chunk(0), chunk(1, text=" "), chunk(2, page_number=True), chunk(3, page_number=0), chunk(4, metadata={"pages": ["1"]}),
        chunk(5, corpus="BB"), chunk(6, reference_answer="x"), chunk(7, text="<!-- evidence-start -->"), chunk(8, page_number=None, metadata=None),
    ]
    write_corpus(tmp_path, "AA", rows, n=99)
    with open(tmp_path / "AA" / "chunks.jsonl", "a") as f:
        f.write("{broken\n")
    lines, m = readers.read_chunk_lines(spark, str(tmp_path)), readers.read_manifests(spark, str(tmp_path))
    got = sorted((r.rule, r.key.split("/")[-1]) for r in readers.chunk_violations(lines, m).collect())
    assert got == sorted([
        ("duplicate_chunk_id", "AA-00000"), ("text_missing", "AA:2"), ("page_number", "AA:3"), ("page_number", "AA:4"),
        ("metadata_pages", "AA:5"), ("foreign_corpus", "BB-00005"), ("forbidden_field", "AA:7"), ("reserved_marker", "AA:8"),
        ("invalid_json", "AA:10"), ("n_chunks_mismatch", "AA"),
    ])
    with pytest.raises(SourceValidationError):
        readers.load_chunks(spark, str(tmp_path))


def test_bad_manifest(spark, tmp_path):
    write_corpus(tmp_path, "AA", [chunk(0)], source_sha256="zz", corpus_version=" ")
    got = {r.rule for r in readers.manifest_violations(readers.read_manifests(spark, str(tmp_path))).collect()}
    assert got == {"source_sha256", "corpus_version_missing"}


def concepts(spark, tmp_path):
    write_corpus(tmp_path, "AA", [chunk(i) for i in range(4)])
    c = readers.load_chunks(spark, str(tmp_path)).select(
        F.col("corpus").alias("tenant"), F.col("source_order").alias("doc_id"), "chunk_id", F.col("document_name").alias("document"),
        "section", F.col("metadata.pages").alias("pages"), "text",
    )
    linked = graph.chain_links(c, width=2)
    name = lambda i: F.when(F.col(i).isNotNull(), F.format_string("AA-%05d", F.col(i)))
    linked = linked.withColumn("prev_chunk", name("prev_id")).withColumn("next_chunk", name("next_id"))
    return bundle.concept_documents(linked, SHA, "v", generated_at="2026-01-01T00:00:00Z")


def test_bundle_on_disk_round_trip(spark, tmp_path):
    made = concepts(spark, tmp_path / "src")
    for out in ("one", "two"):
        sinks.write_markdown_tree(made, str(tmp_path / out))
    one, two = (readers.read_markdown_tree(spark, str(tmp_path / o)) for o in ("one", "two"))
    inv = made.select("path", F.sha2("content", 256).alias("sha256"))
    sinks.verify_tree(inv, one)
    sinks.verify_tree(one, two)
    p = bundle.yaml_to_json(bundle.parse_concepts(one.select("path", "content"))).orderBy("path").collect()
    assert [r.evidence for r in p] == [f"passage {i} ünï\n" for i in range(4)]
    fm = json.loads(p[1].fm_json)
    assert fm["type"] == "Source Passage" and fm["title"] == "AA-00001 — Page 2" and fm["section"] is None
    assert fm["tags"] == ["source-passage", "corpus-aa"] and fm["page_numbers"] == [2] and fm["sources"][0]["title"] == "AA.pdf"
    links = bundle.concept_links(bundle.parse_concepts(one.select("path", "content")))
    c = lambda i: f"concepts/aa/aa-{i:05d}"
    assert sorted((r.src, r.dst) for r in links.collect()) == sorted([(c(i), c(j)) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4])
    (tmp_path / "two" / "concepts" / "aa" / "aa-00000.md").write_text("changed")
    with pytest.raises(BundleFormatError):
        sinks.verify_tree(inv, readers.read_markdown_tree(spark, str(tmp_path / "two")))


def test_missing_type_is_reported(spark):
    df = spark.createDataFrame([("a.md", "---\ntype: X\n---\nbody"), ("b.md", "---\ntitle: y\n---\nb"), ("c.md", "---\n[: bad\n---\n"), ("index.md", "x")], "path string, content string")
    p = bundle.yaml_to_json(bundle.parse_concepts(df))
    assert sorted(r.path for r in bundle.missing_type(p).collect()) == ["b.md", "c.md"]
    assert {r.path: r.evidence for r in p.collect()}["a.md"] == "body"


def test_append_upsert_export_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25)], "k string, s int, v double")
    log = str(tmp_path / "log")
    sinks.append_rows(rows, log, ["k"])
    sinks.append_rows(rows.union(spark.createDataFrame([("c", 1, 1.0)], rows.schema)), log, ["k"])
    assert spark.read.schema(rows.schema).json(log).count() == 3
    store = str(tmp_path / "store")
    sinks.upsert(rows, store, ["k"], "s")
    sinks.upsert(spark.createDataFrame([("a", 2, 9.0)], rows.schema), store, ["k"], "s")
    assert {r.k: r.v for r in spark.read.parquet(store).collect()} == {"a": 9.0, "b": 0.25}
    sinks.export_jsonl(rows, rows.filter("k = 'a'").select("k", F.lit(3).alias("score")), ["k"], str(tmp_path / "x"))
    assert sorted(r.score or 0 for r in spark.read.json(str(tmp_path / "x")).collect()) == [0, 3]
    sinks.write_csv(rows.filter("false"), str(tmp_path / "none"))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert not (tmp_path / "none").exists() and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_target_safety(tmp_path):
    for bad in ("/", "~"):
        with pytest.raises(EvidenceError):
            sinks.check_target(__import__("os").path.expanduser(bad))
    with pytest.raises(EvidenceError):
        sinks.check_target(str(tmp_path / "a"), [str(tmp_path / "a" / "src")])
    with pytest.raises(EvidenceError):
        sinks.check_target(str(tmp_path / "a"), present=True)
    with pytest.raises(EvidenceError):
        sinks.check_target(str(tmp_path / "a"), present=True, overwrite=True)
    sinks.check_target(str(tmp_path / "a"), present=True, overwrite=True, has_marker=True)


@pytest.mark.parametrize(
    ("target", "sources", "ok"),
    [
        ("file:///", [], False), ("s3a://b", [], False), ("hdfs://n/", [], False), ("s3a://b/x", ["s3a://b/x/in"], False), ("s3a://b/x", ["s3a://c/x"], True),
        ("s3a://b/x", ["/x"], True), ("file:///tmp/a", ["/tmp/a/in"], False), ("s3a://b/xy", ["s3a://b/x"], True), ("s3a://b/x/out", ["s3a://b/x"], False),
    ],
)
def test_target_check_knows_uris(target, sources, ok):
    if ok:
        sinks.check_target(target, sources)
    else:
        with pytest.raises(EvidenceError):
            sinks.check_target(target, sources)


def test_sibling_names_are_unique(spark):
    from evispark.operators import tree

    names = ["a", "a", "a-2", "b", "a", "a-2", "a-2-2"]
    df = spark.createDataFrame([(1, 0, i, n) for i, n in enumerate(names)] + [(1, 9, 99, "a")], "doc int, parent int, ord int, base string")
    got = {r["ord"]: r["slug"] for r in tree.sibling_suffix(df, ["doc"], "base").collect()}
    assert [got[i] for i in range(7)] == ["a", "a-2", "a-2-2", "b", "a-3", "a-2-3", "a-2-2-2"] and got[99] == "a"


def test_jsonl_rejects_trailing_text_and_counts_blank_lines(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2} done\n')
    with pytest.raises(SourceValidationError, match="2"):
        readers.read_jsonl(spark, str(f), "a int")
    f.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(f), "a int").orderBy("source_order").collect()] == [(0, 1), (1, 2)]


def test_csv_questions_and_benchmark_json(spark, tmp_path):
    f = tmp_path / "q.csv"
    f.write_text("qid,utility,category,difficulty,topic,topic2,question,is_negative,is_table,is_image\nq1,AA_BB,c,2,t,,why?,TRUE,0,yes\n")
    r = readers.read_question_csv(spark, str(f), {"AA_BB": ["AA", "BB"]}).collect()[0]
    assert (r.corpora, r.primary_corpus, r.is_cross_utility, r.is_negative, r.is_table, r.is_image) == (["AA", "BB"], "AA", True, True, False, True)
    with pytest.raises(SourceValidationError):
        readers.read_question_csv(spark, str(f), {})
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"benchmark_id": "x", "questions": [{"qid": "q", "answerable": True, "expected_pages": [1, 2]}]}, indent=1))
    assert readers.read_benchmark(spark, str(b)).select("qid", "expected_pages").collect()[0].expected_pages == [1, 2]


def test_jsonl_reports_the_bad_line(spark, tmp_path):
    f = tmp_path / "l.jsonl"
    f.write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(SourceValidationError, match="line_no"):
        readers.read_jsonl(spark, str(f), "a int")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    box, store, dead, ck = (str(tmp_path / n) for n in ("in", "store", "dead", "ck"))
    (tmp_path / "in").mkdir()
    line = lambda k, e=None: json.dumps({"k": k, "v": 1, "error": e})
    (tmp_path / "in" / "1.json").write_text("\n".join([line("a"), line("a"), line("b", "boom")]))
    ingest_log(spark, box, "k string, v int, error string", ["k"], store, dead, ck).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join([line("a"), line("c")]))
    ingest_log(spark, box, "k string, v int, error string", ["k"], store, dead, ck).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(store).collect()) == ["a", "c"]
    assert spark.read.json(dead).count() == 1


def test_flow_call_counts_and_citations(spark):
    docs = [(i, "x", f"XX-{i:05d}", i + 1, [i + 1], f"topic {i % 4} words about fire and wire number {i}") for i in range(30)]
    c = spark.createDataFrame(docs, "doc_id bigint, tenant string, chunk_id string, page_number int, pages array<int>, text string")
    q = spark.createDataFrame([("q1", "x", "fire wire 3"), ("q2", "none", "nothing here")], "qid string, tenant string, text string")
    from evispark.operators import dense

    find = lambda asked: dense.hashing_top_k(c, asked, 25)
    calls = {"simple": (1, 1), "reranked": (1, 1), "agentic": (3, 3), "self_reflect": (3, 3), "lookahead": (2, 3)}
    for name, (a, b) in calls.items():
        got = {r.qid: r for r in flows.FLOWS[name](q, c, find).collect()}
        assert (got["q1"].generator_calls, got["q2"].generator_calls) == (a, b), name
        assert not got["q1"].refused and got["q2"].refused
        assert len(got["q1"].citations) == 1 and got["q2"].citations == [] and got["q1"].n_in_context > 0


def test_agentic_stops_on_a_json_verdict(spark):
    docs = [(i, "x", f"XX-{i:05d}", 1, [1], f"fire {i}") for i in range(5)]
    c = spark.createDataFrame(docs, "doc_id bigint, tenant string, chunk_id string, page_number int, pages array<int>, text string")
    q = spark.createDataFrame([("q1", "x", "fire")], "qid string, tenant string, text string")
    from evispark.operators import dense

    find = lambda asked: dense.hashing_top_k(c, asked, 25)
    never = lambda prompt: F.lit('{"sufficient": false, "refined_query": "fire 2"}')
    r = flows.agentic(q, c, find, flows.FlowConfig(agentic_calls=(3, 4)), critic=never).collect()[0]
    assert r.generator_calls == 4
