"""Topic bundles against a plain model, word pieces against a plain cutter, digest trees compared from the top."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evispark.functions import markdown as M
from evispark.operators import experiment, topics, tree, wordpiece

BLOCKS = "doc string, page bigint, y double, x double, text string"
OUTLINE = "doc string, seq bigint, level int, title string, page bigint, y double"


@pytest.fixture(scope="module")
def nodes(spark):
    blocks = [
        ("d", 0, 3.0, 0.0, "\n  The Plan \nsecond line"), ("d", 1, 1.0, 5.0, "right"), ("d", 1, 1.0, 0.0, "Table  of\ncontents ...... 1"), ("d", 1, 9.0, 0.0, "  "),
        ("d", 2, 1.0, 0.0, "LIST OF FIGURES and list of tables"), ("d", 3, 0.0, 0.0, "1  OVERVIEW"), ("d", 3, 2.0, 0.0, "about. See Section 1.1 and Sections 1.1, Section 9.9"),
        ("d", 4, 1.0, 0.0, "early"), ("d", 4, 6.0, 0.0, "late"), ("d", 5, 1.0, 0.0, "table of contents again"), ("e", 0, 0.0, 0.0, " "), ("e", 1, 0.0, 0.0, "only text"),
    ]
    outline = [
        ("d", 0, 1, "1 Overview", 3, 0.0), ("d", 1, 2, "1.1 Same", 4, 5.0), ("d", 2, 2, "Same > name", 4, 5.5), ("d", 3, 2, "Same name", 4, 90.0), ("d", 4, 2, "Same-name!", 5, 0.5), ("d", 5, 1, "Straße", 9, 0.0),
        ("e", 0, 3, "Deep", 1, 0.0),
    ]
    n = topics.topics(spark.createDataFrame(blocks, BLOCKS).repartition(3), spark.createDataFrame(outline, OUTLINE), ["doc"], 3, pages_a_block=2).cache()
    return n


def test_topics_and_their_text(nodes):
    got = {(r.doc, r.ord): r for r in nodes.collect()}
    titles = [got["d", i].title for i in range(11)]
    assert titles == ["Front Matter", "The Plan", "Table Of Contents", "List Of Tables", "List Of Figures", "1 Overview", "1.1 Same", "Same > name", "Same name", "Same-name!", "Straße"]
    assert [got["d", i].parent for i in range(11)] == [None, 0, 0, 0, 0, None, 5, 5, 5, 5, None]
    assert got["d", 5].text == "about. See Section 1.1 and Sections 1.1, Section 9.9\n\nearly"  # its own heading went
    assert got["d", 7].text == "late" and got["d", 6].text == "" and got["d", 5].pages == [4, 5] and got["d", 6].pages == []
    assert got["d", 1].text == "The Plan \nsecond line" and got["d", 2].text == "Table  of\ncontents ...... 1\n\nright"
    assert got["d", 4].text == "LIST OF FIGURES and list of tables" and got["d", 9].text == "table of contents again"
    assert got["d", 5].path == "concepts/1-overview.md" and got["d", 6].path == "concepts/1-overview/1-1-same.md"
    assert [got["d", i].slug for i in (7, 8, 9)] == ["same-name", "same-name-2", "same-name-3"] and got["d", 0].path == "concepts/01-front-matter.md"
    assert got["d", 7].titles == ["1 Overview", "Same > name"] and got["d", 10].slug.startswith("03-stra")
    assert got["e", 1].title == "Cover" and got["e", 2].parent == 1 and got["e", 2].text == "only text"


def test_topic_documents_parse_again(spark, nodes):
    docs = topics.topic_documents(nodes, ["doc"], "ab" * 32, F.lit("PGE"), F.col("doc"), "v1")
    content = {(r.doc, r.ord): r.content for r in docs.collect()}
    one = content["d", 5]
    assert "\n* Parent topic" not in one and "* Previous topic: [Front Matter](01-front-matter.md)" in one and "* Next topic: [Straße](" in one
    assert one.count("* Child topic:") == 4 and "* Child topic: [1.1 Same](1-overview/1-1-same.md)" in one and one.count("* Referenced section: [1.1 Same]") == 1
    assert "* Parent topic: [1 Overview](../1-overview.md)" in content["d", 6] and "no extracted pages" in content["d", 6] and "page_number: null" in content["d", 6]
    assert 'section_path: ["1 Overview","Same > name"]' in content["d", 7] and "**d**, pages 4-5." in one
    read = docs.select("ord", M.evidence(M.body_of(F.col("content"))).alias("e"), "doc").collect()
    text = {(r.doc, r.ord): r.text for r in nodes.collect()}
    assert {(r.doc, r.ord): r.e for r in read} == text


def test_topic_indexes_and_their_version(spark, nodes):
    idx = topics.topic_indexes(nodes, ["doc"], F.lit("All topics"), "1")
    got = {(r.doc, r.path): r.content for r in idx.collect()}
    assert set(p for d, p in got if d == "d") == {"concepts/index.md", "concepts/01-front-matter/index.md", "concepts/1-overview/index.md"}
    root = got["d", "concepts/index.md"]
    assert root.startswith('---\nformat_version: "1"\n') and root.index("01-front-matter.md) - 4 sub-topics") < root.index("1-overview.md) - 4 sub-topics")
    assert got["d", "concepts/1-overview/index.md"] == "# 1 Overview\n\n* [1.1 Same](1-1-same.md)\n* [Same > name](same-name.md) - page 5\n* [Same name](same-name-2.md)\n* [Same-name!](same-name-3.md) - page 6\n"
    assert topics.version_violations(idx, ["doc"], "1").count() == 0
    assert [tuple(r) for r in topics.version_violations(idx.filter("doc = 'd'"), ["doc"], "2").collect()] == [("d", "1")]
    bare = idx.withColumn("content", F.lit("# none"))
    assert [r.found for r in topics.version_violations(bare.filter("doc = 'd'"), ["doc"], "1").collect()] == [None]


def test_many_equal_names_are_numbered_in_order(spark):
    df = spark.range(3000).select(F.lit(1).alias("doc"), F.col("id").alias("ord"), F.lit(0).cast("long").alias("parent"), F.lit("name").alias("b"))
    got = [r.slug for r in tree.sibling_suffix(df, ["doc"], "b").orderBy("ord").collect()]
    assert got == ["name", *[f"name-{i}" for i in range(2, 3001)]]


def test_front_matter_shuffles_no_text(spark):
    blocks = spark.createDataFrame([("d", 0, 2.0, 0.0, "Second"), ("d", 0, 1.0, 0.0, " \n First\tline \nmore"), ("d", 2, 0.0, 0.0, "list\n of  tables"), ("d", 4, 0.0, 0.0, "table of contents"), ("e", 7, 0.0, 0.0, "x"), ("f", 0, 0.0, 0.0, "no outline"), ("d", None, 0.0, 0.0, "List of tables")], BLOCKS)
    outline = spark.createDataFrame([("d", 0, 1, "A", 3, 0.0), ("e", 0, 1, "B", 7, 0.0), ("g", 0, 1, "no blocks", 0, 0.0)], OUTLINE)
    got = topics.front_matter(blocks, outline, ["doc"])
    assert sorted((r.doc, r.ord, r.title, r.page) for r in got.collect()) == [("d", 0, "Front Matter", 0), ("d", 1, "First line", 0), ("d", 2, "List Of Tables", 2), ("e", 0, "Front Matter", 0), ("e", 1, "Cover", 0)]
    big = topics.front_matter(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("lang AS doc", "doc_id AS page", "0D AS y", "0D AS x", "text"), outline, ["doc"])
    exchanges = [p for p in big._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in p]
    assert exchanges and not any("text#" in p for p in exchanges)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("min(")  # places are gathered before they meet the outline


def test_many_small_groups_of_names_share_batches(spark):
    df = spark.range(4000).select(F.expr("id div 4").alias("doc"), F.col("id").alias("ord"), F.lit(None).cast("long").alias("parent"), F.when(F.col("id") % 4 == 3, "name").otherwise(F.concat(F.lit("name-"), (F.col("id") % 4 + 1).cast("string"))).alias("b"), F.array(F.col("id")).alias("more"))
    df = df.unionByName(spark.sql("SELECT id div 2 AS doc, 9000 + id AS ord, NULL AS parent, 'name' AS b, array(id) AS more FROM range(2)"))
    got = tree.sibling_suffix(df, ["doc"], "b")
    assert got.columns == [*df.columns, "slug"] and got.filter("more[0] <> ord % 9000").count() == 0
    assert [r.slug for r in got.filter("doc = 0").orderBy("ord").collect()] == ["name-1", "name-2", "name-3", "name", "name-4", "name-5"]
    assert got.filter("doc > 0 AND slug <> b").count() == 0 and got.count() == 4002
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a call of Python for each group


def plain_pieces(word, vocab):
    out, at = 0, 0
    if len(word) > 100:
        return None
    while at < len(word):
        ends = [e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in vocab]
        if not ends:
            return None
        out, at = out + 1, max(ends)
    return out


def test_word_pieces(spark, monkeypatch):
    rng = random.Random(3)
    vocab = {"un", "##aff", "##able", "a", "##a", "b", "##b", "ab", "##ba", "é", "##é", "#", "x" * 90, "##"}
    ws = ["unaffable", "unaffablé", "aba", "abab", "z", "bé", "x" * 101, "x" * 90, "un"] + ["".join(rng.choices("abé", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(ws, k=rng.randrange(0, 12))) for _ in range(50)] + ["", None, "Un AB"]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string").repartition(3)
    voc = spark.createDataFrame([(v,) for v in vocab], "piece string")
    got = sorted(tuple(r) for r in wordpiece.piece_counts(docs, voc, keep=("text",)).select("n_words", "n_pieces", "n_unknown").collect())
    want = []
    for t in texts:
        sizes = [plain_pieces(w, vocab) for w in re.findall(r"[^\W_]+", (t or "").lower())]
        want.append((len(sizes), sum(s or 1 for s in sizes), sizes.count(None)))
    assert got == sorted(want) and sum(w[2] for w in want) > 5
    stats = wordpiece.truncation_statistics(spark.createDataFrame([("a", n) for n in (0, 100, 256, 512, 1024)], "k string, n_pieces bigint"), ["k"]).collect()[0]
    assert (stats.n, stats.largest, stats.smallest, stats.truncated_share, stats.median_pieces, stats.p90_pieces) == (5, 1024, 0, 0.4, 256, 512)
    assert stats.mean_retained == pytest.approx((3 + 0.5 + 0.25) / 5) and stats.median_retained == 1.0
    monkeypatch.setattr(wordpiece, "MOST_PIECES", 3)
    with pytest.raises(Exception, match="more than 3 pieces"):
        wordpiece.piece_counts(docs, voc)


def test_digest_trees_are_compared_from_the_top(spark):
    files = spark.range(400).select(F.format_string("a/%05d.md", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    changed = files.withColumn("sha256", F.when(F.col("path") == "a/00007.md", "other").otherwise(F.col("sha256"))).filter("path <> 'a/00100.md'").union(spark.createDataFrame([("b", "x")], "path string, sha256 string"))
    got = sorted(tuple(r) for r in experiment.tree_differences(files, changed).collect())
    assert got == [("a/00007.md", "changed"), ("a/00100.md", "missing"), ("b", "unexpected")]
    assert experiment.tree_differences(files, files.repartition(5)).count() == 0
    assert experiment.tree_differences(files.limit(0), files.limit(0)).count() == 0
    assert experiment.tree_differences(files.limit(0), files).filter("problem = 'unexpected'").count() == 400


def test_word_pieces_make_few_rows_python_objects_at_once(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    docs, taken = spark.sql("SELECT 1L AS doc_id, 'a' AS text"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    wordpiece.piece_counts(docs, spark.sql("SELECT 'alpha' AS piece"))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "_words": [["alpha"] * 100 + [f"b{i}"] for i in range(2999)] + [None]})
    tracemalloc.start()
    (out,) = taken[0]([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("n_words").to_pylist() == [101] * 2999 + [0] and out.column("n_unknown").to_pylist() == [1] * 2999 + [0]
    assert peak < 8e6  # 16.7 MB if the batch is turned as a whole
