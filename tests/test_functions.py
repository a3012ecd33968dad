import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from evispark.functions import arrays, markdown, numeric
from evispark.functions import text as T

TEXTS = [
    "The Quick brown-fox, jumps over 2 dogs!", "", "   ", "the of and", "Straße GROSS ß ſ", "snake_case under_score",
    "ñandú é à ü Ørsted œuvre", "日本語 テキスト x", "a b c  d\te\nf", "SCE-00123 and PC-00001, then SCE-00123",
    "x" * 50 + "-" + "y" * 60, "---", "Ⅷ ½ ٣",
]
WORD = re.compile(r"[^\W_]+")


def rows(spark, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r for r in df.select("i", *cols).orderBy("i").collect()]


def test_tokens_and_query_terms(spark):
    t = F.col("t")
    for text, r in zip(TEXTS, rows(spark, T.tokens(t), T.query_terms(t), T.audit_terms(t))):
        model = WORD.findall(text.casefold())
        assert r[1] == model
        kept = [w for w in model if w not in T.STOP_WORDS]
        assert r[2] == (kept or model)
        assert set(r[3]) == {w for w in model if w not in T.AUDIT_STOP_WORDS and len(w) > 1}


def test_words_counts_and_buckets(spark):
    t = F.col("t")
    for text, r in zip(TEXTS, rows(spark, T.words(t), T.token_count(t), numeric.hash_buckets(t, 384))):
        assert r[1] == text.split()
        assert r[2] == int(len(text.split()) * 1.3) + 1
        assert r[3] == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 384 for w in text.lower().split()]


def test_slugs(spark):
    def fold(v):
        return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()

    t = F.col("t")
    for text, r in zip(TEXTS[:7] + TEXTS[8:12], rows(spark, T.slug(t), T.topic_slug(t))[:7] + rows(spark, T.slug(t), T.topic_slug(t))[8:12]):
        if "ſ" in text:  # compatibility letters outside the Latin accents
            continue
        body = re.sub("[^a-z0-9]+", "-", fold(text)).strip("-")
        assert r[1] == (body or "id-" + hashlib.sha256(text.encode()).hexdigest()[:12])
        assert r[2] == (body[:72].rstrip("-") or "topic")


def test_labels_ids_and_citations(spark):
    df = spark.createDataFrame(
        [("SCE-00123", [4], "see SCE-00123, PC-00001 and SCE-00123"), ("abc", [], "x"), ("a-7", [1, 2], "PC-00001")],
        "id string, pages array<int>, t string",
    )
    got = df.select(
        T.page_label(F.col("pages")), T.id_ordinal(F.col("id")),
        T.citations(F.col("t"), F.array(F.lit("SCE-00123"))), T.context_header(F.col("id"), F.get("pages", F.lit(0))),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("page 4", 123, ["SCE-00123"], "[SCE-00123 | p.4]"), ("page not recorded", None, [], "[abc]"),
        ("pages 1, 2", 7, [], "[a-7 | p.1]"),
    ]


def test_predicates_and_formats(spark):
    df = spark.createDataFrame([("I cannot answer this", 0.0004), ("It may be so", 0.25), ("Plain maybe", None)], "t string, p double")
    t = F.col("t")
    got = df.select(T.refused(t), T.low_confidence(t), T.format_p(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True, "< 0.001"), (False, True, "0.250"), (False, False, "n/a")]


def test_metadata_predicates(spark):
    df = spark.createDataFrame([(["a", "b"], "a"), (["b"], "c"), (None, None)], "l array<string>, s string")
    m = arrays.matches
    got = df.select(
        m(F.col("l"), ["a"], True), m(F.col("l"), "b", True), m(F.col("s"), ["a", "c"]), m(F.col("s"), "a"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, True, True, False), (False,) * 4]


def test_page_set(spark):
    df = spark.createDataFrame([(3, [3, 4], None), (5, None, [6]), (None, None, None)], "n int, p array<int>, q array<int>")
    got = [r[0] for r in df.select(arrays.page_set(F.col("n"), F.col("p"), F.col("q"))).collect()]
    assert got == [[3, 4], [5, 6], []]


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "x array<string>")
    got = [r[0] for r in df.select(arrays.counted(F.col("x"))).collect()]
    assert [[(p["term"], p["tf"]) for p in g] for g in got] == [[("a", 1.0), ("b", 2.0)], []]


def test_links(spark):
    cases = [
        ("a/b.md", "c.md", "a/c.md"), ("a/b.md", "/x/y.md", "x/y.md"), ("a/b.md", "../z.md#top", "z.md"),
        ("a/b.md", "../../z.md", None), ("a/b.md", "http://h/z.md", None), ("a/b.md", "#frag", None),
        ("a/b.md", "index.md", None), ("a/b.md", "pic.png", None), ("a/b.md", "sp%20ace.md", "a/sp ace.md"),
        ("a/b.md", "//host/z.md", None), ("a/b.md", "./d/../e.md", "a/e.md"), ("a/b.md", "p+q.md", "a/p+q.md"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, t string, want string")
    got = df.select("i", markdown.resolve_link(F.col("s"), F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [c[2] for c in cases]


def test_link_targets_and_relative(spark):
    body = 'x [a](b.md) ![img](c.png) [d](<e f.md>) [g](h.md "title")'
    df = spark.createDataFrame([(body, "a/b/c.md", "a/d/e.md"), ("none", "x.md", "y/z.md")], "t string, s string, d string")
    got = df.select(markdown.link_targets(F.col("t")), markdown.relative_link(F.col("s"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(["b.md", "e f.md", "h.md"], "../d/e.md"), ([], "y/z.md")]


def test_timestamps_sections_costs(spark):
    df = spark.createDataFrame([("5.2.1 Likelihood", "see Section 3.4 and Sections 7.1.2 and Section 9", "mock"), ("Title", "", "nope")], "a string, b string, m string")
    r = df.select(T.section_number(F.col("a")), T.section_references(F.col("b")), numeric.usage_cost(F.col("m"), F.lit(10), F.lit(10))).collect()
    assert [tuple(x) for x in r] == [("5.2.1", ["3.4", "7.1.2"], 0.0), (None, [], 0.0)]


def test_dates_and_timestamps(spark):
    rows = [("2026-01-31", "2026-08-02T02:30:00+02:00"), ("2026-02-30", "2026-08-02T00:30:00Z"), ("26-1-1", "2026-08-02T00:30:00"), ("x", "zzz")]
    got = spark.createDataFrame(rows, "d string, t string").select(T.iso_date(F.col("d")).cast("string"), T.utc_timestamp(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("2026-01-31", "2026-08-02T00:30:00Z"), (None, "2026-08-02T00:30:00Z"), (None, None), (None, None)]
