"""Catalogue: concept bundles, links, digests, outline trees, as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import markdown as M
from evispark.functions import text as T
from evispark.operators import bundle, experiment, graph, tree
from evispark.plans import corpus, sql
from evispark.plans.q_retrieval import chain
from evispark.plans.registry import query
from evispark.plans.sql import CHUNK_NAME, compose, cte
from evispark.session import spread

SHA = "0123456789abcdef" * 4
NAME = CHUNK_NAME
NAME_OF = lambda col: CHUNK_NAME.replace("doc_id", col)
LABEL = "CASE WHEN len(pages) = 1 THEN 'page ' ELSE 'pages ' END || array_to_string(pages, ', ')"


def linked_chunks(spark, sf):
    links = chain(spark, sf).select("doc_id", "prev_id", "next_id")
    c = spread(corpus.chunks(spark, sf), "doc_id").join(links, "doc_id")
    name = lambda col: F.when(F.col(col).isNotNull(), corpus.chunk_name("tenant", col))
    return c.select(
        "*", corpus.chunk_name().alias("chunk_id"), F.lit(None).cast("string").alias("section"),
        name("prev_id").alias("prev_chunk"), name("next_id").alias("next_chunk"),
    )


def concepts(spark, sf):
    return bundle.concept_documents(linked_chunks(spark, sf), SHA, "v1")


def _path(col):
    return f"'concepts/' || tenant || '/' || lower({NAME_OF(col)}) || '.md'"


cte(
    "concepts", ("chunks", "chain"),
    f"""SELECT tenant, doc_id, {_path('doc_id')} AS path, prev_id, next_id, text,
    '---' || chr(10) || 'type: Source Passage' || chr(10) || 'title: "' || {NAME} || ' — ' || replace({LABEL}, 'page', 'Page') || '"' || chr(10)
    || 'description: "Source chunk ' || {NAME} || ' from ' || document || ', ' || {LABEL} || '."' || chr(10)
    || 'resource: "urn:sha256:{SHA}#chunk=' || {NAME} || '"' || chr(10)
    || 'tags: ["source-passage", "corpus-' || tenant || '"]' || chr(10) || 'status: stable' || chr(10)
    || 'sources: [{{"id": "source-pdf", "resource": "urn:sha256:{SHA}#pages=' || array_to_string(pages, ',') || '", "title": "' || document || '"}}]' || chr(10)
    || 'corpus: "' || tenant || '"' || chr(10) || 'corpus_version: "v1"' || chr(10) || 'source_chunk_id: "' || {NAME} || '"' || chr(10)
    || 'source_order: ' || doc_id || chr(10) || 'page_numbers: [' || array_to_string(pages, ',') || ']' || chr(10) || 'section: null' || chr(10)
    || 'document_name: "' || document || '"' || chr(10) || 'source_sha256: "{SHA}"' || chr(10) || 'content_sha256: "' || sha256(text) || '"' || chr(10) || '---' || chr(10)
    || '# Evidence' || chr(10) || chr(10) || '{M.EVIDENCE_START}' || chr(10) || text || chr(10) || '{M.EVIDENCE_END}'
    || CASE WHEN prev_id IS NULL AND next_id IS NULL THEN '' ELSE chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10)
       || array_to_string(list_filter([CASE WHEN prev_id IS NOT NULL THEN '* Previous passage: [source passage](/' || {_path('prev_id')} || ')' END,
          CASE WHEN next_id IS NOT NULL THEN '* Next passage: [source passage](/' || {_path('next_id')} || ')' END], lambda x: x IS NOT NULL), chr(10)) END
    || chr(10) || chr(10) || '## Provenance' || chr(10) || chr(10) || 'Extracted from **' || document || '**, ' || {LABEL} || '.[^source-pdf]' || chr(10) || chr(10)
    || '[^source-pdf]: ' || document || ', ' || {LABEL} || '.' || chr(10) AS content
    FROM chunks JOIN chain USING (tenant, doc_id, document)""",
)


@query(
    "concept_documents",
    compose("SELECT doc_id, path, sha256(content) AS sha256, length(content)::INT AS n_chars FROM concepts", "concepts"),
)
def concept_documents(spark, sf):
    return concepts(spark, sf).select(
        "doc_id", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars")
    )


@query(
    "concept_round_trip",
    compose(
        "SELECT path, sha256(text) AS evidence_sha, ((prev_id IS NOT NULL)::INT + (next_id IS NOT NULL)::INT) AS n_links FROM concepts",
        "concepts",
    ),
)
def concept_round_trip(spark, sf):
    """Parse the produced documents again: evidence and links must survive."""
    p = bundle.parse_concepts(concepts(spark, sf).select("path", "content"))
    return p.select("path", F.sha2("evidence", 256).alias("evidence_sha"), F.size("targets").alias("n_links"))


@query(
    "concept_links",
    compose(
        f"""SELECT replace(path, '.md', '') AS src, replace({_path('prev_id')}, '.md', '') AS dst FROM concepts WHERE prev_id IS NOT NULL
        UNION ALL SELECT replace(path, '.md', ''), replace({_path('next_id')}, '.md', '') FROM concepts WHERE next_id IS NOT NULL""",
        "concepts",
    ),
)
def concept_links(spark, sf):
    p = bundle.parse_concepts(concepts(spark, sf).select("path", "content"))
    return bundle.concept_links(p).select("src", "dst")


def tree_level(h: str, p: str, d: str, n: str, source: str) -> str:
    return f"""SELECT tenant, {h} AS h, sha256(string_agg({p} || chr(0) || {d} || chr(10), '' ORDER BY {p})) AS d, {n} AS n
      FROM {source} GROUP BY tenant, {h}"""


TREE = {
    "n9": (("concepts",), tree_level("substr(sha256(path), 1, 9)", "path", "sha256(content)", "count(*)", "concepts")),
    "n6": (("n9",), tree_level("substr(h, 1, 6)", "h", "d", "sum(n)", "n9")),
    "n3": (("n6",), tree_level("substr(h, 1, 3)", "h", "d", "sum(n)", "n6")),
}


@query(
    "inventory_digest",
    compose(
        """SELECT tenant, sum(n)::BIGINT AS n_files, sha256(string_agg(h || chr(0) || d || chr(10), '' ORDER BY h)) AS digest FROM n3 GROUP BY tenant""",
        "n3",
        extra=TREE,
    ),
)
def inventory_digest(spark, sf):
    c = concepts(spark, sf).select("tenant", "path", F.sha2("content", 256).alias("sha"))
    return experiment.tree_digest(c, ["tenant"], "path", "sha")


@query(
    "text_digests",
    "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, 'blind-' || substr(sha256(lang || '|' || source || '|' || doc_id), 1, 24) AS evaluation_id FROM documents",
)
def text_digests(spark, sf):
    from evispark.operators.judging import evaluation_id

    return corpus.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"),
        evaluation_id(F.col("lang"), F.col("source"), F.col("doc_id")).alias("evaluation_id"),
    )


@query(
    "store_mismatch",
    """SELECT c.conv_id || '/' || c.turn AS path, 'changed' AS problem FROM conversations c JOIN (
         SELECT conv_id, turn, CASE WHEN role = 'user' THEN upper(text) ELSE text END AS text FROM conversations) s USING (conv_id, turn)
       WHERE sha256(c.text) <> sha256(s.text) AND c.turn <> 1 UNION ALL
       SELECT conv_id || '/' || turn, 'missing' FROM conversations WHERE turn = 1""",
)
def store_mismatch(spark, sf):
    """Two stores of one table compared row by row through digests: the second
    copy lost every turn 1 and shouts the user's text."""
    c = corpus.table(spark, sf, "conversations")
    key = F.concat_ws("/", "conv_id", "turn").alias("path")
    copy = c.filter("turn <> 1").withColumn("text", F.when(F.col("role") == "user", F.upper("text")).otherwise(F.col("text")))
    one = lambda d: d.select(key, F.sha2("text", 256).alias("sha256"))
    return experiment.inventory_mismatch(one(c), one(copy))


SLUG = (
    "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"
)
HEAD = "split_part(text, chr(10), 1)"


@query(
    "passage_labels",
    compose(
        f"""SELECT doc_id, {NAME} || ' — ' || replace({LABEL}, 'page', 'Page') AS title,
        'Source chunk ' || {NAME} || ' from ' || document || ', ' || {LABEL} || '.' AS description,
        'urn:sha256:{SHA}#chunk=' || url_encode({NAME}) AS urn,
        CASE WHEN {SLUG.format(HEAD)} <> '' THEN {SLUG.format(HEAD)} ELSE 'id-' || substr(sha256({HEAD}), 1, 12) END AS slug,
        CASE WHEN rtrim(substr({SLUG.format(HEAD)}, 1, 72), '-') <> '' THEN rtrim(substr({SLUG.format(HEAD)}, 1, 72), '-') ELSE 'topic' END AS topic_slug,
        doc_id AS ordinal FROM chunks""",
        "chunks",
    ),
)
def passage_labels(spark, sf):
    c = corpus.chunks(spark, sf).withColumn("chunk_id", corpus.chunk_name())
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    return c.select(
        "doc_id", T.passage_title(F.col("chunk_id"), F.lit(None).cast("string"), F.col("pages")).alias("title"),
        T.passage_description(F.col("chunk_id"), F.col("document"), F.col("pages")).alias("description"),
        T.chunk_urn(F.lit(SHA), F.col("chunk_id")).alias("urn"), T.slug(head).alias("slug"),
        T.topic_slug(head).alias("topic_slug"), T.id_ordinal(F.col("chunk_id")).alias("ordinal"),
    )


_SCAN = " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, kind, count(*) FILTER (regexp_matches(t, '{p}')) AS n FROM texts GROUP BY kind"
    for n, p in T.SECRET_PATTERNS.items()
)


@query(
    "secret_scan",
    f"""WITH texts AS (SELECT 'documents' AS kind, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages
      UNION ALL SELECT 'conversations', text FROM conversations) {_SCAN}""",
)
def secret_scan(spark, sf):
    """Rows matching each pattern, zero counts included."""
    rows = [
        corpus.table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(c).alias("t"))
        for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))
    ]
    u = rows[0].unionByName(rows[1]).unionByName(rows[2])
    found = u.groupBy("kind").agg(*[F.count_if(F.col("t").rlike(p)).alias(n) for n, p in T.SECRET_PATTERNS.items()])
    return found.unpivot("kind", list(T.SECRET_PATTERNS), "pattern", "n")


@query(
    "page_links",
    """SELECT page_id, pos, target, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:|^//') THEN 'external'
      WHEN starts_with(target, '#') THEN 'fragment' WHEN starts_with(target, '/') THEN 'absolute' ELSE 'relative' END AS kind
    FROM (SELECT page_id, unnest(t) AS target, (generate_subscripts(t, 1) - 1)::INT AS pos FROM (
      SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS t FROM pages))""",
)
def page_links(spark, sf):
    """Anchor targets of raw pages in order, classified like bundle links."""
    p = corpus.table(spark, sf, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a\\s[^>]*href="([^"]*)"'), 1)).alias("pos", "target")
    )
    t = F.col("target")
    kind = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//"), "external").when(F.startswith(t, F.lit("#")), "fragment")
        .when(F.startswith(t, F.lit("/")), "absolute").otherwise("relative")
    )
    return p.select("page_id", "pos", "target", kind.alias("kind"))


@query(
    "rebuild_differences",
    compose(
        """SELECT path, CASE WHEN doc_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS problem FROM concepts WHERE doc_id % 101 = 7 OR doc_id % 97 = 5
        UNION ALL SELECT 'more-' || path, 'unexpected' FROM concepts WHERE doc_id % 103 = 9""",
        "concepts",
    ),
)
def rebuild_differences(spark, sf):
    """The bundle built twice, the second time with known changes: what differs, by comparing digest trees from the top."""
    built = lambda: concepts(spark, sf).select("doc_id", "path", F.sha2("content", 256).alias("sha256"))
    d = F.col("doc_id")
    again = built().filter(d % 101 != 7).withColumn("sha256", F.when(d % 97 == 5, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    extra = built().filter(d % 103 == 9).withColumn("path", F.concat(F.lit("more-"), "path"))
    return experiment.tree_differences(built().drop("doc_id"), again.unionByName(extra).drop("doc_id"))


@query("rebuild_is_the_same", compose("SELECT count(*) AS files, 0 AS differences FROM concepts", "concepts"))
def rebuild_is_the_same(spark, sf):
    """The bundle built twice from the same tables."""
    built = lambda: concepts(spark, sf).select("path", F.sha2("content", 256).alias("sha256"))
    found = experiment.tree_differences(built(), built())
    return built().agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(found.agg(F.count(F.lit(1)).cast("int").alias("differences"))))


OUTLINE = """SELECT (r_regionkey * 100) * 10000000000 AS ord, 1 AS level, r_name AS title FROM region UNION ALL
  SELECT (n_regionkey * 100 + n_nationkey + 1) * 10000000000, 2, n_name FROM nation UNION ALL
  SELECT (n_regionkey * 100 + n_nationkey + 1) * 10000000000 + c_custkey + 1, 3, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey"""
cte("outline", (), OUTLINE)
cte(
    "outline_tree", ("outline",),
    """SELECT *, CASE level WHEN 2 THEN max(CASE WHEN level = 1 THEN ord END) OVER w
      WHEN 3 THEN max(CASE WHEN level < 3 THEN ord END) OVER w END AS parent FROM outline
    WINDOW w AS (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)


def outline(spark, sf):
    """region > nation > customer as one flat outline in reading order."""
    r, n, c = (corpus.table(spark, sf, t) for t in ("region", "nation", "customer"))
    big = F.lit(10000000000)
    at = (F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).cast("bigint") * big
    rows = r.select((F.col("r_regionkey").cast("bigint") * 100 * big).alias("ord"), F.lit(1).alias("level"), F.col("r_name").alias("title"))
    rows = rows.unionByName(n.select(at.alias("ord"), F.lit(2).alias("level"), F.col("n_name").alias("title")))
    cust = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.unionByName(
        cust.select((at + F.col("c_custkey") + 1).alias("ord"), F.lit(3).alias("level"), F.col("c_name").alias("title"))
    )
    return rows.withColumn("doc", F.lit(1))


@query(
    "outline_tree",
    compose(
        """SELECT t.ord, t.level, t.parent, t.level AS depth,
        CASE t.level WHEN 1 THEN t.title WHEN 2 THEN p.title || ' > ' || t.title ELSE g.title || ' > ' || p.title || ' > ' || t.title END AS title_path,
        coalesce(k.n, 0) AS child_count, lag(t.ord) OVER s AS prev_sibling, lead(t.ord) OVER s AS next_sibling
        FROM outline_tree t LEFT JOIN outline_tree p ON p.ord = t.parent LEFT JOIN outline_tree g ON g.ord = p.parent
        LEFT JOIN (SELECT parent, count(*) AS n FROM outline_tree GROUP BY parent) k ON k.parent = t.ord
        WINDOW s AS (PARTITION BY t.parent ORDER BY t.ord)""",
        "outline_tree",
    ),
)
def outline_tree(spark, sf):
    nodes = tree.outline_parents(outline(spark, sf), ["doc"], 3)
    nodes = tree.siblings(tree.child_counts(tree.outline_paths(nodes, ["doc"], 3), ["doc"]), ["doc"])
    return nodes.select("ord", "level", "parent", "depth", "title_path", "child_count", "prev_sibling", "next_sibling")


@query(
    "as_of_purchase",
    """SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'""",
)
def as_of_purchase(spark, sf):
    """Every other event with its user's latest purchase at or before it."""
    e = corpus.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    marks = e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    rows = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    day = F.datediff("ts", F.lit("1970-01-01"))
    return tree.as_of(rows, marks, ["user_id"], ["ts"], day, "purchase_id").select("event_id", "purchase_id")
