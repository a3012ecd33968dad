"""Catalogue: topic bundles; fifty consecutive documents are a volume, each document a page of text blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import markdown as M
from evispark.operators import topics
from evispark.plans import corpus
from evispark.plans.q_bundle import SHA, SLUG
from evispark.plans.registry import query
from evispark.plans.sql import compose, cte
from evispark.session import settle

LEVELS = 3
KEYS = ["v"]
VERSION = "1"

FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
WORDS_SQL = f"concat('Topic ', doc_id, ' ', {FLAT.format('substr(text, 1, 12)')})"
cte("t_docs", (), f"SELECT doc_id // 50 AS v, doc_id % 50 AS page, doc_id, text, trim(CASE WHEN doc_id % 4 = 0 THEN concat(doc_id // 50, '.', doc_id % 50, ' ', {WORDS_SQL}) ELSE {WORDS_SQL} END) AS title FROM documents WHERE text IS NOT NULL")
cte("t_outline", ("t_docs",), "SELECT v, page AS seq, 1 + (doc_id % 7) % 3 AS level, title, page, CASE WHEN doc_id % 6 = 0 THEN 0.0 ELSE 5.0 END AS y FROM t_docs WHERE page >= 3 AND doc_id % 3 <> 1")
cte(
    "t_blocks", ("t_docs",),
    r"""SELECT v, page, y, x, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM (
      SELECT v, page, (i - 1) * 10.0 + 1 AS y, 0.0 AS x, lines[i] AS t FROM (SELECT *, string_split(text, chr(10)) AS lines FROM t_docs), unnest(range(1, len(lines) + 1)) r(i)
      UNION ALL SELECT v, page, 0.5, 0.0, 'Table of ' || chr(10) || ' contents' FROM t_docs WHERE page = 1 AND v % 2 = 0
      UNION ALL SELECT v, page, 0.25, 0.0, 'the list  of tables' FROM t_docs WHERE page = 2
      UNION ALL SELECT v, page, 0.0, 0.0, upper(title) FROM t_docs WHERE doc_id % 6 = 0 AND page >= 3
      UNION ALL SELECT v, page, 9999.0, 0.0, concat('See Sections ', v, '.', (doc_id - doc_id % 12) % 50, ' of it.') FROM t_docs WHERE doc_id % 11 = 0)""",
)
cte(
    "t_entries", ("t_docs", "t_outline"),
    f"""SELECT v, ord, level, title, page, y, nullif(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(.*)$', 1), '') AS number FROM (
      WITH front AS (
        SELECT DISTINCT v, 0 AS k, 1 AS level, 'Front Matter' AS title, 0 AS page, -1.0 AS y FROM t_outline
        UNION ALL SELECT o.v, 1, 2, coalesce((SELECT arg_min(line, struct_pack(p := i)) FROM (SELECT unnest(string_split(d.text, chr(10))) AS raw, generate_subscripts(string_split(d.text, chr(10)), 1) AS i, {FLAT.format('raw')} AS line FROM t_docs d WHERE d.v = o.v AND d.page = 0) WHERE line <> ''), 'Cover'), 0, 0.0
          FROM (SELECT DISTINCT v FROM t_outline) o
        UNION ALL SELECT v, 2, 2, 'Table Of Contents', 1, 0.5 FROM t_docs WHERE page = 1 AND v % 2 = 0 AND v IN (SELECT v FROM t_outline)
        UNION ALL SELECT v, 3, 2, 'List Of Tables', 2, 0.25 FROM t_docs WHERE page = 2 AND v IN (SELECT v FROM t_outline))
      SELECT v, row_number() OVER (PARTITION BY v ORDER BY k) - 1 AS ord, level, title, page, y FROM front
      UNION ALL SELECT o.v, o.seq + n, level, title, page, y FROM t_outline o JOIN (SELECT v, count(*) AS n FROM front GROUP BY v) c ON c.v = o.v)""",
)
cte(
    "t_texts", ("t_entries", "t_blocks"),
    f"""SELECT v, ord, list_sort(list_distinct(list(page + 1))) AS pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY nth) FILTER (NOT (nth = 1 AND lower({FLAT.format('text')}) = lower(title))), '') AS text FROM (
      SELECT b.*, e.ord, e.title, row_number() OVER (PARTITION BY b.v, e.ord ORDER BY b.page, round(b.y, 1), b.x, b.text) AS nth FROM (
        SELECT b.v, b.page, b.y, b.x, b.text, max(struct_pack(p := e.page, y := e.y, o := e.ord)) AS own FROM t_blocks b JOIN t_entries e ON e.v = b.v AND (e.page < b.page OR (e.page = b.page AND e.y <= b.y))
        WHERE b.text <> '' GROUP BY b.v, b.page, b.y, b.x, b.text, b.rowid_) b JOIN t_entries e ON e.v = b.v AND e.ord = b.own.o) GROUP BY v, ord""".replace(", b.rowid_", ""),
)
NAME_SQL = "CASE WHEN rtrim(substr({0}, 1, 72), '-') <> '' THEN rtrim(substr({0}, 1, 72), '-') ELSE 'topic' END"
BARE = "coalesce(nullif(regexp_extract(title, '^\\d+(?:\\.\\d+)*\\.?\\s+(.*)$', 1), ''), title)"
cte("t_parents", ("t_entries",), "SELECT e.*, (SELECT max(p.ord) FROM t_entries p WHERE p.v = e.v AND p.ord < e.ord AND p.level < e.level) AS parent FROM t_entries e")
cte(
    "t_shape", ("t_parents",),
    f"""SELECT *, lag(ord) OVER s AS prev, lead(ord) OVER s AS next, (SELECT count(*) FROM t_parents c WHERE c.v = p.v AND c.parent = p.ord) AS kids,
      CASE WHEN number IS NOT NULL THEN {NAME_SQL.format(SLUG.format('number'))} || '-' || {NAME_SQL.format(SLUG.format(BARE))}
        WHEN parent IS NULL THEN lpad((row_number() OVER s)::VARCHAR, 2, '0') || '-' || {NAME_SQL.format(SLUG.format('title'))} ELSE {NAME_SQL.format(SLUG.format('title'))} END AS slug
      FROM t_parents p WINDOW s AS (PARTITION BY v, parent ORDER BY ord)""",
)
cte(
    "t_paths", ("t_shape",),
    """SELECT v, ord, 'concepts/' || slug AS stem, [title] AS titles FROM t_shape WHERE parent IS NULL
    UNION ALL SELECT s.v, s.ord, p.stem || '/' || s.slug, list_append(p.titles, s.title) FROM t_paths p JOIN t_shape s ON s.v = p.v AND s.parent = p.ord""",
)
cte(
    "t_nodes", ("t_shape", "t_paths", "t_texts"),
    """SELECT s.*, p.stem, p.stem || '.md' AS path, p.titles, coalesce(x.text, '') AS text, coalesce(x.pages, []) AS pages FROM t_shape s JOIN t_paths p ON p.v = s.v AND p.ord = s.ord
    LEFT JOIN t_texts x ON x.v = s.v AND x.ord = s.ord""",
)
A, B = "string_split({0}, '/')[:-2]", "string_split({1}, '/')"
SHARED = f"len(list_filter(range(1, least(len({A}), len({B}) - 1) + 1), lambda i: {A}[1:i] = {B}[1:i]))"
RELATIVE = f"array_to_string(list_concat(list_transform(range(0, len({A}) - {SHARED}), lambda i: '..'), {B}[{SHARED} + 1:]), '/')"


def link_sql(kind: str, rank: int, source: str, order: str) -> str:
    return f"SELECT a.v, a.ord, {rank} AS r, {order} AS i, concat('* {kind}: [', b.title, '](', {RELATIVE.format('a.path', 'b.path')}, ')') AS l FROM {source}"


cte(
    "t_links", ("t_nodes",),
    " UNION ALL ".join([
        link_sql("Parent topic", 0, "t_nodes a JOIN t_nodes b ON b.v = a.v AND b.ord = a.parent", "0"),
        link_sql("Previous topic", 1, "t_nodes a JOIN t_nodes b ON b.v = a.v AND b.ord = a.prev", "0"),
        link_sql("Next topic", 2, "t_nodes a JOIN t_nodes b ON b.v = a.v AND b.ord = a.next", "0"),
        link_sql("Child topic", 3, "t_nodes a JOIN t_nodes b ON b.v = a.v AND b.parent = a.ord", "b.ord"),
        "SELECT v, ord, r, i, l FROM (" + link_sql(
            "Referenced section", 4,
            "(SELECT *, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM (SELECT *, list_distinct(regexp_extract_all(text, '\\bSections?\\s+(\\d+(?:\\.\\d+)+)', 1)) AS refs FROM t_nodes)) a "
            "JOIN t_nodes b ON b.v = a.v AND b.number = a.ref AND b.ord <> a.ord", "a.pos") + ") QUALIFY row_number() OVER (PARTITION BY v, ord ORDER BY i) <= 20",
    ]),
)
SPAN = "CASE len(pages) WHEN 0 THEN 'no extracted pages' WHEN 1 THEN 'page ' || pages[1] ELSE 'pages ' || pages[1] || '-' || pages[-1] END"
NL = " || chr(10) || "
FIELDS = [
    "'type: Document Section'", "'title: ' || to_json(title)", f"'resource: \"urn:sha256:{SHA}#section=' || slug || '\"'",
    "'tags: [\"document-section\", \"corpus-vol\", \"level-' || level || '\"]'", "'status: stable'",
    f"'sources: [{{\"id\": \"source-pdf\", \"resource\": \"urn:sha256:{SHA}#pages=' || array_to_string(pages, ',') || '\", \"title\": \"vol-' || n.v || '\"}}]'",
    "'corpus: \"VOL\"'", "'corpus_version: \"v1\"'", "'source_chunk_id: \"VOL-TOPIC-' || lpad(n.ord::VARCHAR, 5, '0') || '\"'", "'slug: \"' || slug || '\"'",
    "'outline_level: ' || level", "'outline_order: ' || n.ord", "'section_number: ' || coalesce('\"' || number || '\"', 'null')", "'section_path: ' || to_json(titles)",
    "'page_number: ' || coalesce(pages[1]::VARCHAR, 'null')", "'page_numbers: [' || array_to_string(pages, ',') || ']'", "'document_name: \"vol-' || n.v || '\"'",
    f"'source_sha256: \"{SHA}\"'", "'content_sha256: \"' || sha256(text) || '\"'", "'child_count: ' || kids",
]
cte(
    "t_content", ("t_nodes", "t_links"),
    f"""SELECT n.v, n.ord, path, '---'{NL}{NL.join(FIELDS)}{NL}'---'{NL}chr(10) || '# ' || title{NL}''{NL}'## Evidence'{NL}''{NL}'{M.EVIDENCE_START}'{NL}text{NL}'{M.EVIDENCE_END}'{NL}''{NL}
      CASE WHEN links IS NULL THEN '' ELSE '## Relationships'{NL}''{NL}links{NL}''{NL}'' END || '## Provenance'{NL}''{NL}'Extracted from **vol-' || n.v || '**, ' || {SPAN} || '.[^source-pdf]'{NL}''{NL}'[^source-pdf]: vol-' || n.v || ', ' || {SPAN} || '.' || chr(10) AS content
      FROM t_nodes n LEFT JOIN (SELECT v, ord, string_agg(l, chr(10) ORDER BY r, i, l) AS links FROM t_links GROUP BY v, ord) k ON k.v = n.v AND k.ord = n.ord""",
)
DETAIL = "CASE WHEN kids > 0 THEN concat(' - ', kids, ' sub-topics') WHEN len(pages) > 0 THEN concat(' - page ', pages[1]) ELSE '' END"
cte(
    "t_index", ("t_nodes",),
    f"""SELECT v, CASE WHEN parent IS NULL THEN 'concepts/index.md' ELSE pstem || '/index.md' END AS path, CASE WHEN parent IS NULL THEN '---'{NL}'format_version: "{VERSION}"'{NL}'type: Index'{NL}'title: "Topics of vol-' || v || '"'{NL}'---'{NL}''{NL}'# Topics of vol-' || v ELSE '# ' || ptitle END
      {NL}''{NL}string_agg(concat('* [', title, '](', slug, '.md)', {DETAIL}), chr(10) ORDER BY ord) || chr(10) AS content
      FROM (SELECT n.*, p.stem AS pstem, p.title AS ptitle FROM t_nodes n LEFT JOIN t_nodes p ON p.v = n.v AND p.ord = n.parent) GROUP BY v, parent, pstem, ptitle""",
)


def volumes(spark, sf):
    v, page = F.expr("doc_id div 50"), F.col("doc_id") % 50
    words = F.concat(F.lit("Topic "), F.col("doc_id").cast("string"), F.lit(" "), topics.flat(F.substring("text", 1, 12)))
    number = F.concat(F.expr("doc_id div 50").cast("string"), F.lit("."), page.cast("string"), F.lit(" "))
    title = F.trim(F.when(F.col("doc_id") % 4 == 0, F.concat(number, words)).otherwise(words))
    return corpus.table(spark, sf, "documents").filter("text is not null").select("doc_id", "text", v.alias("v"), page.alias("page"), title.alias("title"))


def outline(d):
    level = (F.col("doc_id") % 7 % 3 + 1).cast("int")
    y = F.when(F.col("doc_id") % 6 == 0, 0.0).otherwise(5.0)
    return d.filter("page >= 3 and doc_id % 3 <> 1").select("v", F.col("page").alias("seq"), level.alias("level"), "title", "page", y.alias("y"))


def blocks(d):
    """Lines of each page as blocks, with the headings and references that printed pages have."""
    block = lambda y, t: F.struct(y.cast("double").alias("y"), F.lit(0.0).alias("x"), t.alias("text"))
    when = lambda c, y, t: F.when(c, F.array(block(F.lit(y), t))).otherwise(F.array().cast("array<struct<y: double, x: double, text: string>>"))
    ref = F.concat(F.lit("See Sections "), F.col("v").cast("string"), F.lit("."), ((F.col("doc_id") - F.col("doc_id") % 12) % 50).cast("string"), F.lit(" of it."))
    every = F.concat(
        F.transform(F.split("text", "\n", -1), lambda t, i: block(i * 10.0 + 1, t)), when((F.col("page") == 1) & (F.col("v") % 2 == 0), 0.5, F.lit("Table of \n contents")),
        when(F.col("page") == 2, 0.25, F.lit("the list  of tables")), when((F.col("doc_id") % 6 == 0) & (F.col("page") >= 3), 0.0, F.upper("title")), when(F.col("doc_id") % 11 == 0, 9999.0, ref),
    )
    return d.select("v", "page", F.explode(every).alias("b")).select("v", "page", "b.y", "b.x", "b.text")


def nodes(spark, sf):
    d = volumes(spark, sf)
    return settle(topics.topics(blocks(d), outline(d), KEYS, LEVELS))


@query(
    "topic_nodes",
    compose("SELECT v, ord, level, parent, path, number AS section_number, kids AS child_count, array_to_string(pages, ',') AS pages, sha256(text) AS text_sha256 FROM t_nodes", "t_nodes"),
)
def topic_nodes(spark, sf):
    """Every topic with its place in the tree, its file and the digest of the text that belongs to it."""
    return nodes(spark, sf).select(
        "v", "ord", F.col("level").cast("long").alias("level"), "parent", "path", "section_number", "child_count", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.sha2("text", 256).alias("text_sha256")
    )


@query("topic_documents", compose("SELECT v, ord, path, sha256(content) AS sha256, length(content)::INT AS n_chars FROM t_content", "t_content"))
def topic_documents(spark, sf):
    name = F.concat(F.lit("vol-"), F.col("v").cast("string"))
    docs = topics.topic_documents(nodes(spark, sf), KEYS, SHA, F.lit("VOL"), name, "v1")
    return docs.select("v", "ord", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars"))


@query("topic_index", compose("SELECT v, path, sha256(content) AS sha256, length(content)::INT AS n_chars FROM t_index", "t_index"))
def topic_index(spark, sf):
    title = F.concat(F.lit("Topics of vol-"), F.col("v").cast("string"))
    i = topics.topic_indexes(nodes(spark, sf), KEYS, title, VERSION)
    return i.select("v", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars"))
