"""Topic bundles: text blocks assigned to the entries of an outline, documents and folder listings assembled from the tree."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import markdown as M
from evispark.functions import text as T
from evispark.operators import tree
from evispark.operators.ranking import dense_index, top_k
from evispark.session import settle

# Headings of divisions before the outline starts.
FRONT_HEADINGS = ("TABLE OF CONTENTS", "LIST OF TABLES", "LIST OF FIGURES")
ROOT, COVER = "Front Matter", "Cover"
MOST_REFERENCES = 20


def flat(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def front_matter(blocks: DataFrame, outline: DataFrame, keys) -> DataFrame:
    """(keys, ord, level, title, page, y): what stands before a document's outline.

    The root entry comes first, then the cover, named by the first line of the first page, then each of
    ``FRONT_HEADINGS`` at its first occurrence in a block before the outline's first page, in any case and spacing.
    A document has at most five rows. ``blocks``: keys, page (from 0), y, x, text; ``outline``: keys, seq, level, title,
    page, y.
    """
    keys = list(keys)
    first = outline.groupBy(*keys).agg(F.min("page").alias("_first"))
    place = F.struct("page", F.round("y", 1).alias("r"), "x", "y")
    line = F.when(F.col("page") == 0, F.get(F.filter(F.transform(F.split("text", "\n"), flat), lambda x: x != ""), F.lit(0)))
    # Only blocks with a heading's first word are looked at in full.
    upper = F.upper("text")
    said = [F.when(F.contains(upper, F.lit(h.split()[0])), F.contains(F.upper(flat(F.col("text"))), F.lit(h))) for h in FRONT_HEADINGS]
    marks = blocks.select(*keys, line.alias("_line"), F.when(F.col("page") == 0, place).alias("_at"), *[F.when(c & F.col("page").isNotNull(), place).alias(f"h{i}") for i, c in enumerate(said)])
    # Places begin with their page, so a document's first place decides whether any is before the outline; no text is shuffled.
    at = marks.groupBy(*keys).agg(F.min_by("_line", F.when(F.col("_line").isNotNull(), F.col("_at"))).alias("cover"), *[F.min(f"h{i}").alias(f"h{i}") for i in range(len(FRONT_HEADINGS))])
    at = at.join(first, keys).select(*keys, "cover", *[F.when(F.col(f"h{i}.page") < F.col("_first"), F.col(f"h{i}")).alias(f"h{i}") for i in range(len(FRONT_HEADINGS))])
    found = F.array_sort(
        F.filter(
            F.array(*[F.when(F.col(f"h{i}").isNotNull(), F.struct(F.col(f"h{i}").alias("at"), F.lit(i).alias("i"), F.lit(h.title()).alias("title"))) for i, h in enumerate(FRONT_HEADINGS)]),
            lambda x: x.isNotNull(),
        )
    )
    entry = lambda level, title, page, y: F.struct(F.lit(level).alias("level"), title.alias("title"), page.cast("bigint").alias("page"), y.cast("double").alias("y"))
    all_ = F.concat(
        F.array(entry(1, F.lit(ROOT), F.lit(0), F.lit(-1.0)), entry(2, F.coalesce("cover", F.lit(COVER)), F.lit(0), F.lit(0.0))),
        F.transform(found, lambda x: entry(2, x["title"], x["at"]["page"], x["at"]["y"])),
    )
    return at.select(*keys, F.posexplode(all_).alias("ord", "e")).select(*keys, F.col("ord").cast("bigint").alias("ord"), "e.level", "e.title", "e.page", "e.y")


def topics(blocks: DataFrame, outline: DataFrame, keys, levels: int, pages_a_block: int = 64) -> DataFrame:
    """One row a topic: keys, ord, level, title, section_number, text, pages, parent, child_count, title path, neighbours, slug, path.

    The outline, behind its front matter, decides the hierarchy; position decides the text: a block belongs to the last
    entry at or before it, found by one merge of blocks and entries in reading order, so a document of any length is
    split over its pages. A heading repeated as the first block of its topic goes. Blank blocks are nobody's.
    """
    keys = list(keys)
    front = settle(front_matter(blocks, outline, keys))
    shift = front.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    own = outline.join(shift, keys).select(*keys, (F.col("seq") + F.col("_n")).alias("ord"), "level", flat(F.col("title")).alias("title"), F.col("page").cast("bigint").alias("page"), F.col("y").cast("double").alias("y"))
    entries = settle(front.unionByName(own).withColumn("section_number", T.section_number(F.col("title"))))
    marks = entries.groupBy(*keys, "page", "y").agg(F.max("ord").alias("owner"))
    body = blocks.select(*keys, F.col("page").cast("bigint").alias("page"), F.col("y").cast("double").alias("y"), "x", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    owned = tree.as_of(body, marks, keys, ["page", "y"], F.floor(F.col("page") / pages_a_block), "owner").filter("owner is not null")
    parts = owned.groupBy(*keys, F.col("owner").alias("ord")).agg(
        F.sort_array(F.collect_list(F.struct("page", F.round("y", 1).alias("r"), "x", "text"))).alias("_parts"), F.sort_array(F.collect_set(F.col("page") + 1)).alias("pages")
    )
    texts = F.col("_parts")["text"]
    repeated = T.casefold(flat(F.get(texts, F.lit(0)))) == T.casefold(F.col("title"))
    joined = F.array_join(F.when(repeated, F.slice(texts, 2, F.size(texts))).otherwise(texts), "\n\n")
    nodes = entries.join(parts, [*keys, "ord"], "left").withColumn("text", F.coalesce(joined, F.lit(""))).withColumn("pages", F.coalesce("pages", F.array().cast("array<bigint>"))).drop("_parts")
    # the tree is narrow: texts do not go through its windows
    shape = tree.outline_parents(entries.select(*keys, "ord", "level", "title", "section_number"), keys, levels)
    shape = tree.siblings(tree.child_counts(tree.outline_paths(shape, keys, levels, "titles"), keys), keys)
    shape = _named(settle(shape), keys, levels)
    return nodes.drop("level", "title", "section_number", "y", "page").join(shape, [*keys, "ord"])


def _named(shape: DataFrame, keys, levels: int) -> DataFrame:
    """Adds slug and path: a section's number before its name, a number in order before the name of other roots, unique among siblings."""
    roots = dense_index(shape.filter("parent is null").select(*keys, "ord"), F.floor(F.col("ord") / 4096), ["ord"], "_at", keys)
    bare = F.coalesce(F.nullif(F.regexp_extract("title", r"^\d+(?:\.\d+)*\.?\s+(.*)$", 1), F.lit("")), F.col("title"))
    name = T.topic_slug(F.when(F.col("section_number").isNotNull(), bare).otherwise(F.col("title")))
    number = F.lpad((F.col("_at") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("_at") + 1).cast("string"))), F.lit("0"))
    base = F.when(F.col("section_number").isNotNull(), F.concat_ws("-", T.topic_slug(F.col("section_number")), name)).when(F.col("parent").isNull(), F.concat_ws("-", number, name)).otherwise(name)
    named = settle(tree.sibling_suffix(shape.join(roots, [*keys, "ord"], "left").withColumn("base", base).drop("_at"), keys, "base").drop("base"))
    paths = tree.outline_paths(named.select(*keys, "ord", "parent", F.col("slug").alias("title")), keys, levels)
    path = F.concat(F.lit("concepts/"), F.replace("title_path", F.lit(" > "), F.lit("/")), F.lit(".md"))
    return named.join(paths.select(*keys, "ord", path.alias("path")), [*keys, "ord"])


def topic_documents(nodes: DataFrame, keys, source_sha: str, corpus: Column, document: Column, version: str, most: int = MOST_REFERENCES) -> DataFrame:
    """(keys, ord, path, content): one Markdown document a topic, from `topics`.

    Front matter, the text between markers, links to parent, neighbours, children and the sections that the text names
    (the first ``most``, never itself), and where it comes from.
    """
    keys = list(keys)
    nodes = nodes.withColumn("_corpus", corpus).withColumn("_document", document)
    narrow = nodes.select(*keys, "ord", "parent", "title", "path", "prev_sibling", "next_sibling")
    known = narrow.select(*keys, F.col("ord").alias("_o"), F.col("title").alias("_t"), F.col("path").alias("_p"))
    line = lambda kind: F.concat(F.lit(f"* {kind}: ["), F.col("_t"), F.lit("]("), M.relative_link(F.col("path"), F.col("_p")), F.lit(")"))

    def linked(rows, at, kind, rank, order):
        near = rows.filter(F.col(at).isNotNull()).withColumnRenamed(at, "_o").join(known, [*keys, "_o"])
        return near.select(*keys, "ord", F.struct(F.lit(rank).alias("r"), F.col(order).cast("bigint").alias("i"), line(kind).alias("l")).alias("_link"))

    base = narrow.select(*keys, "ord", "path", "parent", "prev_sibling", "next_sibling")
    children = narrow.filter("parent is not null").select(*keys, F.col("parent").alias("ord"), F.col("ord").alias("_o")).join(base.select(*keys, "ord", "path"), [*keys, "ord"]).withColumn("_c", F.col("_o"))
    said = nodes.select(*keys, "ord", "path", F.posexplode(T.section_references(F.col("text"))).alias("_pos", "section_number"))
    last = nodes.filter("section_number is not null").groupBy(*keys, "section_number").agg(F.max("ord").alias("_o"))
    named = top_k(said.join(last, [*keys, "section_number"]).filter("ord <> _o"), [*keys, "ord"], ["_pos"], most, "_r")
    links = (
        linked(base.select(*keys, "ord", "path", "parent"), "parent", "Parent topic", 0, "ord")
        .unionByName(linked(base.select(*keys, "ord", "path", "prev_sibling"), "prev_sibling", "Previous topic", 1, "ord"))
        .unionByName(linked(base.select(*keys, "ord", "path", "next_sibling"), "next_sibling", "Next topic", 2, "ord"))
        .unionByName(linked(children.select(*keys, "ord", "path", "_o").withColumnRenamed("_o", "_child").withColumn("_c", F.col("_child")), "_child", "Child topic", 3, "_c"))
        .unionByName(linked(named.select(*keys, "ord", "path", F.col("_o").alias("_to"), "_pos"), "_to", "Referenced section", 4, "_pos"))
    )
    lists = links.groupBy(*keys, "ord").agg(F.array_join(F.sort_array(F.collect_list("_link"))["l"], "\n").alias("_links"))
    n_pages, pages = F.size("pages"), F.array_join(F.col("pages").cast("array<string>"), ",")
    span = F.when(n_pages == 0, "no extracted pages").when(n_pages == 1, F.concat(F.lit("page "), F.get("pages", F.lit(0)).cast("string"))).otherwise(
        F.concat(F.lit("pages "), F.get("pages", F.lit(0)).cast("string"), F.lit("-"), F.element_at("pages", -1).cast("string"))
    )
    low, sha = F.lower("_corpus"), json.dumps(source_sha)[1:-1]
    fields = {
        "type": F.lit("Document Section"), "title": M.json_text(F.col("title")), "resource": M.json_text(F.concat(F.lit(f"urn:sha256:{sha}#section="), F.col("slug"))),
        "tags": F.concat(F.lit('["document-section", "corpus-'), low, F.lit('", "level-'), F.col("level").cast("string"), F.lit('"]')), "status": F.lit("stable"),
        "sources": F.concat(F.lit('[{"id": "source-pdf", "resource": '), M.json_text(F.concat(F.lit(f"urn:sha256:{sha}#pages="), pages)), F.lit(', "title": '), M.json_text(F.col("_document")), F.lit("}]")),
        "corpus": M.json_text(F.col("_corpus")), "corpus_version": F.lit(json.dumps(version)),
        "source_chunk_id": M.json_text(F.concat(F.col("_corpus"), F.lit("-TOPIC-"), F.lpad(F.col("ord").cast("string"), F.greatest(F.lit(5), F.length(F.col("ord").cast("string"))), F.lit("0")))),
        "slug": M.json_text(F.col("slug")), "outline_level": F.col("level").cast("string"), "outline_order": F.col("ord").cast("string"),
        "section_number": M.json_text(F.col("section_number")), "section_path": F.to_json("titles"),
        "page_number": F.get("pages", F.lit(0)).cast("string"), "page_numbers": F.to_json("pages"), "document_name": M.json_text(F.col("_document")),
        "source_sha256": F.lit(json.dumps(source_sha)), "content_sha256": M.json_text(F.sha2("text", 256)), "child_count": F.col("child_count").cast("string"),
    }
    relations = F.when(F.col("_links").isNotNull(), F.concat(F.lit("## Relationships\n\n"), F.col("_links"), F.lit("\n\n"))).otherwise(F.lit(""))
    content = F.concat(
        M.frontmatter(fields), F.lit("\n# "), F.col("title"), F.lit(f"\n\n## Evidence\n\n{M.EVIDENCE_START}\n"), F.col("text"), F.lit(f"\n{M.EVIDENCE_END}\n\n"), relations,
        F.lit("## Provenance\n\nExtracted from **"), F.col("_document"), F.lit("**, "), span, F.lit(".[^source-pdf]\n\n[^source-pdf]: "), F.col("_document"), F.lit(", "), span, F.lit(".\n"),
    )
    return nodes.join(lists, [*keys, "ord"], "left").select(*keys, "ord", "path", content.alias("content"))


def topic_indexes(nodes: DataFrame, keys, title: Column, format_version: str) -> DataFrame:
    """(keys, path, content): the listing of each folder, from `topics`.

    A listing holds its folder's children in order, with the number of their sub-topics or else their first page; the
    root's begins with the version of the format, which a reader checks.
    """
    keys = list(keys)
    detail = F.when(F.col("child_count") > 0, F.concat(F.lit(" - "), F.col("child_count").cast("string"), F.lit(" sub-topics"))).when(
        F.size("pages") > 0, F.concat(F.lit(" - page "), F.get("pages", F.lit(0)).cast("string"))
    ).otherwise(F.lit(""))
    line = F.concat(F.lit("* ["), F.col("title"), F.lit("]("), F.substring_index("path", "/", -1), F.lit(")"), detail)
    rows = nodes.select(*keys, "parent", F.struct("ord", line.alias("l")).alias("e"))
    lists = rows.groupBy(*keys, "parent").agg(F.concat(F.array_join(F.sort_array(F.collect_list("e"))["l"], "\n"), F.lit("\n")).alias("_lines"))
    above = nodes.select(*keys, F.col("ord").alias("parent"), "title", "path")
    inner = lists.filter("parent is not null").join(above, [*keys, "parent"]).select(
        *keys, F.concat(M.concept_id(F.col("path")), F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("_lines")).alias("content")
    )
    head = F.concat(M.frontmatter({"format_version": F.lit(json.dumps(format_version)), "type": F.lit("Index"), "title": M.json_text(title)}), F.lit("\n# "), title, F.lit("\n\n"))
    root = lists.filter("parent is null").select(*keys, F.lit("concepts/index.md").alias("path"), F.concat(head, F.col("_lines")).alias("content"))
    return root.unionByName(inner)


def version_violations(indexes: DataFrame, keys, format_version: str) -> DataFrame:
    """(keys, found) of root listings whose format version is not the one a reader knows; null where none is told."""
    told = F.get_json_object(F.regexp_replace(F.regexp_extract(M.split_frontmatter(F.col("content")), r"(?m)^format_version: *(.*)$", 1), r"^(.*)$", r'{"v": $1}'), "$.v")
    return indexes.filter(F.col("path") == "concepts/index.md").select(*keys, told.alias("found")).filter(~F.col("found").eqNullSafe(F.lit(format_version)))
