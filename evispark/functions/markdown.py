"""Concept documents: assembling, parsing, and resolving their links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE_START = "<!-- evidence-start -->"
EVIDENCE_END = "<!-- evidence-end -->"
RESERVED = ("index.md", "log.md")


def json_text(value: Column) -> Column:
    """A JSON string literal, which is also a YAML scalar."""
    literal = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNotNull(), literal)


def frontmatter(fields: dict[str, Column]) -> Column:
    """``key: value`` lines between dashes; NULL becomes null."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("null"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def concept_body(text: Column, document: Column, label: Column, links: list[tuple[str, Column]],
                 start: str = EVIDENCE_START, end: str = EVIDENCE_END) -> Column:
    """Evidence between markers, relationships, provenance.

    One newline frames the text on each side; the reader removes exactly these.
    """
    items = F.array_compact(
        F.array(*[F.when(t.isNotNull(), F.concat(F.lit(f"* {n}: [source passage]("), t, F.lit(")"))) for n, t in links])
    )
    relations = F.when(
        F.size(items) > 0, F.concat(F.lit("\n\n## Relationships\n\n"), F.array_join(items, "\n"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"# Evidence\n\n{start}\n"), text, F.lit(f"\n{end}"), relations,
        F.lit("\n\n## Provenance\n\nExtracted from **"), document, F.lit("**, "), label,
        F.lit(".[^source-pdf]\n\n[^source-pdf]: "), document, F.lit(", "), label, F.lit(".\n"),
    )


def split_frontmatter(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def body_of(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def evidence(body: Column, start: str = EVIDENCE_START, end: str = EVIDENCE_END) -> Column:
    """Text between the markers without its framing newlines; else the trimmed body."""
    at = F.locate(start, body)
    first = at + len(start) + 1
    stop = F.locate(f"\n{end}", body, 1)
    return F.when(
        (at > 0) & (stop > 0), F.substring(body, first, stop - first)
    ).otherwise(F.trim(body))


def link_targets(body: Column) -> Column:
    """Targets of Markdown links, images left out, titles and <> removed."""
    raw = F.regexp_extract_all(body, F.lit(r"(?<!!)\[[^\]]*\]\(([^)]+)\)"), 1)
    bare = lambda t: F.when(
        F.startswith(F.trim(t), F.lit("<")), F.regexp_extract(F.trim(t), r"^<([^>]*)>", 1)
    ).otherwise(F.regexp_extract(F.trim(t), r"^(\S*)", 1))
    return F.transform(raw, bare)


def resolve_link(source: Column, target: Column) -> Column:
    """Bundle path a link points to, or NULL.

    External, empty and fragment-only targets, escapes above the root,
    reserved names and anything but .md resolve to nothing.
    """
    path = F.url_decode(F.replace(F.regexp_extract(target, r"^([^?#]*)", 1), F.lit("+"), F.lit("%2B")))
    foreign = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | F.startswith(target, F.lit("//")) | (path == "")
    folder = F.slice(F.split(source, "/"), 1, F.greatest(F.size(F.split(source, "/")) - 1, F.lit(0)))
    base = F.when(F.startswith(path, F.lit("/")), F.array().cast("array<string>")).otherwise(folder)
    parts = F.concat(base, F.split(path, "/"))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    step = lambda s, x: (
        F.when((x == "") | (x == "."), s)
        .when((x == "..") & (F.size(s["p"]) == 0), F.struct(s["p"].alias("p"), F.lit(True).alias("out")))
        .when(x == "..", F.struct(F.slice(s["p"], 1, F.size(s["p"]) - 1).alias("p"), s["out"].alias("out")))
        .otherwise(F.struct(F.concat(s["p"], F.array(x)).alias("p"), s["out"].alias("out")))
    )
    folded = F.aggregate(parts, start, step)
    clean = F.array_join(folded["p"], "/")
    name = F.element_at(folded["p"], -1)
    ok = ~foreign & ~folded["out"] & (F.size(folded["p"]) > 0) & F.endswith(clean, F.lit(".md")) & ~name.isin(*RESERVED)
    return F.when(ok, clean)


def relative_link(source: Column, target: Column) -> Column:
    """Relative path from the folder of one file to another file."""
    a, b = F.split(source, "/"), F.split(target, "/")
    a = F.slice(a, 1, F.size(a) - 1)
    shared = F.size(
        F.filter(
            F.sequence(F.lit(0), F.least(F.size(a), F.size(b) - 1)),
            lambda i: (i < F.least(F.size(a), F.size(b) - 1)) & (F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1)),
        )
    )
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.array_join(F.concat(ups, F.slice(b, shared + 1, F.size(b))), "/")


def concept_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")
