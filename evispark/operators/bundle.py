"""Concept bundles: produce, parse, link, verify."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions import markdown as M
from evispark.functions import text as T


def concept_documents(linked: DataFrame, source_sha: str, version: str, generated_at: str | None = None) -> DataFrame:
    """(tenant, doc_id, path, concept_id, content, content_sha) one row a passage.

    ``linked`` has tenant, doc_id, chunk_id, document, section, pages, text,
    prev_id, next_id, prev_chunk and next_chunk. Everything is one projection:
    writing a bundle is as parallel as reading its passages.
    """
    tenant_slug = T.slug(F.col("tenant"))
    where = lambda c: F.concat(F.lit("concepts/"), tenant_slug, F.lit("/"), T.slug(F.col(c)), F.lit(".md"))
    label = T.page_label(F.col("pages"))
    pages_json = F.to_json(F.col("pages"))
    sha = F.lit(source_sha)
    fields = {
        "type": F.lit("Source Passage"),
        "title": M.json_text(T.passage_title(F.col("chunk_id"), F.col("section"), F.col("pages"))),
        "description": M.json_text(T.passage_description(F.col("chunk_id"), F.col("document"), F.col("pages"))),
        "resource": M.json_text(T.chunk_urn(sha, F.col("chunk_id"))),
        "tags": F.concat(F.lit('["source-passage", "corpus-'), tenant_slug, F.lit('"]')),
        "status": F.lit("stable"),
    }
    if generated_at is not None:
        fields["generated"] = F.lit(json.dumps({"by": "process:evispark-bundle", "at": generated_at}))
    fields |= {
        "sources": F.concat(
            F.lit('[{"id": "source-pdf", "resource": '), M.json_text(T.pages_urn(sha, F.col("pages"))),
            F.lit(', "title": '), M.json_text(F.col("document")), F.lit("}]"),
        ),
        "corpus": M.json_text(F.col("tenant")),
        "corpus_version": F.lit(json.dumps(version)),
        "source_chunk_id": M.json_text(F.col("chunk_id")),
        "source_order": F.col("doc_id").cast("string"),
        "page_numbers": pages_json,
        "section": M.json_text(F.col("section")),
        "document_name": M.json_text(F.col("document")),
        "source_sha256": F.lit(json.dumps(source_sha)),
        "content_sha256": M.json_text(F.sha2("text", 256)),
    }
    link = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("/"), where(c)))
    body = M.concept_body(
        F.col("text"), F.col("document"), label,
        [("Previous passage", link("prev_chunk")), ("Next passage", link("next_chunk"))],
    )
    return linked.select(
        "tenant", "doc_id", where("chunk_id").alias("path"), F.concat(M.frontmatter(fields), body).alias("content"),
        F.sha2("text", 256).alias("content_sha"),
    ).withColumn("concept_id", M.concept_id(F.col("path")))


def parse_concepts(files: DataFrame) -> DataFrame:
    """(path, concept_id, frontmatter, body, evidence, targets) from (path, content)."""
    body = M.body_of(F.col("content"))
    return files.filter(~F.substring_index("path", "/", -1).isin(*M.RESERVED)).select(
        "path", M.concept_id(F.col("path")).alias("concept_id"),
        M.split_frontmatter(F.col("content")).alias("frontmatter"), body.alias("body"),
    ).withColumn("evidence", M.evidence(F.col("body"))).withColumn("targets", M.link_targets(F.col("body")))


def yaml_to_json(frontmatter: DataFrame, column: str = "frontmatter") -> DataFrame:
    """Adds fm_json: the YAML front matter as canonical JSON, NULL if malformed."""
    import yaml

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                v = yaml.safe_load(t)
            except yaml.YAMLError:
                return None
            return json.dumps(v, sort_keys=True, default=str, ensure_ascii=False) if isinstance(v, dict) else None

        return s.map(one)

    return frontmatter.withColumn("fm_json", convert(column))


def concept_links(parsed: DataFrame) -> DataFrame:
    """(src, dst, pos): links between existing concepts, first mention kept.

    Unresolved, dangling and self links drop out of one join on the path.
    """
    named = parsed.select("path", "concept_id", F.posexplode("targets").alias("pos", "target"))
    named = named.withColumn("to", M.resolve_link(F.col("path"), F.col("target"))).filter("to is not null")
    known = parsed.select(F.col("path").alias("to"), F.col("concept_id").alias("dst"))
    return (
        named.join(known, "to").filter("concept_id <> dst")
        .groupBy(F.col("concept_id").alias("src"), "dst").agg(F.min("pos").alias("pos"))
    )


def missing_type(parsed_json: DataFrame) -> DataFrame:
    """Concepts whose front matter is malformed or lacks the mandatory type."""
    kind = F.get_json_object("fm_json", "$.type")
    return parsed_json.filter(kind.isNull() | (F.trim(kind) == "")).select("path")


def directory_index(children: DataFrame) -> DataFrame:
    """(folder, content): the listing of every folder of a topic tree.

    ``children`` has folder, ord, line. A folder is split into blocks of 1,000
    entries, which keeps each written row bounded.
    """
    blocks = children.withColumn("block", F.floor(F.col("ord") / 1000)).groupBy("folder", "block").agg(
        F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("_l")
    )
    return blocks.select("folder", "block", F.array_join("_l.line", "\n").alias("content"))
