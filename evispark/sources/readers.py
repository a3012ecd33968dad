"""Sources: JSONL, manifests, Markdown trees, CSV questions, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark import schemas
from evispark.errors import SourceValidationError
from evispark.functions import markdown as M
from evispark.functions.jsonx import single_object
from evispark.functions import text as T
from evispark.operators.experiment import duplicate_keys, require_empty
from evispark.operators.ranking import dense_index

def _folder():
    return F.regexp_extract(F.col("_file"), r"^(.*)/[^/]*$", 1)



def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, line_no, source_order, line): non-blank lines, numbered from 0 with (line_no) and without blank ones.

    Lines are numbered inside each input split and shifted by the sizes of the
    splits before it, so a huge file is never sorted or read by one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"),
    )
    numbered = dense_index(raw, F.col("_start"), ["_at"], "line_no", ["_file"]).filter(F.trim("line") != "")
    return dense_index(numbered, F.col("_start"), ["_at"], "source_order", ["_file"]).drop("_start", "_at")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; malformed lines raise with file and position."""
    parsed = read_lines(spark, path).withColumn("_v", single_object(F.col("line")))
    require_empty(
        parsed.filter("_v is null").select("_file", "line_no"), SourceValidationError, "malformed JSON line"
    )
    return parsed.select("source_order", F.from_json("line", schemas.struct(schema)).alias("r")).select("source_order", "r.*")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row a corpus folder holding both manifest.json and chunks.jsonl."""
    m = spark.read.schema(schemas.struct(schemas.MANIFEST)).option("multiLine", True).json(f"{root}/*/manifest.json")
    m = m.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("folder", _folder()).drop("_file")
    c = spark.read.text(f"{root}/*/chunks.jsonl").select(F.col("_metadata.file_path").alias("_file"))
    return m.join(c.select(_folder().alias("folder")).distinct(), "folder", "left_semi")


def manifest_violations(manifests: DataFrame) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [F.when(blank(c), F.lit(f"{c}_missing")) for c in ("corpus", "corpus_version", "source_pdf")]
    rules.append(F.when(~F.coalesce(F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), F.lit("source_sha256")))
    rules.append(F.when(~F.coalesce(F.col("n_chunks") >= 0, F.lit(False)), F.lit("n_chunks")))
    return manifests.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("folder").alias("key"))


def read_chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    """Raw chunk lines with folder and position, plus the parsed VARIANT."""
    return (
        read_lines(spark, f"{root}/*/chunks.jsonl").withColumn("folder", _folder())
        .withColumn("v", single_object(F.col("line"))).drop("_file")
    )


def chunk_violations(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """(rule, key) of every breach of the chunk contract.

    Types are read from the VARIANT, so true is no page number and "3" no int.
    """
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    words = lambda p: F.coalesce(kind(p) == "STRING", F.lit(False)) & (F.trim(F.try_variant_get("v", p, "string")) != "")
    absent = lambda p: kind(p).isNull() | (kind(p) == "VOID")
    page = absent("$.page_number") | ((kind("$.page_number") == "BIGINT") & (F.try_variant_get("v", "$.page_number", "bigint") >= 1))
    pages_kind = kind("$.metadata.pages")
    numbers = F.try_variant_get("v", "$.metadata.pages", "array<bigint>")
    pages = absent("$.metadata.pages") | (pages_kind == "ARRAY<VOID>") | ((pages_kind == "ARRAY<BIGINT>") & F.forall(numbers, lambda p: p >= 1))
    text = F.try_variant_get("v", "$.text", "string")
    keys = F.json_object_keys("line")
    no = lambda ok, rule: F.when(F.col("v").isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(rule))
    rules = [
        F.when(F.col("v").isNull() | keys.isNull(), F.lit("invalid_json")),
        F.when(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in schemas.FORBIDDEN_FIELDS])), F.lit("forbidden_field")),
        *[no(words(f"$.{c}"), f"{c}_missing") for c in ("chunk_id", "corpus", "text")],
        no(page, "page_number"), no(pages, "metadata_pages"),
        F.when(F.contains(text, F.lit(M.EVIDENCE_START)) | F.contains(text, F.lit(M.EVIDENCE_END)), F.lit("reserved_marker")),
    ]
    at = F.concat_ws(":", "folder", F.col("source_order").cast("string"))
    rows = lines.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), at.alias("key"))
    ids = lines.select(
        "folder", F.try_variant_get("v", "$.corpus", "string").alias("corpus"), F.try_variant_get("v", "$.chunk_id", "string").alias("chunk_id")
    )
    twice = duplicate_keys(ids.filter("chunk_id is not null"), ["corpus", "chunk_id"]).select(
        F.lit("duplicate_chunk_id").alias("rule"), F.concat_ws("/", "corpus", "chunk_id").alias("key")
    )
    m = manifests.select("folder", F.col("corpus").alias("_corpus"), "n_chunks")
    foreign = ids.join(m, "folder").filter("corpus <> _corpus").select(
        F.lit("foreign_corpus").alias("rule"), F.concat_ws("/", "folder", "chunk_id").alias("key")
    )
    sizes = ids.groupBy("folder").agg(F.count(F.lit(1)).alias("_n"))
    count = m.join(sizes, "folder", "left").filter("coalesce(_n, 0) <> n_chunks").select(
        F.lit("n_chunks_mismatch").alias("rule"), F.col("folder").alias("key")
    )
    return rows.unionByName(twice).unionByName(foreign).unionByName(count)


def load_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Validated chunks of every corpus below ``root``; fails closed."""
    manifests = read_manifests(spark, root)
    require_empty(manifest_violations(manifests), SourceValidationError, "manifest")
    lines = read_chunk_lines(spark, root)
    require_empty(chunk_violations(lines, manifests), SourceValidationError, "chunks")
    rows = lines.select("folder", "source_order", F.from_json("line", schemas.struct(schemas.CHUNK)).alias("c"))
    m = manifests.select("folder", "corpus_version", "source_pdf", "source_sha256")
    return rows.select("folder", "source_order", "c.*").join(m, "folder").withColumn(
        "document_name", F.coalesce("document_name", "source_pdf")
    )


def read_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, sha256) of every .md file, paths relative to the root."""
    f = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    )
    base = root.rstrip("/")
    rel = F.substring(F.col("path"), F.locate(base + "/", F.col("path")) + len(base) + 1, 1 << 20)
    return f.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), "length")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of one JSON document, one row each."""
    b = spark.read.schema(schemas.struct(schemas.BENCHMARK)).option("multiLine", True).json(path)
    return b.select("benchmark_id", "counts", F.explode("questions").alias("q")).select("benchmark_id", "counts", "q.*")


def read_question_csv(spark: SparkSession, path: str, corpora: dict[str, list[str]]) -> DataFrame:
    """CSV questions with parsed flags and the corpora of their utility token."""
    q = spark.read.schema(schemas.struct(schemas.QUESTION_CSV)).option("header", True).csv(path)
    table = F.lit(None).cast("array<string>")
    for name, tenants in corpora.items():
        table = F.when(F.col("utility") == name, F.array(*[F.lit(t) for t in tenants])).otherwise(table)
    out = q.withColumn("corpora", table)
    require_empty(out.filter("corpora is null").select("qid", "utility"), SourceValidationError, "unknown utility")
    for c in ("is_negative", "is_table", "is_image"):
        out = out.withColumn(c, F.coalesce(T.to_bool(F.col(c)), F.lit(False)))
    return out.withColumn("primary_corpus", F.get("corpora", F.lit(0))).withColumn("is_cross_utility", F.size("corpora") > 1)


def read_table(spark: SparkSession, path: str, keys=()) -> DataFrame:
    """Parquet stand-in for a database scan, ordered when keys are given."""
    df = spark.read.parquet(path)
    return df.orderBy(*keys) if keys else df


def reusable(cached: DataFrame, model: str, corpus_digest: str) -> bool:
    """Whether stored vectors belong to this model and exactly this corpus."""
    other = cached.filter((F.col("model_id") != model) | (F.col("corpus_digest") != corpus_digest))
    return not cached.isEmpty() and other.isEmpty()
