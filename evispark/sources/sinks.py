"""Sinks: append logs, upserts, exports, bundle folders."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from evispark.errors import BundleFormatError, EvidenceError
from evispark.operators import experiment

MARKER = "bundle_manifest.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def append_rows(rows: DataFrame, path: str, keys) -> None:
    """Append what the log does not hold yet; running it twice adds nothing."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = experiment.remaining(rows, spark.read.schema(rows.schema).json(path), keys)
    rows.write.mode("append").json(path)


def upsert(rows: DataFrame, path: str, keys, sequence: str) -> None:
    """INSERT OR REPLACE: newest row of every key, written beside and swapped in."""
    spark = rows.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else None
    merged = rows if old is None else old.unionByName(rows)
    staged = path.rstrip("/") + "__staged"
    experiment.latest(merged, keys, sequence).write.mode("overwrite").parquet(staged)
    install(spark, staged, path, overwrite=True)


def install(spark: SparkSession, staged: str, target: str, overwrite: bool = False) -> None:
    """Move a finished folder into place; the old one survives until then."""
    fs, s = _fs(spark, staged)
    _, t = _fs(spark, target)
    _, b = _fs(spark, target.rstrip("/") + "__previous")
    had = fs.exists(t)
    if had and not overwrite:
        raise EvidenceError(f"{target} exists")
    if had:
        fs.delete(b, True)
        fs.rename(t, b)
    if not fs.rename(s, t):
        if had:
            fs.rename(b, t)
        raise EvidenceError(f"could not install {target}")
    if had:
        fs.delete(b, True)


def export_jsonl(answers: DataFrame, judged: DataFrame, keys, path: str) -> None:
    """Answers with their judge row, one JSON object a line."""
    experiment.joined_export(answers, judged, keys).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nothing is written for an empty result."""
    if not rows.isEmpty():
        rows.write.mode("overwrite").option("header", True).csv(path)


def _sorted(value: Column, kind) -> Column:
    """``value`` with the fields of every struct, and the keys of every map, in sorted order."""
    if isinstance(kind, StructType):
        fields = [_sorted(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    return value


def canonical_json(row_columns, schema: StructType | None = None) -> Column:
    """JSON with its keys in sorted order, for hashing; with the table's ``schema`` at every depth, and nulls written out."""
    names = sorted(row_columns)
    if schema is None:
        return F.to_json(F.struct(*[F.col(c) for c in names]))
    return F.to_json(F.struct(*[_sorted(F.col(f"`{c}`"), schema[c].dataType).alias(c) for c in names]), {"ignoreNullFields": "false"})


def _place(path: str) -> tuple[str, str, str]:
    """(scheme, authority, normalised path); a path without a scheme is a local file."""
    scheme, mark, rest = path.partition(":")
    if not mark or len(scheme) < 2 or "/" in scheme:
        return "file", "", os.path.abspath(path)
    authority = ""
    if rest.startswith("//"):
        authority, _, rest = rest[2:].partition("/")
    return scheme.lower(), authority, os.path.normpath("/" + rest.lstrip("/"))


def check_target(target: str, sources=(), overwrite: bool = False, has_marker: bool = False, present: bool = False) -> None:
    """Refuse to write over a root, the home folder, a source, or foreign data; paths may be URIs of any store."""
    t = _place(target)
    if t[2] == "/" or t == ("file", "", os.path.expanduser("~")):
        raise EvidenceError(f"refusing to write to {target}")
    for source in sources:
        s = _place(source)
        if t[:2] == s[:2] and (t[2] == s[2] or s[2].startswith(t[2] + "/") or t[2].startswith(s[2].rstrip("/") + "/")):
            raise EvidenceError(f"{target} overlaps the source {source}")
    if present and not overwrite:
        raise EvidenceError(f"{target} exists")
    if present and not has_marker:
        raise EvidenceError(f"{target} holds no {MARKER}; not a bundle")


def write_concept_table(concepts: DataFrame, path: str) -> None:
    """Concepts as Parquet (tenant, path, content): the form for large bundles."""
    concepts.write.mode("overwrite").partitionBy("tenant").parquet(path)


def write_markdown_tree(concepts: DataFrame, root: str) -> None:
    """One file a concept in a folder all executors reach.

    Each file is written under a temporary name and renamed, so a task that is
    lost and run again leaves the same bytes.
    """

    def write(rows):
        for r in rows:
            path = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="\n") as f:
                f.write(r["content"])
            os.replace(part, path)

    concepts.select("path", "content").foreachPartition(write)


def verify_tree(inventory: DataFrame, files: DataFrame) -> None:
    """Every file present with the recorded digest, and no other."""
    experiment.require_empty(
        experiment.inventory_mismatch(inventory, files), BundleFormatError, "bundle integrity"
    )
