"""Snapshots behind a pointer: builds that readers see whole or not at all, and upserts that copy only what they touch.

A snapshot root holds data folders, and in ``_commits`` one small file a version, named by its number. A file that is
there is a commit: it is put by one rename to a name that none may have, so of two writers that prepared the same
version one is refused, and a reader, who takes the highest number, sees the state before or after, never a mix. Folders that no
commit names are the leavings of jobs that failed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.errors import EvidenceError
from evispark.operators import experiment
from evispark.sources.sinks import _fs

COMMITS = "_commits"


def _join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def version(spark: SparkSession, root: str) -> int:
    """Number of the last commit, 0 where there is none."""
    fs, p = _fs(spark, _join(root, COMMITS))
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def committed(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """What a commit says, by default the last; an empty dict where there is none."""
    number = version(spark, root) if number is None else number
    if number == 0:
        return {}
    fs, p = _fs(spark, _join(root, COMMITS, str(number)))
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Put version ``number``; refused if it is there already.

    The content is written under a name of its own and gets its number by one rename, which file systems that keep the
    Hadoop contract refuse where the number is taken; a half-written commit has no number.
    """
    text = json.dumps(content, sort_keys=True)
    fs, target = _fs(spark, _join(root, COMMITS, str(number)))
    _, part = _fs(spark, _join(root, COMMITS, f"part-{uuid.uuid4().hex}"))
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise EvidenceError(f"version {number} of {root} was committed by another writer")


def publish(spark: SparkSession, root: str, build: Callable[[str], None], verify: Callable[[str], None]) -> str:
    """Build into a new folder, verify it there, then point readers to it; returns the folder.

    ``build`` writes below the path it is given and ``verify`` raises if what it reads there is wrong. Until the commit,
    and for good if either fails, readers see the snapshot before.
    """
    base = version(spark, root)
    folder = _join(root, f"snapshot-{base + 1}-{uuid.uuid4().hex[:12]}")
    build(folder)
    verify(folder)
    commit(spark, root, base + 1, {"folder": folder.rsplit("/", 1)[1]})
    return folder


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the last published snapshot, None where there is none."""
    told = committed(spark, root)
    return _join(root, told["folder"]) if told else None


def bucket_of(keys, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, root: str, keys, sequence: str, buckets: int = 64) -> list[int]:
    """Replace rows by key, newest by ``sequence``, writing only the hash buckets that ``rows`` touch; returns these.

    The commit names a folder for each bucket; buckets without new rows keep theirs, files and all. The number of
    buckets is fixed by the first commit. Buckets are tasks, not files of one task, so a bucket of any size is written
    in parallel by its key. Null keys are keys like others.
    """
    spark, keys = rows.sparkSession, list(keys)
    base, told = version(spark, root), committed(spark, root)
    buckets, at = int(told.get("buckets", buckets)), dict(told.get("at", {}))
    marked = rows.withColumn("_bucket", bucket_of(keys, buckets))
    touched = sorted(r[0] for r in marked.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    old = [_join(root, at[str(b)]) for b in touched if str(b) in at]
    merged = spark.read.schema(rows.schema).parquet(*old).unionByName(rows) if old else rows
    name = f"data-{base + 1}-{uuid.uuid4().hex[:12]}"
    newest = experiment.latest(merged, keys, sequence).withColumn("_bucket", bucket_of(keys, buckets))
    newest.write.partitionBy("_bucket").parquet(_join(root, name))
    at |= {str(b): f"{name}/_bucket={b}" for b in touched}
    commit(spark, root, base + 1, {"buckets": buckets, "at": at})
    return touched


def read(spark: SparkSession, root: str, schema, number: int | None = None) -> DataFrame:
    """All rows of an upserted table at a version, by default the last."""
    at = committed(spark, root, number).get("at", {})
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_join(root, p) for p in at.values()])
