"""Session defaults and the size checks that gate physical choices."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.errors import EvidenceError

# A side is broadcast only when the bytes behind it are at most this.
BROADCAST_BYTES = 8 << 20
# Rows of a task where texts are cut into words; a scan split of usual texts has fewer than SPLIT_ROWS.
SPREAD_ROWS, SPLIT_ROWS = 8192, 1 << 16


def local_session(app: str = "evispark", cpus: str | int = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # folders go with the last reader
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for file scans the bytes on disk."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def scan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of the inputs behind a plan, whatever joins and projections make of them; None where one has no figure."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    sizes = [int(str(x.stats().sizeInBytes())) for x in leaves]
    return None if max(sizes, default=0) >= 1 << 50 or any(x.nodeName() == "LogicalRDD" for x in leaves) else sum(sizes)


def parts_for(df: DataFrame, part_bytes: int, part_rows: int) -> int | None:
    """Partitions of at most ``part_rows`` rows of ``df`` and ``part_bytes`` of the input behind it, one a core at least; None where one will do.

    AQE joins partitions by the bytes that were shuffled, which says nothing of
    steps that make many rows of one, so these count their own. Files say little
    too where a few bytes of a dictionary stand for many long texts, so the rows
    are counted, which reads no text.
    """
    n = max(-(-(scan_bytes(df) or 0) // part_bytes), -(-df.count() // part_rows))
    return max(n, df.sparkSession.sparkContext.defaultParallelism) if n > 1 else None


def fits_broadcast(source: DataFrame, growth: float = 1.0) -> bool:
    """Whether data derived from ``source`` stays below the broadcast bound.

    ``growth`` is how many times larger the derived side can get, e.g. k result
    rows for each question. Sources without statistics report a huge size and
    therefore take the shuffle path.
    """
    return plan_bytes(source) * growth <= BROADCAST_BYTES


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Hint the checked side; otherwise leave the strategy to AQE."""
    return F.broadcast(df) if small else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fan out an input that few tasks would read.

    A file with one row group is scanned by one task. Below one scan split of
    data that costs all parallelism, so such inputs are redistributed first,
    at most SPREAD_ROWS rows a task: a small file can stand for many long
    texts. Larger inputs come in many splits and are left alone, unless a row
    group leaves more than SPLIT_ROWS rows in one of them.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
    total, most = rows[0] or 0, rows[1] or 0
    if plan_bytes(df) >= split and most <= SPLIT_ROWS:
        return df
    n = max(spark.sparkContext.defaultParallelism, -(-total // SPREAD_ROWS))
    return df.repartition(n, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not sc.master.startswith("local"):
            raise EvidenceError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="evispark-ckpt-")
    sc.setCheckpointDir(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so lost executors cost no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
