"""The append log as a stream: idempotent ingest with a dead-letter side log.

The batch form is ``experiment.remaining``; this one keeps ingesting files as
runners drop them. It is an addition on top of the batch behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispark import schemas
from evispark.operators import experiment
from evispark.sources.sinks import exists


def ingest_log(spark: SparkSession, inbox: str, schema: str, keys, store: str, dead_letters: str, checkpoint: str):
    """Start the query; rows with an error go to the side log, others are
    appended once for each key. A replayed micro-batch appends nothing new."""
    rows = spark.readStream.schema(schemas.struct(schema)).json(inbox)

    def write(batch, _):
        failed = F.col("error").isNotNull()
        batch.filter(failed).write.mode("append").json(dead_letters)
        good = batch.filter(~failed).dropDuplicates(list(keys))
        if exists(batch.sparkSession, store):
            good = experiment.remaining(good, batch.sparkSession.read.parquet(store), keys)
        good.write.mode("append").parquet(store)

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def first_of_each(rows: DataFrame, keys, event_time: str, look_back: str) -> DataFrame:
    """The first row of each key within ``look_back`` of event time.

    The state holds the keys of the look-back and no more: a key is forgotten once the watermark has passed its row's
    time by that much, so the store is never read again. A row that is older than the watermark is late and goes.
    """
    return rows.withWatermark(event_time, look_back).dropDuplicatesWithinWatermark(list(keys))


def ingest_stream(
    spark: SparkSession, inbox: str, schema: str, keys, store: str, dead_letters: str, checkpoint: str,
    event_time: str = "recorded_at", look_back: str = "7 days",
) -> tuple[StreamingQuery, StreamingQuery]:
    """`ingest_log` with bounded look-back in place of reading the whole store for every batch.

    ``event_time`` is a timestamp column of ``schema``; a runner that is started anew repeats rows of the last
    ``look_back`` at most. Both sinks are files that Spark commits by batch, so a batch that is replayed after a failure
    writes nothing twice. Returns the queries of the store and of the side log.
    """
    rows = spark.readStream.schema(schemas.struct(schema)).json(inbox)
    failed = F.col("error").isNotNull()
    good = first_of_each(rows.filter(~failed), keys, event_time, look_back)

    def start(df, kind, path, name):
        to = df.writeStream.format(kind).option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        return to.trigger(availableNow=True).start()

    return start(good, "parquet", store, "store"), start(rows.filter(failed), "json", dead_letters, "dead")
