"""Structured Streaming jobs that take what has arrived, write finished results and stop.

Checkpoint and sink lie in the shared folder, so a job that is started again goes on where it stopped.
Windows are written once the watermark, the latest time less ``late``, has passed their end: the windows
that are still open stay in the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import work_path
from tracewell.sources import transcripts as T

LATE = "10 minutes"


def arriving(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Stream over the Parquet files of a folder whose names fit ``pattern``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_available(out: DataFrame, name: str, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Runs ``out`` over all input that is there into a Parquet sink (exactly once) and reads the sink."""
    spark = out.sparkSession
    sink = sink or work_path(spark, f"{name}-sink")
    job = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint or work_path(spark, f"{name}-state"))
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def windowed(stream: DataFrame, ts: str, window: Column, keys: list[str], *aggs: Column, late: str = LATE) -> DataFrame:
    """Aggregates per window (tumbling, sliding or session) and key, with its bounds."""
    grouped = stream.withWatermark(ts, late).groupBy(window.alias("__w"), *keys).agg(*aggs)
    return grouped.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in grouped.columns if c != "__w"])


def first_arrivals(stream: DataFrame, ts: str, keys: list[str], late: str = LATE) -> DataFrame:
    """One row per key among those that arrive within ``late`` of each other: the state forgets older keys."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ingest_transcripts(spark: SparkSession, landing: str, checkpoint: str, sink: str, pattern: str = "*.jsonl", session: str = T.SESSION_FILE, subagent: str = T.SUBAGENT_FILE) -> DataFrame:
    """Takes the transcript files that are new in ``landing`` and returns all entries taken so far.

    Files land whole and do not change, as chunks of a log that is cut when it is flushed; the checkpoint
    knows which were read, so that a call after a restart reads only what came since.  Entries lie below
    ``sink``/entries and lines that are none below ``sink``/rejected, both written exactly once: a batch that
    is repeated after a failure writes its own folder anew.
    """
    lines = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(landing)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"))

    def take(batch: DataFrame, batch_id: int) -> None:
        parsed = T.parse_lines(batch, session, subagent)
        T.entries(parsed).write.mode("overwrite").parquet(f"{sink}/entries/batch={batch_id}")
        T.rejected(parsed).write.mode("overwrite").parquet(f"{sink}/rejected/batch={batch_id}")

    job = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/entries")


def enriched(stream: DataFrame, catalog: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Stream-static join: the columns of ``catalog`` (unique by ``key``) for every row of ``stream``; a key that
    the catalog lacks takes ``defaults`` (an expression over the row), so no row goes."""
    values = [c for c in catalog.columns if c != key]
    joined = stream.join(catalog.select(key, *[F.col(c).alias(f"__{c}") for c in values]), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), defaults[c]) for c in values}).drop(*[f"__{c}" for c in values])


def split_late(stream: DataFrame, ts: str, checkpoint: str, sink: str, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows behind the watermark, both kept: (on_time, late) of all runs so far.

    The watermark of a batch is the latest time of the batches before it, less ``late``.  Each batch writes
    its latest time beside its rows, in folders of its own number, so repeating a batch changes nothing.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        marks = spark.read.schema("batch long, latest timestamp").parquet(f"{sink}/marks") if batch_id else None
        mark = marks.where(F.col("batch") < batch_id).agg(F.max("latest") - F.expr(f"INTERVAL {late}")).first()[0] if batch_id else None
        behind = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        batch.withColumn("late", behind).write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{sink}/marks/batch={batch_id}")

    job = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    job.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{sink}/rows")
    return rows.where("NOT late").drop("late", "batch"), rows.where("late").drop("late", "batch")
