"""Relevance feedback as a Structured Streaming job.

feedback files --readStream--> copies of an event dropped by its ``event_id`` (keyed state, looked up
   only for the ids of the batch) --foreachBatch--> partial rollup in ``<out>/batch=<id>`` (overwrite:
   a retried batch replaces its own output)
   --every ``COMPACT`` batches--> the partials and the last generation folded into ``<out>/gen<id>``,
   which is renamed into place when it is complete; readers take the largest generation and the partials
   after it, so they read at most ``COMPACT`` partials however long the stream has run
results table = the stored table with that rollup folded in by the batch twin's keyed merge.
   Equal to ``feedback.feedback_upsert`` over the events without their copies.

There is no watermark: a click counts however late it is delivered, and a second copy is recognised
however late.  The state of the ids is in RocksDB, with its changes alone written per batch.  An event
without ``event_id`` cannot be told from a copy of it and counts each time it is delivered.  State
and output live below the shared checkpoint folder (``spark.checkpoint.dir``).

A crash loses and doubles nothing: a generation that was not finished has no number, one that was
stands for the partials up to its batch, whether or not those are still there.  They are deleted one generation
later, so a reader that began before the switch finds its files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.operators.feedback import apply_rollup, valid_feedback
from hitweave.session import STATE_CONF, conf
from hitweave.sources import versions

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("query", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("ml_rank", T.DoubleType()),
    T.StructField("rag_summary", T.StringType()),
    T.StructField("rank", T.IntegerType()),
])
COMPACT = 16  # partials from which a generation is made
GENERATION = "gen"


def partial_rollup(events: DataFrame) -> DataFrame:
    """Per (query, link) of one micro-batch: what the final rollup needs, with the
    (ts, event_id) order keys kept so partials can be combined later."""
    v = valid_feedback(events)
    order = F.struct("ts", "event_id")
    return v.groupBy("query", "link").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(order).alias("latest_key"),
        F.max_by(F.struct("title", "snippet", "ml_rank", "rag_summary"), order).alias("latest"),
        F.min(order).alias("first_key"),
        F.min_by(F.col("rank"), order).alias("first_rank"),
    )


def combine_partials(partials: DataFrame) -> DataFrame:
    """Partials of several micro-batches as one partial."""
    return partials.groupBy("query", "link").agg(
        F.sum("clicks").alias("clicks"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("latest_key").alias("latest_key"),
        F.max_by("latest", "latest_key").alias("latest"),
        F.min("first_key").alias("first_key"),
        F.min_by("first_rank", "first_key").alias("first_rank"),
    )


def first_deliveries(events: DataFrame) -> DataFrame:
    """The events of a stream without copies of those delivered before."""
    known = events.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return known.unionByName(events.filter(F.col("event_id").isNull()))


def start_feedback_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                          files_per_batch: int | None = 1, available_now: bool = True, compact: int = COMPACT):
    """Start the stream; returns the ``StreamingQuery``."""
    out_dir = out_dir.rstrip("/")
    stream = (spark.readStream.schema(FEEDBACK_SCHEMA)
              .option("maxFilesPerTrigger", files_per_batch or 1000)
              .parquet(source_dir))

    def fold(batch: DataFrame, batch_id: int) -> None:
        partial_rollup(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        if len(_partials(batch.sparkSession, out_dir)) >= compact:
            compact_rollup(batch.sparkSession, out_dir)

    w = first_deliveries(stream).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with conf(spark, STATE_CONF):  # a query keeps the conf it started with
        return w.start()


def _generation(spark: SparkSession, out_dir: str) -> int:
    """The batch up to which the latest generation goes, -1 without one."""
    return max(versions.versions(spark, out_dir, GENERATION), default=-1)


def _batches(spark: SparkSession, out_dir: str) -> list[int]:
    files, path = versions.files_at(spark, out_dir)
    if not files.exists(path):
        return []
    named = (re.fullmatch(r"batch=(\d+)", s.getPath().getName()) for s in files.listStatus(path))
    return sorted(int(m[1]) for m in named if m)


def _partials(spark: SparkSession, out_dir: str) -> list[int]:
    """The finished partials after the latest generation."""
    since = _generation(spark, out_dir)
    return [b for b in _batches(spark, out_dir) if b > since and _finished(spark, f"{out_dir}/batch={b}")]


def _finished(spark: SparkSession, folder: str) -> bool:
    files, path = versions.files_at(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def _parts(spark: SparkSession, out_dir: str) -> list[str]:
    """Folders that together are the rollup."""
    since = _generation(spark, out_dir)
    return [f"{out_dir}/{GENERATION}{since}"] * (since >= 0) + [f"{out_dir}/batch={b}" for b in _partials(spark, out_dir)]


def compact_rollup(spark: SparkSession, out_dir: str) -> int:
    """Fold the partials into a new generation, which readers take from the moment it is there; the
    batch it goes up to.  Partials that an earlier generation stands for are deleted."""
    out_dir = out_dir.rstrip("/")
    before, partials = _generation(spark, out_dir), _partials(spark, out_dir)
    if not partials:
        return before
    folder = versions.pending(out_dir)
    combine_partials(_read(spark, _parts(spark, out_dir))).write.parquet(folder)
    versions.publish(spark, folder, out_dir, partials[-1], GENERATION)  # False: another compaction made the same one
    for b in _batches(spark, out_dir):
        if b <= before:
            _delete(spark, f"{out_dir}/batch={b}")
    for g in versions.versions(spark, out_dir, GENERATION):
        if g < before:
            _delete(spark, f"{out_dir}/{GENERATION}{g}")
    return partials[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = versions.files_at(spark, folder)
    files.delete(path, True)


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    schema = partial_rollup(spark.createDataFrame([], FEEDBACK_SCHEMA)).schema
    out = None
    for f in folders:  # folder by folder: their names are no partition columns
        part = spark.read.schema(schema).parquet(f)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """The combined rollup of everything the stream has folded so far (the shape of ``feedback.feedback_rollup``)."""
    out_dir = out_dir.rstrip("/")
    return combine_partials(_read(spark, _parts(spark, out_dir))).drop("latest_key", "first_key")


def results_from_stream(spark: SparkSession, stored: DataFrame, out_dir: str) -> DataFrame:
    """The results table: stored rows with the streamed feedback folded in."""
    return apply_rollup(stored, read_rollup(spark, out_dir))
