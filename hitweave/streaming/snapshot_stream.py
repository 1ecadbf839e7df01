"""Snapshots dropped by a stream of feedback, and by timers when their time is over.

Three streams meet in one keyed state: written snapshots, clicks (each reaches the four keys of its
query) and a clock.  The state of a cache key is its last click and, per kind, the present version.  A
version is dropped, once, with a reason:

    replaced  a newer version of its key and kind has been written
    feedback  a click on its query is not earlier than it
    expired   the clock has reached ``expires_at`` (a timer of the key)

The clock alone moves the watermark (clicks and snapshots have no event time of their own), so nothing that
arrives late is lost, and time passes as the clock's source says.  ``live_snapshots`` is the table without
what was dropped: what ``snapshot_invalidate`` and then ``snapshot_purge`` leave at the clock's time.
State lies below the shared checkpoint folder and the drops are a file sink, written exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hitweave.functions.timefn import TIME_FILTER_DAYS
from hitweave.session import STATE_CONF, conf

WRITE_SCHEMA = "cache_key string, kind string, version bigint, cached_at timestamp, expires_at timestamp"
CLICK_SCHEMA = "query string, ts timestamp"
CLOCK_SCHEMA = "now timestamp"
DROP_SCHEMA = "cache_key string, kind string, version bigint, cached bigint, reason string"
# The last click, and the present version of each kind as parallel arrays; times in microseconds.
STATE_SCHEMA = "click bigint, kinds array<string>, cached array<bigint>, versions array<bigint>, expires array<bigint>"
CLOCK_KEY = "\x00clock"  # the clock's rows have a key of their own


GONE = -1               # in place of ``expires``: the version has been dropped


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One cache key: what its new rows, or its timer, drop."""
    click, *lists = state.get if state.exists else (None, [], [], [], [])
    present = {kind: tuple(at) for kind, *at in zip(*lists)}  # kind -> cached_at, version, expires_at
    now = state.getCurrentWatermarkMs() * 1000
    drops: list[tuple[str, int, int, str]] = []
    for row in (r for part in parts for r in part.itertuples(index=False) if key[0] != CLOCK_KEY):
        if pd.isna(row.kind):
            click = int(row.at) if click is None else max(click, int(row.at))
            continue
        new, old = (int(row.at), int(row.version), int(row.expires)), present.get(row.kind)
        if old is None or old[:2] < new[:2]:
            present[row.kind] = new
            new = old if old is not None and old[2] != GONE else None
        elif old[:2] == new[:2]:
            new = None  # the same version, delivered again
        if new is not None:
            drops.append((row.kind, new[1], new[0], "replaced"))
    for kind, (at, version, end) in present.items():
        reason = "feedback" if click is not None and at <= click else "expired" if end <= now else None
        if end != GONE and reason:
            drops.append((kind, version, at, reason))
            present[kind] = (at, version, GONE)  # kept, so that an older one delivered later is still replaced
    if key[0] != CLOCK_KEY:
        state.update((click, list(present), *(list(x) for x in zip(*present.values()))) if present else (click, [], [], [], []))
        ends = [end for _, _, end in present.values() if end != GONE]
        if ends:  # the timer is due when the clock has passed its millisecond
            state.setTimeoutTimestamp(-(-min(ends) // 1000) - 1)
    yield pd.DataFrame({"cache_key": [key[0]] * len(drops), "kind": [d[0] for d in drops],
                        "version": pd.Series([d[1] for d in drops], dtype="int64"),
                        "cached": pd.Series([d[2] for d in drops], dtype="int64"), "reason": [d[3] for d in drops]})


def start_snapshot_stream(spark: SparkSession, writes_dir: str, clicks_dir: str, clock_dir: str, drops_dir: str, checkpoint_dir: str,
                          available_now: bool = True):
    """Start the stream over three folders of Parquet files (``WRITE_SCHEMA``, ``CLICK_SCHEMA``,
    ``CLOCK_SCHEMA``; other columns do not matter); drops are written to ``drops_dir``.  Returns the ``StreamingQuery``."""
    def source(path: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).parquet(path)

    nothing = lambda kind: F.lit(None).cast(kind)
    writes = source(writes_dir, WRITE_SCHEMA).select(
        "cache_key", "kind", "version", F.unix_micros("cached_at").alias("at"), F.unix_micros("expires_at").alias("expires"),
        nothing("timestamp").alias("clock"))
    clicks = source(clicks_dir, CLICK_SCHEMA).filter(F.col("query").isNotNull() & F.col("ts").isNotNull())
    touched = F.array(F.col("query"), *[F.concat(F.col("query"), F.lit(f":{t}")) for t in TIME_FILTER_DAYS])
    clicks = clicks.select(F.explode(touched).alias("cache_key"), nothing("string").alias("kind"), nothing("bigint").alias("version"),
                           F.unix_micros("ts").alias("at"), nothing("bigint").alias("expires"), nothing("timestamp").alias("clock"))
    clock = source(clock_dir, CLOCK_SCHEMA).filter(F.col("now").isNotNull()).select(
        F.lit(CLOCK_KEY).alias("cache_key"), nothing("string").alias("kind"), nothing("bigint").alias("version"),
        nothing("bigint").alias("at"), nothing("bigint").alias("expires"), F.col("now").alias("clock"))
    drops = (writes.unionByName(clicks).unionByName(clock).withWatermark("clock", "0 seconds").groupBy("cache_key")
             .applyInPandasWithState(_follow, DROP_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))
    w = (drops.select("cache_key", "kind", "version", F.timestamp_micros("cached").alias("cached_at"), "reason")
         .writeStream.format("parquet").option("path", drops_dir).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with conf(spark, STATE_CONF):
        return w.start()


def read_drops(spark: SparkSession, drops_dir: str) -> DataFrame:
    return spark.read.schema("cache_key string, kind string, version bigint, cached_at timestamp, reason string").parquet(drops_dir)


def live_snapshots(snapshots: DataFrame, drops: DataFrame) -> DataFrame:
    """The snapshot table without the versions that were dropped."""
    return snapshots.join(drops.select("cache_key", "kind", "version", "cached_at"), ["cache_key", "kind", "version", "cached_at"], "left_anti")
