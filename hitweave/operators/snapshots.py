"""Finished result lists kept as expiring snapshots (the reference's result cache).

A snapshot table has one row per ``(cache_key, kind, version, chunk)``::

    cache_key string, kind string ('final' | 'fresh'), version bigint, chunk bigint,
    payload string (JSON array of hit structs), n_items bigint,
    cached_at timestamp, expires_at timestamp

A list is cut into chunks of ``CHUNK`` ranks, so no single row (and no single
aggregation group) holds a whole list of unbounded length.  A newer version
replaces an older one, as writing a cache key does: reading takes the latest
version (``cached_at <= now``; of equal times the larger ``version``) of a key, and finds nothing
if that has expired.  ``kind`` separates a query's fresh hits from its merged list, which the
reference stored under the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.functions import timefn
from hitweave.operators.asof import asof_join

DEFAULT_TTL_SECONDS = 600
CHUNK = 100

HIT_FIELDS = ("rank", "title", "link", "snippet", "ml_rank", "rag_summary", "click_count", "relevance")
HIT_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("rank", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("ml_rank", T.DoubleType()),
    T.StructField("rag_summary", T.StringType()),
    T.StructField("click_count", T.LongType()),
    T.StructField("relevance", T.BooleanType()),
]))

SNAPSHOT_COLUMNS = ("cache_key", "kind", "version", "chunk", "payload", "n_items", "cached_at", "expires_at")


def cache_key(query, time_filter) -> F.Column:
    """``query`` or ``query:time_filter`` when a filter is set."""
    q = F.col(query) if isinstance(query, str) else query
    t = F.col(time_filter) if isinstance(time_filter, str) else time_filter
    return F.concat_ws(":", q, F.nullif(t, F.lit("")))


def snapshot_write(results: DataFrame, now, key_col: str = "cache_key", kind: str = "final",
                   ttl_seconds: int | None = None, chunk: int = CHUNK, version: int | F.Column = 1) -> DataFrame:
    """Snapshot rows of formatted result lists (``rank`` 1..n per key).
    ``ttl_seconds`` falsy (None or 0) means the default of 600 s.  ``version`` decides between lists of
    one key written at the same time (:func:`next_version` for a table that is added to)."""
    ttl = int(ttl_seconds or DEFAULT_TTL_SECONDS)
    hits = results.select(F.col(key_col).alias("cache_key"),
                          F.floor((F.col("rank") - 1) / chunk).cast("bigint").alias("chunk"),
                          F.struct(*[F.col(c).cast(f.dataType).alias(c) for c, f in
                                     zip(HIT_FIELDS, HIT_SCHEMA.elementType.fields)]).alias("hit"))
    at = timefn.ts_lit(now)
    return (hits.groupBy("cache_key", "chunk")
                .agg(F.sort_array(F.collect_list("hit")).alias("hits"))
                .select("cache_key", F.lit(kind).alias("kind"), (version if isinstance(version, F.Column) else F.lit(version)).cast("bigint").alias("version"), "chunk", F.to_json("hits").alias("payload"),
                        F.size("hits").cast("bigint").alias("n_items"), at.alias("cached_at"),
                        (at + F.make_interval(secs=F.lit(ttl))).alias("expires_at")))


def valid_snapshots(snapshots: DataFrame, now, kind: str | None = "final") -> DataFrame:
    """Rows of the latest version of each (key, kind), unless that has expired."""
    at = timefn.ts_lit(now)
    s = snapshots.filter(F.col("cached_at") <= at)
    if kind is not None:
        s = s.filter(F.col("kind") == kind)
    return _latest(s).filter(at < F.col("expires_at"))


def next_version(snapshots: DataFrame) -> F.Column:
    """The number after the table's largest, as a scalar subquery."""
    return snapshots.select(F.coalesce(F.max("version"), F.lit(0)) + 1).scalar()


def _latest(snapshots: DataFrame) -> DataFrame:
    latest = snapshots.groupBy("cache_key", "kind").agg(F.max(F.struct("cached_at", "version")).alias("__latest"))
    return (snapshots.join(latest, ["cache_key", "kind"])
                     .filter(F.struct("cached_at", "version") == F.col("__latest")).drop("__latest"))


def snapshot_read(snapshots: DataFrame, keys: DataFrame, now, kind: str | None = "final") -> DataFrame:
    """Decoded hits of the valid snapshots of ``keys`` (a ``cache_key`` column)."""
    v = valid_snapshots(snapshots, now, kind).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
    return (v.select("cache_key", "kind", F.inline(F.from_json("payload", HIT_SCHEMA)))
             .select("cache_key", "kind", *HIT_FIELDS))


def snapshots_at(requests: DataFrame, snapshots: DataFrame, at: str = "asked_at", kind: str = "final") -> DataFrame:
    """J5/J8 for requests that each have their own time: the rows of ``requests`` (``cache_key`` and
    ``at``) with ``version``, ``cached_at`` and ``expires_at`` of the list that was served then, and
    ``status`` 'hit' or 'miss' (those three null).  An as-of join: the last version written by then counts,
    if it had not expired."""
    versions = snapshots.filter(F.col("kind") == kind).select("cache_key", "cached_at", "version", "expires_at").distinct()
    found = asof_join(requests, versions, ["cache_key"], at, "cached_at", ["cached_at", "version", "expires_at"], ["version"])
    live = F.coalesce(F.col(at) < F.col("expires_at"), F.lit(False))
    return found.select(*requests.columns, *[F.when(live, F.col(c)).alias(c) for c in ("version", "cached_at", "expires_at")],
                        F.when(live, F.lit("hit")).otherwise(F.lit("miss")).alias("status"))


def snapshot_read_at(requests: DataFrame, snapshots: DataFrame, at: str = "asked_at", kind: str = "final") -> DataFrame:
    """The decoded hits each request was served at its own time, with the columns of ``requests``."""
    served = snapshots_at(requests, snapshots, at, kind).filter(F.col("status") == "hit").drop("expires_at", "status")
    lists = snapshots.filter(F.col("kind") == kind).select("cache_key", "version", "cached_at", "payload")
    return (served.join(lists, ["cache_key", "version", "cached_at"])
                  .select(*requests.columns, F.inline(F.from_json("payload", HIT_SCHEMA))))


def snapshot_reuse(requests: DataFrame, snapshots: DataFrame, now, kind: str = "final") -> DataFrame:
    """Each requested key marked 'hit' (a valid snapshot exists) or 'miss'
    (to be computed)."""
    keys = requests.select("cache_key").distinct()
    have = valid_snapshots(snapshots, now, kind).select("cache_key").distinct().withColumn("__hit", F.lit(True))
    j = keys.join(have, "cache_key", "left")
    return j.select("cache_key", F.when(F.col("__hit"), F.lit("hit")).otherwise(F.lit("miss")).alias("status"))


def invalidation_keys(events: DataFrame, query_col: str = "query") -> DataFrame:
    """The keys a feedback on a query invalidates: q, q:day, q:month, q:year."""
    q = events.select(F.col(query_col).alias("q")).filter(F.col("q").isNotNull()).distinct()
    return q.select(F.explode(F.array(F.col("q"), *[F.concat(F.col("q"), F.lit(f":{t}"))
                                                    for t in timefn.TIME_FILTER_DAYS])).alias("cache_key")).distinct()


def snapshot_invalidate(snapshots: DataFrame, events: DataFrame, ts_col: str | None = "ts") -> DataFrame:
    """Drop the snapshots of the keys touched by feedback events.

    With ``ts_col`` a snapshot is dropped only when it was cached at or before
    the latest feedback on its query (one written after the feedback already
    reflects it); ``ts_col=None`` drops every touched key regardless of time."""
    if ts_col is None:
        return snapshots.join(invalidation_keys(events), "cache_key", "left_anti")
    last = (events.filter(F.col("query").isNotNull()).groupBy("query")
                  .agg(F.max(ts_col).alias("__last")))
    keys = last.select(F.explode(F.array(F.col("query"), *[F.concat(F.col("query"), F.lit(f":{t}"))
                                                           for t in timefn.TIME_FILTER_DAYS])).alias("cache_key"),
                       "__last")
    stale = snapshots.join(keys, "cache_key").filter(F.col("cached_at") <= F.col("__last")) \
                     .select("cache_key", "kind", "cached_at").distinct()
    return snapshots.join(stale, ["cache_key", "kind", "cached_at"], "left_anti")


def snapshot_purge(snapshots: DataFrame, now) -> DataFrame:
    """The snapshot table without what no reader can get any more at ``now``: versions that a
    newer one replaced, and expired ones.  (Versions dated after ``now`` stay.)"""
    at = timefn.ts_lit(now)
    past, future = snapshots.filter(F.col("cached_at") <= at), snapshots.filter(F.col("cached_at") > at)
    return _latest(past).filter(F.col("expires_at") > at).select(*snapshots.columns).unionByName(future)


def snapshot_clear(snapshots: DataFrame) -> DataFrame:
    """Clear all: an empty table of the same schema."""
    return snapshots.limit(0)
