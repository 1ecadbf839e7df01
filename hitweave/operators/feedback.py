"""Relevance feedback and the stored ``results`` table (keyed ``(query, link)``).

The reference does a read-modify-write per click.  Here a batch of feedback
events is validated, folded per key by one aggregation (partial aggregation
first, so a key clicked a million times is combined map-side), and merged into
the table by a keyed full outer join.  The fold is idempotent per batch:
replaying the same events into the same base gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.functions import timefn

REQUIRED_FEEDBACK = ("query", "link", "title")
REQUIRED_RESULT = ("query", "rank", "link", "title")

RESULT_COLUMNS = ("query", "link", "title", "snippet", "rank", "created", "relevance", "ml_rank",
                  "rag_summary", "click_count", "last_clicked")

# The results table (key (query, link); uniqueness is audited, not enforced).
RESULTS_SCHEMA = T.StructType([
    T.StructField("query", T.StringType(), False),
    T.StructField("link", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("snippet", T.StringType()),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("created", T.TimestampType()),
    T.StructField("relevance", T.BooleanType()),
    T.StructField("ml_rank", T.DoubleType()),
    T.StructField("rag_summary", T.StringType()),
    T.StructField("click_count", T.IntegerType()),
    T.StructField("last_clicked", T.TimestampType()),
])


def conform_results(df: DataFrame, now) -> DataFrame:
    """Cast rows to ``RESULTS_SCHEMA`` and apply the table defaults: created = now,
    relevance false, ml_rank 0, click_count 0 (missing columns are added)."""
    defaults = {"created": timefn.ts_lit(now), "relevance": F.lit(False), "ml_rank": F.lit(0.0),
                "click_count": F.lit(0)}
    cols = []
    for f in RESULTS_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c.cast(f.dataType), defaults[f.name])
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _reason(required) -> F.Column:
    out = None
    for c in required:
        cond = F.col(c).isNull()
        out = F.when(cond, F.lit(f"missing {c}")) if out is None else out.when(cond, F.lit(f"missing {c}"))
    return out


def feedback_rejects(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """events lacking a required field, with the first missing one as ``reason``."""
    return events.withColumn("reason", _reason(REQUIRED_FEEDBACK)).filter(F.col("reason").isNotNull()) \
                 .select(id_col, "reason")


def valid_feedback(events: DataFrame) -> DataFrame:
    """Events with all required fields, optional ones defaulted as the route does."""
    ok = events.filter(_reason(REQUIRED_FEEDBACK).isNull())
    return ok.withColumns({
        "snippet": F.coalesce(F.col("snippet"), F.lit("")),
        "ml_rank": F.coalesce(F.col("ml_rank").cast("double"), F.lit(0.0)),
        "rag_summary": F.coalesce(F.col("rag_summary"), F.lit("")),
        "rank": F.coalesce(F.col("rank").cast("int"), F.lit(1)),
    })


def feedback_rollup(events: DataFrame) -> DataFrame:
    """Per (query, link): clicks, first/last click time, the latest event's
    fields and the first event's rank.  Events are ordered by (ts, event_id)."""
    v = valid_feedback(events)
    order = F.struct("ts", "event_id")
    return v.groupBy("query", "link").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by(F.struct("title", "snippet", "ml_rank", "rag_summary"), order).alias("latest"),
        F.min_by(F.col("rank"), order).alias("first_rank"),
    )


def apply_rollup(results: DataFrame, rollup: DataFrame) -> DataFrame:
    """Fold a rollup into the results table.

    Existing key: clicks added, relevance true, last click time and the latest
    event's title/snippet/ml_rank/rag_summary; rank and created kept.  New key:
    inserted with the first event's rank and time.  Untouched rows unchanged."""
    r = results.alias("r")
    u = rollup.alias("u")
    j = r.join(u, (F.col("r.query") == F.col("u.query")) & (F.col("r.link") == F.col("u.link")), "full")
    hit = F.col("u.query").isNotNull()
    old = F.col("r.query").isNotNull()
    return j.select(
        F.coalesce(F.col("r.query"), F.col("u.query")).alias("query"),
        F.coalesce(F.col("r.link"), F.col("u.link")).alias("link"),
        F.when(hit, F.col("u.latest.title")).otherwise(F.col("r.title")).alias("title"),
        F.when(hit, F.col("u.latest.snippet")).otherwise(F.col("r.snippet")).alias("snippet"),
        F.when(old, F.col("r.rank")).otherwise(F.col("u.first_rank")).cast("int").alias("rank"),
        F.when(old, F.col("r.created")).otherwise(F.col("u.first_ts")).alias("created"),
        F.when(hit, F.lit(True)).otherwise(F.col("r.relevance")).alias("relevance"),
        F.when(hit, F.col("u.latest.ml_rank")).otherwise(F.col("r.ml_rank")).cast("double").alias("ml_rank"),
        F.when(hit, F.col("u.latest.rag_summary")).otherwise(F.col("r.rag_summary")).alias("rag_summary"),
        (F.coalesce(F.col("r.click_count"), F.lit(0)) + F.coalesce(F.col("u.clicks"), F.lit(0))).cast("int")
        .alias("click_count"),
        F.when(hit, F.col("u.last_ts")).otherwise(F.col("r.last_clicked")).alias("last_clicked"),
    )


def feedback_upsert(results: DataFrame, events: DataFrame) -> DataFrame:
    """M7: the results table after a batch of feedback events."""
    return apply_rollup(results, feedback_rollup(events))


def feedback_echo(results: DataFrame, events: DataFrame) -> DataFrame:
    """What the feedback route answers per changed key: query, link, title,
    click_count, relevance."""
    changed = feedback_rollup(events).select("query", "link")
    return feedback_upsert(results, events).join(changed, ["query", "link"], "left_semi") \
        .select("query", "link", "title", "click_count", "relevance")


def results_replace(results: DataFrame, values: DataFrame, now, seq_col: str | None = None) -> DataFrame:
    """Replace-on-key write.  Each valid row of ``values`` (query, rank, link,
    title required) overwrites its key entirely: created=now, missing fields
    default (snippet '', relevance false, ml_rank 0, rag_summary '',
    click_count 0, last_clicked null).  Several rows for one key: the last by
    ``seq_col`` wins (an aggregate, so a hot key is combined map-side)."""
    v = values.filter(_reason(REQUIRED_RESULT).isNull())

    def opt(c, default, typ):
        return (F.col(c) if c in v.columns else F.lit(None)).cast(typ).alias(c) if default is None else \
            F.coalesce(F.col(c) if c in v.columns else F.lit(None), F.lit(default)).cast(typ).alias(c)

    rows = v.select("query", "link", F.col("title").cast("string").alias("title"),
                    opt("snippet", "", "string"), F.col("rank").cast("int").alias("rank"),
                    timefn.ts_lit(now).alias("created"), opt("relevance", False, "boolean"),
                    opt("ml_rank", 0.0, "double"), opt("rag_summary", "", "string"),
                    opt("click_count", 0, "int"), opt("last_clicked", None, "timestamp"),
                    (F.col(seq_col) if seq_col else F.lit(0)).alias("__seq"))
    fields = [c for c in RESULT_COLUMNS if c not in ("query", "link")]
    last = (rows.groupBy("query", "link")
                .agg(F.max_by(F.struct(*fields), F.struct("__seq", "rank", "title")).alias("__r"))
                .select("query", "link", *[F.col(f"__r.{c}").alias(c) for c in fields]))
    keep = results.select(*RESULT_COLUMNS).join(last.select("query", "link"), ["query", "link"], "left_anti")
    return keep.unionByName(last.select(*RESULT_COLUMNS))


def constraint_audit(results: DataFrame) -> DataFrame:
    """NOT NULL and UNIQUE(query, link) checks of the results table, one row.
    Two-level aggregation: per key, then over keys (no sort, no collect)."""
    per_key = results.groupBy("query", "link").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED_RESULT])
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).cast("bigint").alias(f"null_{c}") for c in REQUIRED_RESULT],
        F.count_if(F.col("n") > 1).cast("bigint").alias("dup_keys"))
