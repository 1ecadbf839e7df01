"""Filters and page analysis: blocklist, time windows, page stats, quality floor, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.functions import timefn, web
from hitweave.functions.text import strip_ws
from hitweave.operators.ordinal import ordinal

def _trimmed(requests: DataFrame) -> DataFrame:
    return (requests.withColumn("query", strip_ws(F.coalesce("query", F.lit(""))))
                    .withColumn("time_filter", F.coalesce("time_filter", F.lit(""))))


_KNOWN_FILTERS = ("", *timefn.TIME_FILTER_DAYS)


def clean_queries(requests: DataFrame) -> DataFrame:
    """Trimmed, non-blank queries with a known time filter (or none), and their cache key
    ``query[:time_filter]``.  The others are in :func:`request_rejects`."""
    ok = _trimmed(requests).filter((F.col("query") != "") & F.col("time_filter").isin(*_KNOWN_FILTERS))
    return ok.withColumn("cache_key", F.concat_ws(":", F.col("query"), F.nullif(F.col("time_filter"), F.lit(""))))


def request_rejects(requests: DataFrame) -> DataFrame:
    """Requests that cannot be answered, with the ``reason``."""
    return (_trimmed(requests)
            .withColumn("reason", F.when(F.col("query") == "", F.lit("blank query"))
                        .when(~F.col("time_filter").isin(*_KNOWN_FILTERS), F.lit("unknown time filter")))
            .filter(F.col("reason").isNotNull()))


def blocklist_filter(hits: DataFrame, blocklist: DataFrame, match: str = "exact",
                     link_col: str = "link") -> DataFrame:
    """Drop hits whose URL host is on the blocklist.

    ``match='exact'``: host equals an entry.  ``match='suffix'``: the host or any
    parent domain equals an entry (``ads.x.com`` is blocked by ``x.com``); the
    host's suffixes are exploded so it stays an equi anti join.  Spark
    broadcasts the list while its measured size allows."""
    bl = blocklist.select(F.col("host").alias("__bl_host")).distinct()
    h = hits.withColumn("__host", web.url_host(F.col(link_col)))
    if match == "exact":
        out = h.join(bl, h["__host"] == bl["__bl_host"], "left_anti")
    elif match == "suffix":
        cand = h.select("*", F.explode(web.host_suffixes(F.col("__host"))).alias("__cand"))
        blocked = cand.join(bl, cand["__cand"] == bl["__bl_host"], "left_semi").select(link_col).distinct()
        out = h.join(blocked, link_col, "left_anti")
    else:
        raise ValueError(f"match must be 'exact' or 'suffix', not {match!r}")
    return out.drop("__host")


def time_window(df: DataFrame, time_filter: str | None, now, ts_col: str = "created") -> DataFrame:
    """Rows with ``ts_col >= now - {1, 30, 365} days`` (inclusive, no upper bound);
    blank filter -> all rows; unknown filter -> ValueError."""
    days = timefn.window_days(time_filter)
    if days is None:
        return df
    return df.filter(F.col(ts_col) >= timefn.days_ago(now, days))


def page_stats(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``word_count``, ``link_count`` and ``content_score`` (words per link)."""
    counted = df.withColumns({"__text": web.visible_text(F.col(html_col)), "link_count": web.link_count(F.col(html_col))})
    return (counted.withColumn("word_count", web.word_count("__text")).drop("__text")
                   .withColumn("content_score", web.content_score(F.col("word_count"), F.col("link_count"))))


def page_dates(df: DataFrame, now=None, html_col: str = "html") -> DataFrame:
    """Add ``published_date`` (meta text), ``has_date``, ``published_ts`` and, if
    ``now`` is given, ``time_relevance``."""
    out = (df.withColumn("published_date", web.meta_published_date(F.col(html_col)))
             .withColumn("has_date", F.col("published_date").isNotNull())
             .withColumn("published_ts", timefn.parse_published(F.col("published_date"))))
    if now is not None:
        out = out.withColumn("time_relevance", timefn.age_score(F.col("published_ts"), now))
    return out


def content_filter(hits: DataFrame, blocklist: DataFrame, min_words: float = 50,
                   time_filter: str | None = None, now=None, order_col: str = "pos",
                   key_cols=("query",)) -> DataFrame:
    """Quality filter of a result set, per query: blocklisted hosts out, then the
    time window on ``created`` (if asked), then the words-per-link floor; the
    survivors are renumbered ``final_rank`` 1..n in their previous order (null first).

    ``hits`` have ``html``, which is measured after the cheap tests and goes no further (no
    later step moves a page); or they were measured where the pages were read and have ``content_score`` already."""
    kept = blocklist_filter(hits, blocklist)
    if time_filter:
        if now is None:
            raise ValueError("a time filter needs `now`")
        kept = time_window(kept, time_filter, now)
    measured = kept if "content_score" in kept.columns else page_stats(kept)
    good = measured.drop("html").filter(F.col("content_score") >= F.lit(float(min_words)))
    return ordinal(good, list(key_cols), [order_col, "link"], out="final_rank", base=1)


def date_distribution(dated: DataFrame, now, key_cols=("query",), ts_col: str = "published_ts") -> DataFrame:
    """Per query: hits published in the last day/week/month/year (cumulative, ``>=``),
    older than a year, and of unknown date.  Partial aggregation, no sort."""
    t = F.col(ts_col)

    def since(days):
        return F.count_if(t >= timefn.days_ago(now, days)).cast("bigint")

    return dated.groupBy(*key_cols).agg(
        since(1).alias("last_day"), since(7).alias("last_week"), since(30).alias("last_month"),
        since(365).alias("last_year"), F.count_if(t < timefn.days_ago(now, 365)).cast("bigint").alias("older"),
        F.count_if(t.isNull()).cast("bigint").alias("unknown"))
