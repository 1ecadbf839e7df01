"""Derived inputs: the search-side tables built from the landed test tables.

Every view of FIXTURES.md §4 as a lazily evaluated DataFrame.  The SQL twin of
each lives in ``hitweave.plans.oracle``.  All of them read the given tables, so
their work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.functions.web import url_host, visible_text
from hitweave.operators.filters import page_stats
from hitweave.operators.ordinal import ordinal
from hitweave.session import materialize
from hitweave.sources.tables import read_events, read_pages, read_table

# The fixture blocklist (four entries of the reference's list plus
# the two spam hosts present in ``pages``).
FIXTURE_BLOCKLIST = (
    "google-analytics.com", "doubleclick.net", "facebook.com/tr", "taboola.com",
    "www.cheap-pills.example.com", "www.casino-win.example.org",
)

# Fixed clocks of the fixture (never the wall clock).
NOW_DATED = "2024-01-31 00:00:00"
NOW_WINDOW = {"day": "2024-01-05 00:00:00", "month": "2024-02-03 00:00:00", "year": "2025-01-04 00:00:00"}
NOW_STORED = "2024-01-20 00:00:00"
NOW_FEEDBACK = "2024-02-01 00:00:00"


TITLE = r"(?s)<title>(.*?)</title>"


def page_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the URL's host as the query (a key that grows with the data), title and visible text."""
    return _with_text(read_pages(spark, sf_dir).select(
        "page_id", "url", "html", url_host("url").alias("query")))


def _with_text(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"title": F.regexp_extract("html", TITLE, 1), "body": visible_text(F.col("html"))})


def _numbered(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """``pages`` (by ``page_id``) with their arrival order ``pos`` per query, which is by page id; only
    (page_id, query) is dealt out for that."""
    keys = read_table(spark, sf_dir, "pages").select("page_id", url_host("url").alias("query"))
    return pages.join(ordinal(keys, ["query"], ["page_id"], out="pos", base=0), "page_id")


def _shown_title(title) -> F.Column:
    return F.when(F.col("page_id") % 37 == 5, F.lit("")).otherwise(title)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed search hits ``(query, pos, title, link, snippet)``.  The text regexes run after the numbers are
    joined, so a filter on ``pos`` (the first ten hits) reaches the join before any text work."""
    numbered = _with_text(_numbered(spark, sf_dir, read_pages(spark, sf_dir).select("page_id", "url", "html")))
    return numbered.select("query", "pos", _shown_title(F.col("title")).alias("title"), F.col("url").alias("link"), F.col("body").alias("snippet"))


def measured_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits ``(query, pos, link, word_count, link_count, content_score)``, measured where the pages
    are read: no page moves."""
    pages = page_stats(read_pages(spark, sf_dir).select("page_id", "url", "html")).drop("html")
    return _numbered(spark, sf_dir, pages).withColumnRenamed("url", "link").drop("page_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items packed as API responses of 10 hits (``start`` is the 1-based index of
    the first hit, as the API pages).  Every fifth response page failed with 503."""
    it = items(spark, sf_dir)
    page_no = F.floor(F.col("pos") / 10).cast("bigint")
    return (it.groupBy("query", page_no.alias("page_no"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "title", "link", "snippet"))).alias("hits"))
              .select("query",
                      (F.col("page_no") * 10 + 1).alias("start"),
                      F.when(F.col("page_no") % 5 == 3, F.lit(503)).otherwise(F.lit(200)).cast("int").alias("status"),
                      F.transform("hits", lambda h: F.struct(h["title"].alias("title"), h["link"].alias("link"),
                                                             h["snippet"].alias("snippet"))).alias("items")))


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages; some fetches failed with 404, some URLs were fetched before with another body."""
    pages = read_table(spark, sf_dir, "pages")
    now = pages.select("url", F.when(F.col("page_id") % 9 == 4, F.lit(404)).otherwise(F.lit(200)).cast("int").alias("status"),
                       "html", (F.col("page_id") * 2 + 1).alias("fetch_id"))
    before = pages.filter(F.col("page_id") % 6 == 1).select(
        "url", F.lit(200).alias("status"), F.concat(F.lit("<p>old</p>"), "html").alias("html"), (F.col("page_id") * 2).alias("fetch_id"))
    return now.unionByName(before)


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a publication <meta> in several forms (none, bad, name=, property= reversed)."""
    pb = page_base(spark, sf_dir)
    day = F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("page_id") * 7 % 800).cast("int")).cast("string")
    html = (F.when(F.col("page_id") % 10 == 0, F.col("html"))
             .when(F.col("page_id") % 11 == 0,
                   F.concat(F.lit('<meta property="article:published_time" content="not a date">'), F.col("html")))
             .when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="date" content="'), day, F.lit('">'), F.col("html")))
             .otherwise(F.concat(F.lit('<meta content="'), day, F.lit('T00:00:00Z" property="article:published_time">'),
                                 F.col("html"))))
    return pb.select("page_id", "url", "query", html.alias("html"))


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User actions on pages: each event lands on page ``(user_id*7 + k) % #pages``."""
    ev = read_events(spark, sf_dir)
    # Narrow page columns, hash-partitioned on the join key: the text regexes run
    # once per page below the exchange (a one-to-many hash join would otherwise
    # re-evaluate them per matching event), and the join reuses this partitioning.
    pb = (page_base(spark, sf_dir)
          .select("page_id", "query", "url", "title", F.col("body").alias("snippet"))
          .repartition("page_id"))
    n_pages = read_table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()  # scalar subquery
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = ev.select("event_id", "event_type", "ts", "value", ((F.col("user_id") * 7 + k) % n_pages).alias("pid"))
    return (e.join(pb, e["pid"] == pb["page_id"])
             .select("event_id", "event_type", "ts", "query", F.col("url").alias("link"), "title", "snippet",
                     F.round(F.col("value") / 500, 4).alias("ml_rank")))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click feedback events; some lack the required link, some an id."""
    a = act(spark, sf_dir).filter(F.col("event_type") == "click")
    return a.select(F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("event_id"), "ts", "query",
                    F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("link")).alias("link"),
                    "title", "snippet", "ml_rank", F.lit("").alias("rag_summary"), F.lit(1).cast("int").alias("rank"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``results`` table, keyed (query, link), from all purchases; queries whose pages
    nobody bought from have nothing stored.

    A table at rest in real use: it is written once (Parquet in the shared folder),
    so the jobs reading it several times do not re-derive it."""
    return materialize(_stored(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = act(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return (a.groupBy("query", "link")
             .agg(F.min("title").alias("title"), F.min("snippet").alias("snippet"), F.min("ts").alias("created"),
                  (F.max(F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)) == 1).alias("relevance"),
                  F.max("ml_rank").alias("ml_rank"), F.lit("").alias("rag_summary"),
                  F.count(F.lit(1)).cast("int").alias("click_count"), F.max("ts").alias("last_clicked"),
                  (F.lit(1) + F.min("event_id") % 10).cast("int").alias("rank")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: every query with the time filters day, month, none and an unknown one;
    also blank queries."""
    q = read_table(spark, sf_dir, "pages").select(url_host("url").alias("query")).distinct()
    q = q.unionByName(spark.createDataFrame([("  ",)], "query string"))
    return q.select("query", F.explode(F.array(F.lit("day"), F.lit("month"), F.lit(""), F.lit("decade"))).alias("time_filter"))


def timed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event, at the event's time, for one of the queries, with one of the time filters or none."""
    hosts = read_table(spark, sf_dir, "pages").select(url_host("url").alias("query")).distinct()
    queries = ordinal(hosts, [], ["query"], out="number", base=0)
    n = hosts.select(F.count(F.lit(1))).scalar()
    ev = read_events(spark, sf_dir).select("event_id", F.col("ts").alias("asked_at"), (F.col("user_id") % n).alias("number"))
    suffix = F.element_at(F.array(F.lit(""), F.lit(":day"), F.lit(":month"), F.lit(":year")), (F.col("event_id") % 4 + 1).cast("int"))
    return ev.join(queries, "number").select("event_id", "asked_at", F.concat("query", suffix).alias("cache_key"))


def snapshot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every query's lists over a month: times to live of 10 to 30 hours, some versions of
    one time, some queries' lists of some days missing."""
    hosts = read_table(spark, sf_dir, "pages").select(url_host("url").alias("query")).distinct()
    keys = hosts.select("query", F.explode(F.array(F.lit(""), F.lit(":day"), F.lit(":month"))).alias("suffix"))
    days = keys.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(29)))).filter((F.col("day") + F.length("query")) % 4 != 0)
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(days=F.col("day"), hours=F.col("day") * 7 % 24)
    versions = F.when(F.col("day") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).cast("array<bigint>")
    rows = days.select(F.concat("query", "suffix").alias("cache_key"), F.lit("final").alias("kind"), "day", at.alias("cached_at"),
                       F.explode(versions).alias("version"))
    hours = (F.col("day") % 3 + F.col("version")) * 10
    return rows.select("cache_key", "kind", "version", "cached_at", (F.col("cached_at") + F.make_interval(hours=hours.cast("int"))).alias("expires_at"))


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in FIXTURE_BLOCKLIST], "host string")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document as a query, for the similarity search against all documents."""
    return read_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")
