"""Sources over landed data: search API responses, fetched pages, the blocklist file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.functions.entities import html_unescape

ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("snippet", T.StringType()),
])

# One landed API response per line; ``start`` is the 1-based index of its first hit.
RESPONSE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("items", T.ArrayType(ITEM_SCHEMA)),
])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON responses with a fixed schema; malformed lines become nulls
    (PERMISSIVE) and then yield no hits."""
    return spark.read.schema(RESPONSE_SCHEMA).option("mode", "PERMISSIVE").json(path)


def scan_items(responses: DataFrame) -> DataFrame:
    """Hits of successful responses, one row each: ``(query, pos, title, link, snippet)``.

    A non-200, malformed or item-less response contributes no rows.  ``pos`` is the
    0-based position of the hit in the query's whole result list."""
    ok = responses.filter((F.col("status") == 200) & F.col("items").isNotNull())
    start = F.coalesce(F.col("start"), F.lit(1)).cast("bigint")
    return (ok.select("query", start.alias("start"), F.posexplode("items").alias("i", "item"))
              .select("query", (F.col("start") - 1 + F.col("i")).cast("bigint").alias("pos"),
                      F.col("item.title").alias("title"), F.col("item.link").alias("link"),
                      F.col("item.snippet").alias("snippet")))


def result_page(hits: DataFrame, start: int = 1, num: int = 10) -> DataFrame:
    """The ``num`` hits from the 1-based index ``start`` (the API's paging)."""
    return hits.filter(F.col("pos").between(start - 1, start - 1 + num - 1))


def normalise_items(hits: DataFrame) -> DataFrame:
    """Missing title/link/snippet -> '', title and snippet entity-decoded."""
    return hits.withColumns({
        "link": F.coalesce(F.col("link"), F.lit("")),
        "title": html_unescape(F.coalesce(F.col("title"), F.lit(""))),
        "snippet": html_unescape(F.coalesce(F.col("snippet"), F.lit(""))),
    })


def valid_items(hits: DataFrame) -> DataFrame:
    """Normalised hits that have both a link and a title."""
    n = normalise_items(hits)
    return n.filter((F.col("link") != "") & (F.col("title") != ""))


def attach_pages(hits: DataFrame, fetched: DataFrame) -> DataFrame:
    """Attach the fetched page body to each hit; a failed or missing fetch gives ''.

    ``fetched`` is ``(url, status, html, fetch_id)``; of several successful fetches of a URL the
    one with the largest ``fetch_id`` counts (found on narrow columns, so no page is aggregated).
    Only successful fetches take part (the status filter reaches the scan)."""
    ok = fetched.filter((F.col("status") == 200) & F.col("url").isNotNull())
    last = ok.groupBy("url").agg(F.max("fetch_id").alias("fetch_id"))
    ok = ok.join(last, ["url", "fetch_id"], "left_semi").select(F.col("url").alias("__url"), F.col("html").alias("__html"))
    j = hits.join(ok, hits["link"] == ok["__url"], "left")
    return j.withColumn("html", F.coalesce(F.col("__html"), F.lit(""))).drop("__url", "__html")


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Blocklist file: one host per line, trimmed, blanks dropped, distinct.
    A missing file is an empty blocklist."""
    try:
        lines = spark.read.text(path)
        lines.schema  # resolve now: a missing path raises here
    except Exception as exc:  # noqa: BLE001 - only a missing path is tolerated
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], "host string")
    return (lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("host"))
                 .filter(F.col("host") != "").distinct())
