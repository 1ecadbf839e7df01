"""M1: cleaned, summarised, ranked search hits for every query at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.text import extractive_summary
from hitweave.sources.landed import attach_pages, result_page, valid_items

HITS_PER_QUERY = 10  # the API's page size; the cut is made before invalid hits are dropped


def summarise(hits: DataFrame) -> DataFrame:
    """``rag_summary``: the extractive summary of the snippet for the hit's *title*,
    only when the page body is non-empty (else null)."""
    return hits.withColumn("rag_summary", F.when(F.col("html") != "",
                                                 extractive_summary(F.col("title"), F.col("snippet"))))


def search_hits(items: DataFrame, fetched: DataFrame, limit: int = HITS_PER_QUERY) -> DataFrame:
    """First ``limit`` landed hits per query -> valid, entity-decoded -> page attached
    -> summary -> ``rank`` 1..n in arrival order, ``ml_rank`` 1.0.

    The cut comes first, so the page join and the regexes only see ``limit`` rows
    per query; the rank window then sorts at most ``limit`` rows per group."""
    first = result_page(items, 1, limit)
    hits = summarise(attach_pages(valid_items(first), fetched))
    w = Window.partitionBy("query").orderBy("pos")
    return (hits.withColumn("rank", F.row_number().over(w).cast("bigint"))
                .withColumn("ml_rank", F.lit(1.0)))
