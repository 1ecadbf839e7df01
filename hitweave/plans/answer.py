"""M8: answer a table of search requests end to end, set-oriented.

requests -> clean + cache key -> valid snapshot? reuse its list
                               : stored hits in the request's time window (T1 order)
                                 U fresh hits of the query (a valid 'fresh' snapshot of the
                                   query, else M1 search; no time filter)
                                 -> merge + rank (M4, per cache key) -> format (F10)
The result carries ``from_cache``; ``refresh_snapshots`` writes the computed and the searched lists back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.functions.timefn import window_cutoff_col
from hitweave.operators import merge, snapshots
from hitweave.operators.filters import clean_queries
from hitweave.plans.search import search_hits
from hitweave.session import materialize

OUTPUT = ("cache_key", "query", "time_filter", "rank", "title", "link", "snippet", "ml_rank", "rag_summary",
          "click_count", "relevance", "from_cache")


def answer_requests(requests: DataFrame, stored: DataFrame, items: DataFrame, fetched: DataFrame,
                    snapshot_table: DataFrame, now) -> DataFrame:
    return answers_and_searches(requests, stored, items, fetched, snapshot_table, now)[0]


def answers_and_searches(requests: DataFrame, stored: DataFrame, items: DataFrame, fetched: DataFrame,
                         snapshot_table: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The answers, and the fresh lists that were searched for them (``query, rank``, hit fields)."""
    req = clean_queries(requests).select("query", "time_filter", "cache_key").distinct()
    status = snapshots.snapshot_reuse(req, snapshot_table, now)
    hit_keys = status.filter(F.col("status") == "hit").select("cache_key")
    miss = req.join(status.filter(F.col("status") == "miss"), "cache_key", "left_semi")

    reused = (snapshots.snapshot_read(snapshot_table, hit_keys, now)
                       .join(req, "cache_key")
                       .withColumn("from_cache", F.lit(True)))

    # stored side: each missed request sees its query's rows inside its window
    cut = window_cutoff_col(F.col("time_filter"), now)
    st = (miss.join(stored, "query")
              .filter(cut.isNull() | (F.col("created") >= cut)))
    # the stored order only orders rows here: a sort key, no dense numbering pass
    st = st.withColumn("pos", merge.stored_sort_key())

    # fresh side: a missed query's fresh hit list comes from a valid 'fresh' snapshot
    # (keyed by the query) when there is one; only the other queries are searched
    # (and cut to 10 before pages are joined).  Those lists are written once: they are
    # merged here and kept for the requests to come.
    missed_queries = miss.select("query").distinct()
    cached = (snapshots.snapshot_read(snapshot_table, missed_queries.select(F.col("query").alias("cache_key")),
                                      now, kind="fresh")
              .select(F.col("cache_key").alias("query"), "rank", "title", "link", "snippet", "ml_rank", "rag_summary"))
    to_search = missed_queries.join(cached.select("query").distinct(), "query", "left_anti")
    wanted = items.join(to_search, "query", "left_semi")
    searched = materialize(search_hits(wanted, fetched).select("query", "rank", "title", "link", "snippet", "ml_rank", "rag_summary"),
                           "searched-hits")
    fresh = searched.unionByName(cached).select(
        "query", merge.position_sort_key(F.col("rank") - 1).alias("pos"), "title", "link", "snippet", "ml_rank",
        "rag_summary", F.lit(0).alias("click_count"), F.lit(False).alias("relevance"))
    fr = miss.join(fresh, "query")

    merged = merge.merge_rank(st, fr, key="cache_key")
    shaped = merge.format_results(merged, key="cache_key", order_col="rank", renumber=False)
    computed = shaped.join(req, "cache_key").withColumn("from_cache", F.lit(False))
    cols = [F.col(c) for c in OUTPUT]
    return computed.select(*cols).unionByName(reused.select(*cols)), searched


def refresh_snapshots(snapshot_table: DataFrame, answers: DataFrame, now, ttl_seconds: int | None = None,
                      searched: DataFrame | None = None) -> DataFrame:
    """Write the lists computed for ``answers`` back (S7) as a new version next to the old rows, and the
    ``searched`` fresh lists as well, so that the next request of a query is not searched again.
    Readers take the latest version per key, and ``snapshot_purge`` drops the others later.
    Reused lists are not rewritten."""
    version = snapshots.next_version(snapshot_table)
    out = snapshot_table.select(*snapshots.SNAPSHOT_COLUMNS)
    computed = answers.filter(~F.col("from_cache"))
    out = out.unionByName(snapshots.snapshot_write(computed, now, ttl_seconds=ttl_seconds, version=version))
    if searched is not None:
        lists = searched.withColumns({"click_count": F.lit(0), "relevance": F.lit(False)})
        out = out.unionByName(snapshots.snapshot_write(lists, now, "query", "fresh", ttl_seconds, version=version))
    return out
