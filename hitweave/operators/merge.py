"""Stored + fresh hits -> one ranked list per result key; formatting; counts; order.

Per result key (a query, or a cache key ``query[:time_filter]``):

* both sides present: union (stored first), keep-first dedup on link, composite
  ``rank_score = 2*relevance + clicks/max(clicks) + ml_rank/max(ml_rank)``
  (a term is 0 when its max is not positive), ranked by score;
* one side empty: that side unchanged, in its own order, ``rank_score`` null.

Normalisers are aggregated per key and joined back (one row per key), never an
unbounded window; the final numbering uses ``ordinal`` (range-partitioned), so
a key holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators.ordinal import ordinal
from hitweave.session import materialize

ORDER_DIGITS = 9
WEIGHTS = (2.0, 1.0, 1.0)   # relevance, clicks, ml_rank
SOURCE_PRIORITY = {"db": 0, "new": 1}

FIELDS = ("title", "link", "snippet", "ml_rank", "rag_summary", "click_count", "relevance")


def stored_sort_key() -> F.Column:
    """T1 as one ascending sort key (struct), for when the stored order is only
    needed to order rows (merge), not as a dense number: relevance desc nulls
    first, click_count desc nulls first, rank asc nulls last.  Pair with
    :func:`position_sort_key` on the other side; ties go on to ``link``."""
    rel = F.when(F.col("relevance").isNull(), 0).when(F.col("relevance"), 1).otherwise(2)
    clicks = F.when(F.col("click_count").isNull(), F.lit(-(2 ** 63))).otherwise(-F.col("click_count").cast("bigint"))
    rank = F.coalesce(F.col("rank").cast("bigint"), F.lit(2 ** 63 - 1))
    return F.struct(rel.cast("int").alias("a"), clicks.alias("b"), rank.alias("c"))


def position_sort_key(pos) -> F.Column:
    """A plain position as a sort key of the same type as :func:`stored_sort_key`."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.struct(F.lit(0).alias("a"), p.cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"))


def _side(df: DataFrame, key: str, source: str) -> DataFrame:
    """Align a side: missing fields null, types fixed, source tag and priority.
    ``pos`` is a number or a sort key struct (both sides must agree)."""
    cols = {c: (F.col(c) if c in df.columns else F.lit(None)) for c in FIELDS}
    is_struct = dict(df.dtypes)["pos"].startswith("struct")
    return df.select(
        F.col(key).alias(key), (F.col("pos") if is_struct else F.col("pos").cast("bigint")).alias("pos"),
        cols["title"].cast("string").alias("title"), cols["link"].cast("string").alias("link"),
        cols["snippet"].cast("string").alias("snippet"), cols["ml_rank"].cast("double").alias("ml_rank"),
        cols["rag_summary"].cast("string").alias("rag_summary"),
        cols["click_count"].cast("bigint").alias("click_count"), cols["relevance"].cast("boolean").alias("relevance"),
        F.lit(source).alias("source"), F.lit(SOURCE_PRIORITY[source]).alias("__prio"))


def stored_order(stored: DataFrame, key: str = "query", out: str = "position", base: int = 1) -> DataFrame:
    """Stored hits of each key ordered ``relevance desc, click_count desc,
    rank asc`` (nulls first on the descending keys, last on rank), then link."""
    return ordinal(stored, [key], [F.col("relevance").desc_nulls_first(), F.col("click_count").desc_nulls_first(),
                                   F.col("rank").asc_nulls_last(), F.col("link")], out=out, base=base)


def with_side_sizes(u: DataFrame, key: str) -> DataFrame:
    sizes = u.groupBy(key).agg(F.count_if(F.col("source") == "db").alias("__n_db"),
                               F.count_if(F.col("source") == "new").alias("__n_new"))
    return u.join(sizes, key)


def union_sides(stored: DataFrame, fresh: DataFrame, key: str = "query") -> DataFrame:
    """Both sides aligned and tagged, with per-key side sizes."""
    return with_side_sizes(_side(stored, key, "db").unionByName(_side(fresh, key, "new")), key)


def keep_first(df: DataFrame, key: str = "query") -> DataFrame:
    """One row per (key, link), the first by (stored before fresh, pos).
    An aggregate with partial aggregation, not a window over the key."""
    fields = [c for c in df.columns if c not in (key, "link")]
    first = df.groupBy(key, "link").agg(F.min_by(F.struct(*fields), F.struct("__prio", "pos")).alias("__f"))
    return first.select(key, "link", *[F.col(f"__f.{c}").alias(c) for c in fields])


def merge_dedup(stored: DataFrame, fresh: DataFrame, key: str = "query") -> DataFrame:
    """Union of both sides with keep-first dedup on link, for every key."""
    return keep_first(union_sides(stored, fresh, key), key).drop("__n_db", "__n_new")


def merge_rank(stored: DataFrame, fresh: DataFrame, key: str = "query", weights=WEIGHTS) -> DataFrame:
    """M4: the merged, scored, ranked list of every key (``rank`` 1..n).

    ``stored`` and ``fresh`` carry ``key``, ``pos`` (their own order) and the hit
    fields; fields missing on a side are null (F11)."""
    # Both sides are written once, with a number for each row.  Everything up to the ranks works on
    # narrow columns; the texts come back at the end, in one join.
    sides = _side(stored, key, "db").unionByName(_side(fresh, key, "new"))
    texts = ["title", "snippet", "rag_summary"]
    written = materialize(sides.withColumn("__row", F.monotonically_increasing_id()), "merge-sides")
    u = with_side_sizes(written.drop(*texts), key)
    both = (F.col("__n_db") > 0) & (F.col("__n_new") > 0)
    merged = keep_first(u.filter(both).drop("__n_db", "__n_new"), key)
    merged = merged.withColumns({
        "click_count": F.coalesce(F.col("click_count"), F.lit(0)),
        "relevance": F.coalesce(F.col("relevance"), F.lit(False)),
        "ml_rank": F.coalesce(F.col("ml_rank"), F.lit(0.0)),
    })
    norms = merged.groupBy(key).agg(F.max("click_count").alias("__max_c"), F.max("ml_rank").alias("__max_m"))
    w_rel, w_click, w_ml = weights
    scored = merged.join(norms, key).withColumn(
        "rank_score",
        F.lit(float(w_rel)) * F.col("relevance").cast("int")
        + F.when(F.col("__max_c") > 0, F.lit(float(w_click)) * F.col("click_count") / F.col("__max_c")).otherwise(0.0)
        + F.when(F.col("__max_m") > 0, F.lit(float(w_ml)) * F.col("ml_rank") / F.col("__max_m")).otherwise(0.0),
    ).drop("__max_c", "__max_m")
    single = u.filter(~both).drop("__n_db", "__n_new").withColumn("rank_score", F.lit(None).cast("double"))
    allrows = scored.unionByName(single)
    ranked = ordinal(allrows, [key], [F.round("rank_score", ORDER_DIGITS).desc_nulls_last(), F.col("__prio"),
                                      F.col("pos"), F.col("link")], out="rank", base=1)
    return ranked.drop("__prio").join(written.select("__row", *texts), "__row").drop("__row")


def format_results(df: DataFrame, key: str = "query", order_col: str = "rank", renumber: bool = True) -> DataFrame:
    """The displayed shape.  link = url -> link -> '#'; title -> 'Untitled';
    snippet = snippet -> description -> 'No description available';
    ml_rank = score -> ml_rank -> 0.0; rag_summary = summary -> rag_summary;
    click_count 0 and relevance false by default; rank renumbered 1..n (pass
    ``renumber=False`` when ``order_col`` already is 1..n per key)."""
    def pick(names, default=None):
        cols = [F.col(n) for n in names if n in df.columns]
        if default is not None:
            cols.append(F.lit(default))
        return F.coalesce(*cols) if len(cols) > 1 else (cols[0] if cols else F.lit(None))

    shaped = df.select(
        key, F.col(order_col).alias("__order"),
        pick(["title"], "Untitled").cast("string").alias("title"),
        pick(["url", "link"], "#").cast("string").alias("link"),
        pick(["snippet", "description"], "No description available").cast("string").alias("snippet"),
        pick(["score", "ml_rank"], 0.0).cast("double").alias("ml_rank"),
        pick(["summary", "rag_summary"]).cast("string").alias("rag_summary"),
        pick(["click_count"], 0).cast("bigint").alias("click_count"),
        pick(["relevance"], False).cast("boolean").alias("relevance"),
    )
    if not renumber:  # the order column is already 1..n per key
        return shaped.withColumn("rank", F.col("__order").cast("bigint")).drop("__order")
    return ordinal(shaped, [key], [F.col("__order"), F.col("link")], out="rank", base=1).drop("__order")


def result_counts(stored: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Per request (query, time_filter), the number of stored hits in its
    window.  Stored rows are pre-aggregated per query (one row per query) before
    meeting the requests."""
    from hitweave.functions.timefn import TIME_FILTER_DAYS, days_ago
    aggs = [F.count(F.lit(1)).alias("__n_")]
    aggs += [F.count_if(F.col("created") >= days_ago(now, d)).alias(f"__n_{name}") for name, d in TIME_FILTER_DAYS.items()]
    per_query = stored.groupBy("query").agg(*aggs)
    r = requests.select("query", F.coalesce(F.col("time_filter"), F.lit("")).alias("time_filter"))
    j = r.join(per_query, "query", "left")
    pick = F.when(F.col("time_filter") == "", F.col("__n_"))
    for name in TIME_FILTER_DAYS:
        pick = pick.when(F.col("time_filter") == name, F.col(f"__n_{name}"))
    return j.select("query", "time_filter", F.coalesce(pick, F.lit(0)).cast("bigint").alias("n_results"))
