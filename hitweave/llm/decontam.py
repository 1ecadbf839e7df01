"""Benchmark decontamination by winnowing, in DataFrame operations only.

A *window* is 13 consecutive words of a benchmark item (an item of fewer words is one window).
Winnowing keeps, for every span of ``t`` words, the least hash of its k-grams; as that depends on
the span alone, every occurrence of a window starts where the document's kept hash equals the
window's.  So no shared span of ``t`` words can be missed.

1. Documents: kept hashes per text, distinct, written once with the word count.
2. Join with the benchmark's kept hashes.  Spark broadcasts that side only while its size on
   file is under ``spark.sql.autoBroadcastJoinThreshold``.
3. Hits are extended in the matched documents only: at each place whose kept hash matched, the
   window's words are compared with the benchmark's; the union of the equal windows is hit.

Hashes are taken of words each put through ``lower`` by itself (cheaper than A-Z lowering; equal words
stay equal, which they need not in a text lowered whole: a capital sigma depends on its neighbours);
the comparison of words is exact.  Words joined by a space are compared as one string.

Defined results: null text has no words; an item without words has no window; a null item_id
still marks words but is not listed; repeated rows each get their row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import ascii_lower, split_words, stored, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same, of a text that is not lowered
WINDOW = 13


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _ahead(col: str, n: int) -> Column:
    """The array without its first ``n`` elements."""
    return F.slice(col, n + 1, F.greatest(F.size(col) - n, F.lit(0)))


def _rolled(df: DataFrame, col: str, width: int, combine, repeats: bool) -> DataFrame:
    """``col`` replaced by the ``combine`` of each ``width`` neighbours (the first
    ``size - width + 1`` elements are whole; the rest are partial).  Doubling: widths 1, 2, 4 ...
    are built one from another, and ``width`` from two of them (``repeats``: overlap is harmless)
    or from its binary digits."""
    have, span = [(1, col)], 1
    while span * 2 <= width:
        df = df.withColumn(f"{col}_{span * 2}", F.zip_with(f"{col}" if span == 1 else f"{col}_{span}",
                                                           _ahead(col if span == 1 else f"{col}_{span}", span), combine))
        span *= 2
        have.append((span, f"{col}_{span}"))
    if repeats:
        parts = [(0, have[-1][1])] + ([(width - span, have[-1][1])] if width > span else [])
    else:
        parts, at = [], 0
        for size, name in reversed(have):
            if at + size <= width:
                parts.append((at, name))
                at += size
    acc = f"{col}_{width}w"
    df = df.withColumn(acc, F.col(parts[0][1]))
    for at, name in parts[1:]:
        df = df.withColumn(acc, F.zip_with(acc, _ahead(name, at), combine))
    return df.withColumn(col, F.col(acc)).drop(acc, *[n for s, n in have if s > 1])


def kept_hashes(df: DataFrame, words_col: str, out: str, span: int) -> DataFrame:
    """Add ``out``: per place, the least k-gram hash among the ``span`` words that start there
    (empty for shorter texts)."""
    k = max(1, span // 2)
    df = df.withColumn(out, F.transform(words_col, lambda w: F.xxhash64(F.lower(w))))
    df = _rolled(df, out, k, lambda a, b: F.xxhash64(a, b), False)
    df = df.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (k - 1), F.lit(0))))
    df = _rolled(df, out, span - k + 1, lambda a, b: F.least(a, b), True)
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (span - k), F.lit(0))))


def benchmark_windows(bench: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(window, n, items)``: each distinct window, its words and the ids of its items."""
    w = bench.select(F.col(item_id).cast("string").alias("item"), words(text_or_empty(text)).alias("w")).filter(F.size("w") > 0)
    spans = w.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))),
        lambda i: F.slice("w", i, window))).alias("s"))
    return spans.select(F.array_join("s", " ").alias("window"), F.size("s").alias("n"), "item") \
                .groupBy("window", "n").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items`` (the sorted item ids)."""
    windows = stored(benchmark_windows(bench, window=window), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    short = [n for n in lengths if n < window]
    # One family of kept hashes for whole windows, one for all shorter items together.
    families = ([(window, [window])] if window in lengths else []) + ([(short[0], short)] if short else [])

    loose = split_words(F.col("t"), ANY_CASE)
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t")) \
               .withColumn("key", F.xxhash64("t"))
    prints = base.withColumn("w", loose)
    for span, _ in families:
        prints = kept_hashes(prints, "w", f"h{span}", span)
    prints = stored(prints.select("doc_id", "key", F.size("w").cast("bigint").alias("n_words"),
                                  *[F.array_distinct(f"h{s}").alias(f"h{s}") for s, _ in families]), "doc-prints")

    found = []
    for span, sizes in families:
        # A window's own hash: that of its first ``span`` words.
        own = kept_hashes(windows.filter(F.col("n").isin(sizes)).withColumn(
            "lw", F.split("window", " ")), "lw", "h", span)
        own = stored(own.select(F.get("h", 0).alias("h")).distinct(), "bench-prints")
        found.append(prints.select("doc_id", "key", F.explode(f"h{span}").alias("h")).join(own, "h")
                     .groupBy("doc_id", "key").agg(F.collect_set("h").alias("matched"))
                     .withColumn("span", F.lit(span)))

    result = None
    if found:
        hits = [_extended(base, f, span, sizes, windows) for f, (span, sizes) in zip(found, families)]
        result = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "key").agg(
            F.collect_set(F.struct("start", "n")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        covered = F.aggregate(  # union of the intervals, in order of their starts
            F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda a, s: F.struct(F.greatest(a.end, s.start + s.n).alias("end"),
                                  (a.sum + F.greatest(s.start + s.n - F.greatest(a.end, s.start), F.lit(0))).alias("sum")),
            lambda a: a.sum)
        result = result.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), covered.alias("n_hit"), "items")
        prints = prints.join(result, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    else:
        prints = prints.withColumns({"n_hit": F.lit(0), "items": F.lit(None).cast("array<string>")})
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return prints.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"), "key")


def _extended(base: DataFrame, found: DataFrame, span: int, sizes: list[int], windows: DataFrame) -> DataFrame:
    """Windows that truly occur in the matched documents: ``doc_id, key, start, n, items``."""
    f = found.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "matched")
    docs = base.join(f, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    docs = kept_hashes(docs.withColumn("lw", split_words(F.col("t"), ANY_CASE)), "lw", "h", span)
    places = docs.select("doc_id", "key", words(F.col("t")).alias("w"), F.filter(
        F.transform("h", lambda h, i: F.when(F.array_contains("matched", h), i)), lambda i: i.isNotNull()).alias("at"))
    spans = places.select("doc_id", "key", F.explode(F.flatten(F.transform("at", lambda i: F.array(*[
        F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("window"))
        for n in sizes])))).alias("s"))
    return spans.select("doc_id", "key", "s.start", "s.n", "s.window").join(windows, ["window", "n"]) \
                .select("doc_id", "key", "start", "n", "items")


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names."""
    bad = contamination(docs, bench, doc_id, text).filter("contaminated") \
        .select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.xxhash64(text_or_empty(F.col(f"`{text}`"))).alias("key"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")
