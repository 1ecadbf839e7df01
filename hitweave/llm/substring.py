"""Substring deduplication by seed and extend, on words.

Windows are ``WINDOW`` consecutive words of one document; a window that also starts earlier (in a
smaller doc_id, or in the same document at an earlier place) is a repeat, and its words go.

1. Seeds: every document's winnowed anchors (``anchors``), each with the run of windows that
   select it, extended both ways into a *segment* and written once as (anchor, content hash,
   document, place).  Within a document a segment's repeats are settled at once.
2. Documents are joined on anchors.  Segments of equal content are whole maximal matches: all but
   the least document's are repeats.
3. Where one anchor has segments of different content, the first of each kind is extended window
   by window: windows are joined on (anchor, window hash), and all but the least document's are
   repeats.  Copies never come this far, and no pair of documents is ever made.
4. Repeats that touch are merged into maximal ones and their words removed.

The joins of 2 and 3 are windows over the anchor: one shuffle each.  Anchors that would make a task
much larger than the mean (found by counting seeds in hash buckets, before any is shuffled) go
another way: aggregations that combine before the shuffle, and joins that Spark can split.  Both
ways give the same rows.

Equality is that of two 64-bit hashes, of the anchor and of all words.

Defined results: a null text has no words; a null doc_id counts as larger than any other; rows
with the same doc_id are not earlier than each other (they are told apart by a 32-bit hash of the text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.anchors import Rolling, first_of, merged, segments, word_units
from hitweave.llm.common import any_ids, mapped, stored, text_or_empty

WINDOW = 20
GRAM = 5
MAX_LONG = 2**63 - 1


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id`` (null as the largest), ``key`` (a 32-bit hash of the text) and ``text`` as bytes."""
    whole = text_or_empty(F.col(f"`{text}`"))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(MAX_LONG)).alias("id"),
                       F.hash(whole).alias("key"), whole.cast("binary").alias("text"))


def occurrences(docs: DataFrame, units, gram: int, window: int, settle_first: bool) -> DataFrame:
    """Segments of each document, one row for those of equal content: ``anchor, content, id, key,
    start, count, times``.  Rows with a null anchor are ranges of windows ``start, count`` found
    repeated within the document: all but the first of equals, or all (``settle_first``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
                s = segments([units(t.as_py()) for t in part.column(2)], gram, window)
                if not len(s.text):
                    continue
                first, times = first_of(s.text, s.anchor, s.content)
                settled = np.flatnonzero((times > 1) if settle_first else ~first)
                texts, start, count = [], [], []
                for i in np.unique(s.text[settled]).tolist():
                    of = settled[s.text[settled] == i]
                    a, e = merged(s.start[of], s.start[of] + s.count[of])
                    texts += [i] * len(a)
                    start.append(a)
                    count.append(e - a)
                keep = np.flatnonzero(first)
                owner = np.concatenate((s.text[keep], np.array(texts, np.int64))).astype(np.int64)
                absent = np.arange(len(owner)) >= len(keep)
                fill = lambda x: pa.array(np.concatenate((x[keep].view(np.int64), np.zeros(len(texts), np.int64))), mask=absent)
                yield pa.RecordBatch.from_arrays([
                    fill(s.anchor), fill(s.content), pa.array(ids[owner]), pa.array(keys[owner]),
                    pa.array(np.concatenate([s.start[keep], *start]).astype(np.int64)),
                    pa.array(np.concatenate([s.count[keep], *count]).astype(np.int64)),
                    pa.array(np.concatenate((times[keep], np.ones(len(texts), np.int64))).astype(np.int64))],
                    ["anchor", "content", "id", "key", "start", "count", "times"])

    return docs.transform(mapped, run, "anchor bigint, content bigint, id bigint, key int, start bigint, count bigint, times bigint")


BUCKETS = 64  # hash buckets per shuffle partition, for finding hot anchors
HOT = 8  # times the mean bucket


def with_hot(seeds: DataFrame) -> DataFrame:
    """Add ``hot``: whether the anchor's hash bucket is ``HOT`` times the mean or more."""
    buckets = BUCKETS * int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod("anchor", F.lit(buckets))
    counts = seeds.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.sum("n")).first()[0] or 0
    hot = stored(counts.filter(F.col("n") > max(64, HOT * mean / buckets)).select("bucket", F.lit(True).alias("hot")), "hot-anchors")
    return seeds.withColumn("bucket", bucket).join(hot, "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("bucket")


def _firsts(seeds: DataFrame) -> DataFrame:
    """Seeds that matter (``with_hot`` rows), with ``least``, the least id of equal content, and
    ``open``, whether the anchor has other contents."""
    by_anchor, by_content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    cold = seeds.filter("not hot").withColumn("least", F.min("id").over(by_content)) \
                .withColumn("open", F.min("content").over(by_anchor) < F.max("content").over(by_anchor))
    hot = seeds.filter("hot")
    kinds = hot.groupBy("anchor", "content").agg(F.min("id").alias("least"))
    several = kinds.groupBy("anchor").agg((F.min("content") < F.max("content")).alias("open"))
    hot = hot.join(kinds, ["anchor", "content"]).join(several, "anchor")
    return cold.unionByName(hot).filter("id > least or open")


def _window_hashes(rows: DataFrame) -> DataFrame:
    """Windows of listed segments, one row a segment: ``anchor, again, id, key, start, windows``,
    and one row more for each window that came before in the same document (``again``; its anchor
    is only a number that spreads such rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, key, text, spans in zip(*(b.column(i) for i in range(4))):
                units, spans = word_units(text.as_py()), spans.as_py()
                spans.sort(key=lambda s: s["start"])
                count = np.array([s["count"] for s in spans])
                start = np.concatenate([np.arange(s["start"], s["start"] + s["count"]) for s in spans])
                anchor = np.repeat(np.array([s["anchor"] for s in spans], np.int64), count)
                window = Rolling(units).spans(start, start + WINDOW).view(np.int64)
                first, _ = first_of(anchor.view(np.uint64), window.view(np.uint64))
                again = np.flatnonzero(~first)
                out = [(s["anchor"], False, s["start"], w) for s, w in zip(spans, np.split(window, np.cumsum(count)[:-1]))]
                out += [(w, True, p, np.array([w])) for p, w in zip(start[again].tolist(), (window[again] ^ start[again]).tolist())]
                n = len(out)
                anchors, repeated, starts, windows = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors, pa.int64()), pa.array(repeated), pa.array(np.full(n, id_.as_py())),
                    pa.array(np.full(n, key.as_py(), np.int32)), pa.array(starts, pa.int64()), pa.array(windows, pa.list_(pa.int64()))],
                    ["anchor", "again", "id", "key", "start", "windows"])

    return rows.select("id", "key", "text", "spans").transform(
        mapped, run, "anchor bigint, again boolean, id bigint, key int, start bigint, windows array<bigint>")


def repeats(docs: DataFrame) -> DataFrame:
    """Ranges of repeated windows, ``id, key, start, count``, of ``keyed`` documents."""
    found = stored(occurrences(docs, word_units, GRAM, WINDOW, settle_first=False), "segments")
    seeds = found.filter("anchor is not null").select(
        "anchor", "content", "id", "key", F.shiftleft("start", 8).bitwiseOR(F.col("count")).alias("place"))  # at most 16 windows
    start, count = F.shiftright("place", 8).alias("start"), F.col("place").bitwiseAND(F.lit(255)).alias("count")
    near = stored(_firsts(with_hot(seeds)).select("anchor", "hot", "id", "key", start, count, (F.col("id") > F.col("least")).alias("later")),
                  "repeated-segments")
    span = ["id", "key", "start", "count"]
    def open_segments(which: str) -> DataFrame:
        spans = near.filter("not later").filter(which).groupBy("id", "key").agg(
            F.collect_set(F.struct("start", "count", "anchor")).alias("spans"))
        return _window_hashes(_with_text(docs, spans, "inner"))

    def exploded(segments: DataFrame) -> DataFrame:
        each = segments.select("anchor", "again", "id", "key", "start", F.posexplode("windows").alias("pos", "window"))
        return each.select("anchor", "window", "again", "id", "key", (F.col("start") + F.col("pos")).alias("start"))

    cold = exploded(open_segments("not hot").repartition("anchor")) \
        .withColumn("least", F.min("id").over(Window.partitionBy("anchor", "window")))
    hot = exploded(open_segments("hot"))
    hot = hot.join(hot.groupBy("anchor", "window").agg(F.min("id").alias("least")), ["anchor", "window"])
    out = found.filter("anchor is null").select(*span).unionByName(near.filter("later").select(*span))
    for w in (cold, hot):
        out = out.unionByName(w.filter("again or id > least").select("id", "key", "start", F.lit(1).cast("bigint").alias("count")))
    return out


def _with_text(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    return docs.join(side, ["id", "key"], how)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            words, removed, digest, plain = [], [], [], []
            for text, spans in zip(part.column(1), part.column(2)):
                w = text.as_py().split()
                n, spans = len(w), spans.as_py()
                if spans:
                    cover = np.zeros(n + 1, np.int64)
                    start = np.array([s["start"] for s in spans])
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + np.array([s["count"] for s in spans]) + WINDOW - 1, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                kept = b" ".join(w)
                words.append(n)
                removed.append(n - len(w))
                digest.append(hashlib.sha256(kept).hexdigest())
                plain.append(kept.decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(digest), pa.array(plain)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


@any_ids
def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept``, the
    words that stay joined by a space."""
    base = keyed(docs, doc_id, text)
    spans = repeats(base).groupBy("id", "key").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    rows = _with_text(base, spans, "left").select(_unkeyed(F.col("id")).alias("doc_id"), "text", "spans")
    return rows.transform(mapped, _kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def _unkeyed(id_: Column) -> Column:
    return F.nullif(id_, F.lit(MAX_LONG))
