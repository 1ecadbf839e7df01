"""Substring deduplication by suffix arrays, on bytes.

Strings are ``WINDOW`` consecutive bytes of one document; every byte that a string covers which
also starts anywhere else goes.  One suffix array of a corpus would need all of it in one place;
here each shard gets an array, and shards are made so that equal strings share one:

1. Every string selects its least 200-gram hash (``anchors``); runs of strings with the same anchor
   form segments.  Equal strings have equal anchors, so a shard is an anchor (several small ones
   are put into one array).  Only anchors that occur twice matter.
2. Segments of equal content enter their shard once, with the number of their occurrences: two
   occurrences alone show all their strings repeated.
3. Shards where segments differ are sorted: LMS substrings recursively, then the array induced in
   linear time (``sais``); permuted common prefixes give, for each suffix, the longest prefix it
   shares with another one.  A string is repeated if that is ``WINDOW`` or more.
4. A shard of over ``SHARD`` bytes (a passage shorter than a string, in very many documents) is
   dealt again by the least 16-gram hashes of a string's first and last 64 bytes, which equal
   strings share too.  Pieces of equal content are merged again, and pieces alone in their shard end there.
5. A shard still over ``SHARD`` (a passage almost as long as a string) gets no array: its strings are
   counted by their 64-bit hash, in an aggregation that combines before the shuffle.

Defined results: null is the empty text; every row is a document, so a repeated row repeats all of
its strings; a null doc_id is an ordinary document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.anchors import Rolling, _least, byte_units, merged, mixed
from hitweave.llm.common import any_ids, mapped, stored
from hitweave.llm.sais import permuted_lcp, suffix_array
from hitweave.llm.substring import MAX_LONG, keyed, occurrences

WINDOW = 400
GRAM = 200
SHARD = 1 << 19
BATCH = 1 << 18  # bytes put into one array; a sort takes some hundred bytes of memory for each
END_GRAM, END = 16, 64


def repeated_strings(segments: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows occur elsewhere among the segments."""
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths + 1) - lengths - 1
    # 1 ends a segment, 0 the whole; a common prefix of ``window`` bytes inside a segment has no end in it.
    text = np.zeros(int(lengths.sum()) + len(segments) + 1, np.uint16)
    text[:-1] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 2
    text[starts + lengths] = 1
    sa = suffix_array(text)
    shared = permuted_lcp(text, sa, window)
    longest = shared.copy()
    longest[sa[:-1]] = np.maximum(longest[sa[:-1]], shared[sa[1:]])
    again = longest >= window
    return [again[a:a + max(n - window + 1, 0)] for a, n in zip(starts.tolist(), lengths.tolist())]


def _segment_texts(rows: DataFrame) -> DataFrame:
    """Text of listed segments: ``anchor, shard, id, key, start, count, bytes, alone``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, key, text, spans in zip(*(b.column(i).to_pylist() for i in range(4))):
                for at in range(0, len(spans), 256):
                    s = spans[at:at + 256]
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x["anchor"] for x in s], pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, id_)),
                        pa.array(np.full(n, key, np.int32)), pa.array([x["start"] for x in s], pa.int64()), pa.array([x["count"] for x in s], pa.int64()),
                        pa.array([text[x["start"]:x["start"] + x["count"] + WINDOW - 1] for x in s], pa.binary()),
                        pa.array([x["alone"] for x in s], pa.bool_())], SEGMENT_NAMES)
    return rows.select("id", "key", "text", "spans").transform(mapped, run, SEGMENT)


SEGMENT_NAMES = ["anchor", "shard", "id", "key", "start", "count", "bytes", "alone"]
SEGMENT = "anchor bigint, shard bigint, id bigint, key int, start bigint, count bigint, bytes binary, alone boolean"


def _end_keys(data: bytes) -> np.ndarray:
    """For each window of a segment, a hash of the least 16-grams of its first and last bytes."""
    rolling, n = Rolling(byte_units(data)), len(data)
    at = np.arange(n - END_GRAM + 1)
    least = _least(rolling.spans(at, at + END_GRAM), END - END_GRAM + 1)
    windows = n - WINDOW + 1
    return mixed(least[:windows] * np.uint64(0x9E3779B97F4A7C15) + least[WINDOW - END:][:windows])


def _dealt_again(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys = _end_keys(row["bytes"])
                cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["anchor"])), pa.array(keys[cut[:-1]].view(np.int64)), pa.array(np.full(n, row["id"])),
                    pa.array(np.full(n, row["key"], np.int32)), pa.array([row["start"] + a for a in cut[:-1]], pa.int64()),
                    pa.array(np.diff(cut).astype(np.int64)),
                    pa.array([row["bytes"][a:e + WINDOW - 1] for a, e in zip(cut, cut[1:])], pa.binary()),
                    pa.array([row["alone"]] * n, pa.bool_())], SEGMENT_NAMES)
    return segments.select(*SEGMENT_NAMES).transform(mapped, run, SEGMENT)


def _string_hashes(pieces: DataFrame) -> DataFrame:
    """Hash of each window of the pieces, one row a piece: ``anchor, shard, id, key, start, alone, windows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for data in b.column(6):
                at = np.arange(len(data.as_py()) - WINDOW + 1)
                hashes.append(Rolling(byte_units(data.as_py())).spans(at, at + WINDOW).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(hashes, pa.list_(pa.int64()))],
                                             ["anchor", "shard", "id", "key", "start", "alone", "windows"])
    return pieces.select("anchor", "shard", "id", "key", "start", "alone", "bytes").transform(
        mapped, run, "anchor bigint, shard bigint, id bigint, key int, start bigint, alone boolean, windows array<bigint>")


def _counted_strings(pieces: DataFrame) -> DataFrame:
    """Repeated windows, ``id, key, start, count``, of the pieces that occur once."""
    hashed = stored(_string_hashes(pieces), "string-hashes")
    each = hashed.select("anchor", "shard", "id", "key", "start", "alone", F.posexplode("windows").alias("pos", "window"))
    again = stored(each.groupBy("anchor", "shard", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-strings")
    return each.filter("alone").join(again, ["anchor", "shard", "window"], "left_semi").select(
        "id", "key", (F.col("start") + F.col("pos")).alias("start"), F.lit(1).cast("bigint").alias("count"))


def _large_shards(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of shards over ``SHARD``: pieces for arrays, and ranges already found repeated."""
    shard, span = ["anchor", "shard"], ["id", "key", "start", "count"]
    dealt = stored(_dealt_again(segments).withColumn("content", F.xxhash64("bytes")), "dealt-segments")
    # Pieces of equal content enter their shard once: two are repeated, whichever it is.
    kinds = stored(dealt.groupBy(*shard, "content").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct(*span, "bytes", "alone")).alias("one"))
        .select(*shard, "content", "n", "one.*").withColumn("alone", F.expr("alone and n = 1")), "dealt-kinds")
    found = dealt.filter("alone").join(kinds.filter("n > 1").select(*shard, "content"), [*shard, "content"], "left_semi").select(*span)
    sizes = stored(kinds.groupBy(*shard).agg(F.sum(F.length("bytes")).alias("n"), F.count(F.lit(1)).alias("pieces"),
                                             F.max("alone").alias("open")).filter("pieces > 1 and open"), "dealt-shards")
    small = kinds.join(sizes.filter(F.col("n") <= SHARD).select(*shard), shard, "left_semi")
    large = kinds.join(sizes.filter(F.col("n") > SHARD).select(*shard), shard, "left_semi")
    return small.select(*SEGMENT_NAMES), found.unionByName(_counted_strings(large))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the segments that occur once, as ranges; rows come shard by shard."""
    def found(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        for (_, id_, key, start, _, alone), again in zip(rows, repeated_strings([r[4] for r in rows])):
            if alone:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
                out += [(id_, key, start + a, e - a) for a, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
        columns = zip(*out) if out else ([],) * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "key", "start", "count"])

    held, size = [], 0
    for b in batches:
        anchor, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 6, 7)))):
            of = (anchor[i], shard[i])
            if size >= BATCH and held[-1][0] != of:
                yield found(held)
                held, size = [], 0
            held.append((of, *row))
            size += len(row[3])
    if held:
        yield found(held)


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Rows of ``occurrences`` whose anchor is in another row too."""
    often = found.filter("anchor is not null").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    return found.join(often, "anchor", "left_semi")


def repeats(docs: DataFrame) -> DataFrame:
    """Ranges of repeated strings, ``id, key, start, count``, of ``keyed`` documents."""
    found = stored(occurrences(docs, byte_units, GRAM, WINDOW, settle_first=True), "segments")
    near = stored(repeated_anchors(found), "repeated-segments")
    kinds = stored(near.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.min(F.struct("id", "key", "start")).alias("one")),
                   "segment-kinds")
    span = ["id", "key", "start", "count"]
    often = kinds.filter("times > 1").select("anchor", "content")
    out = found.filter("anchor is null").select(*span).unionByName(near.join(often, ["anchor", "content"], "left_semi").select(*span))
    # Anchors with different segments, one of which occurs once: one of each kind goes into the shard.
    # (Written, so that both sides of the join are plain, and Spark can split a hot anchor.)
    mixed_shards = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least"))
                          .filter("n > 1 and least = 1"), "mixed-shards")
    ones = kinds.join(mixed_shards.select("anchor"), "anchor", "left_semi").select("anchor", "content", "one.*", (F.col("times") == 1).alias("alone"))
    listed = near.join(ones, ["anchor", "content", "id", "key", "start"], "inner").groupBy("id", "key").agg(
        F.collect_set(F.struct("anchor", "start", "count", "alone")).alias("spans"))
    segments = stored(_segment_texts(docs.join(listed, ["id", "key"])), "open-segments")
    large = segments.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("n")).filter(F.col("n") > SHARD).select("anchor")
    large = stored(large, "large-shards")
    if not large.isEmpty():
        pieces, settled = _large_shards(segments.join(large, "anchor", "left_semi"))
        segments = segments.join(large, "anchor", "left_anti").select(*SEGMENT_NAMES).unionByName(pieces)
        out = out.unionByName(settled)
    ordered = segments.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return out.unionByName(ordered.transform(mapped, _sorted_shards, "id bigint, key int, start bigint, count bigint"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sizes, removed, runs, digest, kept = [], [], [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                a, e = merged(np.array([s["start"] for s in spans or ()], np.int64),
                              np.array([s["start"] + s["count"] + WINDOW - 1 for s in spans or ()], np.int64))
                left = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(text)]))
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(len(a))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


@any_ids
def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and
    ``kept``, the bytes that stay."""
    base = keyed(docs, doc_id, text)
    spans = repeats(base).groupBy("id", "key").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    rows = base.join(spans, ["id", "key"], "left").select(F.nullif(F.col("id"), F.lit(MAX_LONG)).alias("doc_id"), "text", "spans")
    return rows.transform(mapped, _kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
