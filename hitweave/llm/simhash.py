"""SimHash near-duplicates by a binary trie self-join.

1. Every text gets a 64-bit fingerprint; only ``(doc_id, fingerprint)`` goes on, written once.
2. Distinct fingerprints are joined.  Two within 3 bits agree on at least one of four 16-bit
   bands, so they meet in that band's bucket.  A bucket of over ``BUCKET`` members is dealt
   again by the four bands of its remaining bits (same argument), so no task holds a hot one; with
   ``FEW`` bits left a bucket has at most 2^``FEW`` members.
3. In a task, all its buckets are tries over one sorted array: a node is a range of it.  Node
   pairs go down together one bit at a time, adding up differing bits; a pair over the budget is
   dropped, a pair of leaves left over is a link.  Node pairs go down at most ``PAIRS`` at a time, and
   links are folded into a spanning forest as they come; that is returned.
4. Links become components by alternating star contraction; each round is a written table.

Defined results: a text without words has fingerprint zero and links like any other; a null
doc_id has a fingerprint and a component, but is never a component's id unless it has no other
(then null); repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import mapped, stored, text_or_empty

SHINGLE = 3
MAX_BITS = 3
BUCKET = 4096
FEW = 12
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text: bit i is set if it is in over half the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):  # 4096 shingles at a time: 256 KB of bits
        counts += np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, fp)`` per row: a hash of the text, and the fingerprint's 64 bits as a bigint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"), F.col(text).alias("text")) \
               .transform(mapped, run, f"doc_id {kind}, key bigint, fp bigint")


def band_masks(mask: int, bands: int) -> list[int]:
    """Bit masks of the buckets that those of ``mask`` are dealt into: each of the ``bands`` bands of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(free), bands)]


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    """Fingerprints ``fp`` of buckets of mask ``m`` in their buckets of the next level: ``mask, value, fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, masks = b.column(0).to_numpy(), b.column(1).to_numpy()
            each, which = np.unique(masks, return_inverse=True)
            deeper = np.array([band_masks(m, bits + 1) for m in each.view(np.uint64).tolist()], np.uint64).reshape(len(each), bits + 1)
            for k in range(bits + 1):
                mask = deeper[which, k].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(mask & fps), b.column(0)], ["mask", "value", "fp"])
    return rows.select("fp", "m").transform(mapped, run, "mask bigint, value bigint, fp bigint").distinct()


def trie_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs, some at a time: rows with equal ``keys`` whose ``fps`` differ in 1
    to ``bits`` bits.  Rows must be sorted by (key, fp) and distinct."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]  # node pairs, at first each root with itself
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if not len(a0):
            continue
        if len(a0) > PAIRS:
            stack += [(bit, *(x[at:at + PAIRS] for x in (a0, a1, b0, b1, diff))) for at in range(0, len(a0), PAIRS)]
            continue
        zeros = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit) & np.uint64(1)) == 0)))
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]  # where each node's second child begins
        self_pair = a0 == b0
        kids = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        other = ~self_pair
        kids.append((am[other], a1[other], b0[other], bm[other], diff[other] + 1))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*kids))
        ok = (a0 < a1) & (b0 < b1) & (diff <= bits) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, diff = a0[ok], a1[ok], b0[ok], b1[ok], diff[ok]
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)  # what is left of two leaves is compared at once
        x, y = a0[leaves], b0[leaves]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= bits
        yield x[near], y[near]
        stack.append((bit - 1, a0[~leaves], a1[~leaves], b0[~leaves], b1[~leaves], diff[~leaves]))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked position but the first of its component, with that first one."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def trie_forest(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of the ``trie_links``, of which at most ``PAIRS`` and those of one step are held."""
    held, size = [], 0
    for pair in trie_links(keys, fps, bits):
        held.append(pair)
        size += len(pair[0])
        if size > PAIRS:
            held = [forest(len(fps), *map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
    return forest(len(fps), *map(np.concatenate, zip(*held))) if size else (np.zeros(0, np.int64),) * 2


def _links_in_task(bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not parts:
            return
        mask, value, fp = (np.concatenate(x) for x in zip(*parts))
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
        bucket, fps = np.cumsum(new), fp.view(np.uint64)
        order = np.lexsort((fps, bucket))
        bucket, fps = bucket[order], fps[order]
        at = 0
        while at < len(fps):  # some whole buckets at a time
            end = min(at + most, len(fps))
            end = np.searchsorted(bucket, bucket[end - 1], "right") if end < len(fps) else end
            b, f = bucket[at:end], fps[at:end]
            child, root = trie_forest(b, f, bits)
            yield pa.RecordBatch.from_arrays([pa.array(f[child].view(np.int64)), pa.array(f[root].view(np.int64))], ["u", "v"])
            at = end
    return run


def links(distinct: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints of column ``fp``: enough of all pairs
    within ``bits`` bits that the same fingerprints are connected."""
    rows, done = distinct.withColumn("m", F.lit(0).cast("bigint")), []
    while True:
        dealt = _dealt(rows, bits)
        hot = dealt.filter(F.bit_count("mask") < 64 - max(FEW, bits)).groupBy("mask", "value").count()
        hot = stored(hot.filter(F.col("count") > bucket).drop("count"), "hot-buckets")
        if hot.isEmpty():
            done.append(dealt)
            break
        dealt = stored(dealt, "bucket-rows")
        done.append(dealt.join(hot, ["mask", "value"], "left_anti"))
        rows = dealt.join(hot, ["mask", "value"], "left_semi").select("fp", F.col("mask").alias("m"))
    out = None
    for part in done:
        found = part.repartition("mask", "value").sortWithinPartitions("mask", "value") \
                    .transform(mapped, _links_in_task(bits, 16 * bucket), "u bigint, v bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` (``u``, ``v``) that is not its component's
    least one, by alternating large-star and small-star rounds."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "edges")
        if (after := state(edges)) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``, and
    ``key`` and ``root``, which name the text and the component within this run."""
    rows = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits, bucket))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left") \
                     .select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(linked.join(ids, "root").select("fp", "component_id", "root"), "classes")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key", "root")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: the row whose doc_id is the
    component's.  Of several such rows the least by (hash of the text, all columns) stays."""
    found = near_duplicates(docs, doc_id, text, shingle, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.groupBy("root", F.col("doc_id").alias("__id")).agg(
        F.min("key").alias("__key"), F.count(F.lit(1)).alias("__n")).withColumnRenamed("root", "__root")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col(f"`{doc_id}`").alias("__doc"), F.xxhash64(text_or_empty(text)).alias("__k"))
    kept = rows.join(stay, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")))
    single = kept.filter("__n = 1").select("__row.*")
    tied = kept.filter("__n > 1").groupBy("__root").agg(F.min("__row").alias("__row")).select("__row.*")
    return single.unionByName(tied)
