"""Ranked lexical search by scanning the documents for the terms of all items at once.

There is no index of the documents.  The terms of all items form one Aho-Corasick automaton, each
with a space on either side, so that only whole terms match; its outputs are term numbers, which
lead to the items that hold them.  The automaton is broadcast, every document is read once, and what
leaves the scan is narrow: the document's number of terms and how often it holds which item term.

1. Scan: ``doc_id, n, terms, counts`` for every document, written once.
2. Document counts of the terms, the number of documents and of all their terms are aggregated from
   that table; the term weights follow.
3. Scores: each task scores its documents for all items in numpy and keeps the best ``k`` of each
   item; those are cut to ``k`` in two steps, over hashed parts of the documents and then over all.

The items are handled in blocks of at most about ``ITEMS`` items and ``BLOCK_BYTES`` bytes of terms (one
block for any usual set of items), so what is broadcast does not grow with them: each block is
a scan of its own.

Defined results: null and empty texts hold no term; rows with the same item_id are one item with the
terms of all of them (a null item_id is an ordinary one); an item without terms, or whose terms no
document holds, has no rows.  Every row of ``docs`` is a document, so a repeated row can be listed
twice; of equal scores the smaller doc_id is first, null last.  Other columns do not matter.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import ascii_lower, mapped, stored, text_or_empty

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # fixed value: what a term is
ITEMS = 4096
BLOCK_BYTES = 1 << 24
PIECE = 1 << 20      # bytes of a text put through the automaton at once
CELLS = 1 << 21      # scores held at once, documents times items
PARTS = 32           # hashed parts of the documents in the first cut to ``k``

# A-Z become a-z, and every ASCII character that no term holds becomes a space.
_FOLDED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_BUILT: dict[str, ahocorasick.Automaton] = {}


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``: the different terms of each item."""
    found = F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(found).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each of ``terms`` between spaces; its outputs are their numbers."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term} ", i)
    found.make_automaton()
    return found


def folded(data: bytes) -> Iterator[bytes]:
    """A text with its terms in lower case and spaces between them, in pieces that end at spaces."""
    spaced, at = data.translate(_FOLDED), 0
    while at < len(spaced):
        end = spaced.find(b" ", at + PIECE) if at + PIECE < len(spaced) else -1
        end = len(spaced) if end < 0 else end
        yield b" %b " % spaced[at:end]
        at = end


def term_counts(found: ahocorasick.Automaton, data: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often it holds each term of the automaton."""
    n, counts, number = 0, Counter(), itemgetter(1)
    for piece in folded(data):
        blank = np.frombuffer(piece, np.uint8) == 32
        n += int(np.count_nonzero(blank[:-1] & ~blank[1:]))
        counts.update(map(number, found.iter(piece.decode())))
    return n, counts


def scanned(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` per row of ``docs``."""
    shared, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:  # once in a process
            _BUILT.clear()
            _BUILT[name] = automaton(shared.value)
        found = _BUILT[name]
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sizes, ends, numbers, counts = [], [0], [], []
                for x in part.column(1):
                    n, held = term_counts(found, x.as_py())
                    sizes.append(n)
                    numbers += held.keys()
                    counts += held.values()
                    ends.append(len(numbers))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).cast("binary").alias("text")).transform(
        mapped, run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Best:
    """The ``k`` best documents of each item among those shown so far."""

    def __init__(self, k: int, items: int):
        self.k, self.least = k, np.ones(items, np.int64)  # scores from here on can be among the best
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def show(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[row, item], ids[row], null[row]))
        self.size += len(row)
        if self.size > max(1 << 18, 4 * self.k * len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, ids, null = (np.concatenate(c) for c in zip(*self.rows))
        order = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        sort = np.lexsort((order, null, -score, item))
        item = item[sort]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, int)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        stay = place < self.k
        last = place == self.k - 1
        kept = (item[stay], score[sort][stay], ids[sort][stay], null[sort][stay])
        self.least[item[last]] = score[sort][last]
        self.rows, self.size = [kept], len(kept[0])
        return kept


def scored(found: DataFrame, documents: int, all_terms: int, weights: np.ndarray, starts: np.ndarray, holders: np.ndarray,
           items: int, k: int) -> DataFrame:
    """The best ``k`` documents of each item in each task: ``item, doc_id, score``.  Term ``t`` is
    held by the items ``holders[starts[t]:starts[t + 1]]``."""
    shared = found.sparkSession.sparkContext.broadcast((weights, starts, holders))
    kind = dict(found.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, holders = shared.value
        best, id_type = Best(k, items), None
        for b in batches:
            id_type = b.schema.field(0).type
            ids, null = _ids(b.column(0))
            n = b.column(1).to_numpy()
            m = 100 - 50 + 50 * n * documents // all_terms
            term, tf = (b.column(c).flatten().to_numpy() for c in (2, 3))
            row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            times = starts[term + 1] - starts[term]
            work = np.concatenate(([0], np.cumsum(np.bincount(row, times, b.num_rows).astype(np.int64) + items)))
            at = 0
            while at < b.num_rows:  # so many documents that scores and terms stay within CELLS
                end = max(at + 1, int(np.searchsorted(work, work[at] + CELLS, "right")) - 1)
                lo, hi = np.searchsorted(row, (at, end))
                t = times[lo:hi]
                place = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(starts[term[lo:hi]], t)
                scores = np.zeros((end - at) * items, np.int64)
                np.add.at(scores, np.repeat(row[lo:hi] - at, t) * items + holders[place], np.repeat(part[lo:hi], t))
                best.show(scores.reshape(-1, items), ids[at:end], null[at:end])
                at = end
        if best.rows:
            item, score, ids, null = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, id_type, mask=null), pa.array(score, pa.int64())],
                                             ["item", "doc_id", "score"])

    return found.filter("size(terms) > 0").select("doc_id", "n", "terms", "counts").transform(
        mapped, run, f"item int, doc_id {kind}, score bigint")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers or, of other types, as objects; and which are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null
    ids = np.empty(len(column), object)
    ids[:] = [x if x is not None else "" for x in column.to_pylist()]
    return ids, null


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_items: int = ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``, ranks from 1."""
    spark = docs.sparkSession
    pairs = stored(item_terms(items, item_id, item_text), "item-terms")
    size = pairs.agg(F.count_distinct("item_id"), F.max(F.isnull("item_id")), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    blocks = max(math.ceil((size[0] + bool(size[1])) / block_items), math.ceil(size[2] / block_bytes))
    item_type, id_type = pairs.schema["item_id"].dataType, docs.schema[doc_id].dataType
    out = None
    for block in range(blocks):
        # The terms of a block: about ``block_bytes`` at most.
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        ids = list({r["item_id"]: None for r in rows})
        number_of = {x: i for i, x in enumerate(ids)}
        terms = sorted({r["term"] for r in rows})
        term_no = {t: i for i, t in enumerate(terms)}
        held = np.array(sorted((term_no[r["term"]], number_of[r["item_id"]]) for r in rows), np.int64)
        starts = np.searchsorted(held[:, 0], np.arange(len(terms) + 1))
        found = stored(scanned(docs, terms, doc_id, text), "term-counts")
        documents, all_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row per term of the block.
        holding = {r["term"]: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        weights = np.array([weight(documents, holding.get(t, 0)) for t in range(len(terms))], np.int64)
        near = scored(found, documents, max(all_terms, 1), weights, starts, held[:, 1], len(ids), k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_type.simpleString()}")
        best = near.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")  # at most about ``block_items`` rows
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", "part").orderBy(*order)
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", F.row_number().over(some)) \
             .filter(F.col("rank") <= k)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))) \
              .filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
