"""What the classifiers share: the split of labelled rows, a bounded training sample, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import mapped

GROUP_BYTES = 1 << 18  # texts are put through numpy together up to this size


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training; a null id has no label and is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id",
                  text: str = "text") -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``per_class`` labelled texts of either class, whole, and how many rows of each
    class there are.  Only rows that are not held out are read; the sample is by hash of the id,
    so it does not depend on the order or the partitions of the tables."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")) \
                  .filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(label), F.col("__id").cast("string"))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("__y") == y).orderBy(order, "__id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # Bounded by 2 * per_class rows of two numbers.
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t")) \
               .join(F.broadcast(sample), "__id").distinct().orderBy(F.xxhash64(F.col("__id").cast("string")), "__id", "__t").collect()
    return [(bytes(r["__t"]), r["__y"]) for r in rows], counts


def weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Per sampled row, so that classes weigh as in all labelled rows; their mean is 1."""
    total = sum(counts.values())
    share = np.array([max(np.mean(y == c), 1e-9) for c in (0, 1)])
    return (np.array([counts.get(c, 0) / total for c in (0, 1)]) / share)[y]


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted`` and ``key``, a hash of
    the text.  ``score`` takes UTF-8 texts."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t.as_py() for t in part.column(3)]
                s = np.concatenate([score(g) for g in grouped(texts)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "key", "score", "predicted"])

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.xxhash64(whole).alias("key"),
                       whole.cast("binary").alias("text")).transform(
        mapped, run, f"doc_id {kind}, held_out boolean, key bigint, score double, predicted int")


class Adam:
    """Adam steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= scale * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
