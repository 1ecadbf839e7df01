"""Centroid clustering: k-means rounds on integer vectors, nearest centroids by Orchard's search.

Each centroid has a list of the others, nearest first.  A vector starts at one centroid and goes
through that centroid's list; a closer centroid takes over at once, with its own list from the
front.  Centroids looked at are marked and not measured again.  A list ends where its next centroid is
strictly more than twice as far from the present centroid as the vector is: by the triangle inequality
nothing beyond is as near, and ties, which go to the smaller number, lie at twice the distance at most.

A round is one pass over the vectors: each task sends the sums of its clusters, at most ``k`` rows, and
the driver holds ``k`` centroids.  All arithmetic is on integers and exact.

Defined results: kept are vectors with exactly ``dims`` components, none null or non-finite; a null
vector is not kept.  Integers are held within +-``LIMIT`` so that distances fit 64 bits.  Every row is a
vector: repeated rows count as often as they occur, and can both be starting centroids; a null
vec_id counts as the empty text.  With fewer than ``k`` kept vectors there are fewer clusters; an empty
table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import mapped, stored

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LIMIT = 1 << 26
ROWS = 4096  # vectors put through numpy together


class Orchard:
    """Exact nearest centroids, with each centroid's list of the others."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        self.gaps = np.array([((centroids - c) ** 2).sum(1) for c in centroids]).reshape(k, k)
        order = np.argsort(self.gaps + 0, axis=1, kind="stable")
        self.lists = np.array([row[row != c] for c, row in enumerate(order)]).reshape(k, k - 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        n, k = len(x), len(self.centroids)
        at = np.zeros(n, np.int64)
        distance = ((x - self.centroids[0]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(going):
            here = at[going]
            other = self.lists[here, place[going]]
            near = self.gaps[here, other] <= 4 * distance[going]
            going, other = going[near], other[near]
            place[going] += 1
            new = ~seen[going, other]
            v, j = going[new], other[new]
            seen[v, j] = True
            d = ((x[v] - self.centroids[j]) ** 2).sum(1)
            closer = (d < distance[v]) | (d == distance[v]) & (j < at[v])
            v = v[closer]
            at[v], distance[v], place[v] = j[closer], d[closer], 0
            going = going[place[going] < k - 1]
        return at, distance


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: kept vectors with components floor(scale * x)."""
    kind = dict(vectors.dtypes)[vec_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = np.flatnonzero(b.column(1).value_lengths().fill_null(0).to_numpy() == dims)
            b = b.take(pa.array(right))
            x = b.column(1).flatten()
            whole = x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = (whole & np.isfinite(x)).all(1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(x[good] * scale), -LIMIT, LIMIT).astype(np.int32)
            offsets = pa.array(np.arange(len(v) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))],
                                             ["vec_id", "v"])

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).transform(
        mapped, run, f"vec_id {kind}, v array<int>")


def _parts(b: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, b.num_rows, ROWS):
        part = b.slice(at, ROWS)
        yield part, part.column(column).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without stays."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, sizes = Orchard(centroids), np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            for _, x in _parts(b, 0, dims):
                cluster, _ = search.nearest(x)
                np.add.at(sums, cluster, x)
                sizes += np.bincount(cluster, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids)), pa.int32()), pa.array(sizes),
                                          pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    sent = kept.select("v").transform(mapped, run, "cluster int, n bigint, sums array<bigint>").filter("n > 0")
    total = sent.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    out = centroids.copy()
    for row in total.collect():  # at most one row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every kept vector."""
    kind, dims = dict(kept.dtypes)["vec_id"], centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in batches:
            for part, x in _parts(b, 1, dims):
                cluster, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v").transform(mapped, run, f"vec_id {kind}, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding",
              dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256`` and ``centroid``, its final centroid's components."""
    spark = vectors.sparkSession
    kept = stored(quantised(vectors, vec_id, embedding, dims, scale), "quantised")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    names = "cluster int, centroid array<bigint>, centroid_sha256 string"
    if not len(centroids):
        found = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    else:
        for _ in range(rounds):
            centroids = next_centroids(kept, centroids)
        found = stored(assigned(kept, centroids), "clusters")
    per_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = found.select(F.sum("distance")).scalar()
    finals = spark.createDataFrame([(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
                                    for i, c in enumerate(centroids.tolist())], names)
    facts = per_cluster.join(finals, "cluster")  # ``k`` rows at most
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256", "centroid")
