"""Centroid clustering of vectors in exact integers."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, fresh_path
from .quantised import EXACT, LONG, integers, pack, unpack, whole_parts

#: Rows of a block of the matrix product.
BLOCK_ROWS = 4096


def nearest_centroid(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of whole doubles; ties go to the smaller number.

    |x|^2 - 2 x.c + |c|^2 with the middle term as a matrix product. Every partial sum is at most
    dim * (|x|max + |c|max)^2, so below 2^53 doubles are exact, and below 2^62 64-bit integers;
    rows beyond both use Python's integers, and their distances are given as 2^63 - 1 at most.
    """
    dim = x.shape[1]
    kinds = {"double": (np.array(centroids, np.float64), lambda v: v)}
    far = max((abs(v) for c in centroids for v in c), default=0)
    if far < 2**62:
        kinds["long"] = (np.array(centroids, np.int64), lambda v: v.astype(np.int64))
    kinds["any"] = (np.array(centroids, object), integers)
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK_ROWS):
        block = x[at : at + BLOCK_ROWS]
        bound = dim * (np.abs(block).max(axis=1, initial=0) + float(far)) ** 2
        kind = np.where(bound < EXACT, 0, np.where((bound < 2.0**62) & ("long" in kinds), 1, 2))
        for k, name in enumerate(("double", "long", "any")):
            rows = np.flatnonzero(kind == k)
            if not len(rows):
                continue
            c, form = kinds[name]
            v = form(block[rows])
            d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
            best = d.argmin(axis=1).astype(np.int64)
            least = d[np.arange(len(rows)), best]
            cluster[at + rows] = best
            distance[at + rows] = [min(int(n), LONG) for n in least] if k == 2 else least.astype(np.int64)
    return cluster, distance


def _add(a, b):
    """Sums and counts of two parts; integers that outgrow 64 bits are Python's."""
    if a is None or b is None:
        return a if b is None else b
    (s, n, top), (t, m, other) = a, b
    if top + other >= 2**62 and s.dtype != object:
        s = s.astype(object)
    return s + t, n + m, top + other


def _sums(x: np.ndarray, cluster: np.ndarray, k: int):
    """(sum of each cluster's rows, rows of each, a bound on every sum)."""
    most = np.abs(x).max(initial=0)
    top = int(most) * len(x)
    wide = top >= 2**62
    v = integers(x) if wide else x.astype(np.int64)
    order = np.argsort(cluster, kind="stable")
    count = np.bincount(cluster, minlength=k)
    held = np.flatnonzero(count)
    total = np.zeros((k, x.shape[1]), object if wide else np.int64)
    if len(held):
        total[held] = np.add.reduceat(v[order], (np.cumsum(count) - count)[held], axis=0)
    return total, count, top


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: int = 2, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid, centroid_sha256: exact integer k-means.

    Components become floor(scale * x). The first centroids are the ``k`` vectors of least sha256
    of "seed:vec_id" (ties by the vector's bytes; null keys last). A round assigns every vector,
    sums each cluster inside every task, adds the tasks' sums as a tree, and takes
    floor(sum / count); a cluster without vectors stays where it is. Only ``k`` centroids pass
    through the driver. The integers are stored once in the shared folder, so rounds don't read
    the source again and a lost executor costs its tasks only.

    Vectors that are null, of another length, or hold null or non-finite components are left out.
    Repeated rows count as often as they stand there; a null key stays null. Fewer than ``k``
    vectors make as many clusters; none make no rows. Sums and distances have no bound, though
    what passes 2^63 - 1 is shown as that. Other columns are not read.
    """
    spark = df.sparkSession

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows, x in whole_parts(batch.column("v"), scale):
                if n == dim:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(pack(x), pa.binary())], names=["vec_id", "x"])

    path = fresh_path(spark, "whole-vectors")
    df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(quantise, "vec_id long, x binary").write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec_id", "x").limit(k).collect()
    centroids = [[int(v) for v in unpack(pa.array([r.x], pa.binary()), dim)[0]] for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")

    def partial(held: list[list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = unpack(batch.column("x"), dim)
                total = _add(total, _sums(x, nearest_centroid(x, held)[0], len(held)))
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

        return run

    for _ in range(rounds):
        parts = rows.select("x").mapInArrow(partial(centroids), "part binary").rdd.map(lambda r: pickle.loads(r.part))
        total, count, _ = parts.treeAggregate(None, _add, _add)
        centroids = [[int(v) // n for v in s] if n else old for s, n, old in zip(total.tolist(), count.tolist(), centroids, strict=True)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest_centroid(unpack(batch.column("x"), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # a row a cluster
    whole = min(sum(inertia.values()), LONG)
    shown = [[str(v) for v in c] for c in centroids]
    table = [(i, min(n, LONG), whole, shown[i], hashlib.sha256(",".join(shown[i]).encode()).hexdigest()) for i, n in sorted(inertia.items())]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", *known.columns[1:])
