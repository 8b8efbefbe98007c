"""Exact inner-product search by ball trees, one a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..plans.lineage import cut, fresh_path
from .quantised import EXACT, LONG, integers, pack, unpack, whole_parts

#: Vectors of a shard, of a leaf, and about how many queries meet a shard at once.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 16_384, 128, 2048
#: Shards of the first wave of a search, and how much larger each next one is: its queries know the k-th score so far.
FIRST_WAVE, GROWTH = 1, 8

INDEX = "shard long, dim int, order array<int>, first array<int>, last array<int>, left array<int>, right array<int>, centres binary, radii array<double>, kind string, vectors binary, copies array<int>, ids array<long>"
_ARROW = pa.schema(
    [("shard", pa.int64()), ("dim", pa.int32())]
    + [(c, pa.list_(pa.int32())) for c in ("order", "first", "last", "left", "right")]
    + [("centres", pa.binary()), ("radii", pa.list_(pa.float64())), ("kind", pa.string()), ("vectors", pa.binary()), ("copies", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]
)


def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A ball tree over distinct rows: ``order`` of the rows, and per node its range in it, children (-1: a leaf), centre and radius. Parents come before their children."""
    order = np.arange(len(x), dtype=np.int32)
    first, last, left, right, centres, radii = [0], [len(x)], [], [], [], []
    node = 0
    while node < len(first):
        a, b = first[node], last[node]
        own = x[order[a:b]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(float(away.max(initial=0)))
        if b - a <= leaf:
            left.append(-1)
            right.append(-1)
        else:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - one), middle)]
            left.append(len(first))
            right.append(len(first) + 1)
            first += [a, a + middle]
            last += [a + middle, b]
        node += 1
    ints = {n: np.array(v, np.int32) for n, v in (("order", order), ("first", first), ("last", last), ("left", left), ("right", right))}
    return ints | {"centres": np.array(centres), "radii": np.array(radii)}


def build_index(df: DataFrame, scale: float = 1024, vector: str = "embedding", key: str = "vec_id", k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard, stored in the shared folder: its tree, its distinct vectors as floor(scale * x), and the least ``k`` + 1 keys of each.

    Every task makes shards of the rows it reads, so nothing is shuffled, a hot key is no group,
    and copies of one vector are one point of a shard; more than ``k`` + 1 of its keys can't be
    among any query's best ``k``. Rows with a null key, and vectors that are null or hold null or
    non-finite components, are left out; those of each length have shards of their own.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def shard(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(part) for part in zip(*held.pop(dim), strict=True))
            _, same = np.unique(np.array(pack(x), object), return_inverse=True)
            by = np.lexsort((ids, same))
            ids, same, x = ids[by], same[by], x[by]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])
            ids, same, x = ids[fresh], same[fresh], x[fresh]
            head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            size = np.diff(np.append(head, len(ids)))
            place = np.arange(len(ids)) - np.repeat(head, size)
            tree = build_tree(x[head])
            wide = np.abs(x).max(initial=0) >= 2**31
            row = {"shard": TaskContext.get().partitionId() << 32 | made, "dim": dim, "kind": "f8" if wide else "i4", "vectors": x[head].astype("f8" if wide else "i4").tobytes()}
            row |= {n: tree[n].tobytes() if n == "centres" else tree[n] for n in tree} | {"copies": np.minimum(size, k + 1), "ids": ids[place <= k]}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            keys = batch.column("vec_id")
            for dim, rows, x in whole_parts(batch.column("v"), scale):
                own = np.array(keys.take(pa.array(rows)), np.int64)
                for a in range(0, len(rows), shard_rows):
                    held.setdefault(dim, []).append((own[a : a + shard_rows], x[a : a + shard_rows]))
                    if sum(len(i) for i, _ in held[dim]) >= shard_rows:
                        yield shard(dim)
        for dim in list(held):
            yield shard(dim)

    path = fresh_path(df.sparkSession, "ball-trees")
    df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(build, INDEX).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _double(v: float) -> float:
    try:
        return float(v)
    except OverflowError:
        return np.inf if v > 0 else -np.inf


class Shard:
    """One row of the index, ready to search."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, self.dim).astype(np.float64)
        self.order, self.first, self.last, self.left, self.right = (np.array(row[c], np.int64) for c in ("order", "first", "last", "left", "right"))
        self.centres = np.frombuffer(row["centres"], np.float64).reshape(-1, self.dim)
        self.radii = np.array(row["radii"])
        copies = np.array(row["copies"], np.int64)
        self.ends = np.cumsum(copies)
        self.starts = self.ends - copies
        self.ids = row["ids"]
        self.most = float(np.abs(self.x).max(initial=0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No inner product of a query with a point of a node exceeds this (queries by nodes): q.c + |q| r, widened beyond any rounding; a node's is at most its parent's."""
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            reach = np.sqrt((self.centres * self.centres).sum(axis=1)) + self.radii
            high = q @ self.centres.T + length * self.radii[None, :] + 1e-9 * length * reach[None, :] + 1
        high = np.where(np.isnan(high), np.inf, high)
        for node in np.flatnonzero(self.left >= 0).tolist():
            for child in (self.left[node], self.right[node]):
                np.minimum(high[:, child], high[:, node], out=high[:, child])
        return high

    def search(self, own: list[int], q: np.ndarray, floors: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best (-score, key) here, least first, ``k`` at most: none of its own key, none below its floor.

        Leaves are taken by descending bound, in runs that double, all queries of a leaf as one
        product; a query is done with a node once its k-th score so far, or its floor, is above
        the node's bound.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        safe = self.dim * np.abs(q).max(axis=1, initial=0) * self.most < EXACT
        for rows, exact in ((np.flatnonzero(safe), False), (np.flatnonzero(~safe), True)):
            if not len(rows):
                continue
            some = q[rows]
            high = self.bounds(some)
            leaves = np.flatnonzero(self.left < 0)
            ranked = leaves[np.argsort(-high[:, leaves], axis=1, kind="stable")]
            form = integers if exact else lambda v: v
            asked, kth = form(some), np.array([-np.inf if floors[i] is None else floors[i] for i in rows], object if exact else np.float64)
            a, b = 0, 1
            while a < len(leaves):
                run = ranked[:, a:b]
                at, place = np.nonzero(np.take_along_axis(high, run, axis=1) >= np.array([_double(v) for v in kth.tolist()])[:, None])
                if not len(at):
                    break
                node = run[at, place]
                for leaf in np.unique(node).tolist():
                    group = at[node == leaf]
                    points = self.order[self.first[leaf] : self.last[leaf]]
                    score = asked[group] @ form(self.x[points]).T
                    met = score >= kth[group][:, None]
                    for g in np.flatnonzero(met.any(axis=1)).tolist():
                        i = int(rows[group[g]])
                        found = {(-int(score[g, j]), key) for j in np.flatnonzero(met[g]).tolist() for key in self.ids[self.starts[points[j]] : self.ends[points[j]]] if key != own[i]}
                        best[i] = sorted(found.union(best[i]))[:k]
                        if len(best[i]) == k:
                            kth[group[g]] = max(kth[group[g]], -best[i][-1][0])
                a, b = b, 2 * b
        return best


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` (query_id, q) the ``k`` greatest integer inner products, ties to the smaller key; never the query's own key.

    Shards are dealt into waves by hash, of 1, 8, 64, ... shards. In a wave every block of queries
    meets every shard as a group of its own; what it finds joins the best so far, and the k-th
    score of those is the next wave's floor. So a group holds a shard and a block whatever the
    tables hold, and a wave sends on at most ``k`` rows a query and shard.

    Scores beyond 64 bits are compared exactly within a shard and given as the nearest long.
    A key whose rows differ counts once for each score. Queries that are null or hold null or
    non-finite components, or have a null id, get no rows, as do those whose length no shard has.
    """
    spark = index.sparkSession

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows, x in whole_parts(batch.column("q"), scale):
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows)), pa.array([n] * len(rows), pa.int32()), pa.array(pack(x), pa.binary())], names=["query_id", "dim", "q"])

    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "q").mapInArrow(quantise, "query_id long, dim int, q binary").distinct()
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)))
    shards = cut(rank_within(index.select("shard", "dim"), [], ["shard"], "place"))
    total = shards.count()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            shard = Shard(left.drop_columns(["block"]).slice(0, 1).to_pylist()[0])
            own, floors = right.column("query_id").to_pylist(), right.column("floor").to_pylist()
            q = unpack(right.column("q").combine_chunks(), shard.dim)
            for name, found in zip(own, shard.search(own, q, floors, k), strict=True):
                for s, key in found:
                    out["query_id"].append(name)
                    out["vec_id"].append(key)
                    out["score"].append(max(min(-s, LONG), -LONG - 1))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    best = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    done, size = 0, FIRST_WAVE
    while done < total:
        wave = shards.where((F.col("place") >= done) & (F.col("place") < done + size)).select("shard", "dim")
        pairs = wave.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        floors = best.where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("floor"))
        wanted = asked.join(floors, "query_id", "left").join(pairs, ["block", "dim"]).select("shard", "block", "query_id", "q", "floor")
        trees = index.join(pairs.select("shard", "block"), "shard")
        found = trees.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        merged = found.union(best.select("query_id", "vec_id", "score")).distinct()
        best = cut(merged.withColumn("rank", place).where(F.col("rank") <= k))
        done, size = done + size, size * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def top_inner_products(df: DataFrame, every: int = 100, k: int = 10, scale: float = 1024, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The search with the rows whose key is divisible by ``every`` as queries, against all rows of ``df``."""
    queries = df.where(F.col(key) % every == 0).select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    return search_index(build_index(df, scale, vector, key, k), queries, k, scale)
