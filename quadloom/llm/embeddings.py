"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.ranking import hash_sample
from ..plans.lineage import cut

#: Projections in all, and those that are sorted.
PROJECTIONS, LEADS = 48, 3
#: Projections counted for every pair; the rest only for pairs that they could still bring up to the least count.
COUNTED = 40
#: Cells of a quantised projection to either side of a query's, in its window.
WINDOW_CELLS = 4
#: Recall aimed at, for a pair at the threshold: of meeting in a sorted projection, and of the collision count.
MEET, COUNT = 0.96, 0.97
#: Vectors of a block, and the least sample that sets the blocks' bounds; a large table's has ``SAMPLE_A_BLOCK`` for each block.
BLOCK_ROWS, SAMPLE_ROWS, SAMPLE_A_BLOCK = 4096, 20_000, 8
SEED = 3


def calibrate(cosine: float, dim: int) -> tuple[float, int]:
    """(cell width, least collisions) for pairs of unit vectors at ``cosine``.

    A projection of their difference on a random unit direction is close to normal with standard
    deviation distance / sqrt(dim). The width lets them meet in one of ``LEADS`` windows with
    probability ``MEET``; the least count is passed with ``COUNT``.
    """
    sd = math.sqrt(max(2 - 2 * cosine, 1e-12) / dim)
    x = np.linspace(0, WINDOW_CELLS + 1, 2001)
    inside = np.clip(WINDOW_CELLS + 1 - x, 0, 1)

    def chance(cell: float) -> float:
        s = sd / cell
        density = np.exp(-0.5 * (x / s) ** 2) / (s * math.sqrt(2 * math.pi))
        return float(2 * ((density * inside)[1:] + (density * inside)[:-1]).sum() / 2 * (x[1] - x[0]))

    want = 1 - (1 - MEET) ** (1 / LEADS)
    low, high = sd / 1000, sd * 10
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if chance(mid) > want else (mid, high)
    p = chance(high)
    tail, least = 1.0, 0
    for n in range(PROJECTIONS + 1):
        tail -= math.comb(PROJECTIONS, n) * p**n * (1 - p) ** (PROJECTIONS - n)
        if tail < COUNT:
            break
        least = n + 1
    return high, least


def directions(dim: int) -> np.ndarray:
    """Random unit directions, (dim, PROJECTIONS): orthogonal in runs of ``dim``, the same in every task."""
    rng = np.random.default_rng([SEED, dim])
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(runs, axis=1)[:, :PROJECTIONS]


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar_vectors(df: DataFrame, cosine: float = 0.9, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, n_links (other vectors at ``cosine`` or more, in double precision), component_id, kept.

    Equal vectors become one first. Each of ``LEADS`` sorted projections is cut into blocks by
    sampled bounds, and a block meets those that its windows reach, two blocks a task. A pair
    within each other's window on a sorted projection, and on no earlier one, is counted over all
    projections and verified if the count passes. A task returns a row per vector: its links, and
    the least vector that it reaches, so links never become rows; components follow from those.

    Vectors that are null, empty or zero, or hold null or non-finite values, link with nothing, and
    vectors of different lengths don't link with each other. Null keys get a component of their
    own value; rows of one key and vector count as copies. Other columns are not read.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    base = cut(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    packed = _packed(base.where(usable & F.col("vec_id").isNotNull()))
    copies = cut(packed.groupBy("dim", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    parts = [cut(_links_of(copies.where(F.col("dim") == d), d, n, cosine)) for d, n in copies.groupBy("dim").count().collect()]
    found = parts[0] if parts else df.sparkSession.createDataFrame([], "node long, root long, links long")
    for p in parts[1:]:
        found = found.union(p)
    components = connected_components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = copies.join(links, "node", "left").join(components.withColumnRenamed("component", "c"), "node", "left")
    known = cut(known.select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("c", "node").alias("c")))
    linked = packed.join(known, ["dim", "vector"]).select("vec_id", "links", "c")
    alone = base.where(~usable | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"))


def _packed(rows: DataFrame) -> DataFrame:
    """vec_id, dim, vector: the doubles as bytes, -0.0 as 0.0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.array(v.flatten()) + 0.0
            size = np.array(v.value_lengths())
            ends = np.cumsum(size)
            data = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "vector"])

    return rows.mapInArrow(pack, "vec_id long, dim int, vector binary")


def _links_of(nodes: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    cell, least = calibrate(cosine, dim)
    plane = directions(dim)
    wanted = -(-n // BLOCK_ROWS)
    drawn = hash_sample(nodes.select("vector", "node"), "node", max(SAMPLE_ROWS, SAMPLE_A_BLOCK * wanted)).select("vector").toArrow()
    sample = np.sort(_units(drawn.column("vector"), dim) @ plane[:, :LEADS], axis=0)
    blocks = max(1, min(wanted, len(sample) // 4))
    bounds = sample[[len(sample) * i // blocks for i in range(1, blocks)]].T.copy() if blocks > 1 else np.zeros((LEADS, 0))
    reach = (WINDOW_CELLS + 1) * cell
    width = 1 if math.sqrt(2 - 2 * cosine) / cell + 2 * WINDOW_CELLS + 2 < 256 else 2
    # The last block that a window from any row of a block reaches.
    far = np.array([[int(np.searchsorted(b, b[i] + reach, "right")) if i < blocks - 1 else blocks - 1 for i in range(blocks)] for b in bounds])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _units(batch.column("vector"), dim) @ plane[:, :LEADS]
            for j in range(LEADS):
                own = np.searchsorted(bounds[j], p[:, j], "right")
                for b in np.unique(own).tolist():
                    rows = pa.array(np.flatnonzero(own == b))
                    part = batch.take(rows)
                    pairs = [(b, c) for c in range(b, far[j, b] + 1)] + [(a, b) for a in range(b) if far[j, a] >= b]
                    for a, c in pairs:
                        k = part.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, j, np.int32)), pa.array(np.full(k, a, np.int32)), pa.array(np.full(k, c, np.int32)), pa.array(np.full(k, b, np.int32)), part.column("node"), part.column("copies"), part.column("vector")],
                            names=["lead", "a", "c", "own", "node", "copies", "vector"],
                        )

    def sweep(table: pa.Table) -> pa.Table:
        j, a, c = (table.column(x)[0].as_py() for x in ("lead", "a", "c"))
        u = _units(table.column("vector"), dim)
        p = u @ plane
        second = np.array(table.column("own")) == c if a != c else np.zeros(len(u), bool)
        order = np.lexsort((p[:, j], second))
        u, p = u[order], p[order]
        node, copies = np.array(table.column("node"))[order], np.array(table.column("copies"))[order]
        head = int((~second).sum()) if a != c else 0
        # Modulo 2^8 or 2^16: two vectors within the threshold are never as far apart as that, so only
        # others may seem to meet where they don't, and the cosine tells those.
        q = np.ascontiguousarray((np.round(p / cell).astype(np.int64) & (256**width - 1)).astype(f"u{width}").T)
        ahead, along = q + q.dtype.type(WINDOW_CELLS), np.ascontiguousarray(p[:, j])
        total, root = np.zeros(len(u), np.int64), np.arange(len(u))
        lefts, rights = [], []
        for o in range(1, len(u)):
            low, high = (max(head - o, 0), min(head, len(u) - o)) if a != c else (0, len(u) - o)
            if low >= high:
                break
            near = along[low + o : high + o] - along[low:high] <= reach
            if not near.any():
                if a == c:
                    break
                continue
            meet = ahead[:COUNTED, low + o : high + o] - q[:COUNTED, low:high] <= 2 * WINDOW_CELLS
            count = meet.sum(axis=0, dtype=np.int8)
            fine = meet[j] & near & (count >= least - (PROJECTIONS - COUNTED))
            if j:
                fine &= ~meet[:j].any(axis=0)
            x = np.flatnonzero(fine)
            if len(x):
                more = (ahead[COUNTED:, x + low + o] - q[COUNTED:, x + low] <= 2 * WINDOW_CELLS).sum(axis=0)
                x = x[count[x] + more >= least] + low
                x = x[np.einsum("ij,ij->i", u[x], u[x + o]) >= cosine]
                lefts.append(x)
                rights.append(x + o)
        if lefts:
            x, y = np.concatenate(lefts), np.concatenate(rights)
            total = np.bincount(x, weights=copies[y], minlength=len(u)).astype(np.int64) + np.bincount(y, weights=copies[x], minlength=len(u)).astype(np.int64)
            while True:  # each vector takes the least row among its neighbours' roots
                before = root.copy()
                np.minimum.at(root, x, before[y])
                np.minimum.at(root, y, before[x])
                root = root[root]
                if (root == before).all():
                    break
        linked = total > 0
        return pa.table({"node": node[linked], "root": node[root[linked]], "links": total[linked]})

    dealt = nodes.select("node", "copies", "vector").mapInArrow(deal, "lead int, a int, c int, own int, node long, copies long, vector binary")
    return dealt.groupBy("lead", "a", "c").applyInArrow(sweep, "node long, root long, links long")
