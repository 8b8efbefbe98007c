"""Connected components by alternating stars: joins and partial aggregates only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Edges that a task contracts at once.
CHUNK = 1_000_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node that it reaches over these edges) of nodes that are not themselves the least."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, before[a], before[b])
        np.minimum.at(root, before[b], before[a])
        while True:  # follow the roots to their ends
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): the same components with at most an edge a node of each task's share of edges, by union within chunks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            u, v = _stars(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            us.append(np.array(batch.column("u")))
            vs.append(np.array(batch.column("v")))
            held += batch.num_rows
            if held >= CHUNK:
                yield flush()
                us, vs, held = [], [], 0
        if held:
            yield flush()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    Each task first contracts its own share of the edges. Then, round by round, every node ties
    its larger neighbours to the least node of its neighbourhood, and its smaller neighbours to
    the least of them, until nothing changes; the edges are then stars around the least nodes. The
    number of rounds grows with the logarithm of the nodes. A hub costs partial aggregates and
    skew-splittable joins. One row a round, a checksum of the edges, goes to the driver.

    Self-loops count as nodes. Null ends are ignored. No edges: no rows.
    """
    pairs = cut(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null"))
    live, seen = cut(_contracted(pairs.where("u <> v")).distinct()), None
    while True:
        state = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if not state[0] or state == seen:
            break
        seen = state
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        tied = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        live = cut(low.select("u", F.col("m").alias("v")).union(tied).distinct())
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(live.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
