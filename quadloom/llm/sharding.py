"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning, subdivided ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

SAMPLE_ROWS = 16_384
RANGES_PER_SHARD = 64
#: Rows of a range, about, from where a table asks for more ranges than those; and sampled rows a range, at least.
ROWS_PER_RANGE, SAMPLED_PER_RANGE = 2_000_000, 16


def sampled_splitters(keys: DataFrame, ranges: int, sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` ascending (k1, k2) boundaries from a size-weighted sample of ``keys`` (k1, k2, size).

    The ``sample_rows`` rows with the largest u^(1/size) are drawn, u being a hash of the row's
    key, so a rerun draws the same rows. A threshold from the sum of sizes leaves about twice as
    many rows to sort, so the sample is bounded whatever the table holds.
    """
    total = keys.agg(F.sum("size")).first()[0]
    u = (F.pmod(F.xxhash64("k1", "k2", F.lit("splitter")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    weighed = keys.select("k1", "k2", (F.log(u) / F.col("size")).alias("w"))
    likely = weighed.where(F.col("w") >= F.lit(-(2.0 * sample_rows + 100) / max(total or 1, 1)))
    drawn = likely.orderBy(F.desc("w"), "k1", "k2").limit(sample_rows)
    sample = sorted((r.k1, r.k2) for r in drawn.collect())
    at = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    return sorted(set(at))


def range_of(k1: Column, k2: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below (k1, k2)."""
    first = np.array([s[0] for s in splitters], dtype=np.int64)
    second = np.array([s[1] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        lo, hi = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        out = lo.copy()
        for start in np.unique(lo[hi > lo]):  # splitters that share k1 are told apart by k2
            rows = (lo == start) & (hi > lo)
            stop = hi[rows][0]
            out[rows] = start + np.searchsorted(second[start:stop], y[rows], "right")
        return pd.Series(out.astype(np.int32))

    return place(k1, k2)


def shard_by_bytes(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Deals the rows into ``shards`` contiguous key ranges of nearly equal bytes: law ``bytes``.

    The key is (hash of the text, ``key``), so equal texts lie together and a large group of them
    can still be cut. Sampled splitters make about ``64 * shards`` ranges, or more on a table so
    large that a range would hold over ``ROWS_PER_RANGE`` rows; their exact byte
    sums, one row a range, are added up, and a range that a shard's end falls into is subdivided
    at the row. Shard sizes differ by less than two of the largest rows.

    Adds size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in a shard) and
    grown_shard (null under this law). A null text has no bytes and checksum 0; null keys count as
    the smallest; rows alike in text and key are each placed. All other columns are kept, unless
    they have an added column's name: then they are replaced. ``keep`` names those to keep; without
    the text among them, texts are read once and only keys and sizes stored. Empty table: no rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added and c not in ("_k1", "_k2", "_r", "_n", "_b", "_first", "_bytes")]
    sized = df.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_k1"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_k2"),
    )
    if text not in keep:
        sized = cut(sized)
    ranges = max(shards * RANGES_PER_SHARD, -(-sized.count() // ROWS_PER_RANGE))
    splitters = sampled_splitters(sized.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "size"), ranges, max(sample_rows, SAMPLED_PER_RANGE * ranges if ranges > shards * RANGES_PER_SHARD else 0))
    ranged = sized.withColumn("_r", range_of(F.col("_k1"), F.col("_k2"), splitters))
    sums = {r["_r"]: (r["n"], r["b"]) for r in ranged.groupBy("_r").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    starts, rows, total = [], 0, 0
    for r in sorted(sums):
        starts.append((r, rows, total))
        rows, total = rows + sums[r][0], total + sums[r][1]
    first = df.sparkSession.createDataFrame(starts, "r int, first long, bytes long")
    inside = Window.partitionBy("_r").orderBy("_k1", "_k2")
    placed = (
        ranged.withColumn("_n", F.row_number().over(inside) - 1)
        .withColumn("_b", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(first), F.col("_r") == F.col("r"))  # at most a row a range
        .withColumn("shard", F.least(F.floor((F.col("_b") + F.col("bytes")) * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
        .withColumn("_at", F.col("_n") + F.col("first"))
    )
    heads = placed.groupBy("shard").agg(F.min("_at").alias("_head")).withColumnRenamed("shard", "_shard")
    return placed.join(F.broadcast(heads), F.col("shard") == F.col("_shard")).select(  # at most a row a shard
        *[F.col(f"`{c}`") for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_head")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
