"""Ranks, prefix sums and large top-k without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", salts: int = 32) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps among the rows of equal ``keys``.

    A hot key is dealt over ``salts`` parts by a hash of ``order``; rows are numbered inside a
    part, and the parts' counts, at most ``salts`` a key, give each part its first number. The
    numbers follow the parts, then ``order``; rows alike in ``order`` are numbered as they come.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    counts = dealt.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = dealt.withColumn("_i", F.row_number().over(inside) - 1)
    on = [numbered[k].eqNullSafe(starts[k]) for k in keys] + [numbered["_salt"] == starts["_salt"]]
    joined = numbered.join(starts, on)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_first") + F.col("_i")).cast("long").alias(out))


def kth_largest(df: DataFrame, score: str, tie: str, k: int, cells: int = 4096, bound: int = 20_000) -> tuple[float, int] | None:
    """The (score, tie) of the row that is k-th by score descending, tie ascending; null scores are left out, and null ties come last.

    The score's range is cut into ``cells`` cells and counted, and the cell that holds the k-th
    row is cut again, until it holds one score or at most ``bound`` rows. Ties of one score are
    then resolved by the same narrowing over the tie column. The driver sees counts and at most
    ``bound`` rows. None if there are no rows or k is below 1; k beyond the rows gives the last.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.coalesce(F.col(tie).cast("long"), F.lit(2**63 - 1)).alias("t"))
    total = rows.count()
    if not total or k < 1:
        return None
    k = min(k, total)
    s, k, rows = _narrow(rows, "s", k, cells, bound, descending=True)
    t, _, _ = _narrow(rows.where(F.col("s") == F.lit(s)), "t", k, cells, bound, descending=False)
    return float(s), int(t)


def _narrow(rows: DataFrame, c: str, k: int, cells: int, bound: int, descending: bool):
    """Value of the k-th row in the order of ``c``, its place among rows of that value (from 1), and the rows left."""
    while True:
        lo, hi, n = rows.agg(F.min(c), F.max(c), F.count("*")).first()
        if lo == hi:
            return lo, k, rows
        if n <= bound:
            values = sorted((r[0] for r in rows.select(c).collect()), reverse=descending)
            v = values[k - 1]
            return v, k - values.index(v), rows
        step = (float(hi) - float(lo)) / cells
        cell = F.least(F.floor((F.col(c).cast("double") - F.lit(float(lo))) / F.lit(step)), F.lit(cells - 1))
        counts = dict(rows.groupBy(cell.alias("cell")).count().collect())
        for i in sorted(counts, reverse=descending):
            if k <= counts[i]:
                break
            k -= counts[i]
        kept = rows.where(cell == F.lit(i))
        if counts[i] == n and rows.agg(F.min(c), F.max(c)).first() == (lo, hi) and step == 0:
            return lo, k, rows
        rows = kept


def before(score: Column, tie: Column, cut_at: tuple[float, int]) -> Column:
    """True for rows at or before ``cut_at`` in the order of ``kth_largest``."""
    s, t = cut_at
    return (score > F.lit(s)) | ((score == F.lit(s)) & (F.coalesce(tie.cast("long"), F.lit(2**63 - 1)) <= F.lit(t)))


def hash_sample(df: DataFrame, key: str, rows: int, seed: str = "sample") -> DataFrame:
    """At most ``rows`` rows, those of least hash of ``key``: the same in every run.

    The rows are counted first, and a threshold on the hash leaves about twice the sample before
    it is sorted, so that no task and no exchange holds the sample once per partition.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    total = df.count()
    few = df if total <= 2 * rows else df.where(h < F.lit(int((1 << 40) * min(1.0, (2 * rows + 100) / total))))
    return few.orderBy(h, key).limit(rows)
