"""Quality by importance resampling: target and raw hashed n-gram models, weights, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import before, hash_sample, kth_largest
from ..plans.lineage import cut
from .chunks import slices
from .ngrams import ngram_buckets

#: log2 of the buckets that words and word pairs are hashed to.
BUCKET_BITS = 14
#: Labelled documents that the target model is fitted on, at most; drawn by a hash of the key.
LABELLED_ROWS = 20_000
#: Share of the labelled target documents whose weight the selected number must reach.
TARGET_SHARE = 0.995
#: Strength of the raw model as the target model's prior, in n-grams a bucket.
SMOOTHING = 1.0
SEED = 20


@dataclass(frozen=True)
class ImportanceModel:
    """log p_target - log p_raw of each bucket, None without a target; and the labelled keys it was fitted on."""

    ratio: np.ndarray | None
    labelled: DataFrame

    def weight(self, text: Column) -> Column:
        """log of the importance weight of a text, p_target / p_raw: the sum of its n-grams' log ratios. Null and empty texts: 0."""
        if self.ratio is None:
            return F.lit(0.0)
        shared = self.labelled.sparkSession.sparkContext.broadcast(self.ratio)

        @F.pandas_udf("double")
        def weigh(texts: pd.Series) -> pd.Series:
            out, ratio = [], shared.value
            for i in range(0, len(texts), 500):
                buckets, count = ngram_buckets([(t or "").encode() for t in texts.iloc[i : i + 500]], BUCKET_BITS)
                out.append(np.bincount(np.repeat(np.arange(len(count)), count), weights=ratio[buckets], minlength=len(count)))
            return pd.Series(np.concatenate(out) if out else [], dtype="float64")

        return weigh(text)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of ``key``: the same in every run."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> ImportanceModel:
    """Counts n-grams over all texts (raw) and over the labelled texts of ``label`` 1 (target).

    At most ``LABELLED_ROWS`` labelled keys are used, one half of them, by a hash, for the counts,
    and the other to tell the weights of target texts not fitted on; the raw counts cover every row. A task sends
    on at most one row a bucket. Conflicting labels of a key: the least. Null keys, labels and
    texts are left out.
    """
    labelled = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    labelled = cut(hash_sample(labelled, "_key", LABELLED_ROWS).withColumn("_held", F.pmod(F.xxhash64("_key", F.lit("half")), F.lit(2)) == 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                buckets, n = ngram_buckets([(t or "").encode() for t in texts], BUCKET_BITS)
                target = np.repeat(np.array(part.column("label").fill_null(0)) == 1, n)
                sums[0] += np.bincount(buckets, minlength=1 << BUCKET_BITS)
                sums[1] += np.bincount(buckets[target], minlength=1 << BUCKET_BITS)
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(sums[0, seen]), pa.array(sums[1, seen])], names=["bucket", "raw", "target"])

    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(labelled), "_key", "left").select("text", F.when(~F.col("_held"), F.col("_label")).alias("label"))  # at most LABELLED_ROWS rows
    counts = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    sums = np.zeros((2, 1 << BUCKET_BITS))
    for b, raw, target in counts.collect():  # at most a row a bucket
        sums[:, b] = raw, target
    if not sums[1].any():
        return ImportanceModel(None, labelled)
    raw = (sums[0] + 1) / (sums[0].sum() + sums.shape[1])
    prior = SMOOTHING * sums.shape[1]
    target = (sums[1] + prior * raw) / (sums[1].sum() + prior)
    return ImportanceModel(np.log(target) - np.log(raw), labelled)


def rows_reaching(scores: DataFrame, labelled: DataFrame, target_share: float) -> int:
    """A k for ``resample``: the rows whose log weight reaches that which ``target_share`` of the held-out target texts reach; all without such texts."""
    target = scores.join(F.broadcast(labelled.where("_held and _label = 1")), scores.doc_id == F.col("_key"))
    least = target.agg(F.percentile("log_weight", F.lit(1 - target_share))).first()[0]
    return scores.where(F.col("log_weight") >= F.lit(least)).count() if least is not None else scores.count()


def resample(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", k: int | None = None, target_share: float = TARGET_SHARE, seed: int = SEED):
    """(scores, keep): doc_id, log_weight, gumbel_key and kept of every row, and a function that filters ``df`` alike.

    The k rows of largest log weight plus Gumbel noise are kept, which samples k without
    replacement in proportion to the weights. A weight is a likelihood ratio, so the noise decides
    among texts that the models hardly tell apart, short ones above all, and leaves clear cases
    alone. Unless given, k is ``rows_reaching(target_share)``. The k-th key is found by repeated
    histograms; rows that tie with it are taken in key order, and rows alike in weight and key are
    kept or left together.

    A null or empty text weighs 0. Rows of a null key share one noise. No target label: every
    weight is 0 and, unless k is given, all rows are kept. Empty table: no rows.
    """
    model = fit(df, labels, label, text, key)
    id_ = F.col(key).cast("long")
    weight = model.weight(F.col(text).cast("string"))
    scores = cut(df.select(id_.alias("doc_id"), weight.alias("log_weight")).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    if k is None:
        k = rows_reaching(scores, model.labelled, target_share)
    at = kth_largest(scores, "gumbel_key", "doc_id", k)
    kept = lambda score, tie: before(score, tie, at) if at else F.lit(False)

    def keep(rows: DataFrame) -> DataFrame:
        names = rows.columns
        keyed = rows.withColumn("_gumbel_key", weight + gumbel(id_, seed))
        return keyed.where(kept(F.col("_gumbel_key"), id_)).select(*[F.col(f"`{c}`") for c in names])

    return scores.withColumn("kept", kept(F.col("gumbel_key"), F.col("doc_id"))), keep
