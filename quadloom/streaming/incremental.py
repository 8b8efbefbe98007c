"""Incremental upkeep: micro-batches of quads merged into a stored set, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph_store import GraphStore
from ..operators.updates import newly_inserted
from ..plans.lineage import cut

#: Parts of the stored set, by a hash of the subject; a micro-batch reads only those that it touches.
BUCKETS = 256


def upkeep(stream: DataFrame, table_path: str, checkpoint: str):
    """Starts a stream that adds to ``table_path`` the quads of each micro-batch that it lacks.

    A micro-batch is compared with the buckets of its own subjects, as earlier batches left them,
    and written as a partition of its own number, replacing what an interrupted run of the same
    batch wrote; so a batch run again adds nothing, and nothing is read while it is written.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select("g", "s", "p", "o").withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r[0] for r in keyed.select("bucket").distinct().collect()]  # at most BUCKETS
        try:
            stored = spark.read.parquet(table_path)
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            stored = keyed.limit(0).withColumn("batch", F.lit(number))
        old = stored.where(F.col("bucket").isin(touched) & (F.col("batch") < number)).select("g", "s", "p", "o")
        new = newly_inserted(old, keyed).withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).cast("int"))
        new.write.partitionBy("bucket").mode("overwrite").parquet(f"{table_path}/batch={number}")
        keyed.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upkeep_graphs(stream: DataFrame, store: GraphStore, checkpoint: str, compact_every: int = 50):
    """Starts a stream that adds to a graph store the quads of each micro-batch that it lacks.

    A micro-batch is one version, named by its number, so a batch that is run again after a
    failure is passed over if it was published and leaves nothing behind if it was not. It is
    compared with the graphs that it touches. Graphs become dirty, to be derived again when the
    caller likes; every ``compact_every`` batches the versions are made one base, so reads don't
    slow down with the stream's age.
    """

    def merge(batch: DataFrame, number: int) -> None:
        note = f"batch {number}"
        if any(v.note == note for v in store.store.log()):
            return
        rows = cut(batch.select("g", "s", "p", "o"))
        graphs = [r.g for r in rows.select("g").distinct().collect()]  # of one micro-batch
        new = newly_inserted(store.quads(graphs), rows) if graphs else rows
        if not new.isEmpty():
            store.apply(new, None, note)
            if number % compact_every == compact_every - 1:
                store.store.compact(f"{note}, compacted")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n): tumbling windows; on a stream, events later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
