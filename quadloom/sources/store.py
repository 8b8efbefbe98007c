"""The stored layout of quads: a partition a predicate, sorted by object, so that a pattern reads its predicate's files and skips row groups by object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quads import distinct_quads


def write_quads(quads: DataFrame, path: str, files: int | None = None) -> None:
    """Writes the set of quads under ``path``, replacing what is there. Rows are range-partitioned by predicate and object, so a predicate with most of the rows is spread over many files; ``files`` is their number, by default the session's."""
    files = files or int(quads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct_quads(quads.select("g", "s", "p", "o")).repartitionByRange(files, "p", "o", "s").sortWithinPartitions("p", "o", "s")
    rows.write.partitionBy("p").mode("overwrite").parquet(path)


def read_quads(spark: SparkSession, path: str, *predicates: str) -> DataFrame:
    """Stored quads, of some predicates only if any are named: other partitions are not listed among the files read."""
    rows = spark.read.parquet(path).select("g", "s", "p", "o")
    return rows.where(F.col("p").isin(list(predicates))) if predicates else rows


def write_by_graph(rows: DataFrame, path: str) -> None:
    """Derived rows with a column ``g``, a partition a graph; written again with rows of one graph, only that partition changes."""
    rows.write.partitionBy("g").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
