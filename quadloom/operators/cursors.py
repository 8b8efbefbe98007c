"""Pages by an opaque cursor over a store that is sorted by range, so that a page opens only the files past its cursor."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 5000


def write_ranged(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Stores rows in the order of ``order`` (columns that together name a row; nulls first) with a table of each file's first and last key and rows."""
    spark = df.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    key = F.struct(*order)
    held = spark.read.schema(df.schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    held.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/files")


def encode(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def decode(cursor: str) -> dict:
    """ValueError for what is no cursor."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if isinstance(found, dict):
            return found
    except Exception as e:
        raise ValueError("that is no cursor") from e
    raise ValueError("that is no cursor")


def page(spark: SparkSession, path: str, order: list[str], cursor: str | None, n: int) -> tuple[DataFrame, str | None]:
    """(the next ``n`` rows past ``cursor``, 5000 at most, in order; the cursor of the page after, None if this is the last).

    Only the files whose last key is past the cursor are thought of, and of those the first few
    that hold enough rows are opened, so a late page costs what an early one does.
    """
    n = max(1, min(n, MOST))
    files = spark.read.parquet(f"{path}/files")
    kind = files.schema["last"].dataType
    after = None
    if cursor is not None:
        values = decode(cursor)
        if list(values) != order:
            raise ValueError("the cursor is of another order")
        after = F.from_json(F.lit(json.dumps(values)), kind)
        files = files.where(F.col("last") > after)
    names, held = [], 0
    # The first file may be behind the cursor in part, so its rows don't count.
    for i, r in enumerate(files.orderBy("first").limit(n + 2).toLocalIterator()):
        names.append(r.file)
        held += r.rows if i or after is None else 0
        if held > n:
            break
    if not names:
        return spark.read.parquet(f"{path}/rows").limit(0), None
    rows = spark.read.parquet(*names)
    if after is not None:
        rows = rows.where(F.struct(*order) > after)
    rows = rows.orderBy(*order)
    keys = [r.k for r in rows.select(F.to_json(F.struct(*order), {"ignoreNullFields": "false"}).alias("k")).limit(n + 1).collect()]
    more = encode(json.loads(keys[n - 1])) if len(keys) > n else None
    return rows.limit(n), more


def pages(spark: SparkSession, path: str, order: list[str], n: int) -> DataFrame:
    """Every row with the number of its page, from 0, as a walk by ``page`` from no cursor on gives them: in one pass, for all pages at once.

    Rows are numbered within their file, and the table of files, a row each, gives each its first number.
    """
    n = max(1, min(n, MOST))
    before = F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    starts = spark.read.parquet(f"{path}/files").select("file", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = spark.read.parquet(f"{path}/rows")
    numbered = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("_i", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(starts), "file").select(*rows.columns, F.floor((F.col("_before") + F.col("_i")) / n).cast("int").alias("page"))


def offset_page(ranked: DataFrame, cursor: str | None, n: int) -> tuple[DataFrame, str | None]:
    """(rows of a ranked result from the cursor's offset on, the next cursor or None): for results that are short, as those of a search, and made anew for each page."""
    at = 0
    if cursor is not None:
        at = decode(cursor).get("offset")
        if not isinstance(at, int) or at < 0:
            raise ValueError("that is no cursor")
    rows = ranked.offset(at)
    more = rows.offset(n).limit(1).count()
    return rows.limit(n), encode({"offset": at + n}) if more else None
