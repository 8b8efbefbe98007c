"""Free SQL over named tables, with a row cap."""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.limits import read_only


class SqlProblem(ValueError):
    """A statement that does not parse or resolve: ``kind``, and ``line`` and ``column`` from 1 if known."""

    def __init__(self, kind: str, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.kind, self.line, self.column = kind, line, column


def validate_sql(spark: SparkSession, sql: str) -> SqlProblem | None:
    """None if ``sql`` parses, else the problem with its place. Nothing is run."""
    try:
        plan = spark.sql(f"EXPLAIN {sql}").first()[0]
    except (ParseException, AnalysisException) as e:
        at = re.search(r"line (\d+)[, ]+pos (\d+)", str(e))
        shift = len("EXPLAIN ") if at and at[1] == "1" else 0
        kind = "syntax" if isinstance(e, ParseException) else "analysis"
        return SqlProblem(kind, e.getCondition() or kind, *((int(at[1]), int(at[2]) + 1 - shift) if at else ()))
    return SqlProblem("analysis", plan.strip()) if plan.startswith("Error occurred during query planning") else None


def cells(df: DataFrame, max_rows: int, seconds: float | None = None) -> tuple[list[dict], bool]:
    """(at most ``max_rows`` rows as JSON values, whether rows were cut off). Beyond ``seconds`` the job is cancelled and TimeoutError raised. The rows, bounded, go to the driver."""
    spark = df.sparkSession
    group = f"console-{uuid.uuid4().hex}"
    late = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group)) if seconds else None
    spark.sparkContext.setJobGroup(group, "console", interruptOnCancel=True)
    if late:
        late.start()
    try:
        rows = [json.loads(r[0]) for r in df.limit(max_rows + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    except Exception as e:
        if late and not late.is_alive():
            raise TimeoutError(f"more than {seconds} seconds") from e
        raise
    finally:
        if late:
            late.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows[:max_rows], len(rows) > max_rows


def run_sql(tables: dict[str, DataFrame], sql: str, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``max_rows`` rows, one more than that, by which a caller tells whether rows were cut off). The tables are views for this statement only. A statement that doesn't read is UpdateNotAllowed."""
    read_only(sql)
    spark = next(iter(tables.values())).sparkSession
    given = {n: f"_{n}_{uuid.uuid4().hex[:8]}" for n in tables}
    scoped = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in given.items())
    for n, v in given.items():
        tables[n].createOrReplaceTempView(v)
    try:
        found = spark.sql(f"WITH {scoped} SELECT * FROM ({sql})")
    finally:
        for v in given.values():
            spark.catalog.dropTempView(v)
    return found.limit(max_rows), found.limit(max_rows + 1)
