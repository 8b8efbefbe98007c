"""Limits of a request, and errors with a kind that a caller can act on."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RequestError(ValueError):
    """A request that cannot be answered: ``kind`` is bad_request, parse, update_not_allowed, unsupported_format, evaluation, too_large, too_slow or denied."""

    kind = "bad_request"


class ParseError(RequestError):
    kind = "parse"


class UpdateNotAllowed(RequestError):
    kind = "update_not_allowed"


class UnsupportedFormat(RequestError):
    kind = "unsupported_format"


class EvaluationError(RequestError):
    kind = "evaluation"


class TooLarge(RequestError):
    kind = "too_large"


class TooSlow(RequestError):
    kind = "too_slow"


class Denied(RequestError):
    kind = "denied"


@dataclass(frozen=True)
class Limits:
    """Most bytes of a request's text, rows of an answer, bytes of an answer, and seconds that it may take."""

    text_bytes: int = 64 << 10
    rows: int = 100_000
    answer_bytes: int = 64 << 20
    seconds: float = 30.0

    def check_text(self, text: str) -> None:
        if len(text.encode()) > self.text_bytes:
            raise TooLarge(f"a request holds {self.text_bytes} bytes at most")


#: What can be written, by the kind of an answer.
FORMATS = {"solutions": ("json", "xml", "csv", "tsv"), "boolean": ("json", "xml", "csv", "tsv"), "graph": ("turtle", "ntriples", "nquads", "jsonld", "rdfxml")}


def check_format(format_: str, answers: str) -> None:
    """UnsupportedFormat for one that answers of this kind cannot be written in."""
    if format_ not in FORMATS[answers]:
        raise UnsupportedFormat(f"{answers} cannot be written as {format_}")


def as_request_error(e: Exception) -> RequestError:
    """The kind of an error: what does not parse or resolve, or a value that cannot be computed."""
    if isinstance(e, RequestError):
        return e
    if isinstance(e, TimeoutError):
        return TooSlow(str(e))
    return (ParseError if isinstance(e, ParseException | AnalysisException) else EvaluationError)(str(e))


def read_only(sql: str) -> str:
    """The statement, if it reads; UpdateNotAllowed if it starts as one that writes or changes a setting."""
    first = re.match(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/|\()*([A-Za-z]*)", sql, re.S)[1].upper()
    if first not in ("SELECT", "WITH", "VALUES", "FROM", "TABLE", "DESCRIBE", "SHOW", "EXPLAIN"):
        raise UpdateNotAllowed(f"{first or 'that'} is no query")
    return sql


def answer(df: DataFrame, limits: Limits = Limits()) -> tuple[list[dict], bool]:
    """(rows as JSON values, whether more were cut off), within ``limits``; TooLarge by bytes, TooSlow by time, EvaluationError otherwise.

    The query runs once: rows come to the driver as they are asked for, and no more are once the
    bytes or the time are spent.
    """
    spark, group = df.sparkSession, f"request-{uuid.uuid4().hex}"
    rows, held, until = [], 0, time.monotonic() + limits.seconds
    late = threading.Timer(limits.seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    spark.sparkContext.setJobGroup(group, "request", interruptOnCancel=True)
    late.start()
    try:
        for r in df.limit(limits.rows + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            held += len(r[0].encode())
            if held > limits.answer_bytes:
                raise TooLarge(f"the answer has more than {limits.answer_bytes} bytes")
            rows.append(json.loads(r[0]))
    except Exception as e:
        if time.monotonic() >= until and not isinstance(e, RequestError):
            raise TooSlow(f"more than {limits.seconds} seconds") from e
        raise as_request_error(e) from e
    finally:
        late.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows[: limits.rows], len(rows) > limits.rows
