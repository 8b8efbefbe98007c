"""Discovery: records by the predicates of two vocabularies, a request's filters, totals, labelled facets, pages and their cards."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import str_, timestamp
from .text import query_tokens, text_scores, within

MOST_TEXT_BYTES, MOST_PROVENANCE_BYTES, MOST_ROWS = 4096, 1024, 1000


@dataclass(frozen=True)
class Predicates:
    """The predicates of each field, in all vocabularies that are read; the first that a subject has decides."""

    fields: dict[str, list[str]]
    many: tuple[str, ...] = ("types", "roles", "collections")
    dates: tuple[str, ...] = ("created", "modified")


def records(quads: DataFrame, v: Predicates, member: list[str] | None = None) -> DataFrame:
    """(s, g, each field): a row a subject, by one aggregate. Single fields hold the least text of the first predicate present, ``many`` sorted sets of terms, ``dates`` timestamps; ``member`` predicates point from a collection to the subject."""
    flat = [p for ps in v.fields.values() for p in ps]
    rows = quads.where(F.col("p").isin(flat)).select("g", "s", "p", "o")
    if member:
        rows = rows.where(~F.col("p").isin(member)).union(quads.where(F.col("p").isin(member)).select("g", F.col("o").alias("s"), "p", F.col("s").alias("o")))
    cells = [F.min("g").alias("g")]
    for name, ps in v.fields.items():
        if name in v.many:
            cells.append(F.array_sort(F.collect_set(F.when(F.col("p").isin(ps), F.col("o")))).alias(name))
            continue
        value = timestamp(F.col("o")) if name in v.dates else str_(F.col("o"))
        cells.append(F.coalesce(*[F.min(F.when(F.col("p") == p, value)) for p in ps]).alias(name))
    return rows.groupBy("s").agg(*cells)


@dataclass(frozen=True)
class Request:
    """What a discovery request asks for; all that is given must hold."""

    text: str | None = None
    type: str | None = None
    role: str | None = None
    collection: str | None = None
    owner: str | None = None
    provenance: str | None = None
    created: tuple[str | None, str | None] = (None, None)
    modified: tuple[str | None, str | None] = (None, None)
    sort: str = "relevance"
    descending: bool | None = None
    offset: int = 0
    limit: int = 50
    boosts: dict[str, float] = field(default_factory=lambda: {"display_id": 3.0, "name": 1.0, "description": 1.0})

    def check(self) -> None:
        """Raises ValueError where a bound is broken."""
        if self.text and len(self.text.encode()) > MOST_TEXT_BYTES:
            raise ValueError("the text is too long")
        if self.provenance and len(self.provenance.encode()) > MOST_PROVENANCE_BYTES:
            raise ValueError("the provenance is too long")
        for after, before in (self.created, self.modified):
            if after and before and after > before:
                raise ValueError("a range ends before it starts")
        if self.sort not in ("relevance", "name", "created", "modified", "iri"):
            raise ValueError(f"no sort {self.sort}")
        if not 1 <= self.limit <= MOST_ROWS or self.offset < 0:
            raise ValueError("offset or limit out of bounds")


def matching(rows: DataFrame, r: Request) -> DataFrame:
    """The records that a request's filters leave, with ``text``, the score of its text (1 without one). Provenance is a substring, case left aside."""
    r.check()
    for column, wanted in (("types", r.type), ("roles", r.role), ("collections", r.collection)):
        if wanted is not None:
            rows = rows.where(F.array_contains(column, wanted))
    if r.owner is not None:
        rows = rows.where(F.col("owner") == r.owner)
    if r.provenance is not None:
        rows = rows.where(F.contains(F.lower("provenance"), F.lower(F.lit(r.provenance))))
    for column, (after, before) in (("created", r.created), ("modified", r.modified)):
        if after or before:
            rows = rows.where(within(F.col(column), after, before))
    if r.text and query_tokens(r.text):
        return text_scores(rows, "s", r.boosts, r.text)
    return rows.withColumn("text", F.lit(1.0))


def sort_name() -> Column:
    """The text that a name sort goes by."""
    return F.lower(F.coalesce("name", "display_id", F.col("s")))


def order(r: Request, rank: str = "rank") -> list[Column]:
    """Sort keys: names and IRIs ascend and the rest descends unless told otherwise; missing dates come last either way; ties by IRI."""
    down = r.descending if r.descending is not None else r.sort not in ("name", "iri")
    if r.sort == "iri":
        return [F.desc("s") if down else F.asc("s")]
    by = {"relevance": F.col("text") * F.log1p(F.coalesce(F.col(rank), F.lit(1.0))), "name": sort_name(), "created": F.col("created"), "modified": F.col("modified")}[r.sort]
    return [by.desc_nulls_last() if down else by.asc_nulls_last(), F.asc("s")]


def page(found: DataFrame, r: Request, rank: str = "rank") -> DataFrame:
    """One page of matching records."""
    rows = found if rank in found.columns else found.withColumn(rank, F.lit(1.0))
    return rows.orderBy(*order(r, rank)).offset(r.offset).limit(r.limit)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def facets(found: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """(value, label, curie, n): how many matching records hold each value; ``labels`` is (value, label, curie), and values without one keep their IRI as label."""
    counts = found.select("s", F.explode(column).alias("value")).groupBy("value").agg(F.countDistinct("s").alias("n"))
    return counts.join(labels, "value", "left").select("value", F.coalesce("label", F.regexp_replace("value", "^<|>$", "")).alias("label"), "curie", "n")


def hydrate(page_rows: DataFrame, cards: DataFrame, fields: list[str]) -> DataFrame:
    """A page, of ``MOST_ROWS`` rows at most, with card metadata by subject; what is not found is null and ``missing``."""
    card = cards.join((page_rows.select("s").distinct()), "s", "left_semi").select("s", *fields, F.lit(False).alias("missing"))
    return page_rows.join(card, "s", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def classic_text(path: str) -> str | None:
    """The free text of a classic search path: its last segment, without stand-alone and, or, not."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    words = [w for w in last.replace("&", " ").split() if w.lower() not in ("and", "or", "not") and "=" not in w]
    return " ".join(words) or None


def classic_request(path: str, predicates: dict[str, str], type_iri: str = "http://sbols.org/v2#") -> tuple[dict, str | None, int, int]:
    """({field: value}, free text, offset, limit) of a classic search path: ``key=<iri>&`` or ``key='text'&`` criteria before the last segment, and ``?offset=`` and ``limit=`` after it.

    ``objectType=Name&`` is a type of the vocabulary; other keys are looked up in ``predicates``
    {key: predicate}, unknown ones are passed over.
    """
    body, _, tail = path.partition("?")
    numbers = {k: int(v) for k, v in (x.split("=", 1) for x in tail.split("&") if "=" in x) if v.isdigit()}
    wanted: dict = {}
    for k, v in re.findall(r"([^/&=?]+)=(<[^>]*>|'[^']*'|[^&/]*)&", body):
        if k == "objectType":
            wanted["type"] = f"<{type_iri}{v}>"
        elif k in predicates:
            wanted[predicates[k]] = v if v.startswith("<") else f'"{v.strip(chr(39))}"'
    return wanted, classic_text(re.sub(r"[^/&=?]+=(<[^>]*>|'[^']*'|[^&/]*)&", "", body)), numbers.get("offset", 0), numbers.get("limit", 50)


def classic_search(quads: DataFrame, rows: DataFrame, path: str, predicates: dict[str, str], type_: str, type_iri: str, boosts: dict[str, float]) -> DataFrame:
    """The page of ``rows`` (records) that a classic search path asks for: its criteria by ``faceted``, its text by ``matching``."""
    wanted, text, offset, limit = classic_request(path, predicates, type_iri)
    class_ = wanted.pop("type", None)
    found = rows.join(faceted(quads, class_, equal=wanted, type_=type_), "s", "left_semi")
    r = Request(text=text, offset=offset, limit=max(1, min(limit, MOST_ROWS)), boosts=boosts)
    return page(matching(found, r), r)


def faceted(quads: DataFrame, class_: str | None = None, member_of: str | None = None, equal: dict[str, str] | None = None, type_: str = "", member: str = "", date: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """(s): compatibility search by class, collection, equality of predicates and a date predicate's range: a semi join for each."""
    found = quads.select("s").distinct()
    if class_ is not None:
        found = quads.where((F.col("p") == type_) & (F.col("o") == class_)).select("s").distinct()
    if member_of is not None:
        found = found.join(quads.where((F.col("p") == member) & (F.col("s") == member_of)).select(F.col("o").alias("s")).distinct(), "s", "left_semi")
    for p, o in (equal or {}).items():
        found = found.join(quads.where((F.col("p") == p) & (F.col("o") == o)).select("s").distinct(), "s", "left_semi")
    if date is not None:
        found = found.join(quads.where((F.col("p") == date) & within(timestamp(F.col("o")), after, before)).select("s").distinct(), "s", "left_semi")
    return found


def request_kind(text: str) -> str:
    """What a search line asks for, by precedence: sequence, similar, text, browse."""
    low = text.lower()
    for mark, kind in (("sequence:", "sequence"), ("globalsequence:", "sequence"), ("similar:", "similar"), ("twins:", "similar")):
        if mark in low:
            return kind
    return "text" if query_tokens(text) else "browse"
