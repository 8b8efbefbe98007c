"""SPARQL updates: a new set of quads from an old one. Every WHERE sees the quads as they were at the start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources.quads import distinct_quads

_KEYS = ["g", "s", "p", "o"]


def _without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    on = quads["g"].eqNullSafe(gone["g"]) & (quads["s"] == gone["s"]) & (quads["p"] == gone["p"]) & (quads["o"] == gone["o"])
    return quads.join(gone, on, "left_anti")


def insert_data(quads: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT DATA: a quad that is there stays one quad."""
    return distinct_quads(quads.select(*_KEYS).union(new.select(*_KEYS)))


def newly_inserted(quads: DataFrame, new: DataFrame) -> DataFrame:
    """The quads of ``new`` that an insert would add."""
    return _without(distinct_quads(new.select(*_KEYS)), quads.select(*_KEYS))


def delete_data(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """DELETE DATA: null graphs match null graphs."""
    return _without(quads.select(*_KEYS), gone.select(*_KEYS))


def modify(quads: DataFrame, delete: DataFrame | None, insert: DataFrame | None) -> DataFrame:
    """DELETE/INSERT WHERE: both templates are already filled in from one snapshot; deletes go first."""
    left = delete_data(quads, delete) if delete is not None else quads.select(*_KEYS)
    return insert_data(left, insert) if insert is not None else left


def clear(quads: DataFrame, graph: str | None) -> DataFrame:
    """CLEAR or DROP of a graph; None is the default graph."""
    return quads.where(F.col("g").isNotNull() if graph is None else F.coalesce(F.col("g") != graph, F.lit(True)))


def targeted(template: DataFrame, default_graph: str | None) -> DataFrame:
    """A template's quads, those without a graph of their own sent to the request's default graph."""
    return template.select(F.coalesce("g", F.lit(default_graph).cast("string")).alias("g"), "s", "p", "o")


def apply_steps(quads: DataFrame, steps: list[tuple[str, DataFrame | str | None]], default_graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(quads after all ``steps`` in order, one row inserted and deleted a step).

    A step is ("insert", rows), ("delete", rows) or ("clear", graph). Rows come from templates that
    were filled in on the snapshot at the start; quads without a graph go to ``default_graph``. The
    counts are of quads that a step really added or took away.
    """
    now, counts = cut(distinct_quads(quads.select(*_KEYS))), None
    for i, (kind, what) in enumerate(steps):
        if kind == "clear":
            gone = now.where(F.col("g").isNull() if what is None else F.col("g") == what)
            after, fresh = clear(now, what), now.limit(0)
        elif kind == "delete":
            rows = distinct_quads(targeted(what, default_graph))
            gone, after, fresh = _within(now, rows), delete_data(now, rows), now.limit(0)
        else:
            fresh = newly_inserted(now, targeted(what, default_graph))
            gone, after = now.limit(0), now.union(fresh)
        row = fresh.agg(F.count("*").alias("inserted")).join(gone.agg(F.count("*").alias("deleted"))).select(F.lit(i).alias("step"), F.lit(kind).alias("kind"), "inserted", "deleted")
        counts = row if counts is None else counts.union(row)
        now = cut(after)
    return now, counts


def _within(quads: DataFrame, rows: DataFrame) -> DataFrame:
    on = quads["g"].eqNullSafe(rows["g"]) & (quads["s"] == rows["s"]) & (quads["p"] == rows["p"]) & (quads["o"] == rows["o"])
    return quads.join(rows, on, "left_semi")


def remove_object(quads: DataFrame, subject: str, top_level: str, member: str, with_members: bool = False) -> DataFrame:
    """Quads without an object: all subjects whose top level it is, and references to it. ``with_members`` takes its members and theirs of the same kind along, as for a collection."""
    tops = quads.where((F.col("p") == top_level) & (F.col("o") == subject)).select("s")
    if with_members:
        held = quads.where((F.col("p") == member) & (F.col("s") == subject)).select(F.col("o").alias("t"))
        tops = tops.union(quads.where(F.col("p") == top_level).join(held, F.col("o") == F.col("t"), "left_semi").select("s"))
    gone = tops.distinct()
    left = quads.join(gone, "s", "left_anti").select(*_KEYS)
    return left.join(gone.select(F.col("s").alias("o")), "o", "left_anti").select(*_KEYS)


def remint(quads: DataFrame, renames: dict[str, str], managed: list[str], stamps: DataFrame) -> DataFrame:
    """``rename_prefixes``, with the ``managed`` predicates dropped and ``stamps`` (s, p, o), by new names, put in the graphs of their subjects."""
    moved = rename_prefixes(quads.where(~F.col("p").isin(managed)) if managed else quads, renames)
    homes = moved.select("g", "s").distinct()
    return insert_data(moved, stamps.join(homes, "s").select(*_KEYS))


def write_graph(quads: DataFrame, graph: str, triples: DataFrame, mode: str) -> DataFrame:
    """A graph store write: ``merge`` adds to the graph, ``replace`` takes its place; ``fail`` raises if it holds anything."""
    if mode == "fail" and not quads.where(F.col("g") == graph).isEmpty():
        raise ValueError(f"graph {graph} is there already")
    if mode == "replace":
        return replace_graph(quads, graph, triples)
    if mode not in ("merge", "fail"):
        raise ValueError(f"no mode {mode}")
    return insert_data(quads, triples.select(F.lit(graph).alias("g"), "s", "p", "o"))


def replace_graph(quads: DataFrame, graph: str, triples: DataFrame) -> DataFrame:
    """A graph store PUT."""
    return insert_data(clear(quads, graph), triples.select(F.lit(graph).alias("g"), "s", "p", "o"))


def rename_prefixes(quads: DataFrame, renames: dict[str, str]) -> DataFrame:
    """IRIs renamed by the longest prefix that matches, at every place of a triple."""
    order = sorted(renames, key=len, reverse=True)

    def renamed(c: str):
        out = None
        for old in order:
            hit = F.col(c).startswith("<" + old)
            new = F.concat(F.lit("<" + renames[old]), F.col(c).substr(F.lit(len(old) + 2), F.length(c)))
            out = F.when(hit, new) if out is None else out.when(hit, new)
        return (F.col(c) if out is None else out.otherwise(F.col(c))).alias(c)

    return distinct_quads(quads.select("g", renamed("s"), renamed("p"), renamed("o")))
