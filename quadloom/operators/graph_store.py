"""A store of graphs: quads with what is derived from them, imported and updated as one version at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources.quads import distinct_quads
from ..sources.versions import Table, VersionedStore
from .views import Vocabulary, members, object_metadata, object_summary, typed_projection, validate

_QUAD = ["g", "s", "p", "o"]
#: What the default graph, which has no name, is stored as.
DEFAULT = ""


def _listed(objects: DataFrame) -> DataFrame:
    """(field, value, g, s): the types and roles of objects, a row each."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("values")) for f, c in (("type", "types"), ("role", "roles"))])
    return objects.select("g", "s", F.explode(fields).alias("x")).select("x.field", F.explode("x.values").alias("value"), "g", "s")  # sets of objects that are one a key, so each row once


class GraphStore:
    """Quads under one path, with object metadata, root members, an index of types and roles, summaries, typed rows and findings, all stored by graph.

    ``kinds`` are typed rows to keep (see ``PROJECTIONS``), of the vocabulary with the IRI ``base``.
    """

    def __init__(self, spark: SparkSession, path: str, vocabulary: Vocabulary, kinds: tuple[str, ...] = (), base: str = "", buckets: int = 16):
        self.spark, self.v, self.kinds, self.base = spark, vocabulary, kinds, base
        by_graph = lambda columns, key: Table(columns, key, ["g"], buckets)
        self.store = VersionedStore(spark, path, {
            "quads": by_graph("g string, s string, p string, o string", _QUAD),
            "graphs": by_graph("g string, triples long, status string, issues long", ["g"]),
            "dirty": by_graph("g string", ["g"]),
            "objects": by_graph("g string, s string, display_id string, title string, description string, version string, types array<string>, roles array<string>, creators array<string>, top_level boolean", ["g", "s"]),
            "members": by_graph("g string, collection string, member string, is_root boolean", ["g", "collection", "member"]),
            "listed": Table("field string, value string, g string, s string", ["field", "value", "g", "s"], ["value"], buckets),
            "summaries": by_graph("g string, s string, display_id string, name string, description string, types array<string>, roles array<string>, data string, hash string", ["g", "s"]),
            "typed": by_graph("g string, kind string, s string, class string, parent string, data string", ["g", "kind", "s"]),
            "findings": by_graph("g string, s string, rule string, severity string", ["g", "s", "rule"]),
        })

    # ---- writing

    def import_graph(self, triples: DataFrame, graph: str | None, mode: str = "fail", rules: dict[str, tuple[str, Column]] | None = None, note: str | None = None) -> int:
        """One parsed document (s, p, o) as a graph: quads, metadata, summaries, typed rows and findings of ``rules`` {name: (severity, condition on metadata)}, published as one version or not at all.

        ``merge`` adds to the graph, ``replace`` takes its place, ``fail`` raises ValueError if it
        holds anything. A document that breaks rules is stored, with the graph's status ``failed``
        or ``warning``. Only rows that differ from what is stored are written.
        """
        if mode not in ("fail", "replace", "merge"):
            raise ValueError(f"no mode {mode}")
        with self.store.pinned():
            return self._import(triples, graph, mode, rules, note)

    def _import(self, triples: DataFrame, graph: str | None, mode: str, rules: dict | None, note: str | None) -> int:
        g = DEFAULT if graph is None else graph
        named = self._named(g)
        old = cut(self._of_graphs("quads", named))
        empty = old.isEmpty()
        if mode == "fail" and not empty:
            raise ValueError(f"graph {graph} is there already")
        first = empty and self._of_graphs("dirty", named).isEmpty()  # a dirty graph may have rows that were derived from quads now gone
        new = distinct_quads(triples.select(F.lit(g).alias("g"), "s", "p", "o").dropna())
        now = cut(distinct_quads(old.union(new)) if mode == "merge" and not empty else new)
        changes = {"quads": (now, None) if empty else self._differences("quads", now, old)}
        return self.store.commit(changes | self._derived(now, named, rules, first), note)

    def apply(self, put: DataFrame | None, gone: DataFrame | None, note: str | None = None) -> int:
        """Quads added and taken away; their graphs are logged as dirty, and what is derived from them is made anew by ``refresh``."""
        put, gone = (None if x is None else distinct_quads(self._stored(x)) for x in (put, gone))
        if put is not None and gone is not None:
            gone = gone.join(put, _QUAD, "left_anti")
        graphs = [x.select("g") for x in (put, gone) if x is not None]
        dirty = graphs[0].union(graphs[-1]).distinct()
        return self.store.commit({"quads": (put, gone), "dirty": (dirty, None)}, note)

    def refresh(self, rules: dict[str, tuple[str, Column]] | None = None) -> int | None:
        """Derives again what comes from dirty graphs, and only from those; None if there are none."""
        with self.store.pinned():
            dirty = cut(self.store.snapshot("dirty"))
            if dirty.isEmpty():
                return None
            return self.store.commit(self._derived(cut(self._of_graphs("quads", dirty)), dirty, rules), "refresh")

    def _named(self, g: str) -> DataFrame:
        return self.spark.createDataFrame([(g,)], "g string")

    def _stored(self, quads: DataFrame) -> DataFrame:
        return quads.select(F.coalesce("g", F.lit(DEFAULT)).alias("g"), "s", "p", "o")

    def _of_graphs(self, name: str, graphs: DataFrame, as_of: int | None = None) -> DataFrame:
        return self.store.snapshot(name, as_of, graphs)

    def _differences(self, name: str, now: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows to put, keys to take away) that lead from ``old`` to ``now``."""
        key = self.store.tables[name].key
        names = [c.split()[0] for c in self.store.tables[name].columns.split(", ")]
        a, b = now.select(*names), old.select(*names)
        same = [F.equal_null(a[c], b[c]) for c in names]
        return a.join(b, same, "left_anti"), b.select(*key).join(a.select(*key), key, "left_anti")

    def _derived(self, now: DataFrame, graphs: DataFrame, rules: dict | None, first: bool = False) -> dict:
        """Changes of every derived table for ``graphs``, whose quads are ``now``. The ``first`` time nothing is stored to compare them with."""
        objects = cut(object_metadata(now, self.v))
        summary = object_summary(now, self.v, ("g", "s"))
        typed = self.spark.createDataFrame([], "g string, kind string, s string, class string, parent string, data string")
        for kind in self.kinds:
            rows = typed_projection(now, kind, self.base, keys=("g", "s"))
            cells = [c for c in rows.columns if c not in ("g", "s", "class", "parent")]
            typed = typed.union(rows.select("g", F.lit(kind), "s", "class", "parent", F.to_json(F.struct(*cells))))
        findings, runs = validate(graphs, rules or {"stored": ("error", F.lit(True))}, objects)
        issues = findings.groupBy("g").agg(F.count("*").alias("issues"))
        triples = now.groupBy("g").agg(F.count("*").alias("triples"))
        about = runs.join(triples, "g").join(issues, "g", "left").select("g", "triples", "status", F.coalesce("issues", F.lit(0)).alias("issues"))
        made = {"objects": objects, "members": members(now, self.v), "summaries": summary, "typed": typed, "findings": findings, "graphs": about}
        if first:
            return {name: (rows, None) for name, rows in made.items()} | {"listed": (_listed(objects), None)}
        made |= {name: cut(made[name]) for name in ("members", "summaries")}  # both what to put and what to take away come from them
        changes = {name: self._differences(name, rows, self._of_graphs(name, graphs)) for name, rows in made.items()}
        new, old = _listed(objects), _listed(self._of_graphs("objects", graphs))
        on = ["field", "value", "g", "s"]
        changes["listed"] = (new.join(old, on, "left_anti"), old.join(new, on, "left_anti"))
        dirty = self._of_graphs("dirty", graphs)
        return changes if dirty.isEmpty() else changes | {"dirty": (None, dirty)}

    # ---- reading

    def quads(self, graphs: list[str | None] | None = None, as_of: int | None = None) -> DataFrame:
        """Stored quads, of some graphs only if any are named: their folders are read."""
        wanted = None if graphs is None else self.spark.createDataFrame([(DEFAULT if g is None else g,) for g in graphs], "g string")
        rows = self.store.snapshot("quads", as_of, wanted)
        return rows.withColumn("g", F.nullif("g", F.lit(DEFAULT)))

    def objects(self, graphs: list[str] | None = None, type_: str | None = None, role: str | None = None, top_level: bool = False) -> DataFrame:
        """Object metadata as stored, nothing derived anew, for the views. Types and roles are looked up in their index and intersected; dirty graphs are as they were when last derived."""
        wanted = None if graphs is None else self.spark.createDataFrame([(g,) for g in graphs], "g string")
        for field, value in (("type", type_), ("role", role)):
            if value is not None:
                asked = self.spark.createDataFrame([(value,)], "value string")
                found = self.store.snapshot("listed", wanted=asked).where(F.col("field") == field).select("g", "s")
                wanted = found if wanted is None else found.join(wanted, [c for c in ("g", "s") if c in wanted.columns], "left_semi")
        rows = self.store.snapshot("objects", wanted=None if wanted is None else cut(wanted))
        if wanted is not None and "s" in wanted.columns:
            rows = rows.join(wanted, ["g", "s"], "left_semi")
        return rows.where("top_level") if top_level else rows

    def root_members(self, collection: str | None = None) -> DataFrame:
        """(g, collection, member, is_root) as stored."""
        rows = self.store.snapshot("members")
        return rows if collection is None else rows.where(F.col("collection") == collection)

    def dirty(self) -> DataFrame:
        return self.store.snapshot("dirty")

    def history(self, subject: str) -> DataFrame:
        """(version, gone, g, s, hash, name): every revision of a subject's summary, oldest first."""
        return self.store.changes("summaries").where(F.col("s") == subject).select("version", "gone", "g", "s", "hash", "name").orderBy("version", "g")
