"""Quads (g, s, p, o): from tables and N-Quads, to N-Quads; set semantics, graph filters, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import RDF_TYPE, XSD, iri, literal

BASE = "http://example.org/"
SCHEMA = "g string, s string, p string, o string"
_TERM = r'<[^<>\s]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?'
_LINE = rf"^\s*({_TERM})\s+(<[^<>\s]*>)\s+({_TERM})\s*(<[^<>\s]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def name(local: str) -> str:
    """The IRI term of a local name."""
    return f"<{BASE}{local}>"


def node(table: str, key: Column) -> Column:
    """The IRI term of a table's row."""
    return iri(F.concat(F.lit(f"{BASE}{table}/"), key.cast("string")))


def _datatype(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return XSD + "integer"
    if isinstance(kind, T.DoubleType | T.FloatType):
        return XSD + "double"
    return XSD + "dateTime" if isinstance(kind, T.TimestampType | T.TimestampNTZType) else None


def table_quads(df: DataFrame, table: str, key: str, links: dict[str, str] | None = None, columns: list[str] | None = None, graph: Column | None = None) -> DataFrame:
    """The direct mapping of a table: a type and a triple per column; ``links`` maps a column to the table it refers to. Null cells make no triple."""
    links = links or {}
    s = node(table, F.col(key))
    pairs = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(name(table.capitalize())).alias("o"))]
    for f in df.schema:
        if columns is None or f.name in columns:
            value = F.date_format(F.col(f.name), "yyyy-MM-dd'T'HH:mm:ss") if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) else F.col(f.name)
            o = node(links[f.name], F.col(f.name)) if f.name in links else literal(value, _datatype(f.dataType))
            pairs.append(F.struct(F.lit(name(f.name)).alias("p"), o.alias("o")))
    g = graph if graph is not None else F.lit(name(f"g/{table}"))
    return df.select(g.alias("g"), s.alias("s"), F.explode(F.array(*pairs)).alias("x")).select("g", "s", "x.p", "x.o").where("o is not null")


_ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)"


def unescaped(term: Column) -> Column:
    """A term with its numeric escapes decoded, so that one term has one spelling; what must stay escaped in a literal does."""
    found, between = F.regexp_extract_all(term, F.lit(_ESCAPE), F.lit(0)), F.split(term, _ESCAPE)
    digits = lambda e: F.lpad(F.substr(e, F.lit(3)), 8, "0")
    char = lambda e: F.decode(F.unhex(digits(e)), "UTF-32")
    held = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}
    keep = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])
    one = lambda e: F.when(F.substr(e, F.lit(2), F.lit(1)).isin("u", "U"), F.coalesce(F.try_element_at(keep, char(e)), char(e))).otherwise(e)
    joined = F.array_join(F.zip_with(between, F.concat(F.transform(found, one), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(term.contains("\\"), joined).otherwise(term)


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Quads or N-Triples text; comments and blank lines are passed over, a malformed line fails the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: unescaped(F.regexp_extract("value", _LINE, i))
    ok = F.when(F.col("value").rlike(_LINE), part(4)).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), F.col("value"))))
    return distinct_quads(lines.select(F.nullif(ok, F.lit("")).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o")))


def to_lines(quads: DataFrame) -> DataFrame:
    """N-Quads lines as ``value``."""
    return quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def distinct_quads(quads: DataFrame) -> DataFrame:
    """A graph is a set; null graphs are one graph."""
    return quads.dropDuplicates(["g", "s", "p", "o"])


def graph_filter(quads: DataFrame, which: str = "all") -> DataFrame:
    """Quads of one graph by its IRI, of the named graphs (``named``), of the default graph only (``default``), or all."""
    g = F.col("g")
    return {"all": lambda: quads, "named": lambda: quads.where(g.isNotNull()), "default": lambda: quads.where(g.isNull())}.get(which, lambda: quads.where(g == which))()


def dataset(quads: DataFrame, from_: list[str] | None = None, from_named: list[str] | None = None, default_uris: list[str] | None = None, named_uris: list[str] | None = None, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples of the default graph, quads that GRAPH sees) of a request.

    The query's FROM and FROM NAMED outrank the request's own default-graph and named-graph URIs. With
    only FROM there are no named graphs, with only FROM NAMED the default graph is empty; without
    either the default graph is the union of all, and GRAPH sees every named one. ``allowed`` is a
    ceiling on both.
    """
    if from_ is None and from_named is None:
        from_, from_named = default_uris, named_uris
    given = from_ is not None or from_named is not None
    default = in_graphs(quads, (from_ or []) if given else None, allowed)
    named = graph_filter(quads, "named") if not given else quads.where(F.col("g").isin(from_named) if from_named else F.lit(False))
    if allowed is not None:
        named = named.where(F.col("g").isin(allowed) if allowed else F.lit(False))
    return default, named


def in_graphs(quads: DataFrame, graphs: list[str] | None, allowed: list[str] | None = None) -> DataFrame:
    """Triples (s, p, o) of the union of ``graphs`` (None: all) within ``allowed`` (None: no ceiling), each once."""
    if graphs is not None:
        quads = quads.where(F.col("g").isin(graphs) if graphs else F.lit(False))
    if allowed is not None:
        quads = quads.where(F.col("g").isin(allowed) if allowed else F.lit(False))
    return quads.select("s", "p", "o").distinct()


def content_hash(quads: DataFrame, run: int = 4096) -> DataFrame:
    """(g, n, content_hash): a hash of the set of a graph's lines, in whatever order they come.

    The lines' SHA-256 digests are sorted within runs that share a prefix, and the runs' digests
    hashed in turn, level by level. The first prefix has as many hexadecimal digits as leave about
    ``run`` lines a run in the largest graph, so no group grows with the graph.
    """
    line = F.sha2(F.concat_ws(" ", "s", "p", "o", F.lit(".")), 256)
    lines = distinct_quads(quads).select("g", line.alias("h"))
    counts = lines.groupBy("g").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    digits = 0
    while most / 16**digits > run:
        digits += 2
    level = lines.select("g", F.col("h").alias("at"), "h")
    for d in range(digits, -1, -2):
        level = level.groupBy("g", F.substring("at", 1, d).alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return level.join(counts, F.equal_null(level["g"], counts["g"])).select(level["g"], "n", F.col("h").alias("content_hash"))
