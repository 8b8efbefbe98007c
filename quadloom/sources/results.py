"""Result sinks: solutions as JSON, XML, CSV and TSV, graphs as Turtle, JSON-LD and RDF/XML; a line or a subject a row, for ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import datatype, is_blank, is_iri, is_literal, lang, str_

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def truncated(solutions: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``max_rows`` solutions, one row: whether there were more)."""
    return solutions.limit(max_rows), solutions.limit(max_rows + 1).agg((F.count("*") > max_rows).alias("truncated"))


def _text(t: Column) -> Column:
    return F.when(is_blank(t), t.substr(F.lit(3), F.length(t))).otherwise(str_(t))


def _tagged(t: Column) -> Column:
    return F.when(is_literal(t) & t.endswith(">") & t.contains('"^^<'), datatype(t))


def json_rows(solutions: DataFrame) -> DataFrame:
    """``value``: a solution a row as a W3C JSON binding object; unbound variables are left out."""

    def binding(t: Column) -> Column:
        kind = F.when(is_iri(t), "uri").when(is_blank(t), "bnode").otherwise("literal")
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), _text(t).alias("value"), F.nullif(lang(t), F.lit("")).alias("xml:lang"), _tagged(t).alias("datatype")))

    return solutions.select(F.to_json(F.struct(*[binding(F.col(c)).alias(c) for c in solutions.columns])).alias("value"))


def json_document(solutions: DataFrame, max_rows: int) -> DataFrame:
    """``value``: one row, the whole W3C JSON document of at most ``max_rows`` solutions, with ``truncated`` beside head and results."""
    rows, more = truncated(solutions, max_rows)
    names = ",".join(f'"{c}"' for c in solutions.columns)
    body = json_rows(rows).agg(F.array_join(F.collect_list("value"), ",").alias("b"))
    return body.join(more).select(F.concat(F.lit(f'{{"head":{{"vars":[{names}]}},"results":{{"bindings":['), "b", F.lit(']},"truncated":'), F.col("truncated").cast("string"), F.lit("}")).alias("value"))


def csv_rows(solutions: DataFrame) -> DataFrame:
    """``value``: W3C CSV, bare lexical forms, quoted where they must be; the head line is the columns' names."""
    cell = lambda t: F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    shown = lambda t: F.coalesce(F.when(is_blank(t), t).otherwise(cell(str_(t))), F.lit(""))
    return solutions.select(F.concat_ws(",", *[shown(F.col(c)) for c in solutions.columns]).alias("value"))


def tsv_rows(solutions: DataFrame) -> DataFrame:
    """``value``: W3C TSV, terms as they are written in Turtle; numbers of the common types bare."""
    bare = lambda t: F.when(_tagged(t).isin(*[f"http://www.w3.org/2001/XMLSchema#{x}" for x in ("integer", "decimal", "double")]), str_(t)).otherwise(t)
    return solutions.select(F.concat_ws("\t", *[F.coalesce(bare(F.col(c)), F.lit("")) for c in solutions.columns]).alias("value"))


def _xml(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def xml_rows(solutions: DataFrame) -> DataFrame:
    """``value``: a ``result`` element of W3C XML a solution."""

    def binding(name: str) -> Column:
        t = F.col(name)
        inner = F.when(is_iri(t), F.concat(F.lit("<uri>"), _xml(_text(t)), F.lit("</uri>"))).when(is_blank(t), F.concat(F.lit("<bnode>"), _xml(_text(t)), F.lit("</bnode>")))
        more = F.when(lang(t) != "", F.concat(F.lit(' xml:lang="'), lang(t), F.lit('"'))).when(_tagged(t).isNotNull(), F.concat(F.lit(' datatype="'), _xml(_tagged(t)), F.lit('"'))).otherwise("")
        inner = inner.otherwise(F.concat(F.lit("<literal"), more, F.lit(">"), _xml(_text(t)), F.lit("</literal>")))
        return F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{name}">'), inner, F.lit("</binding>"))).otherwise("")

    return solutions.select(F.concat(F.lit("<result>"), *[binding(c) for c in solutions.columns], F.lit("</result>")).alias("value"))


def turtle_rows(triples: DataFrame) -> DataFrame:
    """``value``: a subject a row, its predicates and objects in order."""
    objects = triples.select("s", "p", "o").distinct().groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), " , ").alias("os"))
    pairs = objects.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "os"))), lambda x: F.concat(x["p"], F.lit(" "), x["os"])), " ; ").alias("body"))
    return pairs.select(F.concat("s", F.lit(" "), "body", F.lit(" .")).alias("value"))


def jsonld_rows(triples: DataFrame) -> DataFrame:
    """``value``: an expanded JSON-LD node object a subject; joined by commas in brackets they are a document."""
    t = F.col("o")
    ref = F.when(is_blank(t), t).otherwise(str_(t))
    value = F.when(is_literal(t), F.struct(F.lit(None).cast("string").alias("@id"), str_(t).alias("@value"), F.nullif(lang(t), F.lit("")).alias("@language"), _tagged(t).alias("@type")))
    value = value.otherwise(F.struct(ref.alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"), F.lit(None).cast("string").alias("@type")))
    per = triples.select("s", "p", "o").distinct().groupBy("s", "p").agg(F.array_sort(F.collect_list(value)).alias("vs"))
    rows = per.groupBy("s").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(str_(F.col("p")).alias("k"), F.col("vs").alias("v")))))).alias("m"))
    head = F.to_json(F.struct(F.when(is_blank(F.col("s")), F.col("s")).otherwise(str_(F.col("s"))).alias("@id")))
    return rows.withColumn("h", head).select(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(","), F.expr("substring(m, 2)")).alias("value"))


def rdfxml_rows(triples: DataFrame) -> DataFrame:
    """``value``: an ``rdf:Description`` a subject, each property with its own namespace; predicates must end in a name."""
    p, o = str_(F.col("p")), F.col("o")
    local = F.regexp_extract(p, r"([A-Za-z_][\w.-]*)$", 1)
    space = F.expr("substring(_p, 1, length(_p) - length(_l))")
    rows = triples.select("s", "p", "o").distinct().withColumn("_p", p).withColumn("_l", local).withColumn("_n", space)
    more = F.when(is_iri(o), F.concat(F.lit(' rdf:resource="'), _xml(str_(o)), F.lit('"/>'))).when(is_blank(o), F.concat(F.lit(' rdf:nodeID="'), o.substr(F.lit(3), F.length(o)), F.lit('"/>')))
    kind = F.when(lang(o) != "", F.concat(F.lit(' xml:lang="'), lang(o), F.lit('"'))).when(_tagged(o).isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(_tagged(o)), F.lit('"'))).otherwise("")
    more = more.otherwise(F.concat(kind, F.lit(">"), _xml(str_(o)), F.lit("</n:"), F.col("_l"), F.lit(">")))
    element = F.concat(F.lit("<n:"), F.col("_l"), F.lit(' xmlns:n="'), _xml(F.col("_n")), F.lit('"'), more)
    about = F.when(is_blank(F.col("s")), F.concat(F.lit(' rdf:nodeID="'), F.expr("substring(s, 3)"), F.lit('"'))).otherwise(F.concat(F.lit(' rdf:about="'), _xml(str_(F.col("s"))), F.lit('"')))
    body = rows.select("s", element.alias("e")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("e"))
    return body.select(F.concat(F.lit(f'<rdf:Description xmlns:rdf="{_RDF}"'), about, F.lit(">"), "e", F.lit("</rdf:Description>")).alias("value"))
