"""Sources, requests and services on small rows."""

import pytest
from pyspark.sql import functions as F

from quadloom.functions import terms as x
from quadloom.operators import console, discovery, ontology, text, updates, vectors
from quadloom.plans import limits
from quadloom.sources import quads as qs
from quadloom.sources import rdf


def test_turtle_forms():
    doc = """@prefix : <http://e/> . @base <http://b/x> . PREFIX f: <http://f#>
    :a a :B ; f:p "x\\n\\u00e9"@EN , 'y' , 1 , 2.5, 1e3, true ; :q [ :r (1 :c) ; ] . <#z> :long \"\"\"a"b
c\"\"\" . _:g1 :p _:g1 . :g { :s :p :o } GRAPH <http://h> { :s :p [] }"""
    got = rdf.parse_turtle(doc, scope="k")
    plain = {(s, p, o) for g, s, p, o in got if g is None and not s.startswith("_:") and not o.startswith("_:")}
    assert {("<http://e/a>", "<http://f#p>", '"x\\né"@en'), ("<http://b/x#z>", "<http://e/long>", '"a\\"b\\nc"'), ("<http://e/a>", x.RDF_TYPE, "<http://e/B>")} <= plain
    assert len(got) == 17 and {g for g, *_ in got} == {None, "<http://e/g>", "<http://h>"}
    loop = [(s, o) for _, s, p, o in got if s == o]
    assert len(loop) == 1 and not any(loop[0][0] in (q[1], q[3]) for q in got if q[1] != q[3])  # a label of the text is no generated one
    with pytest.raises(ValueError):
        rdf.parse_turtle(":a :b")


def test_rdfxml_and_jsonld_agree():
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:T rdf:about="http://e/a" e:n="v"><e:p rdf:resource="http://e/b"/>
    <e:q xml:lang="EN">hi</e:q><e:c rdf:parseType="Collection"><rdf:Description rdf:about="http://e/m"/></e:c><e:r><e:U rdf:about="http://e/u"/></e:r></e:T></rdf:RDF>"""
    ld = """{"@context": {"e": "http://e/", "p": {"@id": "e:p", "@type": "@id"}, "c": {"@id": "e:c", "@container": "@list"}}, "@id": "e:a", "@type": "e:T", "e:n": "v", "p": "http://e/b",
    "e:q": {"@value": "hi", "@language": "en"}, "c": [{"@id": "e:m"}], "e:r": {"@id": "e:u", "@type": "e:U"}}"""
    flat = lambda qs_: sorted((s[:2] if s[0] == "_" else s, p, o[:2] if o[0] == "_" else o) for _, s, p, o in qs_)
    assert flat(rdf.parse_rdfxml(xml)) == flat(rdf.parse_jsonld(ld)) and len(flat(rdf.parse_rdfxml(xml))) == 9


def test_a_file_that_does_not_parse_fails_the_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://e/a> <http://e/b> ")
    with pytest.raises(Exception, match="a.ttl"):
        rdf.read_rdf(spark, str(tmp_path), "turtle").collect()


def test_escapes_have_one_spelling(spark):
    rows = spark.createDataFrame([('"\\u0041\\U0001F600\\\\u0041\\n\\u000A"',), ('"plain"',), (None,)], "t string")
    assert [r[0] for r in rows.select(qs.unescaped(F.col("t"))).collect()] == ['"A\U0001f600\\\\u0041\\n\\n"', '"plain"', None]


def test_swapped_letters_are_one_edit(spark):
    df = spark.createDataFrame([("steel",), ("setel",), ("stele",), ("stool",), ("steal wheel",), (None,)], "t string")
    assert {r.t for r in text.text_scores(df, "t", {"t": 1.0}, "steel").collect()} == {"steel", "setel", "stele", "steal wheel"}
    assert text.query_tokens("éa b_1 B_1") == ["e", "a", "b_1"]  # as documents are cut


def test_request_bounds(spark):
    for bad in ({"limit": 0}, {"limit": 1001}, {"text": "x" * 5000}, {"provenance": "x" * 2000}, {"created": ("2021-01-02", "2021-01-01")}, {"sort": "size"}):
        with pytest.raises(ValueError):
            discovery.Request(**bad).check()
    assert discovery.classic_text("search/type=x&/steel and not wood") == "steel wood" and discovery.classic_text("") is None
    assert [discovery.request_kind(t) for t in ("sequence:ac", "similar:<x>", "steel", " ")] == ["sequence", "similar", "text", "browse"]


def test_vector_queries_are_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.1]), (7, [2.0, 0.1])], "id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [3.0])], "query long, q array<double>")
    got = vectors.nearest_each(df, "v", "id", queries, "cosine", 2).collect()
    assert sorted((r["query"], r["id"]) for r in got) == [(1, 1), (1, 6), (4, 4)]
    assert vectors.nearest_each(df, "v", "id", queries.limit(0)).count() == 0 and vectors.nearest_each(df.limit(0), "v", "id", queries).count() == 0
    for q, dim, metric in (([], None, "dot"), ([0.0], None, "cosine"), ([1.0], 2, "dot"), ([float("inf")], None, "dot"), ([1.0], 1, "hamming")):
        with pytest.raises(ValueError):
            vectors.check_query(q, dim, metric)
    assert vectors.choose("cosine", False, 10, 10**7) == "cells" and vectors.choose("cosine", True, 10, 10**7) == "exact"
    with pytest.raises(ValueError):
        vectors.choose("cosine", False, 10**6, 5)


def test_write_modes_and_steps(spark):
    q = spark.createDataFrame([("<g>", "<a>", "<p>", "<b>"), (None, "<a>", "<p>", "<b>")], qs.SCHEMA)
    with pytest.raises(ValueError):
        updates.write_graph(q, "<g>", q, "fail")
    after, counts = updates.apply_steps(q, [("clear", None), ("insert", q), ("delete", q.limit(0))], "<h>")
    assert [(r.step, r.inserted, r.deleted) for r in counts.orderBy("step").collect()] == [(0, 0, 1), (1, 1, 0), (2, 0, 0)]
    assert {r.g for r in after.collect()} == {"<g>", "<h>"}


def test_first_term_of_an_id_stays(spark, tmp_path):
    (tmp_path / "a.obo").write_text("format-version: 1.2\n\n[Term]\nid: SO:1\nname: one\n\n[Term]\nid: SO:1\nname: two\nis_a: SO:9\n\n[Term]\nid: X:1\nname: x\nis_a: SO:1 ! one\n")
    terms = ontology.read_obo(spark, str(tmp_path / "a.obo"))
    assert {(r.id, r.name) for r in terms.collect()} == {("SO:1", "one"), ("X:1", "x")}
    (own,) = ontology.plan(terms, "X").collect()
    assert own.is_a == [] and own.iri == "http://purl.obolibrary.org/obo/X_1"


def test_limits_of_a_request(spark):
    rows, more = limits.answer(spark.range(5).toDF("n"), limits.Limits(rows=3))
    assert len(rows) == 3 and more and set(rows[0]) == {"n"}
    with pytest.raises(limits.TooLarge):
        limits.answer(spark.range(5).toDF("n"), limits.Limits(answer_bytes=4))
    with pytest.raises(limits.TooLarge):
        limits.Limits(text_bytes=2).check_text("abc")
    with pytest.raises(limits.TooSlow):
        slow = F.udf(lambda i: __import__("time").sleep(20) or i, "long")
        limits.answer(spark.range(1).select(slow("id").alias("n")), limits.Limits(seconds=0.5))
    assert console.validate_sql(spark, "SELECT 1") is None and console.validate_sql(spark, "SELECT 1 FROM (").kind == "syntax"
