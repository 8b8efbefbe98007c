"""More queries of the catalogue: sources and sinks, term functions, updates, views, discovery, text index, sequences, vectors, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _DNA, _PAIRS, _dna, key, local, name, num, quads, query, table, text_of
from .functions import terms as x
from .operators import access, components, discovery, ontology, patterns, sequences, text, text_index, traverse, updates, vectors, views
from .operators.views import Vocabulary
from .plans.lineage import cut, fresh_path
from .sources import quads as qs
from .sources import archives, rdf, results, store
from .sources import sequence_files as files

short = lambda c: F.regexp_extract(c, "org/(.*)>", 1)

# ---- sources and sinks

_NATIONS = """SELECT 'nation/' || n_nationkey AS s, 'n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'n_regionkey', 'region/' || n_regionkey FROM nation
    UNION ALL SELECT 'nation/' || n_nationkey, 'n_nationkey', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'nation/' || n_nationkey, '22-rdf-syntax-ns#type', 'Nation' FROM nation"""


def _spo(q):
    o = F.when(x.is_iri(F.col("o")), short("o")).otherwise(text_of("o"))
    return q.select(short("s").alias("s"), local("p").alias("p"), o.alias("o"))


def _stored(spark, d, rows, kind, head="", tail="", ending="txt"):
    """Rows of text written as files of a format that need a head and a tail, a file a region of rows."""
    path = fresh_path(spark, kind)
    body = rows.withColumn("n", F.pmod(F.xxhash64("value"), F.lit(4))).groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("value")), ",\n" if kind == "jsonld" else "\n").alias("b"))
    body.select("n", F.concat(F.lit(head), "b", F.lit(tail)).alias("value")).write.partitionBy("n").option("lineSep", "\n").text(path)
    return path


@query(_NATIONS)
def turtle_round_trip(spark, d):
    path = _stored(spark, d, results.turtle_rows(quads(spark, d, "nation")), "turtle")
    return _spo(rdf.read_rdf(spark, f"{path}/*/*.txt", "turtle"))


@query(_NATIONS)
def jsonld_round_trip(spark, d):
    path = _stored(spark, d, results.jsonld_rows(quads(spark, d, "nation")), "jsonld", "[", "]")
    return _spo(rdf.read_rdf(spark, f"{path}/*/*.txt", "jsonld"))


@query(_NATIONS)
def rdfxml_round_trip(spark, d):
    path = _stored(spark, d, results.rdfxml_rows(quads(spark, d, "nation")), "rdfxml", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n', "\n</rdf:RDF>")
    return _spo(rdf.read_rdf(spark, f"{path}/*/*.txt", "rdfxml"))


@query("SELECT 'g/' || r_regionkey AS g, 'nation/' || n_nationkey AS s, n_name AS o FROM nation JOIN region ON r_regionkey = n_regionkey")
def trig_source(spark, d):
    n = table(spark, d, "nation")
    inside = F.concat(F.lit("e:n"), "n_nationkey", F.lit(" rdfs:label '''"), "n_name", F.lit("''' ."))
    blocks = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(inside)), "\n").alias("b"))
    path = fresh_path(spark, "trig")
    head = "@prefix e: <http://example.org/nation/> .\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
    rows = blocks.select("n_regionkey", F.concat(F.lit(head), F.lit("<http://example.org/g/"), "n_regionkey", F.lit("> {\n"), F.replace("b", F.lit("e:n"), F.lit("e:")), F.lit("\n}")).alias("value"))
    rows.write.partitionBy("n_regionkey").text(path)
    q = rdf.read_rdf(spark, f"{path}/*/*.txt", "turtle")
    return q.select(short("g").alias("g"), short("s").alias("s"), text_of("o").alias("o"))


@query("SELECT n_nationkey AS n, 'é ' || n_name || chr(10) || '\"' AS label FROM nation")
def nquads_escapes(spark, d):
    n = table(spark, d, "nation")
    path = fresh_path(spark, "nquads")
    line = F.concat(qs.node("nation", F.col("n_nationkey")), F.lit(f' {name("label")} "\\u00E9\\U00000020'), "n_name", F.lit('\\u000A\\u0022" .'))
    n.select(line.alias("value")).write.text(path)
    q = qs.read_nquads(spark, path)
    same = q.where(F.col("o").startswith('"é '))  # one spelling for equal terms
    return same.select(key("s").alias("n"), text_of("o").alias("label"))


@query("""SELECT '{"n":{"type":"uri","value":"http://example.org/nation/' || n_nationkey || '"},"name":{"type":"literal","value":"' || n_name || '"},"k":{"type":"literal","value":"' || n_nationkey || '","datatype":"http://www.w3.org/2001/XMLSchema#integer"}}' AS value FROM nation""")
def result_json(spark, d):
    s = patterns.star(quads(spark, d, "nation"), "n", {"name": name("n_name"), "k": name("n_nationkey")})
    return results.json_rows(s)


@query("""SELECT 'http://example.org/part/' || p_partkey || ',' || CASE WHEN p_name LIKE '%,%' THEN '"' || p_name || '"' ELSE p_name END || ',' || p_size AS value FROM part""")
def result_csv(spark, d):
    return results.csv_rows(patterns.star(quads(spark, d, "part", columns=["p_name", "p_size"]), "p", {"name": name("p_name"), "size": name("p_size")}))


@query("""SELECT '<http://example.org/part/' || p_partkey || '>' || chr(9) || '"' || p_name || '"' || chr(9) || p_size AS value FROM part""")
def result_tsv(spark, d):
    return results.tsv_rows(patterns.star(quads(spark, d, "part", columns=["p_name", "p_size"]), "p", {"name": name("p_name"), "size": name("p_size")}))


@query("""SELECT '<result><binding name="n"><uri>http://example.org/nation/' || n_nationkey || '</uri></binding><binding name="r"><literal>' || n_name || '</literal></binding></result>' AS value FROM nation""")
def result_xml(spark, d):
    return results.xml_rows(patterns.match(quads(spark, d, "nation"), "?n", name("n_name"), "?r"))


@query("SELECT count(*) > 10 AS truncated FROM nation")
def result_truncated(spark, d):
    return results.truncated(patterns.match(quads(spark, d, "nation"), "?n", name("n_name"), "?r"), 10)[1]


@query("SELECT 'nation/' || n_nationkey AS s, 'g/' || CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'nation' END AS g FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT 'region/' || r_regionkey, 'g/new' FROM region")
def import_modes(spark, d):
    """A replaced graph, then a merge into another."""
    q = quads(spark, d, "nation", columns=["n_name"])
    keep = q.where(F.col("p") == name("n_name")).join(quads(spark, d, "nation", columns=["n_regionkey"]).where(F.col("p") == name("n_regionkey")).select("s", F.col("o").alias("r")), "s")
    low = updates.write_graph(q.limit(0), name("g/nation"), keep.where(key("r").isin(0, 2)), "replace")
    new = updates.write_graph(low, name("g/new"), keep.where(key("r") == 1), "fail")
    r = quads(spark, d, "region", columns=["r_name"]).where(F.col("p") == name("r_name"))
    return updates.write_graph(new, name("g/new"), r, "merge").select(short("s").alias("s"), short("g").alias("g"))


@query("SELECT count(*) FILTER (n_regionkey = 0) AS unnamed, count(*) FILTER (n_regionkey <> 0) AS named, count(*) FILTER (n_regionkey = 3) AS one FROM nation")
def graph_filters(spark, d):
    df = table(spark, d, "nation")
    q = qs.table_quads(df, "nation", "n_nationkey", columns=["n_name"], graph=F.when(F.col("n_regionkey") > 0, x.iri(F.concat(F.lit(qs.BASE + "g/"), "n_regionkey")))).where(F.col("p") == name("n_name"))
    n = lambda w, c: qs.graph_filter(q, w).agg(F.count("*").alias(c))
    return n("default", "unnamed").join(n("named", "named")).join(n(name("g/3"), "one"))


@query("SELECT 'default' AS part, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'named', count(*) FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'protocol', count(*) FROM nation WHERE n_regionkey IN (2, 3) UNION ALL SELECT 'union', count(*) FROM nation WHERE n_regionkey IN (1, 2, 3)")
def dataset_precedence(spark, d):
    """FROM and FROM NAMED outrank the protocol's graphs, these the union of all; a ceiling (here 1, 2, 3) holds for each."""
    df = table(spark, d, "nation")
    q = qs.table_quads(df, "nation", "n_nationkey", columns=["n_name"], graph=x.iri(F.concat(F.lit(qs.BASE + "g/"), "n_regionkey"))).where(F.col("p") == name("n_name"))
    g = lambda *n: [name(f"g/{i}") for i in n]
    default, named = qs.dataset(q, g(0, 1), g(3, 4), g(2, 3), g(1), allowed=g(1, 2, 3))
    protocol, _ = qs.dataset(q, None, None, g(2, 3, 4), g(1), allowed=g(1, 2, 3))
    all_, _ = qs.dataset(q, allowed=g(1, 2, 3))
    out = None
    for part, rows in (("default", default), ("named", named), ("protocol", protocol), ("union", all_)):
        n = rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("SELECT 'part/' || p_partkey AS s, p AS p FROM part, (VALUES ('p_name'), ('p_size'), ('p_partkey'), ('p_brand'), ('p_type'), ('p_retailprice'), ('~type')) v(p) WHERE '<http://example.org/part/' || p_partkey || '>' > '<http://example.org/part/2>' ORDER BY '<http://example.org/part/' || p_partkey || '>', p LIMIT 50")
def quads_keyset(spark, d):
    q = quads(spark, d, "part")
    page = views.quads_page(q, (name("g/part"), name("part/2"), "~", ""), 50, name("g/part"))
    return page.select(short("s").alias("s"), F.when(F.col("p") == x.RDF_TYPE, "~type").otherwise(local("p")).alias("p"))


# ---- term functions and aggregates


@query("SELECT event_id AS e, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::DOUBLE AS s, 'Z' AS tz, 'PT0S' AS zone FROM events")
def sparql_time_funcs(spark, d):
    df = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("t"))
    s = df.select(F.col("event_id").alias("e"), x.literal(F.col("t"), x.XSD + "dateTime").alias("t"))
    t = F.col("t")
    return s.select("e", x.hours(t).alias("h"), x.minutes(t).alias("m"), x.seconds(t).cast("double").alias("s"), x.tz(t).alias("tz"), x.timezone(t).alias("zone"))


@query(
    """SELECT doc_id AS doc, lang AS tag, lang = 'en' AS english, starts_with(lang, 'f') AS f, false AS iri, true AS lit, false AS blank, '22-rdf-syntax-ns#langString' AS dt, lang || 'x' AS typed, 'http://example.org/t' AS typed_dt, true AS same, md5(lang) AS node FROM documents"""
)
def sparql_term_funcs(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang")
    t, typed = x.str_lang(F.lit("some text"), F.upper("lang")), x.str_dt(F.concat("lang", F.lit("x")), F.lit("<http://example.org/t>"))
    s = df.select(F.col("doc_id").alias("doc"), "lang", t.alias("t"), typed.alias("y"))
    t, y = F.col("t"), F.col("y")
    return s.select("doc", x.lang(t).alias("tag"), x.lang_matches(x.lang(t), "EN").alias("english"), x.lang_matches(x.lang(t), "fr").alias("f"), x.is_iri(t).alias("iri"), x.is_literal(t).alias("lit"), x.is_blank(t).alias("blank"), F.regexp_extract(x.datatype(t), "([^/]+)$", 1).alias("dt"), x.str_(y).alias("typed"), x.datatype(y).alias("typed_dt"), x.same_term(t, x.str_lang(F.lit("some text"), F.col("lang"))).alias("same"), F.substring(x.bnode(F.col("lang")), 4, 99).alias("node"))


@query("SELECT o_orderkey AS o, o_orderkey + 9007199254740992 = o_orderkey + 9007199254740993 AS eq, true AS lt, (o_orderkey + 9007199254740993)::VARCHAR AS total FROM orders")
def sparql_exact_integers(spark, d):
    big = lambda n: x.literal(F.col("o_orderkey") + F.lit(n), x.XSD + "integer")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), big(9007199254740992).alias("a"), big(9007199254740993).alias("b"))
    one = F.lit(f'"1"^^<{x.XSD}integer>')
    return s.select("o", x.equal(F.col("a"), F.col("b")).alias("eq"), x.less(F.col("a"), F.col("b")).alias("lt"), x.str_(x.arithmetic(F.col("a"), one, "+")).alias("total"))


@query("SELECT n_nationkey AS n, '22-' || n_nationkey AS u, true AS fresh, true AS text FROM nation")
def sparql_uuid(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), x.uuid_iri().alias("a"), x.str_uuid().alias("b"))
    return s.select("n", F.concat(F.lit("22-"), "n").alias("u"), F.col("a").rlike("^<urn:uuid:[0-9a-f-]{36}>$").alias("fresh"), F.col("b").rlike('^"[0-9a-f-]{36}"$').alias("text"))


@query("SELECT p_brand AS brand, sum(DISTINCT p_size)::DOUBLE AS total, round(avg(DISTINCT p_size), 6)::DOUBLE AS mean, min(p_name) AS some, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1")
def sparql_distinct_aggregates(spark, d):
    s = patterns.star(quads(spark, d, "part", columns=["p_brand", "p_size", "p_name", "p_type"]), "p", {"brand": name("p_brand"), "size": name("p_size"), "n": name("p_name"), "t": name("p_type")})
    a = patterns.aggregate(s, ["brand"], total=patterns.total_distinct(num("size")), mean=F.round(patterns.mean_distinct(num("size")), 6), some=patterns.sample(text_of("n")), types=patterns.group_concat(text_of("t"), "|", distinct=True))
    return a.withColumn("brand", text_of("brand"))


@query("SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS n, r FROM (SELECT *, n_regionkey r FROM customer, nation WHERE n_nationkey < 5 AND (c_custkey % 3 <> 0 OR c_nationkey = n_nationkey)) WHERE c_custkey % 2 = 1")
def sparql_join_unbound(spark, d):
    """A shared variable that is unbound in some rows: those join with all, without a cartesian plan for the rest."""
    c = table(spark, d, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("c"), F.when(F.col("c_custkey") % 3 == 0, qs.node("nation", F.col("c_nationkey"))).alias("n"))
    n = table(spark, d, "nation").where("n_nationkey < 5").select(qs.node("nation", F.col("n_nationkey")).alias("n"), F.col("n_regionkey").alias("r"))
    j = patterns.join(c, n, maybe_unbound=("n",))
    return j.select("c", F.when(F.col("c") % 3 == 0, key("n").cast("int")).alias("n"), "r")


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey % 3 <> 0 OR c_nationkey >= 5")
def sparql_minus_unbound(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("n"))
    n = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("n"))
    return patterns.minus(c, n, maybe_unbound=("n",)).select("c")


@query("SELECT 'nation/' || n_nationkey AS y FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5 UNION SELECT 'region/' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def sparql_path_plus_bound(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    r = patterns.one_or_more(patterns.edges(q, name("c_nationkey"), name("n_regionkey")), from_=patterns.values(spark, ["x"], [(name("customer/5"),)]))
    return r.select(short("y").alias("y"))


@query("SELECT 'nation/' || n_nationkey AS a, 'nation/' || n_nationkey AS b FROM nation UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation")
def sparql_path_star_optional(spark, d):
    q = quads(spark, d, "nation", columns=["n_regionkey"])
    e = patterns.edges(q, name("n_regionkey"))
    nodes = q.select("s").distinct()
    return patterns.zero_or_more(e, nodes).union(patterns.zero_or_one(e, nodes)).distinct().select(short("x").alias("a"), short("y").alias("b"))


@query("SELECT 'nation/' || n_nationkey AS a, n_nationkey::VARCHAR AS b FROM nation UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation")
def sparql_path_negated(spark, d):
    e = patterns.edges(quads(spark, d, "nation"), x.RDF_TYPE, name("n_regionkey"), negate=True)
    return e.select(short("x").alias("a"), text_of("y").alias("b"))


# ---- updates


@query("SELECT * FROM (SELECT 0 AS step, 'insert' AS kind, (SELECT count(*) FROM region) AS inserted, 0::BIGINT AS deleted UNION ALL SELECT 1, 'delete', 0, (SELECT count(*) FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 2, 'insert', 0, 0 UNION ALL SELECT 3, 'clear', 0, (SELECT count(*) FROM region))")
def update_outcomes(spark, d):
    """Steps in order, with what each really changed; templates without a graph go to the default target."""
    q = quads(spark, d, "nation", columns=["n_regionkey"]).where(F.col("p") == name("n_regionkey"))
    r = quads(spark, d, "region", columns=["r_name"]).where(F.col("p") == name("r_name"))
    gone = q.where(F.col("o") == name("region/1"))
    bare = r.withColumn("g", F.lit(None).cast("string"))
    _, counts = updates.apply_steps(q, [("insert", bare), ("delete", gone), ("insert", bare), ("clear", name("g/target"))], name("g/target"))
    return counts


@query("SELECT 'nation/' || n_nationkey AS s FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'region/' || r_regionkey FROM region WHERE r_regionkey <> 2")
def update_remove_object(spark, d):
    """A region goes with the nations whose top level it is, and with all references to it."""
    q = quads(spark, d, "nation", "region", columns=["n_regionkey", "r_name"]).where(F.col("p") != x.RDF_TYPE)
    top = q.where(F.col("p") == name("n_regionkey")).select("g", "s", F.lit(name("top")).alias("p"), "o").union(q.where(F.col("p") == name("r_name")).select("g", "s", F.lit(name("top")).alias("p"), F.col("s").alias("o")))
    return updates.remove_object(q.union(top), name("region/2"), name("top"), name("member")).select(short("s").alias("s")).distinct()


@query("SELECT 'nation/' || n_nationkey AS s FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'region/' || r_regionkey FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 2")
def update_remove_collection(spark, d):
    """A collection goes with its members, all that has one of those as its top level, and all references to them: a region with its nations and their suppliers."""
    q = quads(spark, d, "nation", "region", "supplier", columns=["n_regionkey", "r_name", "s_nationkey"]).where(F.col("p") != x.RDF_TYPE)
    own = lambda p: q.where(F.col("p") == name(p)).select("g", "s", F.lit(name("top")).alias("p"), F.col("s").alias("o"))
    top = own("r_name").union(own("n_regionkey")).union(q.where(F.col("p") == name("s_nationkey")).select("g", "s", F.lit(name("top")).alias("p"), "o"))
    held = q.where(F.col("p") == name("n_regionkey")).select("g", F.col("o").alias("s"), F.lit(name("member")).alias("p"), F.col("s").alias("o"))
    left = updates.remove_object(cut(q.union(top).union(held)), name("region/2"), name("top"), name("member"), with_members=True)
    return left.select(short("s").alias("s")).distinct()


@query("SELECT 'copy/' || n_nationkey AS s, 'n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'copy/' || n_nationkey, 'n_regionkey', 'region/' || n_regionkey FROM nation UNION ALL SELECT 'copy/' || n_nationkey, 'stamp', 'me' FROM nation")
def update_remint(spark, d):
    q = quads(spark, d, "nation", columns=["n_name", "n_regionkey"]).where(F.col("p") != x.RDF_TYPE)
    old = q.select("g", "s").distinct().select("g", "s", F.lit(name("stamp")).alias("p"), F.lit('"old"').alias("o"))
    stamps = table(spark, d, "nation").select(qs.node("copy", F.col("n_nationkey")).alias("s"), F.lit(name("stamp")).alias("p"), F.lit('"me"').alias("o"))
    return _spo(updates.remint(q.union(old), {qs.BASE + "nation/": qs.BASE + "copy/", qs.BASE + "n": qs.BASE + "n"}, [name("stamp")], stamps))


# ---- views and typed objects

_V = Vocabulary(name("p_name"), name("p_type"), name("p_brand"), name("p_brand"), name("p_type"), name("self"), name("member"))


def _part_quads(spark, d):
    return quads(spark, d, "part", columns=["p_name", "p_type", "p_brand"])


def _member_quads(spark, d):
    """Brands as collections of parts; a part refers to the part of half its number, of the same brand or not."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    g = F.lit(name("g/part"))
    m = p.select(g.alias("g"), x.iri(F.concat(F.lit(qs.BASE + "brand/"), "p_brand")).alias("s"), F.lit(name("member")).alias("p"), qs.node("part", F.col("p_partkey")).alias("o"))
    half = p.where("p_partkey > 0").select(g.alias("g"), qs.node("part", F.col("p_partkey")).alias("s"), F.lit(name("half")).alias("p"), qs.node("part", F.floor(F.col("p_partkey") / 2)).alias("o"))
    return m, half


@query(
    """WITH e AS (SELECT p_partkey a, p_partkey // 2 b FROM part WHERE p_partkey > 0), w AS (SELECT a, b FROM e UNION SELECT e.a, f.b FROM e JOIN e f ON f.a = e.b)
    SELECT m.p_partkey AS p FROM part m WHERE p_brand = 'Brand#17' AND NOT EXISTS (SELECT 1 FROM w JOIN part o ON o.p_partkey = w.a WHERE o.p_brand = m.p_brand AND w.b = m.p_partkey AND w.a <> w.b)"""
)
def view_collection_roots(spark, d):
    m, half = _member_quads(spark, d)
    roots = views.members(m.union(half), _V)
    return views.in_scope(views.object_metadata(_part_quads(spark, d), _V), root_of=roots, collection=name("brand/Brand#17"), root_only=True).select(key("s").alias("p"))


@query(
    """WITH e AS (SELECT p_partkey a, p_partkey // 2 b FROM part WHERE p_partkey > 0), w AS (SELECT a, b FROM e UNION SELECT e.a, f.b FROM e JOIN e f ON f.a = e.b)
    SELECT m.p_partkey AS p FROM part m WHERE p_brand = 'Brand#3' AND NOT EXISTS (SELECT 1 FROM w JOIN part o ON o.p_partkey = w.a WHERE o.p_brand = m.p_brand AND w.b = m.p_partkey AND w.a <> w.b)"""
)
def view_root_by_type_and_role(spark, d):
    m, half = _member_quads(spark, d)
    return views.in_scope(views.object_metadata(_part_quads(spark, d), _V), type_=name("Part"), role='"Brand#3"', root_of=views.members(m.union(half), _V)).select(key("s").alias("p"))


@query(
    """SELECT p_partkey AS p, p_size AS version, 'brand/' || p_brand AS role FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_size, NULL FROM part WHERE p_size % 2 = 1"""
)
def view_field_prefixes(spark, d):
    """Roles under one prefix only; an object with none has an unbound cell."""
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    s = qs.node("part", F.col("p_partkey"))
    rows = lambda p, o: df.select(F.lit(name("g/part")).alias("g"), s.alias("s"), F.lit(name(p)).alias("p"), o.alias("o"))
    brand = x.iri(F.concat(F.when(F.col("p_size") % 2 == 0, F.lit(qs.BASE + "brand/")).otherwise(F.lit(qs.BASE + "other/")), "p_brand"))
    q = rows("role", brand).union(rows("role", F.lit(name("other/all")))).union(rows("version", x.literal(F.col("p_size"), x.XSD + "integer")))
    o = views.object_metadata(q, Vocabulary(name("none"), name("none"), name("none"), name("role"), name("none"), name("self"), name("member"), version=name("version")))
    listed = views.object_list(o, role_prefix=qs.BASE + "brand/").select("s", "role")
    return listed.join(o.select("s", "version"), "s").select(key("s").alias("p"), num("version").cast("int").alias("version"), short("role").alias("role"))


@query("SELECT p_partkey AS p FROM part WHERE p_brand = 'Brand#17' AND '<http://example.org/part/' || p_partkey || '>' > '<http://example.org/part/15>' ORDER BY '<http://example.org/part/' || p_partkey || '>' LIMIT 12")
def object_list_filtered(spark, d):
    """Class, role, graph and keyset together: a page after another."""
    o = views.in_scope(views.object_metadata(_part_quads(spark, d), _V).where(F.col("g") == name("g/part")), type_=name("Part"), role='"Brand#17"')
    return views.keyset_page(o, name("part/15"), 12).select(key("s").alias("p"))


@query("SELECT p_name AS display_id, p_brand AS role FROM part WHERE p_partkey = 3")
def view_object_metadata(spark, d):
    o = views.object_metadata(_part_quads(spark, d), _V)
    return views.object_row(o, name("part/3"), ["display_id"], ["roles"]).select(text_of("display_id").alias("display_id"), text_of("roles").alias("role"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g, count(*) AS n, count(*) FILTER (p_name LIKE '% new') AS fresh FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' new' ELSE p_name END p_name FROM part) GROUP BY 1")
def view_refresh(spark, d):
    """One graph's rows are made anew, the other's stay as stored."""
    df = table(spark, d, "part").select("p_partkey", "p_name")
    graph = F.when(F.col("p_partkey") % 2 == 0, name("g/even")).otherwise(name("g/odd"))
    stored = views.object_metadata(qs.table_quads(df, "part", "p_partkey", columns=["p_name"], graph=graph), _V)
    now = qs.table_quads(df.withColumn("p_name", F.concat("p_name", F.lit(" new"))), "part", "p_partkey", columns=["p_name"], graph=graph)
    rows = views.refresh_graph(stored, now, name("g/even"), _V)
    return rows.groupBy(local("g").alias("g")).agg(F.count("*").alias("n"), F.count_if(text_of("display_id").endswith(" new")).alias("fresh"))


@query("SELECT p_partkey AS p, contains(lower(p_type), 'small') AS \"first\" FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small') ORDER BY contains(lower(p_type), 'small') DESC, p_name, '<http://example.org/part/' || p_partkey || '>' LIMIT 30 OFFSET 20")
def object_substring_page(spark, d):
    """A page of a search: those whose title holds the text first."""
    o = views.object_metadata(_part_quads(spark, d), _V)
    return views.substring_search(o, "sMALl", limit=30, offset=20).select(key("s").alias("p"), "first")


@query("SELECT count(*) AS n FROM part WHERE contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid') OR contains(lower(p_brand), 'wid')")
def object_substring_count(spark, d):
    return views.substring_count(views.object_metadata(_part_quads(spark, d), _V), "WID")


@query("SELECT p_partkey AS p FROM part WHERE contains(lower(p_name), 'red')")
def object_predicate_search(spark, d):
    return views.predicate_search(_part_quads(spark, d), name("p_name"), "Red").select(key("s").alias("p"))


@query("SELECT p_brand AS collection FROM part WHERE p_partkey = 7")
def object_collections(spark, d):
    return views.containing_collections(_member_quads(spark, d)[0], name("member"), name("part/7")).select(local("collection").alias("collection"))


@query("""SELECT n_nationkey AS n, n_name AS name, '{"http://example.org/n_name":["' || n_name || '"]}' AS data FROM nation""")
def object_summary(spark, d):
    q = quads(spark, d, "nation", columns=["n_name"]).where(F.col("p") == name("n_name"))
    s = views.object_summary(q, Vocabulary(name("none"), name("n_name"), name("none"), name("none"), name("none"), name("self"), name("member")))
    return s.select(key("s").alias("n"), "name", F.replace(F.replace(F.replace(F.col("data"), F.lit("<"), F.lit("")), F.lit(">"), F.lit("")), F.lit('\\"'), F.lit("")).alias("data"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS \"start\", l_partkey + 10 AS \"end\" FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL")
def typed_locations(spark, d):
    """Ranges and the features that hold them."""
    base = "http://sbols.org/v3#"
    li = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    node = x.iri(F.concat(F.lit(qs.BASE + "loc/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("/"), "l_partkey"))
    parent = x.iri(F.concat(F.lit(qs.BASE + "feature/"), "l_orderkey"))
    g = F.lit(name("g/loc"))
    row = lambda s, p, o: li.select(g.alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    i = lambda c: x.literal(c, x.XSD + "integer")
    q = row(node, x.RDF_TYPE, F.lit(f"<{base}Range>")).union(row(node, f"<{base}start>", i(F.col("l_partkey")))).union(row(node, f"<{base}end>", i(F.col("l_partkey") + 10))).union(row(parent, f"<{base}hasLocation>", node)).union(row(node, f"<{base}orientation>", F.lit("<http://sbols.org/v3#inline>")))
    t = views.typed_projection(q, "location", base, "hasLocation")
    return t.select(F.regexp_extract("parent", r"/(\d+)>", 1).cast("long").alias("o"), F.regexp_extract("s", r"/(\d+)/\d+>", 1).cast("int").alias("n"), num("start").cast("long").alias("start"), num("end").cast("long").alias("end"))


@query("SELECT p_brand AS g, CASE WHEN bool_or(p_size > 45) THEN 'failed' WHEN bool_or(p_type = 'ECONOMY') THEN 'warning' ELSE 'passed' END AS status FROM part GROUP BY 1")
def validation_runs(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("s"), "p_size", "p_type")
    _, runs = views.validate(rows, {"size": ("error", F.col("p_size") <= 45), "type": ("warning", F.col("p_type") != "ECONOMY")}, rows)
    return runs


@query("SELECT c_custkey AS s, CASE WHEN c_custkey % 10 = 0 THEN 'deleted' WHEN c_custkey % 10 = 1 THEN 'created' ELSE 'updated' END AS change FROM customer WHERE c_custkey % 10 < 3")
def object_revisions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("s"), F.md5("c_name").alias("hash"))
    before, after = c.where("s % 10 <> 1"), c.where("s % 10 <> 0").withColumn("hash", F.when(F.col("s") % 10 == 2, "new").otherwise(F.col("hash")))
    return views.revisions(before, after).select("s", "change")


@query("SELECT 'nation' AS g, count(*) * 4 AS triples, count(*) AS subjects, 4::BIGINT AS predicates, 0::BIGINT AS top_levels, 1::BIGINT AS classes FROM nation UNION ALL SELECT 'region', count(*) * 3, count(*), 3, 0, 1 FROM region")
def graph_overview(spark, d):
    return views.graph_overview(quads(spark, d, "nation", "region"), name("top")).withColumn("g", local("g"))


@query("SELECT 'class' AS kind, 'Nation' AS term, count(*) AS n FROM nation UNION ALL SELECT 'class', 'Region', count(*) FROM region UNION ALL SELECT 'predicate', p, count(*) FROM nation, (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(p) GROUP BY p UNION ALL SELECT 'predicate', p, count(*) FROM region, (VALUES ('r_regionkey'), ('r_name')) v(p) GROUP BY p UNION ALL SELECT 'predicate', '22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def schema_sample(spark, d):
    return views.schema_sample(quads(spark, d, "nation", "region")).withColumn("term", local("term"))


# ---- traversal


@query("SELECT 'nation/' || n_nationkey AS s, 'n_name' AS p, n_name AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region/1', 'r_name', r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation/' || n_nationkey, 'n_regionkey', 'region/1' FROM nation WHERE n_regionkey = 1")
def neighborhood_literals(spark, d):
    q = quads(spark, d, "nation", "region", columns=["n_regionkey", "n_name", "r_name"])
    nodes = traverse.neighborhood(q, name("region/1"), 1, "both", [name("n_regionkey")])
    return _spo(traverse.neighborhood_edges(q, nodes, literals=True))


@query("SELECT 'nation/' || n_nationkey AS node, 1 AS depth, 'Nation' AS \"class\", n_name AS label FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region/1', 0, 'Region', r_name FROM region WHERE r_regionkey = 1")
def neighborhood_decorated(spark, d):
    q = quads(spark, d, "nation", "region", columns=["n_regionkey", "n_name", "r_name"])
    nodes = traverse.neighborhood(q, name("region/1"), 1, "both", [name("n_regionkey")])
    n = traverse.decorated(nodes, q, [name("n_name"), name("r_name")])
    return n.select(short("node").alias("node"), "depth", local("class").alias("class"), text_of("label").alias("label"))


@query("SELECT count(*) * 2 + 1 AS triples FROM part WHERE p_brand = 'Brand#17'")
def collection_download(spark, d):
    """A collection's own triples and those of all whose top level is a member, without a walk."""
    m, _ = _member_quads(spark, d)
    one = m.where(F.col("s") == name("brand/Brand#17"))
    top = m.select("g", F.col("o").alias("s"), F.lit(name("top")).alias("p"), "o")
    label = one.limit(1).select("g", "s", F.lit(name("label")).alias("p"), F.lit('"b"').alias("o"))
    return traverse.collection_download(one.union(top).union(label), name("brand/Brand#17"), name("top"), name("member")).agg(F.count("*").alias("triples"))


@query("SELECT 'user/ann/' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'public/r1'")
def related_iris(spark, d):
    """A walk held to a user's own prefix and the public one."""
    n = table(spark, d, "nation").where("n_nationkey > 0")
    own = F.when(F.col("n_regionkey") == 1, F.concat(F.lit(qs.BASE + "user/ann/"), "n_nationkey")).otherwise(F.concat(F.lit(qs.BASE + "user/bob/"), "n_nationkey"))
    e = n.select(F.lit(None).cast("string").alias("g"), F.lit(name("public/r1")).alias("s"), F.lit(name("has")).alias("p"), x.iri(own).alias("o"))
    seeds = patterns.values(spark, ["n"], [(name("public/r1"),)])
    return traverse.closure(e, seeds, prefixes=[qs.BASE + "user/ann/", qs.BASE + "public/"]).select(short("node").alias("node"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey % 5 AS s, c_custkey % 7 AS d FROM customer WHERE c_custkey % 7 < 5), k AS (SELECT DISTINCT s, d FROM e WHERE s IN (SELECT unnest(range(5)))), g AS (SELECT s, count(*) c FROM k GROUP BY 1),
    r(i, n, rank) AS (SELECT 0, range, 0.2::DOUBLE FROM range(5) UNION ALL
    SELECT i + 1, v.n, v.x / sum(v.x) OVER () FROM (SELECT any_value(r.i) i, t.range AS n, 0.15 / 5 + 0.85 * coalesce(sum(CASE WHEN g.s IS NULL THEN r.rank / 5 WHEN k.d = t.range THEN r.rank / g.c END), 0) AS x
      FROM r CROSS JOIN range(5) t LEFT JOIN g ON g.s = r.n LEFT JOIN k ON k.s = r.n AND k.d = t.range WHERE r.i < 12 GROUP BY t.range) v)
    SELECT n AS node, round(rank, 7) AS rank FROM r WHERE i = 12"""
)
def pagerank_twelve_rounds(spark, d):
    e = table(spark, d, "customer").where("c_custkey % 7 < 5").select((F.col("c_nationkey") % 5).cast("long").alias("src"), (F.col("c_custkey") % 7).alias("dst")).distinct()
    return traverse.pagerank(spark.range(5), e, tolerance=0.0, rounds=12).select("node", F.round("rank", 7).alias("rank"))


@query("WITH e AS (SELECT DISTINCT c_custkey % 40 a, c_custkey % 40 + 40 * (c_custkey % 2) b FROM customer) SELECT a AS node, a AS component FROM e UNION SELECT b, a FROM e")
def graph_components(spark, d):
    e = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("src"), (F.col("c_custkey") % 40 + 40 * (F.col("c_custkey") % 2)).alias("dst"))
    return components.connected_components(e)


# ---- text index and discovery

_TOK = "'[\\p{L}\\p{N}_]+'"


def _index(spark, d):
    q = quads(spark, d, "part", columns=["p_name", "p_brand", "p_type"])
    ranks = table(spark, d, "part").select(qs.node("part", F.col("p_partkey")).alias("node"), F.col("p_size").cast("double").alias("rank"))
    return text_index.assemble(q, {"display_id": name("p_name"), "name": name("p_type"), "version": name("p_brand")}, x.RDF_TYPE, ranks)


def _hits(words, fields):
    """SQL of the text score: boosts of fields with a token near each word."""
    edits = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    return " + ".join(f"CASE WHEN len(list_filter(regexp_extract_all(lower({f}), {_TOK}), lambda t: damerau_levenshtein(t, '{w}') <= {edits(w)})) > 0 THEN {b} ELSE 0 END" for w in words for f, b in fields.items())


_FIELDS = {"'http://example.org/part/' || p_partkey": 1.0, "p_name": 3.0, "p_type": 1.0, "p_brand": 1.0, "'Part'": 1.0}


@query(f"SELECT p, score FROM (SELECT p_partkey AS p, round((m * ln(p_size + 1))::DOUBLE, 6) AS score, row_number() OVER (ORDER BY m * ln(p_size + 1) DESC, 'http://example.org/part/' || p_partkey) k FROM (SELECT *, {_hits(['smal', 'widget'], _FIELDS)} AS m FROM part) WHERE m > 0) WHERE k <= 40")
def text_index_search(spark, d):
    return text_index.search(_index(spark, d), "smal WIDGET", type_=name("Part"), graphs=[name("g/part")], limit=40).select(key("s").alias("p"), F.round("score", 6).alias("score"))


@query(
    f"""WITH c AS (SELECT p_partkey p, p_brand b, m * ln(p_size + 1) AS base, 'http://example.org/part/' || p_partkey AS subject FROM (SELECT *, {_hits(['small'], _FIELDS)} AS m FROM part) WHERE m > 0 ORDER BY base DESC, subject LIMIT 30)
    SELECT p, round((base / CASE WHEN row_number() OVER (PARTITION BY b ORDER BY base DESC, subject) > 1 THEN 2 ELSE 1 END)::DOUBLE, 6) AS score FROM c"""
)
def text_index_pool(spark, d):
    """Only the best thirty candidates go into the ranking; those of one brand after the first count half."""
    return text_index.search(_index(spark, d), "small", cluster="version", pool=30).select(key("s").alias("p"), F.round("score", 6).alias("score"))


@query(f"SELECT count(*) AS n FROM (SELECT {_hits(['rign'], _FIELDS)} AS m FROM part) WHERE m > 0")
def text_index_count(spark, d):
    return text_index.count(_index(spark, d), "rign")


@query("SELECT p_partkey AS p, p_name AS display_id, p_size::DOUBLE AS rank, 'Part' AS type FROM part")
def text_index_assembly(spark, d):
    return _index(spark, d).select(key("s").alias("p"), "display_id", "rank", "type")


@query(
    """SELECT n_nationkey AS n, replace(n_name, '_', ' ') || ' term ' || n_regionkey || ' alpha beta Dna' AS keywords FROM nation"""
)
def text_keywords(spark, d):
    n = table(spark, d, "nation")
    docs = n.select(qs.node("nation", F.col("n_nationkey")).alias("s"), F.col("n_name").alias("display_id"))
    roles = n.select(qs.node("nation", F.col("n_nationkey")).alias("s"), F.concat(F.lit("http://identifiers.org/so/SO:"), F.lpad((F.col("n_regionkey") + 100).cast("string"), 7, "0")).alias("role"))
    terms = table(spark, d, "region").select(F.concat(F.lit("SO:"), F.lpad((F.col("r_regionkey") + 100).cast("string"), 7, "0")).alias("id"), F.concat(F.lit("term "), "r_regionkey").alias("name"), F.array(F.lit("INSDC_feature:alpha"), F.lit("beta"), F.lit("alpha")).alias("synonyms"))
    out = text_index.with_keywords(docs, text_index.role_words(roles, terms), text_index.biopax_word(F.lit("http://www.biopax.org/release/biopax-level3.owl#Dna")))
    return out.select(key("s").alias("n"), "keywords")


_D = discovery.Predicates({"display_id": [name("p_name")], "name": [name("absent"), name("p_type")], "roles": [name("p_brand"), name("other")], "types": [x.RDF_TYPE], "description": [name("none")], "owner": [name("p_brand")], "provenance": [name("p_type")], "created": [name("made")], "modified": [name("none2")], "collections": [name("member")]})


def _records(spark, d):
    q = _part_quads(spark, d)
    made = table(spark, d, "part").where("p_partkey % 5 > 0").select(F.lit(name("g/part")).alias("g"), qs.node("part", F.col("p_partkey")).alias("s"), F.lit(name("made")).alias("p"), x.literal(F.concat(F.date_format(F.dateadd(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "yyyy-MM-dd"), F.lit("T10:00:00Z")), x.XSD + "dateTime").alias("o"))
    return discovery.records(q.union(made).union(_member_quads(spark, d)[0]), _D, [name("member")])


_MADE = "CASE WHEN p_partkey % 5 > 0 THEN TIMESTAMP '2020-01-01 10:00:00' + INTERVAL (p_partkey % 300) DAY END"


@query(f"SELECT p_partkey AS p, {_MADE} AS created FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 300 BETWEEN 31 AND 90 AND contains(lower(p_type), 'econ') ORDER BY created DESC, '<http://example.org/part/' || p_partkey || '>' LIMIT 30 OFFSET 3")
def discovery_request(spark, d):
    r = discovery.Request(type=name("Part"), provenance="Econ", created=("2020-02-01", "2020-03-31"), sort="created", offset=3, limit=30)
    return discovery.page(discovery.matching(_records(spark, d), r), r).select(key("s").alias("p"), "created")


@query(f"SELECT count(*) AS n FROM (SELECT {_hits(['rign'], {'p_name': 3.0, 'p_type': 1.0})} AS m FROM part WHERE p_brand = 'Brand#17') WHERE m > 0")
def discovery_total(spark, d):
    r = discovery.Request(text="rign", collection=name("brand/Brand#17"), role='"Brand#17"', owner="Brand#17")
    return discovery.total(discovery.matching(_records(spark, d), r))


@query(f"SELECT p_brand AS value, CASE WHEN p_brand = 'Brand#17' THEN 'Seventeen' ELSE '\"' || p_brand || '\"' END AS label, count(*) AS n FROM (SELECT *, {_hits(['small'], {'p_name': 3.0, 'p_type': 1.0})} AS m FROM part) WHERE m > 0 GROUP BY 1, 2")
def discovery_facet_labels(spark, d):
    labels = spark.createDataFrame([('"Brand#17"', "Seventeen", "B:17")], "value string, label string, curie string")
    found = discovery.matching(_records(spark, d), discovery.Request(text="small"))
    return discovery.facets(found, "roles", labels).select(text_of("value").alias("value"), "label", "n")


@query("SELECT p_partkey AS p, lower(p_type) AS n FROM part ORDER BY lower(p_type), '<http://example.org/part/' || p_partkey || '>' LIMIT 25 OFFSET 10")
def discovery_name_order(spark, d):
    r = discovery.Request(sort="name", offset=10, limit=25)
    return discovery.page(discovery.matching(_records(spark, d), r), r).select(key("s").alias("p"), discovery.sort_name().alias("n"))


@query("SELECT p_partkey AS p, p_name AS display_id, p_partkey % 2 = 1 AS missing FROM part ORDER BY '<http://example.org/part/' || p_partkey || '>' LIMIT 20")
def discovery_hydration(spark, d):
    r = discovery.Request(sort="iri", limit=20)
    page = discovery.page(discovery.matching(_records(spark, d), r), r).select("s", "display_id")
    cards = _records(spark, d).where(key("s") % 2 == 0).select("s", F.col("owner").alias("card"))
    return discovery.hydrate(page, cards, ["card"]).select(key("s").alias("p"), "display_id", "missing")


@query("SELECT p_partkey AS p FROM part WHERE p_brand = 'Brand#17' AND p_type = 'ECONOMY' AND p_partkey % 5 > 0 AND p_partkey % 300 <= 100")
def discovery_faceted(spark, d):
    q = _part_quads(spark, d)
    made = table(spark, d, "part").where("p_partkey % 5 > 0").select(F.lit(name("g/part")).alias("g"), qs.node("part", F.col("p_partkey")).alias("s"), F.lit(name("made")).alias("p"), x.literal(F.concat(F.date_format(F.dateadd(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "yyyy-MM-dd"), F.lit("T10:00:00Z")), x.XSD + "dateTime").alias("o"))
    found = discovery.faceted(q.union(made).union(_member_quads(spark, d)[0]), name("Part"), name("brand/Brand#17"), {name("p_type"): '"ECONOMY"'}, x.RDF_TYPE, name("member"), name("made"), None, "2020-04-10")
    return found.select(key("s").alias("p"))


@query(f"SELECT p_partkey AS p FROM (SELECT *, {_hits(['rign'], {'p_name': 3.0, 'p_type': 1.0})} AS m FROM part WHERE p_brand = 'Brand#17' OR p_brand = 'Brand#4') WHERE m > 0 AND p_brand = 'Brand#17' ORDER BY m DESC, '<http://example.org/part/' || p_partkey || '>' LIMIT 12 OFFSET 3")
def discovery_classic_path(spark, d):
    """A search by the older form of paths: criteria, text, offset and limit in one line."""
    q = _part_quads(spark, d)
    line = "/search/objectType=Part&brand='Brand%23x'&color='red'&brand='Brand#17'&rign/?offset=3&limit=12"
    found = discovery.classic_search(q, _records(spark, d), line, {"brand": name("p_brand")}, x.RDF_TYPE, qs.BASE, {"display_id": 3.0, "name": 1.0})
    return found.select(key("s").alias("p"))


@query("SELECT doc_id AS doc, round(sum(1.0 / (60 + r)), 9)::DOUBLE AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) r FROM documents UNION ALL SELECT doc_id, row_number() OVER (ORDER BY -n_chars DESC, doc_id) FROM documents WHERE lang = 'en') GROUP BY 1")
def rank_fusion(spark, d):
    df = table(spark, d, "documents")
    a = df.select(F.lit("a").alias("source"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("score"))
    b = df.where("lang = 'en'").select(F.lit("b").alias("source"), F.col("doc_id").alias("doc"), (-F.col("n_chars")).alias("score"))
    return text.reciprocal_rank_fusion(a.union(b), "doc", "source", "score").select("doc", F.round("score", 9).alias("score"))


# ---- sequences


def _pattern_sql(patterns_):
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    back = lambda p: "".join(comp[c] for c in reversed(p))
    each = lambda n, p, s: f"SELECT '{n}' AS pattern, doc_id, '{s}' AS strand, (length(seq) - length(replace(seq, '{p}', ''))) // {len(p)} AS n FROM s WHERE contains(seq, '{p}')"
    return _DNA + " UNION ALL ".join(x for n, p in patterns_.items() for x in ([each(n, p, "+")] + ([] if back(p) == p else [each(n, back(p), "-")])))


@query(_pattern_sql({"one": "ACGA", "two": "TTCA", "own": "ACGT"}))
def sequence_batch_search(spark, d):
    h = sequences.batch_hits(_dna(spark, d), "seq", "doc_id", {"one": "acga", "two": "TT CA", "own": "acgt"})
    return h.groupBy("pattern", "doc_id", "strand").agg(F.count("*").alias("n"))


@query(_DNA + "SELECT doc_id, 1.0::DOUBLE AS identity, (doc_id % 7 + 1)::DOUBLE AS rank FROM s WHERE (contains(seq, 'ACGA') OR contains(seq, 'TCGT')) AND doc_id % 3 > 0 ORDER BY doc_id % 7 DESC, doc_id LIMIT 50")
def sequence_search_exact(spark, d):
    s = _dna(spark, d)
    ranks = s.select("doc_id", (F.col("doc_id") % 7 + 1).cast("double").alias("rank"))
    return sequences.exact_matches(sequences.substring_hits(s, "seq", "doc_id", "ACGA"), ranks, "doc_id", s.where("doc_id % 3 > 0"))


@query(
    _DNA
    + """, k AS (SELECT DISTINCT doc_id, substr(seq, i::INT + 1, 12) f FROM s, unnest(range(0, length(seq) - 11)) u(i)), c AS (SELECT doc_id, least(f, upper(translate(reverse(lower(f)), 'acgt', 'tgca'))) m FROM k),
    q AS (SELECT DISTINCT least(substr(seq, i::INT + 1, 12), upper(translate(reverse(lower(substr(seq, i::INT + 1, 12))), 'acgt', 'tgca'))) m, doc_id query FROM (SELECT doc_id, seq FROM s WHERE doc_id % 50 = 0), unnest(range(0, length(seq) - 11)) u(i))
    SELECT DISTINCT query, doc_id FROM q JOIN c USING (m) UNION SELECT a.doc_id, b.doc_id FROM s a, s b WHERE a.doc_id % 50 = 0 AND length(a.seq) < 12"""
)
def sequence_align_candidates(spark, d):
    s = _dna(spark, d)
    queries = s.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.col("seq").alias("q"))
    return sequences.align_candidates(s, "seq", "doc_id", queries, 12)


@query("SELECT c_custkey AS c, (c_custkey % 9)::DOUBLE AS rank FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 11) AND c_custkey <> 11")
def sequence_similar(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("cluster"))
    return sequences.similar(c, c.select("c", (F.col("c") % 9).cast("double").alias("rank")), "c", 11)


@query("SELECT s_suppkey AS s, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 24 + row_number() OVER (PARTITION BY s_suppkey % 3 = 0 ORDER BY s_suppkey) END::BIGINT AS cluster FROM supplier")
def sequence_assign(spark, d):
    """New sequences join a neighbour's cluster or open one past the largest; suppliers stand for sequences, nations for clusters 0 to 24."""
    s = table(spark, d, "supplier")
    known = spark.range(25).select((-F.col("id") - 1).alias("s"), F.col("id").alias("cluster"))
    alike = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("s"), (-F.col("s_nationkey") - 1).cast("long").alias("other"))
    got = sequences.assign_clusters(s.select(F.col("s_suppkey").alias("s")), known, alike, "s")
    plain = got.groupBy((F.col("s") % 3 == 0).alias("near")).agg(F.sort_array(F.collect_list("cluster")).alias("cs"), F.sort_array(F.collect_list("s")).alias("ss"))
    return plain.where("near").select(F.explode("ss").alias("s")).join(got, "s").union(plain.where("not near").select(F.explode(F.arrays_zip("ss", "cs")).alias("z")).select("z.ss", "z.cs"))


@query(_DNA + "SELECT doc_id, (length(seq) - length(replace(seq, 'ACGA', ''))) // 4 AS plus, (length(seq) - length(replace(seq, 'TCGT', ''))) // 4 AS minus FROM s WHERE contains(seq, 'ACGA') OR contains(seq, 'TCGT')")
def sequence_indexed_search(spark, d):
    s, path = _dna(spark, d), fresh_path(spark, "kmers")
    sequences.write_kmer_index(sequences.kmers(s, "seq", "doc_id", 4), path)
    h = sequences.indexed_hits(spark.read.parquet(path), s, "seq", "doc_id", "acga", 4)
    return h.groupBy("doc_id").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


_GB = "SELECT n_nationkey AS n, 'nation ' || n_name AS definition, lower(repeat(substr('ACGTTGCAAC', 1, 3 + n_nationkey % 7), 30)) AS seq, 'gene' AS type, '1..' || (n_nationkey + 5) AS location, 'a \"b\" ' || n_name AS note FROM nation"


@query(_GB)
def genbank_round_trip(spark, d):
    n = table(spark, d, "nation")
    seq = F.repeat(F.substring(F.lit("ACGTTGCAAC"), F.lit(1), 3 + F.col("n_nationkey") % 7), F.lit(30))
    features = F.array(F.struct(F.lit("gene").alias("type"), F.concat(F.lit("1.."), F.col("n_nationkey") + 5).alias("location"), F.create_map(F.lit("note"), F.concat(F.lit('a "b" '), "n_name")).alias("qualifiers")))
    path = fresh_path(spark, "genbank")
    n.select(archives.genbank_records(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("nation "), "n_name"), seq, features)).write.text(path)
    g = files.read_genbank(spark, path).withColumn("f", F.element_at("features", 1))
    return g.select(F.substring("id", 2, 9).cast("int").alias("n"), "definition", "seq", F.col("f.type").alias("type"), F.col("f.location").alias("location"), F.col("f.qualifiers")["note"].alias("note"))


@query("SELECT r_regionkey AS r, 'n' || n_nationkey || '.txt' AS location, n_name AS content FROM nation JOIN region ON r_regionkey = n_regionkey")
def omex_round_trip(spark, d):
    """An archive a region, a file a nation."""
    n = table(spark, d, "nation")
    f = F.struct(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("location"), F.lit("text/plain").alias("format"), F.col("n_name").alias("content"))
    a = n.groupBy(F.col("n_regionkey").alias("r")).agg(archives.omex(F.array_sort(F.collect_list(f))).alias("a"))
    return a.select("r", F.explode(archives.omex_contents(F.col("a"))).alias("f")).select("r", "f.location", "f.content")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS value FROM nation""")
def summary_json(spark, d):
    return table(spark, d, "nation").withColumn("none", F.lit(None).cast("string")).select(archives.summary_json("n_nationkey", "n_name", "none").alias("value"))


@query("SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
def store_patterns(spark, d):
    """Quads in their stored layout, read pattern by pattern."""
    path = fresh_path(spark, "store")
    store.write_quads(quads(spark, d, "customer", "nation", columns=["c_name", "c_nationkey", "c_mktsegment", "n_name"]), path)
    q = store.read_quads(spark, path)
    s = patterns.bgp(q, ("?c", name("c_mktsegment"), '"MACHINERY"'), ("?c", name("c_name"), "?name"), ("?c", name("c_nationkey"), "?n"), ("?n", name("n_name"), "?nation"))
    return s.select(text_of("name").alias("name"), text_of("nation").alias("nation"))


@query("SELECT count(*) * 6 + (SELECT count(*) * 7 FROM orders) AS quads FROM customer")
def store_ingest(spark, d):
    """Customers and orders as quads, written in the stored layout and counted."""
    path = fresh_path(spark, "store")
    store.write_quads(quads(spark, d, "customer", "orders"), path)
    return store.read_quads(spark, path).agg(F.count("*").alias("quads"))


@query("SELECT 'parts' AS name, item_id AS item, text AS value FROM benchmark UNION ALL SELECT 'sketches', item_id, 'none' FROM benchmark UNION ALL SELECT 'clusters', item_id, item_id::VARCHAR FROM benchmark UNION ALL SELECT 'ranks', item_id, (SELECT round(1.0 / count(*), 6)::DOUBLE::VARCHAR FROM benchmark) FROM benchmark")
def index_rebuild(spark, d):
    """All tables of the index from quads, with what they hold: texts without bases have no sketch, and are clusters of their own; nodes without links rank alike."""
    q = quads(spark, d, "benchmark", columns=["text"])
    path = fresh_path(spark, "index")
    text_index.rebuild(q, {"name": name("text")}, x.RDF_TYPE, name("text"), q.select("s").distinct(), path)
    out = None
    shown = {"parts": ("s", F.col("name")), "sketches": ("s", F.coalesce(F.array_join("sig", " "), F.lit("none"))), "clusters": ("s", key("cluster").cast("string")), "ranks": ("node", F.round("rank", 6).cast("string"))}
    for t, (node, value) in shown.items():
        n = spark.read.parquet(f"{path}/{t}").select(F.lit(t).alias("name"), key(node).alias("item"), value.alias("value"))
        out = n if out is None else out.union(n)
    return out


# ---- vectors


@query(f"SELECT query, vec_id, round(s, 5) AS score, label FROM (SELECT a.query, b.vec_id, list_cosine_similarity(e, q) AS s {_PAIRS} WHERE b.vec_id % 4 <> 1) JOIN embeddings USING (vec_id) WHERE label IN (0, 2, 4) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5")
def knn_scoped_hydrated(spark, d):
    """Within some graphs and a filter, with the documents of what is found."""
    e = table(spark, d, "embeddings")
    points = vectors.in_scope(e.withColumn("g", F.concat(F.lit("g"), F.col("vec_id") % 4)), ["g0", "g2", "g3"], F.col("label").isin(0, 2, 4))
    hits = vectors.nearest_each(points, "embedding", "vec_id", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "cosine", 5)
    return vectors.hydrate(hits, e.select("vec_id", "label"), "vec_id").where("not missing").select("query", "vec_id", F.round("score", 5).alias("score"), "label")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 1")
def vector_generations(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    g = vectors.Generations(spark, fresh_path(spark, "generations"))
    g.apply("first", e)
    g.activate("first")
    g.apply("second", e.where("id % 10 = 0").withColumn("label", F.lit(-1)), e.where("id % 10 = 1"))
    g.activate("second")
    return g.snapshot()


@query("SELECT count(*) AS expected, true AS fine FROM (SELECT a.vec_id AS query, b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) <= 10)")
def knn_cells_recall(spark, d):
    """Of the true ten neighbours of every fiftieth vector, how many there are, and whether the cells find 0.9 of them; ``knn_cells_measured`` has the recall itself."""
    return knn_cells_measured(spark, d).select("expected", (F.col("recall") >= 0.9).alias("fine"))


@query()
def knn_cells_measured(spark, d):
    """Recall at 10 of the cells against all rows, for every fiftieth vector."""
    from .catalogue import QUERIES

    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    true = vectors.nearest_each(e, "embedding", "vec_id", queries, "cosine", 10).select("query", "vec_id")
    found = QUERIES["knn_cells"](spark, d).select("query", "vec_id").withColumn("_hit", F.lit(1))
    n = true.join(found, ["query", "vec_id"], "left").agg(F.count("*").alias("expected"), F.count("_hit").alias("matched"))
    return n.withColumn("recall", F.col("matched") / F.col("expected"))


@query("SELECT share, count(*) AS expected, true AS fine FROM (SELECT share, a.vec_id AS query, b.vec_id FROM embeddings a, embeddings b, (VALUES (1), (10), (50)) t(share) WHERE a.vec_id % 50 = 0 AND (b.vec_id * 7 + b.vec_id // 100 * 13) % 100 < share QUALIFY row_number() OVER (PARTITION BY share, a.vec_id ORDER BY b.vec_id) <= 10) GROUP BY 1")
def knn_cells_filtered(spark, d):
    """Neighbours among a hundredth, a tenth and a half of all rows: how many there are, and whether the cells find 0.9 of them."""
    from .operators import cells

    e = table(spark, d, "embeddings").withColumn("part", (F.col("vec_id") * 7 + F.floor(F.col("vec_id") / 100) * 13) % 100)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    model = cells.fit_cells(e, "embedding", "vec_id", 256)
    indexed = cut(cells.index_cells(e, "embedding", model))
    probes, out = cells.calibrate_probes(indexed, model, "embedding", "vec_id", 10), None
    for share in (1, 10, 50):
        passes = F.col("part") < share
        true = vectors.nearest_each(e.where(passes), "embedding", "vec_id", queries, "cosine", 10).select("query", "vec_id")
        found = cells.search_filtered(indexed, queries, model, "embedding", "vec_id", passes, k=10, probes=probes).select("query", "vec_id").withColumn("_hit", F.lit(1))
        n = true.join(found, ["query", "vec_id"], "left").agg(F.lit(share).alias("share"), F.count("*").alias("expected"), (F.count("_hit") >= 0.9 * F.count("*")).alias("fine"))
        out = n if out is None else out.union(n)
    return out


_JUDGED = """WITH r AS (SELECT source AS query, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), j AS (SELECT source AS query, doc_id AS doc, quality AS rel FROM documents JOIN labels USING (doc_id)),
    h AS (SELECT r.query, k, coalesce(rel, 0) rel FROM r LEFT JOIN j USING (query, doc) WHERE k <= 10) """


@query(_JUDGED + "SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(f), 6) AS reciprocal_rank FROM (SELECT query, count(*) FILTER (rel > 0) / 10 AS p, coalesce(1 / min(k) FILTER (rel > 0), 0) AS f FROM h GROUP BY 1)")
def relevance_means(spark, d):
    """Means of the measures of every source's longest documents, judged by their labels."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("score"))
    judged = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "doc"), "doc").select("query", "doc", F.col("quality").alias("relevance"))
    m = vectors.means(vectors.relevance(docs, judged))
    return m.select("queries", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


#: FNV-1a of a text, byte by byte, with the offset and prime that are fixed in its definition.
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, length(hex(encode(x))) // 2), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::INT, 2))::UHUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(
    f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM benchmark),
    p AS (SELECT item_id, t AS x, 1.0 AS w FROM t UNION ALL SELECT item_id, substr(t, i::INT, 3), 0.35 FROM t, unnest(range(1, length(t) - 1)) u(i)),
    h AS (SELECT x, {_FNV} AS h FROM (SELECT DISTINCT x FROM p)),
    v AS (SELECT item_id, (h % 256)::INT AS dim, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -w ELSE w END)::DOUBLE AS v FROM p JOIN h USING (x) GROUP BY 1, 2),
    n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1)
    SELECT item_id, dim, round(v / n, 6)::DOUBLE AS value FROM v JOIN n USING (item_id) WHERE abs(v / n) > 0.000001"""
)
def hash_embedding_values(spark, d):
    """Every component that is not zero of the hashing embedding of the benchmark's texts."""
    e = table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hashing_embedding(F.col("text"))).alias("dim", "v"))
    return e.where("abs(v) > 0.000001").select("item_id", "dim", F.round("v", 6).alias("value"))


@query("SELECT vec_id, CASE vec_id % 7 WHEN 1 THEN 'null' WHEN 2 THEN 'length' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'zero' END AS problem FROM embeddings")
def knn_problems(spark, d):
    """Why a vector can't be a query under cosine."""
    v, m = F.col("embedding"), F.col("vec_id") % 7
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(m == 2, F.slice(v, 1, 63)).when(m == 3, F.transform(v, lambda c, i: F.when(i == 5, F.lit(float("nan"))).otherwise(c))).when(m == 4, F.transform(v, lambda c: c * 0)).when(m != 1, v))
    return vectors.problems(e, "embedding", 64).select("vec_id", "problem")


@query(f"SELECT query, vec_id, round(s, 5) AS score FROM (SELECT query, vec_id, list_inner_product(e, q) AS s {_PAIRS}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5")
def knn_by_strategy(spark, d):
    """A metric that the cells don't offer goes to the exact search, however low the cutoff."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vectors.search_by_strategy(e, "embedding", "vec_id", queries, "dot", 5, cutoff=10).select("query", "vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY label DESC, vec_id)::INTEGER AS place FROM (SELECT query, vec_id FROM (SELECT query, vec_id, list_cosine_similarity(e, q) AS s {_PAIRS}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 20) JOIN embeddings USING (vec_id) QUALIFY place <= 5")
def knn_reranked(spark, d):
    """The first twenty by cosine, ordered again by their label, of which five stay."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    hits = vectors.nearest_each(e, "embedding", "vec_id", queries, "cosine", 30).join(e.select("vec_id", "label"), "vec_id")
    return vectors.rerank(hits, F.col("label"), "vec_id", 20, 5).select("query", "vec_id", "place")


# ---- ontology, access, console


@query("SELECT 'SO:' || lpad((n_nationkey + 1)::VARCHAR, 7, '0') AS id, 'first ' || n_name AS name, CASE WHEN n_nationkey > 4 THEN 'SO:' || lpad((n_regionkey + 1)::VARCHAR, 7, '0') END AS parent FROM nation")
def ontology_source(spark, d):
    """OBO stanzas read back: of two of one id the first stays."""
    n = table(spark, d, "nation")
    so = lambda c: F.concat(F.lit("SO:"), F.lpad((c + 1).cast("string"), 7, "0"))
    parent = F.when(F.col("n_nationkey") > 4, F.concat(F.lit("\nis_a: "), so(F.col("n_regionkey")), F.lit(" ! label"))).otherwise("")
    stanza = lambda which: F.concat(F.lit("[Term]\nid: "), so(F.col("n_nationkey")), F.lit(f"\nname: {which} "), "n_name", parent)
    doc = n.orderBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", stanza("first").alias("a"), stanza("second").alias("b")))), lambda t: F.concat(t["a"], F.lit("\n\n"), t["b"])), "\n\n").alias("value"))
    path = fresh_path(spark, "obo")
    doc.coalesce(1).write.text(path)
    return ontology.read_obo(spark, path).select("id", "name", F.get("is_a", F.lit(0)).alias("parent"))


@query("SELECT r_regionkey AS r, 'SO:' || lpad(r_regionkey::VARCHAR, 7, '0') AS canonical FROM region")
def ontology_aliases(spark, d):
    so = F.concat(F.lit("SO:"), F.lpad(F.col("r_regionkey").cast("string"), 7, "0"))
    r = table(spark, d, "region")
    names = ontology.aliases(r.select(so.alias("id"), F.array().cast("array<string>").alias("alt_ids")))
    asked = r.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, ontology.purl(so)).otherwise(F.concat(F.lit("https://identifiers.org/so/"), so)).alias("role"))
    return ontology.canonicalize(asked, "role", names).select(F.col("r_regionkey").alias("r"), "canonical")


@query("SELECT 'SO:' || lpad(c_custkey::VARCHAR, 7, '0') AS id, (SELECT count(*) FROM customer WHERE (contains(lower(c_name), '7') OR contains(c_custkey::VARCHAR, '7')) AND c_custkey % 3 > 0) AS total FROM customer WHERE (contains(lower(c_name), '7') OR contains(c_custkey::VARCHAR, '7')) AND c_custkey % 3 > 0 ORDER BY 1 LIMIT 15 OFFSET 4")
def ontology_listing(spark, d):
    """A page of the terms of one prefix that hold a text, with the total; customers stand for terms."""
    c = table(spark, d, "customer")
    prefix = F.when(F.col("c_custkey") % 3 == 0, "EX:").otherwise("SO:")
    terms = c.select(F.concat(prefix, F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("id"), F.col("c_name").alias("name"))
    page, total = ontology.listing(terms, "SO", "7", 15, 4)
    return page.join(total).select("id", "total")


@query("SELECT c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def ontology_role_expansion(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    closed = ontology.closure(n.select("child").union(n.select("parent")), n)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("roles"))
    return ontology.with_roles(c, "roles", closed, "r2").select("c")


@query("SELECT doc_id AS s, source = 'src1' AS owned, source = 'src1' AND lang <> 'en' AS writable FROM documents")
def acl_write(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("s"), F.col("lang").alias("g"), "source")
    owners = docs.where("source = 'src1'").select("s", F.lit("ann").alias("owner")).union(docs.where("source = 'src2'").select("s", F.lit("bob")))
    w = access.can_write(docs.select("s", "g"), owners, spark.createDataFrame([("en",)], "g string"), "ann")
    return access.owns_object(w, owners, "ann").select("s", "owned", "writable")


@query("SELECT 'syntax' AS kind, 1 AS line, true AS placed UNION ALL SELECT 'analysis', NULL, false UNION ALL SELECT 'fine', NULL, false")
def console_validation(spark, d):
    from .operators.console import validate_sql

    found = [validate_sql(spark, "SELECT 1 FROM a b c d ("), validate_sql(spark, "SELECT nothing_there"), validate_sql(spark, "SELECT 1 AS a")]
    rows = [(p.kind if p else "fine", p.line if p and p.kind == "syntax" else None, bool(p and p.kind == "syntax" and p.column)) for p in found]
    return spark.createDataFrame(rows, "kind string, line int, placed boolean")


@query("SELECT true AS cut_off, 3 AS rows")
def console_cells(spark, d):
    from .operators.console import cells as json_cells

    rows, more = json_cells(table(spark, d, "nation"), 3, seconds=120)
    return spark.createDataFrame([(more, len(rows))], "cut_off boolean, rows int")
