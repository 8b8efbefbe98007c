"""Every query of the library by name, with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from .functions import terms as x  # noqa: E402
from .operators import access, alignment, cells, ontology, patterns, sequences, text, traverse, updates, vectors, views  # noqa: E402
from .plans.lineage import cut, fresh_path  # noqa: E402
from .sources import quads as qs  # noqa: E402
from .sources import sequence_files as files  # noqa: E402
from .sources.quads import name  # noqa: E402


def table(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "labels": "doc_id", "benchmark": "item_id"}
_LINKS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}}


def quads(spark: SparkSession, d: str, *tables: str, columns: list[str] | None = None) -> DataFrame:
    """The direct mapping of tables; ``columns`` keeps the scan to those needed. Rows of a table are dealt over all cores, and into more parts the more there are, or one task of the scan would hold the distinct quads, or the subjects, of millions of rows."""
    found = None
    for t in tables:
        df = table(spark, d, t)
        if columns is not None:
            df = df.select(*[c for c in df.columns if c in columns or c == _KEYS[t]])
        df = df if t in ("nation", "region") else wide(df, -(-df.count() // ROWS_A_TASK))
        q = qs.table_quads(df, "documents" if t == "labels" else t, _KEYS[t], _LINKS.get(t), columns, F.lit(name(f"g/{t}")))
        found = q if found is None else found.union(q)
    return found


#: Rows of a table that become quads in one task: a file's rows may take a few bytes each, so that its size does not tell.
ROWS_A_TASK = 100_000


def wide(df: DataFrame, parts: int = 0) -> DataFrame:
    """Rows dealt over all cores, and ``parts`` at least, where a table has fewer partitions, as for heavy work on each row; on others nothing is moved."""
    least = max(parts, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def num(c: str):
    return x.number(F.col(c))


def text_of(c: str):
    return x.str_(F.col(c))


def local(c: str):
    """The last part of an IRI, as text."""
    return F.regexp_extract(c, r"([^/>]+)>$", 1)


def key(c: str):
    return local(c).cast("long")


@query(
    """SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1"""
)
def sparql_bgp_count(spark: SparkSession, d: str) -> DataFrame:
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "c_acctbal", "n_name"])
    c = patterns.star(q, "c", {"n": name("c_nationkey"), "bal": name("c_acctbal")}).where(num("bal") > 0)
    s = patterns.join(c, patterns.match(q, "?n", name("n_name"), "?nation"))
    return patterns.aggregate(s, ["nation"], customers=F.count_distinct("c"), balance=F.round(patterns.total(num("bal")), 2)).withColumn("nation", text_of("nation"))


@query("SELECT c_custkey AS c, c_name AS name, c_mktsegment AS segment, round(c_acctbal, 2) AS bal FROM customer")
def sparql_star_join(spark, d):
    q = quads(spark, d, "customer", columns=["c_name", "c_mktsegment", "c_acctbal"])
    s = patterns.star(q, "c", {"name": name("c_name"), "segment": name("c_mktsegment"), "bal": name("c_acctbal")})
    return s.select(key("c").alias("c"), text_of("name").alias("name"), text_of("segment").alias("segment"), F.round(num("bal"), 2).alias("bal"))


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_bgp_join(spark, d):
    q = quads(spark, d, "nation", "region")
    s = patterns.bgp(q, ("?n", name("n_name"), "?nation"), ("?n", name("n_regionkey"), "?r"), ("?r", name("r_name"), "?region"))
    return s.select(text_of("nation").alias("nation"), text_of("region").alias("region"))


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def sparql_optional_filter(spark, d):
    c = patterns.match(quads(spark, d, "customer", columns=["c_name"]), "?c", x.RDF_TYPE, name("Customer"))
    q = quads(spark, d, "orders", columns=["o_custkey", "o_totalprice"])
    o = patterns.bgp(q, ("?o", name("o_custkey"), "?c"), ("?o", name("o_totalprice"), "?price"))
    s = patterns.optional(c, o, x.number(F.col("b.price")) > 300000)
    return s.select(key("c").alias("c"), key("o").alias("o"))


@query("SELECT d.doc_id AS doc, quality FROM documents d LEFT JOIN labels USING (doc_id)")
def sparql_optional_unbound(spark, d):
    a = patterns.match(quads(spark, d, "documents", columns=["lang"]), "?s", name("lang"), "?lang").select("s")
    b = patterns.match(quads(spark, d, "labels", columns=["quality"]), "?s", name("quality"), "?q")
    return patterns.optional(a, b).select(key("s").alias("doc"), num("q").cast("int").alias("quality"))


@query("SELECT n_name AS label FROM nation UNION ALL SELECT r_name FROM region")
def sparql_union_bag(spark, d):
    q = quads(spark, d, "nation", "region")
    return patterns.union(patterns.match(q, "?s", name("n_name"), "?label"), patterns.match(q, "?s", name("r_name"), "?label")).select(text_of("label").alias("label"))


@query("SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def sparql_union_distinct(spark, d):
    q = quads(spark, d, "customer", "supplier", columns=["c_nationkey", "s_nationkey"])
    u = patterns.union(patterns.match(q, "?s", name("c_nationkey"), "?n"), patterns.match(q, "?s", name("s_nationkey"), "?n"))
    return u.select("n").distinct().select(key("n").cast("int").alias("n"))


@query("SELECT doc_id AS doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sparql_minus(spark, d):
    a = patterns.match(quads(spark, d, "documents", columns=["lang"]), "?s", name("lang"), "?l").select("s")
    b = patterns.match(quads(spark, d, "labels", columns=["quality"]), "?s", name("quality"), "?q")
    return patterns.minus(a, b).select(key("s").alias("doc"))


@query("SELECT n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def sparql_not_exists(spark, d):
    a = patterns.match(quads(spark, d, "nation"), "?n", x.RDF_TYPE, name("Nation"))
    q = quads(spark, d, "customer", columns=["c_nationkey", "c_acctbal"])
    b = patterns.bgp(q, ("?c", name("c_nationkey"), "?n"), ("?c", name("c_acctbal"), "?bal")).where(num("bal") > 9900)
    return patterns.exists(a, b, negate=True).select(key("n").alias("n"))


@query("SELECT s_suppkey AS s FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal + 9000)")
def sparql_exists(spark, d):
    q = quads(spark, d, "supplier", "customer", columns=["s_nationkey", "s_acctbal", "c_nationkey", "c_acctbal"])
    a = patterns.bgp(q, ("?s", name("s_nationkey"), "?n"), ("?s", name("s_acctbal"), "?sb"))
    b = patterns.bgp(q, ("?c", name("c_nationkey"), "?n"), ("?c", name("c_acctbal"), "?cb"))
    return patterns.exists_greater(a, b, x.number(F.col("sb")) + 9000, x.number(F.col("cb"))).select(key("s").alias("s"))


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3)")
def sparql_values(spark, d):
    q = quads(spark, d, "nation", "region")
    v = patterns.values(spark, ["r"], [(name("region/1"),), (name("region/3"),)])
    s = patterns.join(patterns.join(v, patterns.match(q, "?r", name("r_name"), "?region")), patterns.bgp(q, ("?n", name("n_regionkey"), "?r"), ("?n", name("n_name"), "?nation")))
    return s.select(text_of("region").alias("region"), text_of("nation").alias("nation"))


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS state, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
def sparql_bind_if_coalesce(spark, d):
    q = quads(spark, d, "customer", columns=["c_acctbal", "c_mktsegment"])
    s = patterns.star(q, "c", {"bal": name("c_acctbal"), "seg": name("c_mktsegment")})
    return s.select(key("c").alias("c"), F.when(num("bal") < 0, "debt").otherwise("credit").alias("state"), F.coalesce(F.nullif(text_of("seg"), F.lit("BUILDING")), F.lit("none")).alias("seg"))


@query("SELECT c_custkey AS c, c_name AS name FROM customer ORDER BY c_name DESC LIMIT 20 OFFSET 10")
def sparql_order_limit_offset(spark, d):
    s = patterns.match(quads(spark, d, "customer", columns=["c_name"]), "?c", name("c_name"), "?name")
    return patterns.slice_(s, x.order_keys(F.col("name"), descending=True), 10, 20).select(key("c").alias("c"), text_of("name").alias("name"))


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) > 5")
def sparql_having(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_name"])
    s = patterns.bgp(q, ("?c", name("c_nationkey"), "?n"), ("?n", name("n_name"), "?nation"))
    return patterns.aggregate(s, ["nation"], n=F.count("*")).where("n > 5").select(text_of("nation").alias("nation"), "n")


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sparql_group_concat(spark, d):
    q = quads(spark, d, "nation", "region")
    s = patterns.bgp(q, ("?n", name("n_name"), "?nation"), ("?n", name("n_regionkey"), "?r"), ("?r", name("r_name"), "?region"))
    return patterns.aggregate(s, ["region"], nations=patterns.group_concat(text_of("nation"), ",")).select(text_of("region").alias("region"), "nations")


@query("SELECT c_mktsegment AS seg, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def sparql_min_max_avg_sum(spark, d):
    q = quads(spark, d, "customer", columns=["c_acctbal", "c_mktsegment"])
    s = patterns.star(q, "c", {"bal": name("c_acctbal"), "seg": name("c_mktsegment")})
    b = num("bal")
    return patterns.aggregate(s, ["seg"], lo=F.round(F.min(b), 2), hi=F.round(F.max(b), 2), mean=F.round(patterns.mean(b), 4), total=F.round(patterns.total(b), 2)).withColumn("seg", text_of("seg"))


@query("SELECT 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, 0::BIGINT AS n")
def sparql_aggregate_of_nothing(spark, d):
    s = patterns.match(quads(spark, d, "customer", columns=["c_acctbal"]), "?c", name("absent"), "?v")
    return patterns.aggregate(s, [], total=patterns.total(num("v")), mean=patterns.mean(num("v")), n=F.count("*"))


@query("SELECT r_name AS region, sum(n)::BIGINT AS customers FROM (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def sparql_subselect_sum_of_count(spark, d):
    q = quads(spark, d, "customer", "nation", "region", columns=["c_nationkey", "n_regionkey", "r_name"])
    inner = patterns.aggregate(patterns.match(q, "?c", name("c_nationkey"), "?n"), ["n"], k=F.count("*"))
    s = patterns.join(inner, patterns.bgp(q, ("?n", name("n_regionkey"), "?r"), ("?r", name("r_name"), "?region")))
    return patterns.aggregate(s, ["region"], customers=F.sum("k")).withColumn("region", text_of("region"))


@query("SELECT source AS g, count(*) AS n FROM documents GROUP BY 1")
def sparql_graph_var(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang", "source")
    q = qs.table_quads(df, "documents", "doc_id", columns=["lang"], graph=x.iri(F.concat(F.lit(qs.BASE + "g/"), F.col("source"))))
    return patterns.aggregate(patterns.match(q, "?s", name("lang"), "?l", "?g"), ["g"], n=F.count("*")).withColumn("g", local("g"))


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def sparql_from_scope(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang", "source")
    q = qs.table_quads(df, "documents", "doc_id", columns=["lang"], graph=x.iri(F.concat(F.lit(qs.BASE + "g/"), F.col("source"))))
    t = qs.in_graphs(q, [name("g/src1"), name("g/src2"), name("g/src3")], allowed=[name("g/src1"), name("g/src2")])
    return patterns.aggregate(patterns.match(t, "?s", name("lang"), "?lang"), ["lang"], n=F.count("*")).withColumn("lang", text_of("lang"))


@query("SELECT doc_id AS doc, 'one' AS scope FROM documents WHERE lang = 'fr'")
def sparql_scope_denied(spark, d):
    """A scope of no graph sees nothing, whatever is asked for; one of a single graph sees that one's rows."""
    df = table(spark, d, "documents").select("doc_id", "lang")
    q = qs.table_quads(df, "documents", "doc_id", columns=["lang"], graph=x.iri(F.concat(F.lit(qs.BASE + "g/"), "lang")))
    seen = lambda scope, **how: patterns.match(qs.in_graphs(q, [name("g/fr"), name("g/de")], **how), "?s", name("lang"), "?l").select(key("s").alias("doc"), F.lit(scope).alias("scope"))
    return seen("none", allowed=[]).union(seen("one", allowed=[name("g/fr")]))


@query(
    """SELECT p_partkey AS p, length(p_name) AS n, upper(p_name) AS up, lower(p_type) AS low, contains(p_name, 'a') AS has, starts_with(p_type, 'S') AS st,
    split_part(p_type, ' ', 1) AS before, substr(p_name, 2, 3) AS sub, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rep, regexp_matches(p_type, '(?i)^s') AS rx, concat(p_brand, '/', p_type) AS cat FROM part"""
)
def sparql_str_funcs(spark, d):
    q = quads(spark, d, "part", columns=["p_name", "p_type", "p_brand"])
    s = patterns.star(q, "p", {"name": name("p_name"), "type": name("p_type"), "brand": name("p_brand")})
    n, t = text_of("name"), text_of("type")
    before = F.when(t.contains(" "), x.str_before(t, " ")).otherwise(t)
    return s.select(key("p").alias("p"), F.char_length(n).cast("long").alias("n"), F.upper(n).alias("up"), F.lower(t).alias("low"), n.contains("a").alias("has"), t.startswith("S").alias("st"), before.alias("before"), n.substr(2, 3).alias("sub"), F.regexp_replace(n, "[aeiou]", "_").alias("rep"), x.regex(t, "^s", "i").alias("rx"), F.concat(text_of("brand"), F.lit("/"), t).alias("cat"))


@query("SELECT c_custkey AS c, round(abs(c_acctbal), 2) AS a, ceil(c_acctbal)::BIGINT AS up, floor(c_acctbal)::BIGINT AS down, floor(c_acctbal + 0.5)::BIGINT AS r FROM customer")
def sparql_num_funcs(spark, d):
    s = patterns.match(quads(spark, d, "customer", columns=["c_acctbal"]), "?c", name("c_acctbal"), "?b")
    b = num("b")
    return s.select(key("c").alias("c"), F.round(F.abs(b), 2).alias("a"), F.ceil(b).alias("up"), F.floor(b).alias("down"), x.round_half_up(b).alias("r"))


@query("SELECT o_orderkey AS o, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def sparql_date_funcs(spark, d):
    s = patterns.match(quads(spark, d, "orders", columns=["o_orderdate"]), "?o", name("o_orderdate"), "?t")
    t = x.timestamp(F.col("t"))
    return s.where((t >= F.to_timestamp(F.lit("1995-01-01"))) & (t < F.to_timestamp(F.lit("1996-01-01")))).select(key("o").alias("o"), F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"))


@query("SELECT n_nationkey AS n, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
def sparql_hash_funcs(spark, d):
    s = patterns.match(quads(spark, d, "nation"), "?n", name("n_name"), "?name")
    t = text_of("name")
    return s.select(key("n").alias("n"), F.md5(t).alias("m"), F.sha1(t).alias("s1"), F.sha2(t, 256).alias("s2"))


@query("SELECT c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sparql_path_sequence(spark, d):
    q = quads(spark, d, "customer", "nation", "region", columns=["c_nationkey", "n_regionkey", "r_name"])
    p = patterns.sequence(patterns.sequence(patterns.edges(q, name("c_nationkey")), patterns.edges(q, name("n_regionkey"))), patterns.edges(q, name("r_name")))
    return p.select(key("x").alias("c"), text_of("y").alias("region"))


@query("SELECT n_nationkey AS n, count(*) AS k FROM (SELECT c_nationkey n_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def sparql_path_inverse_alternative(spark, d):
    q = quads(spark, d, "customer", "supplier", columns=["c_nationkey", "s_nationkey"])
    return patterns.edges(q, name("c_nationkey"), name("s_nationkey"), inverse=True).groupBy("x").agg(F.count("*").alias("k")).select(key("x").cast("int").alias("n"), "k")


@query(
    """WITH e AS (SELECT 'customer/' || c_custkey a, 'nation/' || c_nationkey b FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
    r AS (SELECT a, b FROM e UNION SELECT e.a, f.b FROM e JOIN e f ON e.b = f.a) SELECT b AS target, count(*) AS n FROM r GROUP BY 1"""
)
def sparql_path_plus(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    r = patterns.one_or_more(patterns.edges(q, name("c_nationkey"), name("n_regionkey")))
    return r.groupBy("y").agg(F.count("*").alias("n")).select(F.regexp_extract("y", "org/(.*)>", 1).alias("target"), "n")


@query("SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation UNION SELECT 'nation/' || n_nationkey, n_name FROM nation")
def sparql_construct(spark, d):
    q = quads(spark, d, "nation")
    s = patterns.star(q, "n", {"r": name("n_regionkey"), "label": name("n_name")})
    t = patterns.construct(s, ("?n", name("in"), "?r"), ("?n", name("label"), "?label"), ("?label", name("bad"), "?n"))
    return t.select(F.regexp_extract("s", "org/(.*)>", 1).alias("s"), F.when(x.is_iri(F.col("o")), F.regexp_extract("o", "org/(.*)>", 1)).otherwise(text_of("o")).alias("o"))


@query("SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal > 9990")
def sparql_ask(spark, d):
    return patterns.ask(patterns.match(quads(spark, d, "customer", columns=["c_acctbal"]), "?c", name("c_acctbal"), "?b").where(num("b") > 9990))


@query("SELECT 'n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'n_nationkey', n_nationkey::VARCHAR FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'n_regionkey', n_regionkey::VARCHAR FROM nation WHERE n_nationkey = 7 UNION ALL SELECT '22-rdf-syntax-ns#type', 'Nation'")
def sparql_describe(spark, d):
    t = patterns.describe(quads(spark, d, "nation"), patterns.values(spark, ["r"], [(name("nation/7"),)]))
    return t.select(local("p").alias("p"), F.when(x.is_iri(F.col("o")), local("o")).otherwise(text_of("o")).alias("o"))


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS seg FROM customer")
def update_delete_insert(spark, d):
    q = quads(spark, d, "customer", columns=["c_acctbal", "c_mktsegment"])
    hit = patterns.bgp(q, ("?c", name("c_acctbal"), "?b"), ("?c", name("c_mktsegment"), "?seg")).where(num("b") < 0)
    row = lambda o: hit.select(F.lit(name("g/customer")).alias("g"), F.col("c").alias("s"), F.lit(name("c_mktsegment")).alias("p"), o.alias("o"))
    after = updates.modify(q, row(F.col("seg")), row(F.lit('"DEBT"')))
    return patterns.match(after, "?c", name("c_mktsegment"), "?seg").select(key("c").alias("c"), text_of("seg").alias("seg"))


@query("SELECT count(*) AS quads, 0::BIGINT AS added FROM (SELECT unnest(['type', 'key', 'name', 'region']) FROM nation)")
def update_set_semantics(spark, d):
    q = quads(spark, d, "nation")
    after = updates.insert_data(q, q)
    added = updates.newly_inserted(q, q)
    return after.agg(F.count("*").alias("quads")).crossJoin(added.agg(F.count("*").alias("added")))


@query("SELECT n_nationkey AS n FROM nation WHERE n_regionkey <> 2")
def update_delete_data(spark, d):
    q = quads(spark, d, "nation")
    gone = q.where((F.col("p") == name("n_regionkey")) & (F.col("o") == name("region/2")))
    return patterns.match(updates.delete_data(q, gone), "?n", name("n_regionkey"), "?r").select(key("n").alias("n"))


_PARTS = views.Vocabulary(display_id=name("p_name"), title=name("p_type"), description=name("p_brand"), role=name("p_brand"), creator=name("p_type"), top_level=name("self"), member=name("member"))


def _parts(spark, d):
    q = quads(spark, d, "part", columns=["p_name", "p_type", "p_brand"])
    own = q.select("g", "s").distinct().select("g", "s", F.lit(name("self")).alias("p"), F.col("s").alias("o")).where(key("s") % 2 == 0)
    return views.object_metadata(q.union(own), _PARTS)


@query(
    """WITH t(type) AS (VALUES ('Part'), ('Thing')), r AS (SELECT p_partkey p, 'size/' || p_size role FROM part UNION SELECT p_partkey, 'brand/' || p_brand FROM part)
    SELECT p_partkey AS p, p_name AS display_id, type, role FROM part CROSS JOIN t JOIN r ON p = p_partkey WHERE p_partkey % 2 = 0
    ORDER BY p_name, '<http://example.org/part/' || p_partkey || '>', type, role LIMIT 25 OFFSET 5"""
)
def view_object_list(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    s = qs.node("part", F.col("p_partkey"))
    more = lambda p, o: df.select(F.lit(name("g/part")).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    role = name("role")
    q = quads(spark, d, "part", columns=["p_name"]).union(more(x.RDF_TYPE, F.lit(name("Thing")))).union(more(role, x.iri(F.concat(F.lit(qs.BASE + "size/"), "p_size")))).union(more(role, x.iri(F.concat(F.lit(qs.BASE + "brand/"), "p_brand"))))
    q = q.union(more(name("self"), s).where(key("s") % 2 == 0))
    objects = views.object_metadata(q, views.Vocabulary(name("p_name"), name("p_type"), name("none"), role, name("none"), name("self"), name("member")))
    rows = views.object_list(views.in_scope(objects, top_level=True), 5, 25)
    return rows.select(key("s").alias("p"), text_of("display_id").alias("display_id"), local("type").alias("type"), F.regexp_extract("role", "org/(.*)>", 1).alias("role"))


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 2 = 0 AND p_brand = 'Brand#11'")
def view_count(spark, d):
    return views.count_objects(views.in_scope(_parts(spark, d), top_level=True, role='"Brand#11"'))


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def view_facet_counts(spark, d):
    return views.facet_counts(views.in_scope(_parts(spark, d), top_level=True), "roles").withColumn("value", text_of("value"))


@query("SELECT DISTINCT p_type AS value FROM part")
def view_facets(spark, d):
    return views.facet(_parts(spark, d), "creators").withColumn("value", text_of("value"))


@query(
    """WITH m AS (SELECT n_regionkey c, 'nation/' || n_nationkey x FROM nation UNION SELECT n_regionkey, 'customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
    e AS (SELECT 'customer/' || c_custkey a, 'nation/' || c_nationkey b FROM customer)
    SELECT c AS region, x AS member, NOT EXISTS (SELECT 1 FROM m o JOIN e ON e.a = o.x WHERE o.c = m.c AND e.b = m.x) AS is_root FROM m"""
)
def view_root_members(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"]).withColumn("g", F.lit(name("g/all")))
    n = patterns.match(q, "?n", name("n_regionkey"), "?r")
    c = patterns.join(patterns.match(q, "?c", name("c_nationkey"), "?n"), n)
    member = n.select("r", F.col("n").alias("m")).union(c.select("r", F.col("c").alias("m"))).select(F.lit(name("g/all")).alias("g"), F.col("r").alias("s"), F.lit(name("member")).alias("p"), F.col("m").alias("o"))
    link = q.where(F.col("p") == name("c_nationkey"))
    return views.members(link.union(member), _PARTS).select(key("collection").cast("int").alias("region"), F.regexp_extract("member", "org/(.*)>", 1).alias("member"), "is_root")


@query("SELECT p_partkey AS p FROM part ORDER BY '<http://example.org/part/' || p_partkey || '>' LIMIT 40")
def object_list_keyset(spark, d):
    return views.keyset_page(_parts(spark, d), None, 40).select(key("s").alias("p"))


@query("SELECT p_partkey AS p, contains(lower(p_type), 'small') AS \"first\" FROM part WHERE contains(lower(p_type), 'small') OR contains(lower(p_name), 'small') OR contains(lower(p_brand), 'small')")
def object_substring(spark, d):
    return views.substring_search(_parts(spark, d), "SmaLL").select(key("s").alias("p"), "first")


@query("SELECT 'customer/' || c_custkey AS u FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 2")
def object_uses(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    return views.uses(q, name("region/2"), name("self")).select(F.regexp_extract("user", "org/(.*)>", 1).alias("u"))


@query("SELECT doc_id AS doc, count(*) OVER (PARTITION BY upper(text)) AS n FROM documents QUALIFY n > 1")
def object_twins(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    q = qs.table_quads(df, "documents", "doc_id", columns=["text"])
    own = df.select(F.lit(None).cast("string").alias("g"), qs.node("documents", F.col("doc_id")).alias("s"), F.lit(name("seq")).alias("p"), qs.node("documents", F.col("doc_id")).alias("o"))
    return views.twins(q.select("g", "s", "p", "o").union(own), name("seq"), name("text")).select(key("object").alias("doc"), "n")


@query("SELECT c_custkey AS c, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def typed_projection_pivot(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_name", "c_nationkey", "n_name"])
    c = views.pivot(q.where(F.col("g") == name("g/customer")), {"name": name("c_name"), "nation": name("c_nationkey")})
    n = views.pivot(q.where(F.col("g") == name("g/nation")), {"label": name("n_name")}).withColumnRenamed("s", "nation")
    return c.join(n, "nation").select(key("s").alias("c"), text_of("name").alias("name"), text_of("label").alias("nation"))


_WALK = """WITH e AS (SELECT 'customer/' || c_custkey a, 'nation/' || c_nationkey b FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation) """


@query(_WALK + "SELECT 'customer/1' AS node, 0 AS depth UNION ALL SELECT b, 1 FROM e WHERE a = 'customer/1' UNION ALL SELECT f.b, 2 FROM e JOIN e f ON f.a = e.b WHERE e.a = 'customer/1'")
def neighborhood_forward(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    links = [name("c_nationkey"), name("n_regionkey")]
    return traverse.neighborhood(q, name("customer/1"), 3, "forward", links).select(F.regexp_extract("node", "org/(.*)>", 1).alias("node"), "depth")


@query(_WALK + "SELECT 'region/1' AS node, 0 AS depth UNION ALL SELECT a, 1 FROM e WHERE b = 'region/1' UNION ALL SELECT f.a, 2 FROM e JOIN e f ON f.b = e.a WHERE e.b = 'region/1'")
def neighborhood_backward(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    links = [name("c_nationkey"), name("n_regionkey")]
    return traverse.neighborhood(q, name("region/1"), 2, "backward", links).select(F.regexp_extract("node", "org/(.*)>", 1).alias("node"), "depth")


@query(_WALK + """, b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w0 AS (SELECT 'nation/3' n), w1 AS (SELECT DISTINCT b n FROM b2 JOIN w0 ON a = n), w2 AS (SELECT DISTINCT b n FROM b2 JOIN w1 ON a = n)
    SELECT n AS node, min(k)::INT AS depth FROM (SELECT n, 0 k FROM w0 UNION ALL SELECT n, 1 FROM w1 UNION ALL SELECT n, 2 FROM w2) GROUP BY 1""")
def neighborhood_both(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    links = [name("c_nationkey"), name("n_regionkey")]
    return traverse.neighborhood(q, name("nation/3"), 2, "both", links).select(F.regexp_extract("node", "org/(.*)>", 1).alias("node"), "depth")


@query("SELECT 'nation/' || c_nationkey AS node FROM customer WHERE c_custkey IN (1, 2, 3) UNION SELECT 'customer/' || c_custkey FROM customer WHERE c_custkey IN (1, 2, 3) UNION SELECT 'region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (1, 2, 3)")
def closure_recursive(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"])
    seeds = patterns.values(spark, ["n"], [(name(f"customer/{i}"),) for i in (1, 2, 3)])
    return traverse.closure(q, seeds, without=[x.RDF_TYPE]).select(F.regexp_extract("node", "org/(.*)>", 1).alias("node"))


@query("SELECT 'customer/' || c_custkey AS src, 'region/' || n_regionkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey")
def link_graph(spark, d):
    q = quads(spark, d, "customer", "nation", columns=["c_nationkey", "n_regionkey"]).where(F.col("p") != x.RDF_TYPE)
    nodes = q.where(F.col("p") == name("c_nationkey")).select("s").union(q.where(F.col("p") == name("n_regionkey")).select("o"))
    strip = lambda c: F.regexp_extract(c, "org/(.*)>", 1).alias(c)
    return traverse.link_graph(q, nodes).select(strip("src"), strip("dst"))


@query(
    """WITH n AS (SELECT 'n' || n_nationkey k FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region), c AS (SELECT count(*)::DOUBLE t FROM n),
    e AS (SELECT 'n' || n_nationkey s, 'r' || n_regionkey d FROM nation), g AS (SELECT d, count(*)::DOUBLE m FROM e GROUP BY 1),
    a1 AS (SELECT k, 0.15 / t + 0.85 * ((SELECT count(*) FROM region) / t) / t + 0.85 * coalesce(m, 0) / t AS r FROM n LEFT JOIN g ON d = k, c)
    SELECT k AS node, round(r / (SELECT sum(r) FROM a1), 9) AS rank FROM a1"""
)
def pagerank_one_round(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("k")).union(r.select(F.concat(F.lit("r"), "r_regionkey")))
    links = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return traverse.pagerank(nodes, links, rounds=1).select("node", F.round("rank", 9).alias("rank"))


@query()
def pagerank(spark, d):
    q = quads(spark, d, "customer", "orders", columns=["o_custkey"])
    nodes = q.select("s").distinct()
    return traverse.pagerank(nodes, traverse.link_graph(q.where(F.col("p") != x.RDF_TYPE), nodes))


@query(
    """WITH t AS (SELECT 'r' || r_regionkey k FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer),
    u AS (SELECT 'n' || n_nationkey c, 'r' || n_regionkey p FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
    SELECT k AS ancestor, k AS descendant, 0 AS depth FROM t UNION ALL SELECT p, c, 1 FROM u UNION ALL SELECT v.p, u.c, 2 FROM u JOIN u v ON v.c = u.p"""
)
def ontology_closure(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    terms = up.select(F.col("child").alias("t")).union(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey")))
    return ontology.closure(terms, up)


@query("SELECT 'n' || n_nationkey AS descendant, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 0")
def ontology_descendants(spark, d):
    n = table(spark, d, "nation")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    terms = up.select(F.col("child").alias("t")).union(up.select("parent"))
    return ontology.descendants(ontology.closure(terms, up), "r1")


def _dna(spark, d):
    return wide(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


_DNA = "WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents) "


@query(_DNA + "SELECT doc_id, translate(reverse(lower(seq)), 'acgt', 'tgca') AS rc FROM s")
def rc_string(spark, d):
    return _dna(spark, d).select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query(
    _DNA
    + """, k AS (SELECT doc_id, substr(seq, i::INT + 1, 8) f FROM s, unnest(range(0, length(seq) - 7)) u(i)), c AS (SELECT f, upper(translate(reverse(lower(f)), 'acgt', 'tgca')) b FROM k)
    SELECT least(f, b) AS kmer, count(*) AS n, count(*) FILTER (f <= b) AS plus FROM c GROUP BY 1"""
)
def kmer_index(spark, d):
    return sequences.kmer_counts(_dna(spark, d), "seq", 8)


@query(_DNA + "SELECT doc_id, (length(seq) - length(replace(seq, 'ACGA', ''))) // 4 AS plus, (length(seq) - length(replace(seq, 'TCGT', ''))) // 4 AS minus FROM s WHERE contains(seq, 'ACGA') OR contains(seq, 'TCGT')")
def sequence_substring(spark, d):
    h = sequences.substring_hits(_dna(spark, d), "seq", "doc_id", "acga")
    return h.groupBy("doc_id").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


@query()
def sketch_bands(spark, d):
    return sequences.bands(_dna(spark, d).withColumn("sig", sequences.sketch(F.col("seq"))), "sig", "doc_id")


@query()
def lsh_candidates(spark, d):
    b = cut(sketch_bands(spark, d))
    return sequences.lsh_candidates(b, b.where(F.col("doc_id") % 50 == 0), "doc_id")


@query()
def sequence_clusters(spark, d):
    return alignment.cluster_sequences(_dna(spark, d), "seq", "doc_id")


@query()
def sequence_alignments(spark, d):
    """Queries (every fiftieth) against all that share a band with them."""
    s = _dna(spark, d)
    b = cut(sequences.bands(s.withColumn("sig", sequences.sketch(F.col("seq"))), "sig", "doc_id"))
    pairs = sequences.lsh_candidates(b, b.where(F.col("doc_id") % 50 == 0), "doc_id")
    return alignment.aligned_pairs(pairs, s, "seq", "doc_id").select("query", "doc_id", "a.*")


@query(_DNA + "SELECT doc_id::VARCHAR AS id, 'lang x' AS description, coalesce(seq, '') AS seq FROM s")
def fasta_round_trip(spark, d):
    path = fresh_path(spark, "fasta")
    _dna(spark, d).select(files.fasta_records(F.col("doc_id"), F.col("seq"), F.lit("lang x"))).write.text(path)
    return files.read_fasta(spark, path)


@query(
    """SELECT o_orderstatus AS seqid, 'region' AS type, o_orderkey::BIGINT AS start, (o_orderkey + 10)::BIGINT AS "end", o_totalprice::DOUBLE AS score, '+' AS strand, NULL::INTEGER AS phase,
    'o' || o_orderkey AS id, o_orderpriority || ';a=b%c+d&é' AS note FROM orders"""
)
def gff3_round_trip(spark, d):
    path = fresh_path(spark, "gff3")
    note = F.concat("o_orderpriority", F.lit(";a=b%c+d&é"))
    attributes = F.create_map(F.lit("ID"), F.concat(F.lit("o"), "o_orderkey"), F.lit("Note"), note)
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("seqid"), F.lit(None).cast("string").alias("source"), F.lit("region").alias("type"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 10).alias("end"), F.col("o_totalprice").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("phase"), attributes.alias("attributes"))
    files.gff3_lines(o).write.text(path)
    return files.read_gff3(spark, path).select("seqid", "type", "start", "end", "score", "strand", "phase", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Note"].alias("note"))


@query()
def knn_cells(spark, d):
    """Every fiftieth vector against all rows."""
    e = table(spark, d, "embeddings")
    model = cells.fit_cells(e, "embedding", "vec_id", 256)
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    indexed = cut(cells.index_cells(e, "embedding", model))
    return cells.search_cells(indexed, queries, model, "embedding", "vec_id", 10, cells.calibrate_probes(indexed, model, "embedding", "vec_id", 10))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents")
def text_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query(
    """WITH t AS (SELECT p_partkey p, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')) a, list_distinct(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}_]+')) b FROM part),
    s AS (SELECT p, CASE WHEN len(list_filter(a, lambda w: damerau_levenshtein(w, 'rde') <= 1)) > 0 THEN 3.0 ELSE 0.0 END + CASE WHEN len(list_filter(a, lambda w: damerau_levenshtein(w, 'widegtt') <= 2)) > 0 THEN 3.0 ELSE 0.0 END + CASE WHEN len(list_filter(b, lambda w: damerau_levenshtein(w, 'widegtt') <= 2)) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN len(list_filter(b, lambda w: damerau_levenshtein(w, 'rde') <= 1)) > 0 THEN 1.0 ELSE 0.0 END AS m FROM t)
    SELECT p, round(m * ln(2.0), 6)::DOUBLE AS score FROM s WHERE m > 0"""
)
def text_fuzzy_rank(spark, d):
    p = table(spark, d, "part").withColumn("rank", F.lit(1.0))
    s = text.text_scores(p, "p_partkey", {"p_name": 3.0, "p_type": 1.0}, "rde Widegtt")
    return text.ranked(s, "p_partkey", "rank").select(F.col("p_partkey").alias("p"), F.round("score", 6).alias("score"))


@query(
    """WITH b AS (SELECT p_partkey p, p_brand c, ln(1 + p_size) AS base, p_size % 7 = 0 AS q FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY base DESC, p) k FROM b)
    SELECT p, round(base / CASE WHEN k > 1 THEN 2 ELSE 1 END / CASE WHEN q THEN 10 ELSE 1 END, 6) AS score FROM r"""
)
def text_rank_penalty(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("c"), F.col("p_size").cast("double").alias("rank"), (F.col("p_size") % 7 == 0).alias("q"), F.lit(1.0).alias("text"))
    return text.ranked(p, "p", "rank", "c", "q").select("p", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey AS o, o_orderdate AS created FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1995-06-30 23:59:59' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def discovery_sort_dates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").alias("created"))
    return text.discovery_page(o.where(text.within(F.col("created"), "1995-03-01", "1995-06-30")), "created", "o", descending=True, limit=100)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def discovery_facets(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_PAIRS = "FROM (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b"


def _query_vector(spark, d):
    return [float(v) for v in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def _knn(metric, **more):
    """Every fiftieth vector against all rows."""

    def run(spark, d):
        e = table(spark, d, "embeddings")
        queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
        return vectors.nearest_each(e, "embedding", "vec_id", queries, metric, 20, **more).select("query", "vec_id", F.round("score", 5).alias("score"))

    return run


for _metric, _sql in (("cosine", "list_cosine_similarity(e, q)"), ("dot", "list_inner_product(e, q)"), ("euclidean", "-list_distance(e, q)"), ("manhattan", "-list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))")):
    QUERIES[f"knn_{_metric}"] = _knn(_metric)
    ORACLES[f"knn_{_metric}"] = f"SELECT query, vec_id, round(s, 5) AS score FROM (SELECT query, vec_id, {_sql} AS s {_PAIRS}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 20"


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS score FROM embeddings, {_Q} WHERE label IN (1, 2) OR NOT (label >= 4) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10 OFFSET 5")
def knn_filtered(spark, d):
    payload = F.to_json(F.struct(F.struct("label").alias("meta")))
    e = table(spark, d, "embeddings").withColumn("payload", payload)
    f = vectors.field("payload", "meta.label")
    rows = vectors.nearest(e, "embedding", "vec_id", _query_vector(spark, d), "cosine", 10, where=vectors.any_of(f, [1, 2]) | ~vectors.between(f, low=4), offset=5)
    return rows.select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT query, vec_id, round(s, 5) AS score FROM (SELECT query, vec_id, list_cosine_similarity(e, q) AS s {_PAIRS}) WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 20")
def knn_threshold(spark, d):
    return _knn("cosine", threshold=0.2)(spark, d)


@query()
def hash_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", vectors.hashing_embedding(F.col("text")).alias("embedding"))


@query(
    """WITH r AS (SELECT source AS query, doc_id AS doc, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
    j AS (SELECT source AS query, doc_id AS doc, quality AS rel FROM documents JOIN labels USING (doc_id)),
    h AS (SELECT r.query, k, coalesce(rel, 0) rel FROM r LEFT JOIN j USING (query, doc) WHERE k <= 10),
    g AS (SELECT query, count(*) FILTER (rel > 0) n, min(k) FILTER (rel > 0) f, sum((2 ** rel - 1) / log2(k + 1)) dcg FROM h GROUP BY 1),
    i AS (SELECT query, count(*) al, sum(CASE WHEN k <= 10 THEN (2 ** rel - 1) / log2(k + 1) END) idcg FROM (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc) k FROM j WHERE rel > 0) GROUP BY 1)
    SELECT query, n / 10 AS precision, round(coalesce(n / al, 0), 6) AS recall, round(coalesce(1 / f, 0), 6) AS reciprocal_rank, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM g LEFT JOIN i USING (query)"""
)
def relevance_metrics(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("score"))
    judged = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "doc"), "doc").select("query", "doc", F.col("quality").alias("relevance"))
    m = vectors.relevance(docs, judged)
    return m.select("query", "precision", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query("SELECT source AS g, count(*) AS n FROM documents WHERE source IN ('src1', 'src4', 'src7') GROUP BY 1")
def acl_scope(spark, d):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    g = access.visible_graphs(frame([("src1",)], "g string"), frame([("src4", "ann"), ("src5", "bob")], "g string, owner string"), frame([("src7", "ann"), ("src8", "bob")], "g string, viewer string"), "ann")
    docs = table(spark, d, "documents").select(F.col("source").alias("g"))
    return access.readable(docs, g).groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS g, 100::BIGINT AS triples, count(*) AS subjects, 4::BIGINT AS predicates FROM nation UNION ALL SELECT 'region', 15, count(*), 3 FROM region")
def graph_stats(spark, d):
    return views.graph_stats(quads(spark, d, "nation", "region")).withColumn("g", local("g"))


@query("SELECT 'Nation' AS \"class\", count(*) AS n FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def class_histogram(spark, d):
    return views.class_histogram(quads(spark, d, "nation", "supplier", columns=["n_name", "s_name"])).withColumn("class", local("class"))


@query(
    """WITH t AS (SELECT 'nation' AS t, n_nationkey k, unnest([{p: 'n_nationkey', o: '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>'}, {p: 'n_name', o: '"' || n_name || '"'}, {p: 'n_regionkey', o: '<http://example.org/region/' || n_regionkey || '>'}, {p: 't', o: '<http://example.org/Nation>'}]) x FROM nation
    UNION ALL SELECT 'region', r_regionkey, unnest([{p: 'r_regionkey', o: '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>'}, {p: 'r_name', o: '"' || r_name || '"'}, {p: 't', o: '<http://example.org/Region>'}]) FROM region),
    l AS (SELECT t, sha256('<http://example.org/' || t || '/' || k || '> ' || CASE x.p WHEN 't' THEN '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' ELSE '<http://example.org/' || x.p || '>' END || ' ' || x.o || ' .') h FROM t)
    SELECT '<http://example.org/g/' || t || '>' AS g, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS content_hash FROM l GROUP BY t"""
)
def content_hash(spark, d):
    return qs.content_hash(quads(spark, d, "nation", "region"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from .streaming.incremental import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def sql_console(spark, d):
    from .operators.console import run_sql

    rows, _ = run_sql({"orders": table(spark, d, "orders")}, "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC", 3)
    return rows


from . import catalogue_services, catalogue_stores  # noqa: E402, F401
