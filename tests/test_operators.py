"""Operators on small hand-made graphs and tables."""

from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.operators import components, ontology, patterns, ranking, sequences, traverse, updates, vectors, views
from quadloom.sources import quads as qs


def graph(spark, rows):
    return spark.createDataFrame(rows, qs.SCHEMA)


A, B, C, P, Q, G = "<u:a>", "<u:b>", "<u:c>", "<u:p>", "<u:q>", "<u:g>"


def test_terms(spark):
    rows = [('"a\\"b\\\\n\\n"@en-GB',), ('"01"^^<http://www.w3.org/2001/XMLSchema#int>',), ("<u:x>",), ("_:b",), (None,), ('"x"',)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(terms.str_(t), terms.lang(t), terms.number(t), terms.effective_boolean(t), terms.lang_matches(terms.lang(t), "en")).collect()]
    assert got[0] == ('a"b\\n\n', "en-GB", None, True, True)
    assert got[1] == ("01", "", 1.0, True, False)
    assert got[2][0] == "u:x" and got[3] == (None,) * 5 and got[4] == (None,) * 5
    ordered = [r.t for r in df.orderBy(*terms.order_keys(t)).collect()]
    assert ordered[0] is None and ordered[1] == "_:b" and ordered[2] == "<u:x>"
    text = spark.createDataFrame([("a-b-c",), ("abc",), (None,)], "s string")
    s = F.col("s")
    assert [tuple(r) for r in text.select(terms.str_before(s, "-"), terms.str_after(s, "-"), terms.encode_for_uri(F.concat(s, F.lit(" ~*")))).collect()] == [("a", "b-c", "a-b-c%20~%2A"), ("", "", "abc%20~%2A"), (None, None, None)]


def test_nquads_round_trip(spark, tmp_path):
    lines = ['<u:a> <u:p> "x \\"y\\""@en <u:g> .', "# note", "", "_:n <u:p> <u:b> .", "_:n <u:p> <u:b> .", '<u:a> <u:q> "1"^^<u:int> . # end']
    (tmp_path / "in.nq").write_text("\n".join(lines))
    q = qs.read_nquads(spark, str(tmp_path / "in.nq"))
    assert q.count() == 3 and q.where("g is null").count() == 2
    out = tmp_path / "out"
    qs.to_lines(q).write.text(str(out))
    assert sorted(map(str, qs.read_nquads(spark, str(out)).collect())) == sorted(map(str, q.collect()))
    assert qs.content_hash(q).collect() == qs.content_hash(q.union(q).repartition(3)).collect()


def test_algebra_with_unbound_variables(spark):
    q = graph(spark, [(G, A, P, B), (None, A, P, B), (G, B, P, C), (G, C, P, A), (G, C, Q, '"z"')])
    triples = qs.in_graphs(q, None)
    assert triples.count() == 4  # the same triple of two graphs is one
    left = patterns.optional(patterns.match(triples, "?x", P, "?y"), patterns.match(triples, "?x", Q, "?z"))
    assert sorted((r.x, r.z) for r in left.collect()) == sorted([(A, None), (B, None), (C, '"z"')], key=str)
    again = patterns.join(left, patterns.values(spark, ["z"], [('"w"',)]), maybe_unbound=("z",))
    assert sorted((r.x, r.z) for r in again.collect()) == [(A, '"w"'), (B, '"w"')]
    gone = patterns.minus(left, patterns.values(spark, ["z"], [('"z"',)]), maybe_unbound=("z",))
    assert sorted(r.x for r in gone.collect()) == [A, B]
    assert patterns.minus(left, patterns.values(spark, ["other"], [("<u:o>",)])).count() == 3
    cycle = patterns.one_or_more(patterns.edges(triples, P))
    assert cycle.count() == 9
    assert patterns.zero_or_one(patterns.edges(triples, P), patterns.values(spark, ["n"], [(A,), ("<u:lone>",)])).count() == 5


def test_updates(spark):
    q = graph(spark, [(G, A, P, B), (None, A, P, B), (G, A, P, C)])
    assert updates.delete_data(q, graph(spark, [(None, A, P, B)])).count() == 2
    assert updates.insert_data(q, q).count() == 3 and updates.newly_inserted(q, q).count() == 0
    assert updates.clear(q, None).count() == 2 and updates.clear(q, G).count() == 1
    renamed = updates.rename_prefixes(q, {"u:": "v:", "u:b": "w:b"}).where("g is null").first()
    assert (renamed.s, renamed.o) == ("<v:a>", "<w:b>")


def test_root_members(spark):
    m = "<u:member>"
    v = views.Vocabulary(*[f"<u:{n}>" for n in ("id", "title", "desc", "role", "creator", "top")], member=m)
    q = graph(spark, [(G, "<u:col>", m, x) for x in ("<u:1>", "<u:2>", "<u:3>", "<u:4>")] + [(G, "<u:1>", P, "<u:2>"), (G, "<u:1>", P, "_:x"), (G, "_:x", P, "<u:3>"), (G, "<u:4>", P, "<u:4>")])
    assert {r.member for r in views.members(q, v).where("is_root").collect()} == {"<u:1>", "<u:4>"}


def test_pagerank_and_closure(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "n string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "a")], "src string, dst string")
    got = {r.node: r["rank"] for r in traverse.pagerank(nodes, links, tolerance=1e-10).collect()}
    out, rank = {"a": "b", "b": "c", "c": "ac", "d": ""}, dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        lost = sum(rank[k] for k in out if not out[k])
        rank = {k: 0.15 / 4 + 0.85 * (lost / 4 + sum(rank[s] / len(o) for s, o in out.items() if k in o)) for k in out}
    assert all(abs(got[k] - rank[k]) < 1e-6 for k in rank) and abs(sum(got.values()) - 1) < 1e-9
    up = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b"), ("d", "zz")], "child string, parent string")
    closed = {(r.ancestor, r.descendant): r.depth for r in ontology.closure(nodes, up).collect()}
    assert closed[("a", "d")] == 2 and closed[("b", "d")] == 1 and closed[("d", "d")] == 0 and len(closed) == 10


def test_components(spark):
    pairs = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000, x) for x in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert all(got[i] == i // 50 * 50 for i in range(200)) and all(got[x] == 1000 for x in range(1000, 1300)) and got[5000] == 5000
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranks_and_top_k(spark):
    df = spark.createDataFrame([(i % 3, i, float(i % 10)) for i in range(300)], "k int, v long, s double")
    ranks = ranking.rank_within(df, ["k"], ["v"]).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in ranks if r.k == k) == list(range(100))
    for k in (1, 37, 300, 999):
        s, t = ranking.kth_largest(df, "s", "v", k, cells=7, bound=5)
        assert (s, t) == [(r.s, r.v) for r in sorted(df.collect(), key=lambda r: (-r.s, r.v))][min(k, 300) - 1]
    assert ranking.kth_largest(df.limit(0), "s", "v", 3) is None
    assert ranking.hash_sample(df, "v", 20).count() == 20


def test_sequences(spark):
    df = spark.createDataFrame([("a", "ACGTNACGTAA"), ("b", "aca aca"), ("c", None), ("d", "AC")], "k string, s string")
    assert {(r.kmer, r.position, r.strand) for r in sequences.kmers(df, "s", "k", 4).where("k = 'a'").collect()} == {("ACGT", 0, "+"), ("ACGT", 5, "+"), ("CGTA", 6, "+"), ("GTAA", 7, "+")}
    assert [(r.start, r.end, r.strand) for r in sequences.substring_hits(df, "s", "k", "aca").where("k = 'b'").collect()] == [(0, 3, "+"), (3, 6, "+")]
    assert sequences.substring_hits(df, "s", "k", "ACGT").count() == 2  # its own reverse complement counts once
    long = "ACGGTCATTGCAATCGGATCCGTTAAGC" * 3
    pair = spark.createDataFrame([(long, long.replace("GG", "GA", 1)), (long, None)], "x string, y string").select(sequences.sketch(F.col("x")).alias("x"), sequences.sketch(F.col("y")).alias("y"))
    assert 0.2 < pair.select(sequences.jaccard(F.col("x"), F.col("y"))).first()[0] <= 1.0


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], '{"m": {"year": 2020}}'), ("b", [1.0, 1.0], '{"m": {"year": 2021}}'), ("c", [-1.0, 0.0], "{}"), ("d", [0.0, 0.0], None), ("e", [1.0], None)], "id string, v array<double>, p string")
    assert [r.id for r in vectors.nearest(df, "v", "id", [1.0, 0.0]).collect()] == ["a", "b", "c"]
    year = vectors.field("p", "m.year")
    assert [r.id for r in vectors.nearest(df, "v", "id", [1.0, 0.0], "dot", where=~vectors.between(year, 2021)).collect()] == ["a", "d", "c"]


def test_keeping_a_stored_set(spark, tmp_path):
    from quadloom.streaming.incremental import upkeep

    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    graph(spark, [(G, A, P, B), (None, A, P, B)]).write.parquet(source)
    for _ in range(2):
        upkeep(spark.readStream.schema(qs.SCHEMA).parquet(source), store, str(tmp_path / "check")).awaitTermination()
        graph(spark, [(G, A, P, B), (G, A, P, C)]).write.mode("append").parquet(source)
    assert spark.read.parquet(store).count() == 3


def test_parts_of_quads_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """However many rows a few bytes of a file hold, a task makes quads of a bounded number."""
    from quadloom import catalogue

    monkeypatch.setattr(catalogue, "ROWS_A_TASK", 1000, raising=False)
    spark.range(20_000).selectExpr("id AS p_partkey", "'one name' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = catalogue.quads(spark, str(tmp_path), "part", columns=["p_name"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 40_000 and max(r["count"] for r in sizes) <= 2 * 2 * 1000


def test_quads_of_one_file_are_dealt_over_all_cores(spark):
    """A table in one file is no single task of the scan, which would hold the quads or the subjects of all its rows."""
    from quadloom.catalogue import quads

    path = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{path}/part.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    q = quads(spark, path, "part", columns=["p_name"])
    sizes = q.rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and 0 < max(sizes) <= sum(sizes) // 2


def test_pagerank_rounds_hold_numbers_only(spark, monkeypatch):
    """No name of a node is joined or stored in a round; repeated links count once, ends elsewhere not at all."""
    from quadloom.operators import traverse

    kept, stored = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: kept.append((name, [k for _, k in df.dtypes])) or stored(df, name))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "node string")
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("b", "z"), ("z", "a")], "src string, dst string")
    got = {r.node: r["rank"] for r in traverse.pagerank(nodes, links, tolerance=0.0, rounds=30).collect()}
    assert all("string" not in kinds for name, kinds in kept if name != "nodes") and sum(name == "ranks" for name, _ in kept) > 2
    r = {n: 1 / 3 for n in "abc"}
    for _ in range(30):
        base = 0.05 + 0.85 * r["c"] / 3
        r = {"a": base, "b": base + 0.85 * r["a"] / 2, "c": base + 0.85 * (r["a"] / 2 + r["b"])}
    assert got.keys() == r.keys() and all(abs(got[n] - r[n]) < 1e-12 for n in r)
