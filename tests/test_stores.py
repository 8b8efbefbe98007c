"""Stored structures: the text index, the log of versions, banded alignment, sequences, graphs, pages, vectors; requests."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.functions.terms import RDF_TYPE
from quadloom.operators import alignment, banded, cells, cursors, discovery, graph_store, patterns, postings, sequence_store, sequences, text, text_index, vectors, views
from quadloom.operators.views import Vocabulary
from quadloom.plans import limits
from quadloom.sources.versions import Conflict, Table, VersionedStore
from quadloom.streaming import incremental

SF = "/root/testdata/sf0.001"


# ---- text index


def words(rng, n):
    return ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8]))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    long = "x" * 40
    rows = [(f"d{i}", " ".join(words(rng, 6)), " ".join(words(rng, 3)), "g1" if i % 3 else "g2", float(i % 7), ["A"] if i % 2 else ["A", "B"]) for i in range(300)]
    rows += [("long", f"{long} zz", None, "g1", 1.0, ["A"]), ("near", f"{long}y {'q' * 32}", "", "g1", None, ["A"]), ("null", None, None, "g1", 1.0, None)]
    return spark.createDataFrame(rows, "subject string, name string, display_id string, g string, rank double, types array<string>")


@pytest.fixture(scope="module")
def index(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("text") / "index")
    postings.write_text_index(documents, path)
    return path


QUERIES = ["abcd", "abcde edcba", "bacde ab", "c", "aabbcc " + "x" * 41, "q" * 31, "d43 cabbage", "dddddddd"]


def test_index_finds_what_a_scan_finds(spark, documents, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query int, q string")
    got = postings.search(spark, index, asked, limit=15, type_="A", graphs=["g1"])
    found = {}
    for r in got.orderBy("query", "place").collect():
        found.setdefault(r["query"], []).append((r.key, round(r.score, 9)))
    assert sum(map(len, found.values())) > 40
    for i, q in enumerate(QUERIES):
        want = text_index.search(documents, q, type_="A", graphs=["g1"], limit=15).collect()
        assert found.get(i, []) == [(r.subject, round(r.score, 9)) for r in want]


def test_index_pool_cluster_and_count(spark, documents, index):
    asked = spark.createDataFrame([(1, "abcde edcba")], "query int, q string")
    got = postings.search(spark, index, asked, limit=30, pool=20, cluster="g").orderBy("place").collect()
    want = text_index.search(documents, "abcde edcba", limit=30, pool=20, cluster="g").collect()
    assert [(r.key, round(r.score, 9)) for r in got] == [(r.subject, round(r.score, 9)) for r in want]
    assert postings.count(spark, index, asked).first().n == text_index.count(documents, "abcde edcba").first().n
    assert postings.search(spark, index, asked, graphs=[]).collect() == []


def test_index_reads_only_its_tokens_folders(spark, documents, index, tmp_path):
    asked = spark.createDataFrame([(1, "abcd")], "query int, q string")
    want = sorted(tuple(r) for r in postings.count(spark, index, asked).collect())
    near = postings.near_tokens(spark, index, asked.select(F.explode(text.tokens(F.col("q"))).alias("w"))).withColumn("b", postings._bucket("token"))
    forms = asked.select(F.explode(postings.deletions(F.col("q"), F.lit(1))).alias("f")).select(postings._bucket("f"))
    kept = {"postings": {r.b for r in near.collect()}, "forms": {r[0] for r in forms.collect()}}
    shutil.copytree(index, tmp_path / "index")
    for t, buckets in kept.items():
        folders = list((tmp_path / "index" / t).glob("bucket=*"))
        assert len(buckets) < len(folders)
        for f in folders:
            if int(f.name.split("=")[1]) not in buckets:
                shutil.rmtree(f)
    assert sorted(tuple(r) for r in postings.count(spark, str(tmp_path / "index"), asked).collect()) == want


def test_index_of_nothing(spark, documents, tmp_path):
    postings.write_text_index(documents.limit(0), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "abcd"), (2, None), (3, " ")], "query int, q string")
    assert postings.search(spark, str(tmp_path / "none"), asked).collect() == []


def test_close_is_near(spark):
    rng = random.Random(2)
    pairs = [(w, t) for w in words(rng, 40) for t in words(rng, 40)] + [("abcd", "badc"), ("abcdef", "badcef"), ("abcdef", "bacdfe"), ("abcdef", "bacde")]
    df = spark.createDataFrame(pairs, "w string, t string").withColumn("c", text.close(F.col("w"), F.col("t"), text.edits_of(F.col("w"))))
    got = {(r.w, r.t): r.c for r in df.collect()}
    for w in {w for w, _ in pairs}:
        n = text.allowed_edits(w)
        near = df.where(F.col("w") == w).select("t", (text._near(w, n)(F.col("t")) if n else F.col("t") == w).alias("n")).collect()
        assert all(got[w, r.t] == r.n for r in near)


def test_close_pairs_and_forms_as_by_columns(spark):
    """What tasks compute of single tokens is what the columns say."""
    rng = random.Random(6)
    some = sorted({*words(rng, 250), "", "a", "ab", "éa", "aé", "abcdef", "badcfe", "abdcfe", "bacdfe", "zzbacdef"})
    df = spark.createDataFrame([(w, t) for w in some for t in some], "w string, t string").withColumn("n", text.edits_of(F.col("w"))).withColumn("c", text.close(F.col("w"), F.col("t"), F.col("n")))
    assert [r for r in df.collect() if r.c != text.is_close(r.w, r.t, r.n)] == []
    n = F.length("w")
    depth = F.when(n >= 4, 2).when(n >= 2, 1).otherwise(0)
    rows = spark.createDataFrame([(w,) for w in some if w], "w string").select(F.col("w").alias("token"), F.explode(postings.deletions(F.col("w"), depth)).alias("form"))
    batches = [__import__("pyarrow").RecordBatch.from_pydict({"token": [w for w in some if w]})]
    assert {(r.token, r.form) for r in rows.collect()} == {x for b in postings._forms(batches) for x in zip(*b.to_pydict().values(), strict=True)}


def test_parts_get_only_tokens_that_they_hold(spark, monkeypatch, tmp_path):
    """A word's near tokens go to the parts whose postings have them, not to all; the result does not depend on the parts."""
    docs = spark.createDataFrame([(f"d{i}", f"common token{chr(97 + i % 26)}{chr(97 + i // 26)}", "g", 1.0, ["t"]) for i in range(200)], "subject string, text string, g string, rank double, types array<string>")
    path = str(tmp_path / "index")
    postings.write_text_index(docs, path, boosts={"text": 1.0})
    asked = spark.createDataFrame([(1, "common"), (2, "tokenaa"), (3, "tokenzz comon")], "query int, q string")
    found = []
    for many in (1_000_000, 10):
        monkeypatch.setattr(postings, "POSTED", many)
        found.append({(r["query"], r.place, r.key, r.score) for r in postings.search(spark, path, asked, limit=30).collect()})
    assert found[0] == found[1] and found[0]


# ---- versions

TABLES = {"a": Table("k long, v string", ["k"], buckets=4), "b": Table("k long, j long, v string", ["k", "j"], ["k"], 4)}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string")


def state(store, as_of=None):
    return {r.k: r.v for r in store.snapshot("a", as_of).collect()}


def test_versions_as_of_compaction_and_vacuum(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), TABLES)
    assert store.tip() is None and state(store) == {}
    history = [{}]
    rng = random.Random(1)
    for step in range(6):
        put = {rng.randrange(12): f"v{step}" for _ in range(4)}
        gone = [k for k in range(12) if rng.random() < 0.2 and k not in put]
        pairs = spark.createDataFrame([(k, j, v) for k, v in put.items() for j in (1, 2)], "k long, j long, v string")
        n = store.commit({"a": (rows(spark, *put.items()), spark.createDataFrame([(k,) for k in gone], "k long")), "b": (pairs, None)})
        assert n == step + (step > 3)
        history.append({k: v for k, v in {**history[-1], **put}.items() if k not in gone})
        if step == 3:
            assert store.compact() == 4
            assert state(store) == history[-1]
    versions = [0, 1, 2, 3, 5, 6]
    for v, want in zip(versions, history[1:], strict=True):
        assert state(store, v) == want
    wanted = rows(spark, (3, ""), (5, "")).select("k")
    assert {r.k for r in store.snapshot("a", wanted=wanted).collect()} == {3, 5} & set(history[-1])
    assert {(r.k, r.j) for r in store.snapshot("b", wanted=wanted).collect()} <= {(k, j) for k in (3, 5) for j in (1, 2)}
    assert {r.version for r in store.changes("a", after=4).collect()} == {5, 6}
    assert store.vacuum() == [4, 5, 6]
    assert state(store) == history[-1]
    with pytest.raises(ValueError):
        state(store, 2)


def test_failed_and_conflicting_commits_leave_the_old_state(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), TABLES)
    store.commit({"a": (rows(spark, (1, "one"), (None, "no key")), None)})
    bad = rows(spark, (1, "two")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"b": (rows(spark, (1, "x")).withColumn("j", F.lit(1)), None), "a": (bad, None)})
    assert state(store) == {1: "one"} and store.snapshot("b").count() == 0
    with pytest.raises(Conflict):
        store._publish(None, None, "delta", "x", ["a"], None)
    store.commit({"a": (rows(spark, (2, "deux"), (2, "zwei")), None)})
    assert state(store) == {1: "one", 2: "zwei"}


# ---- alignment in a band


def mutated(rng, s, rate):
    out = []
    for ch in s:
        r = rng.random()
        out += [] if r < rate / 3 else [rng.choice("acgt"), ch] if r < 2 * rate / 3 else [rng.choice("acgt")] if r < rate else [ch]
    return "".join(out)


def plain_band(q, t, d):
    """The best score by a cell-by-cell recurrence within the band."""
    low, h, e, f = -(10**6), {}, {}, {}
    for i in range(len(q) + 1):
        for j in range(max(0, i + d - 6), min(len(t), i + d + 6) + 1):
            if i == 0:
                h[i, j], e[i, j], f[i, j] = 0, low, low
                continue
            f[i, j] = max(h.get((i - 1, j), low) - 6, f.get((i - 1, j), low) - 1)
            e[i, j] = max(h.get((i, j - 1), low) - 6, e.get((i, j - 1), low) - 1)
            same = j > 0 and q[i - 1] == t[j - 1] and q[i - 1] < 4
            h[i, j] = max(h.get((i - 1, j - 1), low) + (1 if same else -1) if j else low, e[i, j], f[i, j])
    return max(v for (i, _), v in h.items() if i == len(q))


def test_band_as_plain_recurrence():
    rng = random.Random(5)
    code = lambda s: alignment._BASES[np.frombuffer(s.encode(), np.uint8)]
    jobs = []
    while len(jobs) < 60:
        t = "".join(rng.choice("acgt") for _ in range(rng.randrange(20, 200)))
        a = rng.randrange(len(t) // 2)
        q = mutated(rng, t[a : a + rng.randrange(10, len(t))], rng.choice([0.02, 0.1, 0.2])) + "n" * rng.randrange(2)
        d = banded.diagonal(code(q), code(t)) if q else None
        if d is not None:
            jobs.append((code(q), code(t), d[0]))
    same = 0
    for (q, t, d), (score, identity, cigar) in zip(jobs, banded.align_in_band(jobs), strict=True):
        assert score == plain_band(q.tolist(), t.tolist(), d)
        full = alignment._align(q, t)
        assert score <= full[0] and 0 <= identity <= 1
        same += (score, identity, cigar) == full
    assert same > 50  # elsewhere the band clips, or two paths score alike


def test_band_strands_and_odd_pairs(spark):
    rng = random.Random(6)
    t = "".join(rng.choice("acgt") for _ in range(120))
    back = t[20:90][::-1].translate(alignment._PAIR)
    pairs = [(t, t), (back, t), (t[30:60], t), ("acgtacg", t), (None, t), (t, None), ("", t), (t, "acgt"), ("a" * 3000, "a" * 4000), ("g" * 40, t)]
    got = banded.align_pairs(pairs)
    assert got[0] == (1.0, "+", "120M", 120) and got[1] == (1.0, "-", "70M", 70) and got[2] == (1.0, "+", "30M", 30)
    assert got[3:8] == [None] * 5 and got[8] == (1.0, "+", "3000M", 3000) and got[9] is None
    df = spark.createDataFrame(pairs, "q string, t string").select(banded.banded_alignment(F.col("q"), F.col("t")).alias("a"))
    assert [r.a and tuple(r.a) for r in df.collect()] == got


# ---- the sequence store


@pytest.fixture(scope="module")
def dna(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    rng = random.Random(7)
    base = "".join(rng.choice("acgt") for _ in range(400))
    made = [(10_000 + i, mutated(rng, base, 0.03)) for i in range(20)] + [(10_100 + i, base[50:]) for i in range(30)] + [(10_200, None), (10_201, "acg")]
    return docs.union(spark.createDataFrame(made, "doc_id long, seq string")).cache()


def test_store_appends_as_clustered_at_once(spark, dna, tmp_path):
    store = sequence_store.SequenceStore(spark, str(tmp_path / "seq"), buckets=8)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    for low, high in ((0, 6), (6, 9), (9, 10)):
        store.append(dna.where((part >= low) & (part < high)), "seq", "doc_id")
    store.append(dna.limit(5), "seq", "doc_id")  # all known already
    want = alignment.cluster_sequences(dna, "seq", "doc_id", banded=True)
    assert {tuple(r) for r in store.clusters().collect()} == {tuple(r) for r in want.collect()}
    written = {r.version: r["count"] for r in store.store.changes("clusters").groupBy("version").count().collect()}
    assert written[2] < dna.count() / 2 and 3 not in written  # only what changed


def test_clusters_take_few_rounds_and_follow_the_order(spark, monkeypatch):
    """Forty unlike sequences in one band, and copies and near copies among them: as a walk in order gives, without a round each."""
    rng = random.Random(11)
    base = "".join(rng.choice("acgt") for _ in range(120))
    texts = ["".join(rng.choice("acgt") for _ in range(rng.randint(60, 200))) for _ in range(40)] + [mutated(rng, base, r) for r in (0, 0, 0.05, 0.1, 0.2, 0.3)] + [base] * 3
    monkeypatch.setattr(alignment, "bands", lambda df, sig, key: df.where(F.col(sig).isNotNull()).select(key, F.lit(1).cast("long").alias("band")))
    cuts, cut = [], alignment.cut
    monkeypatch.setattr(alignment, "cut", lambda df: cuts.append(1) or cut(df))
    got = {r.id: r.cluster for r in alignment.cluster_sequences(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), "seq", "id").collect()}
    want, leaders = {}, []
    for x in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        found = [r for r in leaders if (a := alignment.align_pair(texts[x], texts[r])) and a[0] >= alignment.MIN_IDENTITY]
        want[x] = found[0] if found else x
        leaders += [] if found else [x]
    assert got == want and len(leaders) >= 40
    assert len(cuts) < 50  # five a round before, with a round for each leader


def test_fewest_errors_leave_out_no_pair(spark):
    rng = random.Random(12)
    for _ in range(300):
        t = "".join(rng.choice("acgtn") for _ in range(rng.randint(20, 90)))
        q = mutated(rng, t, rng.choice((0, 0.1, 0.2, 0.4)))[rng.randint(0, 20) :] or "a"
        q = q if rng.random() < 0.6 else q[::-1].translate(str.maketrans("acgt", "tgca"))
        whole = alignment.align_pair(q, t)
        for least in (0.5, 0.8, 0.95):
            quick = alignment.align_pair(q, t, min_identity=least)
            assert (quick if quick and quick[0] >= least else None) == (whole if whole and whole[0] >= least else None)


def test_candidates_share_kmers_near_one_diagonal(spark):
    """A copy with changes and its reverse complement are candidates; texts of the same words in another order, which share as many 12-mers, are not."""
    rng = random.Random(13)
    words = ["".join(rng.choice("ACGT") for _ in range(14)) for _ in range(40)]
    mixed = [rng.sample(words, 40) for _ in range(20)]
    query = "".join(words)
    near = mutated(rng, query.lower(), 0.08).upper()
    back = near[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, query), (2, near), (3, back), (4, query[:200])] + [(10 + i, "".join(m)) for i, m in enumerate(mixed)]
    held = spark.createDataFrame(rows, "id long, t string")
    asked = spark.createDataFrame([(7, query), (8, "ACG"), (9, query[:300])], "query long, q string")
    every = {tuple(r) for r in sequences.align_candidates(held, "t", "id", asked.where("length(q) >= 12"), 12).collect()}
    assert len(every) == 2 * len(rows)
    got = {tuple(r) for r in sequences.align_candidates(held, "t", "id", asked, 12, 0.15, 0.8).collect()}
    assert got == {(7, 1), (7, 2), (7, 3), (9, 1), (9, 2), (9, 3)}


def test_store_search_recall(spark, dna, tmp_path):
    store = sequence_store.SequenceStore(spark, str(tmp_path / "seq"), buckets=8)
    store.append(dna, "seq", "doc_id")
    asked = dna.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.col("seq").alias("q"))
    got = {(r["query"], r.key): round(r.identity, 9) for r in store.search(asked, most=1000).collect()}
    every = asked.crossJoin(dna).withColumn("a", banded.banded_alignment(F.col("q"), F.col("seq"))).where("a is not null")
    want = {(r["query"], r.doc_id): round(r.a.identity, 9) for r in every.collect()}
    assert all(want.get(k) == v for k, v in got.items())
    banded_only = {(r["query"], r.key) for r in store.search(asked, most=1000, by="bands").collect()}
    print("recall at 0.8:", sum(k in got for k in want), "by bands", len(banded_only), "of", len(want))
    assert len(want) > 50 and sum(k in got for k in want) >= 0.9 * len(want) and banded_only <= set(got)
    ranks = dna.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 7).cast("double").alias("rank"))
    few = store.search(asked, ranks, dna.where("doc_id % 3 > 0").select(F.col("doc_id").alias("key")), most=5).collect()
    best = {}
    for (q, k), i in got.items():
        if k % 3:
            best.setdefault(q, []).append((-(k % 7) * i, k))
    assert {(r["query"], r.place, r.key) for r in few} == {(q, n + 1, k) for q, found in best.items() for n, (_, k) in enumerate(sorted(found)[:5])}


# ---- graphs

N = "http://example.org/"
V = Vocabulary(f"<{N}id>", f"<{N}title>", f"<{N}text>", f"<{N}role>", f"<{N}by>", f"<{N}top>", f"<{N}member>")


def document(spark, *subjects, title="t"):
    rows = []
    for s in subjects:
        rows += [(f"<{N}{s}>", RDF_TYPE, f"<{N}Thing>"), (f"<{N}{s}>", f"<{N}id>", f'"{s}"'), (f"<{N}{s}>", f"<{N}title>", f'"{title}"'), (f"<{N}{s}>", f"<{N}top>", f"<{N}{s}>"), (f"<{N}c>", f"<{N}member>", f"<{N}{s}>"), (f"<{N}{s}>", f"<{N}role>", f"<{N}r{len(s)}>")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def derived_anew(store):
    """What each derived table should hold, from the quads alone."""
    q = store.quads().withColumn("g", F.coalesce("g", F.lit("")))
    return {"objects": views.object_metadata(q, V), "members": views.members(q, V), "summaries": views.object_summary(q, V, ("g", "s"))}


def same_rows(a, b):
    names = sorted(a.columns)
    return sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))


def test_graph_store_modes_upkeep_and_history(spark, tmp_path):
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), V, buckets=4)
    g, h = f"<{N}g>", f"<{N}h>"
    rules = {"titled": ("error", F.col("title") != '"bad"'), "short": ("warning", F.length("display_id") < 5)}
    store.import_graph(document(spark, "a", "bb"), g, rules=rules)
    with pytest.raises(ValueError, match="there already"):
        store.import_graph(document(spark, "z"), g)
    with pytest.raises(ValueError, match="no mode"):
        store.import_graph(document(spark, "z"), g, "append")
    store.import_graph(document(spark, "cc", title="bad"), g, "merge", rules)
    store.import_graph(document(spark, "x"), h, "replace", rules)
    store.import_graph(document(spark, "y"), None, rules=rules)  # the default graph
    about = {r.g: (r.triples, r.status, r.issues) for r in store.store.snapshot("graphs").collect()}
    assert about == {g: (18, "failed", 1), h: (6, "passed", 0), "": (6, "passed", 0)}
    assert store.quads([None]).where("g is null").count() == 6
    broken = document(spark, "q").withColumn("o", F.when(F.col("p") == RDF_TYPE, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("o")))
    tip = store.store.tip()
    with pytest.raises(Exception, match="lost"):
        store.import_graph(broken, h, "merge")
    assert store.store.tip() == tip and store.quads([h]).count() == 6
    assert {r.s for r in store.objects(role=f"<{N}r2>", type_=f"<{N}Thing>").collect()} == {f"<{N}bb>", f"<{N}cc>"}
    assert {r.s for r in store.objects(graphs=[h], top_level=True).collect()} == {f"<{N}x>"}
    # An update makes one graph dirty; the views stay as they were until it is derived again.
    q = store.quads([g])
    gone = q.where((F.col("s") == f"<{N}a>") | (F.col("o") == f"<{N}a>"))
    put = document(spark, "ddd").withColumn("g", F.lit(g)).union(document(spark, "bb", title="new").where(F.col("p") == f"<{N}title>").withColumn("g", F.lit(g)))
    store.apply(put, gone.union(q.where((F.col("s") == f"<{N}bb>") & (F.col("p") == f"<{N}title>"))))
    assert [r.g for r in store.dirty().collect()] == [g]
    assert f"<{N}a>" in {r.s for r in store.objects().collect()}
    before = store.store.tip()
    store.refresh(rules)
    assert store.refresh() is None and store.dirty().isEmpty()
    for name, rows in derived_anew(store).items():
        assert same_rows(store.store.snapshot(name), rows), name
    written = {(r.s, r.gone) for r in store.store.changes("objects", after=before).collect()}
    assert written == {(f"<{N}a>", True), (f"<{N}bb>", False), (f"<{N}ddd>", False)}
    assert {r.s for r in store.objects(role=f"<{N}r1>").collect()} == {f"<{N}x>", f"<{N}y>"}
    assert [(r.version, r.gone) for r in store.history(f"<{N}bb>").collect()] == [(0, False), (before + 1, False)]
    assert same_rows(store.quads([g], as_of=0), document(spark, "a", "bb").withColumn("g", F.lit(g)))
    store.store.compact()
    assert store.store.vacuum() == [before + 2]
    for name, rows in derived_anew(store).items():
        assert same_rows(store.store.snapshot(name), rows), name


# ---- cursors


def test_pages_make_the_whole_and_open_few_files(spark, tmp_path):
    rows = [(i % 5 if i % 7 else None, i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b long, v string")
    path, order = str(tmp_path / "pages"), ["a", "b"]
    cursors.write_ranged(df, path, order, files=12)
    got, at, opened, first = [], None, [], True
    while first or at is not None:
        page, at = cursors.page(spark, path, order, at, 45)
        got += [tuple(r) for r in page.collect()]
        opened.append(len(page.inputFiles()))
        first = False
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert max(opened) <= 4 < 12 and len(opened) == 12
    for bad in ("nonsense", cursors.encode({"b": 1}), cursors.encode({"a": 1, "b": 2})[:-6]):
        with pytest.raises(ValueError):
            cursors.page(spark, path, order, bad, 5)
    cursors.write_ranged(df.limit(0), str(tmp_path / "none"), order)
    page, at = cursors.page(spark, str(tmp_path / "none"), order, None, 5)
    assert page.collect() == [] and at is None and page.columns == ["a", "b", "v"]


def test_offset_pages(spark):
    ranked = spark.range(7).orderBy(F.desc("id"))
    got, at, first = [], None, True
    while first or at is not None:
        page, at = cursors.offset_page(ranked, at, 3)
        got.append([r.id for r in page.collect()])
        first = False
    assert got == [[6, 5, 4], [3, 2, 1], [0]]
    with pytest.raises(ValueError):
        cursors.offset_page(ranked, cursors.encode({"offset": "x"}), 3)


# ---- vectors


def test_generations_branch_from_the_active_one(spark, tmp_path):
    points = lambda *rows: spark.createDataFrame(list(rows), "id string, v array<double>")
    store = vectors.Generations(spark, str(tmp_path / "v"))
    assert store.active() is None and store.snapshot() is None
    store.apply("one", points(("a", [1.0]), ("b", [2.0]), ("c", [3.0])))
    store.activate("one")
    store.apply("two", points(("b", [9.0])), points(("c", [0.0])))
    store.apply("three", points(("d", [4.0])))  # of "one" too, as that is active
    read = lambda name=None: {r.id: r.v for r in store.snapshot(name).collect()}
    assert read() == {"a": [1.0], "b": [2.0], "c": [3.0]}
    assert read("two") == {"a": [1.0], "b": [9.0]} and read("three") == {"a": [1.0], "b": [2.0], "c": [3.0], "d": [4.0]}
    store.activate("two")
    assert store.active() == "two" and store.delete_inactive() == [0, 1]
    store.compact()
    assert store.active() == "two" and read() == {"a": [1.0], "b": [9.0]}
    assert store.delete_inactive() == [2]
    again = vectors.Generations(spark, str(tmp_path / "v"))
    assert {r.id for r in again.snapshot().collect()} == {"a", "b"}


def test_filtered_cells_widen(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(100)))
    model = cells.fit_cells(e, "embedding", "vec_id", 64)
    indexed = cells.index_cells(e, "embedding", model).cache()
    asked = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    probes = cells.calibrate_probes(indexed, model, "embedding", "vec_id", 5)
    for share in (5, 20, 60):
        passes = F.col("part") < share
        true = {(r["query"], r.vec_id) for r in vectors.nearest_each(e.where(passes), "embedding", "vec_id", asked, "cosine", 5).collect()}
        got = {(r["query"], r.vec_id) for r in cells.search_filtered(indexed, asked, model, "embedding", "vec_id", passes, k=5, probes=probes).collect()}
        assert len(got & true) >= 0.9 * len(true)
        by_key = cells.search_filtered(indexed, asked, model, "embedding", "vec_id", allowed=e.where(passes).select("vec_id"), k=5, probes=probes)
        assert {(r["query"], r.vec_id) for r in by_key.collect()} == got
    assert cells.search_filtered(indexed, asked, model, "embedding", "vec_id", F.col("part") < 0, k=5, probes=probes).collect() == []


def test_many_queries_in_few_passes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    asked = df.toDF("query", "q")
    best = lambda **how: {(r["query"], r.k, round(r.score, 9)) for r in vectors.nearest_each(df, "v", "k", asked, "dot", 3, **how).collect()}
    assert len(best()) == 360 and best() == best(block=7, held=50)


# ---- requests


def test_limits_and_kinds(spark):
    rows = spark.range(50)
    assert limits.answer(rows, limits.Limits(rows=60))[1] is False
    got, more = limits.answer(rows, limits.Limits(rows=20))
    assert len(got) == 20 and more
    with pytest.raises(limits.TooLarge):
        limits.answer(rows, limits.Limits(answer_bytes=100))
    with pytest.raises(limits.EvaluationError):
        limits.answer(rows.select(F.raise_error(F.lit("x")).cast("string").alias("a")))
    assert (limits.Limits().text_bytes, limits.Limits().rows) == (65_536, 100_000)
    with pytest.raises(limits.UnsupportedFormat):
        limits.check_format("turtle", "solutions")
    for sql in ("DROP TABLE a", " -- c\n insert into a select 1", "/* x */ SET a=1", "CREATE VIEW a AS SELECT 1"):
        with pytest.raises(limits.UpdateNotAllowed):
            limits.read_only(sql)
    assert limits.read_only("(SELECT 1)") and limits.read_only("-- a\nWITH a AS (SELECT 1) SELECT * FROM a")
    try:
        spark.sql("SELECT FROM WHERE 1 x y z (")
    except Exception as e:
        assert limits.as_request_error(e).kind == "parse"


def test_joins_of_unbound_variables_plan_only_parts_with_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, k string")
    b = spark.createDataFrame([("x", 5), ("y", 6)], "k string, j int")
    got = {tuple(r) for r in patterns.join(a, b, ("k",)).select("i", "k", "j").collect()}
    assert got == {(1, "x", 5), (2, "x", 5), (2, "y", 6)}
    plan = patterns.join(a, b, ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # b is never unbound
    assert patterns.join(a.limit(0), b, ("k",)).collect() == [] and {r.i for r in patterns.minus(a, b, ("k",)).collect()} == {2}


def test_classic_paths():
    wanted, words, offset, limit = discovery.classic_request("/search/objectType=Part&role=<http://r>&x='1'&steel and wood/?offset=5&limit=7", {"role": "<p>"}, N)
    assert wanted == {"type": f"<{N}Part>", "<p>": "<http://r>"} and (words, offset, limit) == ("steel wood", 5, 7)


def test_stream_into_a_graph_store(spark, tmp_path):
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), V, buckets=4)
    files = str(tmp_path / "in")
    quad = lambda i: (f"<{N}g{i % 2}>" if i % 3 else None, f"<{N}s{i}>", f"<{N}title>", f'"{i}"')
    schema = "g string, s string, p string, o string"
    seen = set()
    for low, high in ((0, 6), (3, 9), (3, 9), (8, 12)):
        spark.createDataFrame([quad(i) for i in range(low, high)], schema).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files)
        incremental.upkeep_graphs(stream, store, str(tmp_path / "checkpoint"), compact_every=2).awaitTermination()
        seen |= {quad(i) for i in range(low, high)}
        assert {tuple(r) for r in store.quads().collect()} == seen
    notes = [v.note for v in store.store.log()]
    assert notes == ["batch 0", "batch 1", "batch 1, compacted", "batch 3", "batch 3, compacted"]  # the third brought nothing new


def test_first_import_compares_nothing_but_leaves_no_stale_rows(spark, tmp_path, monkeypatch):
    """A graph that is not there is written as it comes, unless rows derived from quads now gone are left."""
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), V, buckets=2)
    compared = []
    differences = graph_store.GraphStore._differences
    monkeypatch.setattr(graph_store.GraphStore, "_differences", lambda self, name, *rest: compared.append(name) or differences(self, name, *rest))
    triples = lambda *subjects: spark.createDataFrame([(s, V.display_id, '"x"') for s in subjects], "s string, p string, o string")
    store.import_graph(triples("<a>", "<b>"), "<g>")
    assert compared == []
    store.apply(None, store.quads())
    assert not store.quads().count() and store.objects().count() == 2  # not derived again yet
    store.import_graph(triples("<c>"), "<g>")
    assert "objects" in compared and not store.dirty().count()
    for name in ("objects", "summaries"):
        assert [r.s for r in store.store.snapshot(name).collect()] == ["<c>"]


def test_summaries_of_the_default_graph(spark):
    """A graph without a name has summaries as any other."""
    q = spark.createDataFrame([(None, "<a>", V.display_id, '"x"'), ("<g>", "<a>", V.display_id, '"y"')], "g string, s string, p string, o string")
    assert {(r.g, r.display_id) for r in views.object_summary(q, V, ("g", "s")).collect()} == {(None, "x"), ("<g>", "y")}


def test_long_sequences_join_clusters(spark):
    """No length is too long to be compared: copies and near copies of over 5,000 bases are one cluster, by the full recurrence and by a band."""
    rng = random.Random(11)
    long = "".join(rng.choice("ACGT") for _ in range(6200))
    near = list(long[: 6200 - 3])
    for i in range(60, 6000, 400):
        near[i] = "ACGT"["ACGT".index(near[i]) - 1]
    rows = [(1, long), (2, long), (3, "".join(near)), (4, "".join(rng.choice("ACGT") for _ in range(5500)))]
    df = spark.createDataFrame(rows, "id long, seq string")
    for banded in (False, True):
        got = {r.id: (r.cluster, round(r.identity, 3)) for r in alignment.cluster_sequences(df, "seq", "id", banded=banded).collect()}
        assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, round(1 - 15 / 6197, 3)), 4: (4, 1.0)}, banded


def test_side_by_side_as_the_whole_recurrence(monkeypatch):
    """Diagonals that can't hold the best placing are left out without changing a score, an identity, a strand or a CIGAR, and origins are kept a block of rows at a time."""
    rng = random.Random(5)
    pairs = []
    for n in [*range(1, 40), *[rng.randrange(40, 300) for _ in range(160)]]:
        t = [rng.choice("ACGT") for _ in range(n + rng.randrange(20, 400))]
        at = rng.randrange(len(t) - n)
        q = t[at : at + n]
        for _ in range(rng.randrange(1 + n // 3)):
            i, kind = rng.randrange(len(q)), rng.randrange(6)
            q[i : i + (kind == 1) + 9 * (kind == 2)] = [] if kind in (1, 2) else [rng.choice("ACGTN") for _ in range(12 if kind == 3 else 2 if kind == 4 else 1)]
            q = q or ["A"]
        text = "".join(q)
        pairs.append((text[::-1].translate(alignment._PAIR).upper() if n % 3 == 0 else text, "".join(t)))
    codes = lambda x: alignment._BASES[np.frombuffer(x.encode(), np.uint8)]
    whole = []
    for q, t in pairs:
        one, two = (alignment._align(codes(x), codes(t)) for x in (q.lower(), q.lower()[::-1].translate(alignment._PAIR)))
        (score, identity, cigar), strand = (two, "-") if two[0] > one[0] else (one, "+")
        whole.append((identity, strand, cigar, score))
    assert alignment.align_each(pairs) == whole
    monkeypatch.setattr(alignment, "_ORIGINS", 500)
    assert alignment.align_each(pairs) == whole
