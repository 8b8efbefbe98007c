"""Sequence files, alignment, clustering and the cell index against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from quadloom.operators import alignment, cells, sequences, vectors
from quadloom.sources import sequence_files as files

SF = "/root/testdata/sf0.001"


def plain_score(q, t):
    """Gotoh's recurrences cell by cell."""
    low = -(10**6)
    n, m = len(q), len(t)
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0] = [0] * (m + 1)
    for i in range(1, n + 1):
        for j in range(m + 1):
            f[i][j] = max(h[i - 1][j] - 6, f[i - 1][j] - 1)
            if j:
                e[i][j] = max(h[i][j - 1] - 6, e[i][j - 1] - 1)
            h[i][j] = max(f[i][j], e[i][j], h[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -1) if j else low)
    return max(h[n])


def test_alignment_against_plain_recurrences():
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choices("acgt", k=rng.randrange(20, 70)))
        q = list(t[rng.randrange(5) : len(t) - rng.randrange(5)])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(q))
            q[at : at + rng.randrange(3)] = rng.choices("acgt", k=rng.randrange(3))
        q = "".join(q) or "a"
        identity, strand, cigar, score = alignment.align_pair(q, t)
        back = q[::-1].translate(str.maketrans("acgt", "tgca"))
        assert score == max(plain_score(q, t), plain_score(back, t))
        used = {op: sum(int(x) for x, o in alignment.re.findall(r"(\d+)([MID])", cigar) if o == op) for op in "MID"}
        assert used["M"] + used["I"] == len(q) and used["M"] + used["D"] <= len(t) and 0 <= identity <= 1
    assert alignment.align_pair("acgu" * 6, "ACGT" * 6)[:3] == (1.0, "+", "24M")
    assert alignment.align_pair("aaaaaaaaaaccccccccccgg", "ccgggggggggggttttttttttt")[1] == "-"
    assert alignment.align_pair("acgt", "acgt") is None and alignment.align_pair(None, "acgt" * 9) is None and alignment.align_pair("", "acgt" * 9) is None


def test_clusters_against_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = []
    for family in range(6):
        base = "".join(rng.choices("ACGT", k=300 - family))
        for copy in range(8):
            s = list(base)
            for _ in range(rng.choice([0, 0, 3, 12, 70])):
                s[rng.randrange(len(s))] = rng.choice("ACGT")
            rows.append((family * 100 + copy, "".join(s)))
    rows += [(900, None), (901, ""), (902, "NNNN" * 20), (903, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, s string").withColumn("band", F.lit(1))
    got = {r.id: r.cluster for r in alignment.cluster_sequences(df, "s", "id").collect()}
    banded = {}
    for r in sequences.bands(df.withColumn("sig", sequences.sketch(F.col("s"))), "sig", "id").collect():
        banded.setdefault(r.id, set()).add(r.band)
    leaders, want, text = [], {}, dict(rows)
    for i in sorted(text, key=lambda k: (-len(text[k] or ""), k)):
        want[i] = i
        mates = [(-len(banded[i] & banded[x]), n, x) for n, x in enumerate(leaders) if banded.get(i, set()) & banded[x]]
        for _, _, x in sorted(mates):
            found = alignment.align_pair(text[i], text[x])
            if found and found[0] >= 0.8:
                want[i] = x
                break
        if want[i] == i and i in banded:
            leaders.append(i)
    assert got == want
    assert len(set(got.values())) < len(got)
    assert alignment.cluster_sequences(df.limit(0), "s", "id").count() == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first of all\r\nACGT\r\nAC GT\r\n>two\n\n>three x\nTT\n")
    got = sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "a.fa")).collect()))
    assert got == [("one", "first of all", "ACGTACGT"), ("three", "x", "TT"), ("two", "", "")]
    rows = spark.createDataFrame([("k", "A" * 130), ("n", None)], "k string, s string")
    assert [r[0] for r in rows.select(files.fasta_records(F.col("k"), F.col("s"))).collect()] == [">k\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10, ">n\n"]


def test_gff3_and_genbank(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff-version 3\nchr1\t.\tgene\t5\t90\t.\t+\t.\tID=g1;Note=a%3Bb\nchr1\tx\tCDS\t5\t20\t1.5\t-\t0\t.\n##FASTA\n>chr1\nACGT\n")
    a, b = sorted(files.read_gff3(spark, str(tmp_path / "a.gff")).collect(), key=lambda r: r.end, reverse=True)
    assert (a.source, a.score, a.phase, a.attributes) == (None, None, None, {"ID": "g1", "Note": "a;b"})
    assert (b.source, b.type, b.start, b.score, b.strand, b.phase, b.attributes) == ("x", "CDS", 5, 1.5, "-", 0, {})
    record = "LOCUS       AB1 12 bp DNA\nDEFINITION  a thing\n            of two lines.\nACCESSION   AB1\nSOURCE      x\n  ORGANISM  E. coli\nFEATURES             Location/Qualifiers\n     gene            1..6\n                     /gene=\"a\"\n     CDS             complement(join(2..4,\n                     6..9))\n                     /note=\"two\n                     lines\"\n                     /pseudo\nORIGIN\n        1 acgtac gtacgt\n//\n"
    (tmp_path / "a.gb").write_text(record + record.replace("AB1", "AB2"))
    x, y = sorted(files.read_genbank(spark, str(tmp_path / "a.gb")).collect())
    assert (x.id, x.accession, x.definition, x.organism, x.seq) == ("AB1", "AB1", "a thing of two lines.", "E. coli", "acgtacgtacgt")
    assert [tuple(f) for f in y.features] == [("gene", "1..6", {"gene": "a"}), ("CDS", "complement(join(2..4,6..9))", {"note": "two lines", "pseudo": ""})] and y.id == "AB2"


def test_probes_reach_the_recall_on_a_larger_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    model = cells.fit_cells(e, "embedding", "vec_id", 256)
    indexed = cells.index_cells(e, "embedding", model).cache()
    probes = cells.calibrate_probes(indexed, model, "embedding", "vec_id", 10)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = cells.search_cells(indexed, queries, model, "embedding", "vec_id", 10, probes).select("query", "vec_id")
    true = vectors.nearest_each(e, "embedding", "vec_id", queries, "cosine", 10).select("query", "vec_id")
    assert true.join(found, ["query", "vec_id"]).count() >= 0.9 * true.count() and probes < len(model.clusterCenters())


def test_cell_index_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 4), (-3, [float("nan")] * 4)], "vec_id long, embedding array<float>")
    rows = e.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    model = cells.fit_cells(rows, "embedding", "vec_id", 256)
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = {}
    for r in cells.search_cells(cells.index_cells(rows.union(odd), "embedding", model), queries, model, "embedding", "vec_id", 10, 8).collect():
        got.setdefault(r["query"], set()).add(r.vec_id)
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    keys = np.array(list(table))
    unit = np.stack([v / np.linalg.norm(v) for v in table.values()])
    hit = [len(got[q] & set(keys[np.argsort(-(unit @ unit[list(keys).index(q)]), kind="stable")[:10]].tolist())) / 10 for q in got]
    assert len(got) == queries.count() and np.mean(hit) >= 0.9


def test_sketch_by_hand(spark):
    """Slots and bands of a short sequence, from plain integers."""
    mask = 2**64 - 1

    def mix(v):
        v = v + 0x9E3779B97F4A7C15 & mask
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & mask
        v = (v ^ v >> 27) * 0x94D049BB133111EB & mask
        return v ^ v >> 31

    seq = "ACGTTGCAACGGTACCATTGNACGGATCCATTGACCA"
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    words = set()
    for i in range(len(seq) - 13):
        w = seq[i : i + 14]
        if "N" not in w:
            back = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
            words.add(min(sum(code[c] << 2 * (13 - j) for j, c in enumerate(v)) for v in (w, back)))
    slots = [min((mix(w) + i * (mix(w ^ 0xA5A5A5A5A5A5A5A5) | 1)) & mask for w in words) for i in range(32)]
    bands = []
    for b in range(8):
        acc = mix(b ^ 0x243F6A8885A308D3)
        for v in slots[4 * b : 4 * b + 4]:
            acc = mix(acc ^ v)
        bands.append(acc)
    df = spark.createDataFrame([("a", seq), ("b", "ACG"), ("c", None)], "k string, s string").withColumn("sig", sequences.sketch(F.col("s")))
    got = {r.k: r.sig for r in df.collect()}
    assert [v & mask for v in got["a"]] == slots and got["b"] is None and got["c"] is None
    assert [r.band & mask for r in sequences.bands(df, "sig", "k").collect()] == bands
    other = df.where("k = 'a'").withColumn("k", F.lit("d"))
    assert {(r["query"], r.k) for r in sequences.lsh_candidates(sequences.bands(df.union(other), "sig", "k"), sequences.bands(other, "sig", "k"), "k").collect()} == {("d", "a")}


def test_hashing_embedding_by_hand(spark):
    import re

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    text = "Steel widget, été 12"
    want = np.zeros(256)
    for token in re.findall(r"\w+", text.lower()):
        for part, weight in [(token, 1.0), *((token[i : i + 3], 0.35) for i in range(len(token) - 2))]:
            h = fnv(part.encode())
            want[h % 256] += -weight if h >> 63 else weight
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(vectors.hashing_embedding(F.col("t")).alias("e")).collect()
    assert np.allclose(rows[0].e, want / np.linalg.norm(want)) and not any(rows[1].e) and not any(rows[2].e)


def test_cells_meet_as_products_with_ties_by_key(spark):
    """No pair of a query and a row goes through a join; copies of a vector tie by key, in one pass of queries and in many."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    base[60:] = base[:60] * 3  # as near as their originals
    table = {900 - i: base[i % 120].tolist() for i in range(600)}
    rows = spark.createDataFrame([*table.items(), (-1, None), (-2, [0.0] * 24)], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([*((i, table[i]) for i in range(400, 430)), (-1, None), (-2, [1.0, 2.0])], "query long, q array<double>")
    model = cells.fit_cells(rows, "v", "id", 8)
    indexed = cells.index_cells(rows, "v", model)
    found = cells.search_cells(indexed, queries, model, "v", "id", 7, 8)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.id)
    # ten copies of the query's own vector, of which the seven of least keys are wanted
    want = {q: sorted(i for i in table if (900 - i) % 60 == (900 - q) % 60)[:7] for q in range(400, 430)}
    assert got.keys() == want.keys() and all(len(v) == 7 for v in got.values())
    near = cells._distances(model, queries)
    split = cells._best_in_cells(indexed, near, "v", "id", 7, held=4)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, found.collect()))
    for q, ids in got.items():
        assert set(ids) <= {i for i in table if (900 - i) % 60 == (900 - q) % 60}, q
    exact = {}
    for r in vectors.nearest_each(rows, "v", "id", queries, "dot", 3, block=7, held=11).collect():
        exact.setdefault(r["query"], []).append((-r.score, r.id))
    m = np.array([table[i] for i in table])
    for q, have in exact.items():
        s = (m * np.array(table[q])).sum(axis=1)
        assert [i for _, i in sorted(have)] == [i for _, i in sorted(zip((-s).tolist(), table, strict=True))[:3]], q


def test_filtered_cells_reach_the_recall_among_copies(spark):
    """Copies fill the neighbourhood of a row, so that one cell does for all rows; the filter leaves one of them."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    copies = e.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).select((F.col("vec_id") + F.col("copy") * 10_000).alias("vec_id"), "embedding", "copy")
    model = cells.fit_cells(copies, "embedding", "vec_id", 256)
    indexed = cells.index_cells(copies, "embedding", model).cache()
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    probes = cells.calibrate_probes(indexed, model, "embedding", "vec_id", 10)
    found = cells.search_filtered(indexed, queries, model, "embedding", "vec_id", F.col("copy") == 5, k=10, probes=probes).select("query", "vec_id")
    true = vectors.nearest_each(copies.where("copy = 5"), "embedding", "vec_id", queries, "cosine", 10).select("query", "vec_id")
    assert true.join(found, ["query", "vec_id"]).count() >= 0.9 * true.count()


def test_candidates_shuffle_sequences_once_for_many_queries(spark):
    """Queries of three million bases are one block, so each sequence is shuffled once."""
    held = spark.createDataFrame([(1, "ACGTTGCAACGGTACC" * 4), (2, "GGGGTTTTGGGGTTTT")], "k long, s string")
    queries = held.where("k = 1").select(F.col("k").alias("query"), F.repeat("s", 48_000).alias("q"))
    found = sequences.align_candidates(held, "s", "k", queries, 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {spark.sparkContext.defaultParallelism})" in plan.split("hashpartitioning(block")[1].split("REPARTITION")[0]
    assert {(r["query"], r.k) for r in found.collect()} == {(1, 1)}
