"""Findings of round 3: results against brute force, and that what is shuffled or planned stays bounded."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from quadloom.operators import sequences


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_candidates_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "_BLOCK", 300)  # several blocks of queries
    letters = lambda i, n: "".join("ACGT"[(i * 7 + j * j * (i % 5 + 1) + j // 3) % 4] for j in range(n))
    rows = [(i, letters(i, 5 + i % 40)) for i in range(120)] + [(200, None), (201, ""), (202, "acgu acgu nnn"), (7, "TTTTTTTTTTTT"), (None, "ACGTACGTACGT")]
    stored = spark.createDataFrame(rows, "id long, s string")
    queries = stored.where("id % 10 = 7 OR id IN (201, 202)").select(F.col("id").alias("query"), F.col("s").alias("q"))

    def cut(s, k=6):
        s = "".join((s or "").split()).upper().replace("U", "T")
        words = [s[i : i + k] for i in range(len(s) - k + 1)]
        return {min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in words if set(w) <= set("ACGT")}

    wanted = set()
    for q, t in [(r.query, r.q) for r in queries.collect()]:
        short = len("".join((t or "").split())) < 6
        wanted |= {(q, i) for i, s in rows if short or cut(t) & cut(s)}
    found = sequences.align_candidates(stored, "s", "id", queries, 6)
    assert plan_of(found).count("Exchange") == 1  # of texts, not of pairs
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_exists_greater_as_pairs(spark):
    from quadloom.operators import patterns

    a = spark.createDataFrame([("n1", "a1", 1.0), ("n1", "a2", 9.0), ("n2", "a3", -5.0), ("n3", "a4", 0.0), ("n1", "a5", None), ("n1", "a6", float("nan")), (None, "a7", 0.0)], "n string, s string, x double")
    b = spark.createDataFrame([("n1", 5.0), ("n1", 2.0), ("n1", None), ("n2", None), ("n2", float("nan"))], "n string, y double")
    for negate in (False, True):
        pairs = patterns.exists(a, b, negate, ~F.isnan("b.y") & ~F.isnan("a.x") & (F.col("b.y") > F.col("a.x") + 1))
        found = patterns.exists_greater(a, b, F.col("x") + 1, F.col("y"), negate)
        assert found.columns == a.columns
        assert sorted(r.s for r in found.collect()) == sorted(r.s for r in pairs.collect())
    assert [r.s for r in patterns.exists_greater(a, b, F.col("x") + 1, F.col("y")).collect()] == ["a1"]


def test_pages_in_one_pass_as_by_cursors(spark, tmp_path):
    from quadloom.operators import cursors

    rows = [(None if i % 11 == 0 else f"g{i % 3}", i, "x") for i in range(137)]
    path, order = str(tmp_path / "pages"), ["g", "i"]
    cursors.write_ranged(spark.createDataFrame(rows, "g string, i long, v string").repartition(3), path, order, 5)
    walked, at, n = {}, None, 0
    while n == 0 or at is not None:
        page, at = cursors.page(spark, path, order, at, 20)
        walked |= {r.i: n for r in page.collect()}
        n += 1
    found = cursors.pages(spark, path, order, 20)
    assert {r.i: r.page for r in found.collect()} == walked and found.count() == 137
    many = cursors.pages(spark, path, order, 1)
    assert plan_of(many).count("Scan parquet") == 2 and {r.i: r.page for r in many.collect()} == {i: n for n, i in enumerate(sorted(walked, key=lambda i: (rows[i][0] or "", i)))}
    empty = str(tmp_path / "none")
    cursors.write_ranged(spark.createDataFrame([], "g string, i long, v string"), empty, order)
    assert cursors.pages(spark, empty, order, 20).collect() == []


def test_postings_of_a_common_kmer_are_several_files(spark, tmp_path):
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df = spark.range(4000).select("id", F.lit("A" * 60).alias("s")).repartition(8)
    path = str(tmp_path / "kmers")
    spark.conf.set(setting, "32KB")
    try:
        sequences.write_kmer_index(sequences.kmers(df, "s", "id", 4), path)
    finally:
        spark.conf.unset(setting)
    index = spark.read.parquet(path)
    assert index.count() == 4000 * 57 and index.select("bucket").distinct().count() == 1
    assert len(index.inputFiles()) > 1
    assert sequences.indexed_hits(index, df, "s", "id", "aaaa", 4).select("id").distinct().count() == 4000


def test_index_blocks_meet_as_one(spark, tmp_path, monkeypatch):
    from quadloom.operators import postings

    word = lambda i: f"wo{'abcdefgh'[i % 8] * (i % 4 + 1)}{i % 7}"
    docs = spark.createDataFrame([(f"s{i % 70}", f"{word(i)} {word(i * 3)} common", f"r{word(i // 2)}", "g", float(i % 5), ["t"]) for i in range(90)], "subject string, text string, role string, g string, rank double, types array<string>")
    path = str(tmp_path / "index")
    postings.write_text_index(docs.dropDuplicates(["subject"]), path, boosts={"text": 1.0, "role": 3.0})
    asked = spark.createDataFrame([(i, f"{word(i)} comon") for i in range(9)] + [(None, "common"), (50, ""), (51, "nothing alike")], "query int, q string")
    answers = lambda: (sorted(map(tuple, postings.count(spark, path, asked).collect()), key=str), sorted(map(str, postings.search(spark, path, asked, limit=4, offset=1).drop("types").collect())), sorted(map(str, postings.search(spark, path, asked, limit=3, pool=8).drop("types").collect())))
    once = answers()
    every = postings.matching(spark, path, asked)
    assert sorted(map(tuple, every.groupBy("query").count().collect()), key=str) == once[0] and dict(once[0])[None] == 70
    assert plan_of(every).count("Exchange") == 1  # of words and postings, not of what a query hits
    monkeypatch.setattr(postings, "ASKED", 5)
    monkeypatch.setattr(postings, "POSTED", 20)
    assert answers() == once


def test_alignment_of_what_lies_within(monkeypatch):
    from quadloom.operators import alignment

    tables = []
    plain = alignment._align
    monkeypatch.setattr(alignment, "_align", lambda q, t: tables.append(1) or plain(q, t))
    codes = lambda s: alignment._BASES[__import__("numpy").frombuffer(s.encode(), "uint8")]
    back = lambda s: s[::-1].translate(str.maketrans("acgt", "tgca"))
    t = "acgtacgtaaaaaccgttgacgtacgtaagg"
    for q in ("acgtacgtaa", "aaaa", t, back(t), back("ccgttgac"), "acguacgu"):
        score, identity, cigar = max((plain(codes(x), codes(t)) for x in (q, back(q.replace("u", "t")))), key=lambda r: r[0])
        got = alignment.align_pair(q, t)
        assert (got[3], got[0], got[2]) == (score, identity, cigar)
    assert not tables  # none needs the recurrence
    assert alignment.align_pair("acgn", "acgn" * 6)[0] < 1 and tables
