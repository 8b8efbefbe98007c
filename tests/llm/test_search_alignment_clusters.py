"""Exact top-k, cross-tokenizer alignment and centroid clustering against brute force, and over odd rows."""

import collections
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quadloom.llm import balltree, centroids, crosstokens, quantised, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "vec_id long, embedding array<double>, rank int, score string, q string, dim int, shard int, cluster int"


def whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else tuple(math.floor(scale * x) for x in v)


def odd_vectors(dim, n=300, wide=False):
    rng = random.Random(dim)
    near = lambda: [rng.gauss(0, 1) for _ in range(dim)]
    rows = [(i, near()) for i in range(n)]
    hot = near()
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(1000, hot), (1000, near()), (None, near()), (2000, None), (2001, []), (2002, [1.0] * (dim - 1)), (2003, [None] + [1.0] * (dim - 1)), (2004, [float("nan")] + [1.0] * (dim - 1)), (2005, [float("inf")] + [1.0] * (dim - 1)), (2100, [0.0] * dim)]
    if wide:
        rows += [(3000 + i, [x * 10.0**p for x in near()]) for i, p in enumerate((3, 6, 9, 12, 15, 20, 30))]
    return [(k, v, 1, "s", "q", 2, 3, 4) for k, v in rows]


def brute_top(rows, every, k, scale):
    fine = [(r[0], whole(r[1], scale)) for r in rows if r[0] is not None and whole(r[1], scale) is not None]
    out = {}
    for key, q in fine:
        if key % every == 0:
            out.setdefault(key, set()).update((-max(min(sum(a * b for a, b in zip(q, v, strict=True)), 2**63 - 1), -(2**63)), other) for other, v in fine if other != key and len(v) == len(q))
    return {(key, i + 1, other, -s) for key, found in out.items() for i, (s, other) in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("wide", [False, True])
def test_top_k_as_brute_force(spark, monkeypatch, wide):
    rows = odd_vectors(5, wide=wide)
    monkeypatch.setattr(balltree, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(balltree.build_tree, "__defaults__", (7,))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = df.where("vec_id % 20 = 0").select("vec_id", "embedding").toDF("query_id", "q")
    index = balltree.build_index(df, 1024, k=10, shard_rows=50)
    assert index.count() > 8  # more waves than one
    got = [tuple(r) for r in balltree.search_index(index, asked, 10, 1024, block=3).collect()]
    if wide:  # scores beyond 64 bits are shown as the nearest long, so ties of those go by the true score
        want = brute_top(rows, 20, 10, 1024)
        assert len(got) == len(want) and {g for g in got if abs(g[3]) < 2**63 - 1} <= {(q, r, v, s) for q, r, v, s in want}
        assert collections.Counter((g[0], g[1], g[3]) for g in got) == collections.Counter((w[0], w[1], w[3]) for w in want)
    else:
        assert len(got) == len(set(got)) and set(got) == brute_top(rows, 20, 10, 1024)


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.unique(np.floor(1024 * (rng.standard_normal((20, 6))[rng.integers(0, 20, 3000)] * 5 + 0.1 * rng.standard_normal((3000, 6)))), axis=0)
    tree = balltree.build_tree(x, 32)
    row = {n: v.tobytes() if n == "centres" else v for n, v in tree.items()} | {"dim": 6, "vectors": x.tobytes(), "kind": "f8", "copies": [1] * len(x), "ids": list(range(len(x)))}
    shard = balltree.Shard(row)
    q = x[:50]
    high = shard.bounds(q)
    assert sorted(tree["order"].tolist()) == list(range(len(x)))
    for node in range(len(tree["first"])):
        inside = q @ x[tree["order"][tree["first"][node] : tree["last"][node]]].T
        assert (inside <= high[:, [node]]).all()
    best = shard.search([-1] * len(q), q, [None] * len(q), 5)
    kth = np.array([-b[-1][0] for b in best])
    leaves = tree["left"] < 0
    assert (high[:, leaves] < kth[:, None]).mean() > 0.5  # most leaves need no look
    assert all(b == sorted((-int(s), i) for i, s in enumerate(x @ row_q))[:5] for b, row_q in zip(best, q, strict=True))


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert balltree.top_inner_products(none).collect() == []
    few = spark.createDataFrame(odd_vectors(3)[:4], SCHEMA)
    assert {tuple(r) for r in balltree.top_inner_products(few, every=1).collect()} == brute_top(odd_vectors(3)[:4], 1, 10, 1024)


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op13_centroid_clustering"])
def test_vector_queries_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())


def brute_clusters(rows, k, rounds, scale, dim, seed):
    kept = [(r[0], whole(r[1], scale)) for r in rows if r[1] is not None and len(r[1]) == dim and whole(r[1], scale) is not None]
    name = lambda key: (1, "") if key is None else (0, hashlib.sha256(f"{seed}:{key}".encode()).hexdigest())
    c = [list(v) for _, v in sorted(kept, key=lambda r: name(r[0]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == i]
            if own:
                c[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    placed = [(key, *near(v)[::-1]) for key, v in kept]
    top = lambda n: min(n, 2**63 - 1)
    sums = collections.Counter()
    for _, i, d in placed:
        sums[i] += top(d)
    return collections.Counter((key, i, top(d), top(sums[i]), top(sum(sums.values())), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest()) for key, i, d in placed)


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_as_brute_force(spark, wide):
    rows = [r for r in odd_vectors(6, wide=wide) if r[0] != 1000]  # one row a key, as equal keys tie
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, k=7, rounds=3, scale=256, dim=6)
    assert collections.Counter(tuple(r) for r in got.drop("centroid").collect()) == brute_clusters(rows, 7, 3, 256, 6, 2)


def test_clusters_of_few_and_none(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, [1.5], 1, "", "", 1, 1, 1), (7, [1.5], 1, "", "", 1, 1, 1), (None, [-0.3], 1, "", "", 1, 1, 1)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=5, dim=1, scale=10)
    assert sorted((r.vec_id or 0, r.cluster, r.distance, r.inertia) for r in got.collect()) == [(0, 2, 0, 0), (7, 0, 0, 0), (7, 0, 0, 0)]


def test_quantised_rows():
    column = pa.array([[0.5, -0.5], None, [1.0, None], [1e300, 1.0], [], [float("nan"), 1.0]], pa.list_(pa.float64()))
    assert [(n, rows.tolist(), x.tolist()) for n, rows, x in quantised.whole_parts(column, 3)] == [(0, [4], [[]]), (2, [0, 3], [[1.0, -2.0], [3e300, 3.0]])]
    x = np.array([[1.0, -32768.0], [2.0**60, 3.0]])
    assert (quantised.unpack(pa.array(quantised.pack(x), pa.binary()), 2) == x).all()


def brute_alignment(texts):
    """Per text None, or its ids of both sides, links and groups, by whole-text tokenizing and two pointers."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in shown)}
    out = []
    for t in texts:
        a, b = first.encode(f" {t or ''}", add_special_tokens=False).ids, second.encode(t or "")
        left = [bytes(shown[c] for c in first.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not t or b"".join(left) != f" {t}".encode() or b"".join(right) != f" {t}".encode():
            out.append(None)
            continue
        i = j = x = y = 0
        links, groups, held = [], [], ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            u, v = x + len(left[i]), y + len(right[j])
            if u <= v:
                held[0].append(str(a[i]))
                i, x = i + 1, u
            if v <= u:
                held[1].append(str(b[j]))
                j, y = j + 1, v
            if u == v:
                groups.append("|".join(map(",".join, held)))
                held = ([], [])
        out.append((len(a), len(b), links, groups))
    return out


def brute_rows(rows):
    """The result rows of (key, text) rows."""
    found = brute_alignment([t for _, t in rows])
    count = collections.Counter(p for f in found if f for p in f[2])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = collections.Counter()
    for (key, _), f in zip(rows, found, strict=True):
        if not f:
            out[key, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_a, n_b, links, groups = f
        out[key, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


ODD = ["", None, "m². of", "a▁b", " lead", "\nline", "trail ", "  two  ", "x\n\n y", "<s> <|endoftext|> <0x41>", "日本語😀 É é", "it's, ok. 'll.", "\0 a\0b", "ﬁ Ａ　b", ",start", ".a,b.c , d", "_a, b_. c", " ", "\t", "twice", "twice"]


def test_alignment_as_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = docs + [(10_000 + i // 2, t) for i, t in enumerate(ODD)] + [(None, "no key, twice")] * 2 + [(9, " ".join(f"word{i % 700}, more." for i in range(30_000)))] + [(20_000 + i, "one hot line, the same.") for i in range(200)]
    df = spark.createDataFrame([(k, t, 1, 2, "x", 3) for k, t in rows], "doc_id long, text string, slice int, bucket int, pair string, n int").repartition(3)
    monkeypatch.setattr(crosstokens, "SLICE_BYTES", 40_000)
    monkeypatch.setattr(crosstokens, "TASK_BYTES", 20_000)
    monkeypatch.setattr(crosstokens, "_HELD", 500)
    got = collections.Counter(tuple(r) for r in crosstokens.align_corpus(df, A, B).collect())
    assert got == brute_rows(rows)


def test_alignment_of_nothing(spark):
    assert crosstokens.align_corpus(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    got = crosstokens.align_corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_forgetting_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(crosstokens, "MOST_CHUNKS", 40)
    aligner = crosstokens.Aligner(A, B)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "deltoid", f"n{rng.randrange(200)}"]) for _ in range(60)) for _ in range(30)]
    for i in range(0, 30, 5):
        counts, shown, pairs = aligner(texts[i : i + 5])
        at = 0
        for c, g, want in zip(counts.tolist(), shown, brute_alignment(texts[i : i + 5]), strict=True):
            assert c == [want[0], want[1], len(want[3]), len(want[2])] and g == ";".join(want[3])
            assert [(int(p) & (1 << 21) - 1, int(p) >> 21) for p in pairs[at : at + c[3]]] == want[2]
            at += c[3]
