"""Each operator against brute force, and over odd rows."""

import base64
import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions

from quadloom.llm import bpe, chunks, embeddings, idcoder, importance, media, ngrams, packing, sharding, simhash, substring, suffixes, tokenfiles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, size long, shard int, removed string, fp long, media string, rank int, _r int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 700} and more." for i in range(30_000))
    rows = [(1, "One line here.\nAnother  line, İΣ it's 12.", 5, 6, "a", 7, "b", 8, 9), (2, None, None, None, None, None, None, None, None), (3, "", *[None] * 7), (4, long, *[None] * 7), (None, "no key", *[None] * 7), (5, "twice", *[None] * 7), (5, "twice", *[None] * 7), (6, "twice", *[None] * 7), (7, "　 \x1c\t", *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_units_removed_as_by_hand(spark):
    shared = "Ten words stand in this one line which is shared. More of it here."
    rows = [(3, f"Own start here.\n{shared}\nOwn end."), (1, shared), (2, f"Lead. {shared.upper()} Tail."), (4, "Short one.\nShort one.")]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == shared and not got[1].removed
    assert got[2].text == "Lead.  Tail."
    assert [rows[0][1][a:b] for a, b in got[3].removed] == [shared]
    assert got[3].text == "Own start here.\n\nOwn end."
    assert got[4].text == "Short one.\nShort one."  # fewer words than a run must hold


def test_units_against_brute_force(docs, texts):
    seen, want = set(), {}
    for k in sorted(texts):
        t, own, runs, last = texts[k], set(), [], None
        for i, (a, b) in enumerate(u for u in substring.split_units(t) if t[slice(*u)].split()):
            w = tuple(t[a:b].lower().split())
            if w in seen or w in own:
                if last == i - 1 and runs:
                    runs[-1] = (runs[-1][0], b, runs[-1][2] + len(w))
                else:
                    runs.append((a, b, len(w)))
                last = i
            own.add(w)
        seen |= own
        want[k] = [(a, b) for a, b, n in runs if n >= substring.MIN_WORDS]
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in substring.remove_repeats(docs).collect()}
    assert got == want


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, most):
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_against_brute_force(docs, texts):
    fps = {k: _fingerprint(t) for k, t in texts.items()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r.fp % 2**64 for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == _components(fps, 2)


@pytest.mark.parametrize("paired", [64, 2])
@pytest.mark.parametrize("most", [1, 2])
def test_links_of_crowded_groups(spark, monkeypatch, paired, most):
    """Small groups go by pairs, crowded ones by midpoints; both keep every link."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {}
    for i in range(160):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        fps[i] = x
    rows = spark.createDataFrame([(k, v - 2**64 if v >> 63 else v) for k, v in fps.items()], "doc_id long, fp long")
    links = simhash.link_fingerprints(rows, most)
    got = simhash._labelled(rows, "fp", simhash.connected_components(links))
    assert {r.doc_id: r.component_id for r in got.collect()} == _components(fps, most)


def test_similar_documents_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    rows, families = [], 40
    for f in range(families):
        words = [word() for _ in range(300)]
        for v in range(3):
            copy = list(words)
            for _ in range(3 * v):
                copy[rng.randrange(300)] = word()
            rows.append((f * 10 + v, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c // 10 == k // 10 for k, c in got.items())  # no clean document goes
    # Three changed words of 300 leave a similarity of 0.91, six 0.82.
    assert sum(got[f * 10 + 1] == f * 10 for f in range(families)) >= 0.97 * families
    assert sum(got[f * 10 + 2] == f * 10 for f in range(families)) >= 0.95 * families


def test_large_groups_meet_their_neighbours(spark, monkeypatch):
    """Groups over the bound still take in each other and single texts, all at once or by chains."""
    monkeypatch.setattr(simhash, "LARGE", 8)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    base, rows = [word() for _ in range(300)], []
    for i in range(150):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(300)] = word()
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(c == 0 for c in got.values()) >= 149


def test_start_plan_keeps_starts_small():
    for rows in (1, 1000, 10**6, 10**9, 10**12):
        bits, starts = simhash.start_plan(rows, 0.8)
        assert rows / 2**bits <= 64 and 1 - (1 - (1 - simhash.rate(0.8)) ** bits) ** starts >= simhash.RECALL


def _family(rng, members, words, share, start):
    """Texts of ``words`` words that have a block of the first ``share`` in common; every pair has the same similarity."""
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    block = [word() for _ in range(share)]
    return [(start + i, " ".join(block + [word() for _ in range(words - share)])) for i in range(members)]


def test_families_below_the_similarity_stay(spark):
    rng = random.Random(11)
    rows = []
    for f, share in enumerate((200, 225, 243, 258)):  # of 300 words: similarities of 0.49, 0.60, 0.68 and 0.75
        rows += _family(rng, 40, 300, share, 1000 * f)
    line = "the same line is repeated here again and again "
    rows += [(5000 + i, line * 60 + t) for i, (_, t) in enumerate(_family(rng, 20, 60, 0, 0))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k, _ in rows}


def test_copies_among_strangers_that_share_text(spark):
    """Rows of a mutual similarity of 0.54 fill the starts; each copy at 0.82 is still found."""
    rng = random.Random(12)
    rows = _family(rng, 1500, 300, 212, 0)
    for i in range(60):
        words = rows[i][1].split()
        for k in rng.sample(range(300), 6):
            words[k] = f"changed{i}{k}"
        rows.append((10_000 + i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[10_000 + i] == i for i in range(60)) >= 57
    assert all(got[k] in (k, k - 10_000) for k in got)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(300, 700):  # near the threshold and nearer, in chains
        n = rng.standard_normal(24)
        x[i] = x[i - 300] + n / np.linalg.norm(n) * rng.uniform(0.05, 0.5)
    x[700:720] = x[5]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0]), (1004, [1.0, None]), (None, [1.0] * 24)]
    got = {r.vec_id: r for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    links = sum(got[i].n_links for i in range(900))
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(900)) and got[5].n_links >= 20
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (1000, 1001, 1002, 1003, 1004)) and None in got


def test_vectors_far_out_on_a_projection(spark):
    dim, rng = 64, np.random.default_rng(4)
    plane = embeddings.directions(dim)
    out = 3.2 / np.sqrt(dim)
    x = rng.standard_normal((300, dim))
    centre = rng.standard_normal(dim)
    centre -= plane[:, 0] * (centre @ plane[:, 0])
    centre = plane[:, 0] * out + centre / np.linalg.norm(centre) * np.sqrt(1 - out**2)
    x = centre + 0.31 * x / np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum() - len(u)
    rows = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    assert 0.9 * near <= sum(r.n_links for r in embeddings.similar_vectors(rows).collect()) <= near


def test_shards(docs, texts, odd, none):
    rows = sharding.shard_by_bytes(docs, 5, sample_rows=40).collect()
    sizes = collections.Counter()
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows) and len(rows) == len(texts)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == 9 and {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)} and all(0 <= r.shard < 3 for r in rows)
    assert not sharding.shard_by_bytes(none, 3).collect()


def test_streams(docs, texts, odd, none, spark):
    for n in [*range(64, 1200, 64), 70_016]:
        data = random.Random(n).randbytes(n)
        got = media.parse_stream(media.write_stream(data))
        assert got["payload"] == data and got["continuity_errors"] == 0 and all(u["random_access"] for u in got["units"])
    m = media.write_stream(bytes(100_000))
    lost = media.parse_stream(m[: 188 * 5] + m[188 * 6 :])
    assert lost["problem"] and lost["continuity_errors"] == 1
    assert media.parse_stream(m[:20] + bytes([m[20] ^ 1]) + m[21:])["problem"] and media.parse_stream(b"x")["problem"] and media.parse_stream(None)["problem"]
    for df, n in ((docs, len(texts)), (odd, 9), (none, 0)):
        rows = media.stream_digest(df).collect()
        assert len(rows) == n
    for df, rows in ((docs, texts), (odd.where("doc_id <> 5"), {r.doc_id: r.text for r in odd.where("doc_id <> 5").collect()})):
        for r in media.stream_digest(df).collect():
            raw = (rows[r.doc_id] or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            stored = media.write_stream(padded)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    columns = media.with_parsed(media.with_streams(spark.createDataFrame([(b"abc",), (None,), (b"",)], "payload binary"), "payload")).collect()
    assert [bytes(c.parsed.payload) if c.parsed.payload is not None else None for c in columns] == [b"abc", None, b""]


def test_a_foreign_stream():
    """Two programs, a table over two packets behind a pointer, stuffing, a repeated packet, a lost one."""

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        return c.to_bytes(4, "big")

    def section(table, number, body):
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
        return head + body + crc(head + body)

    def packet(pid, counter, payload, start=False, flags=0):
        room = 184 - len(payload)
        field = b"" if room == 0 else bytes([room - 1]) + (bytes([flags]) + b"\xff" * (room - 2) if room > 1 else b"")
        return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15]) + field + payload

    def tables(pid, sections, pointer=0):
        data = bytes([pointer]) + b"\xff" * pointer + sections
        parts = [data[i : i + 184] for i in range(0, len(data), 184)]
        return b"".join(packet(pid, i, p + b"\xff" * (184 - len(p)), i == 0) for i, p in enumerate(parts))

    def pes(body):
        return b"\0\0\1\xc0" + (len(body) + 3).to_bytes(2, "big") + b"\x80\0\0" + body

    long = b"\x05\xc8" + bytes(200)  # a descriptor that makes the program table span two packets
    one = section(2, 7, b"\xe1\x01\xf0\x00" + b"\x0f\xe1\x01" + (0xF000 | len(long)).to_bytes(2, "big") + long + b"\x06\xe1\x02\xf0\x00")
    two = section(2, 9, b"\xe2\x01\xf0\x00\x0f\xe2\x01\xf0\x00")
    pat = section(0, 1, b"\0\0\xe0\x10" + b"\0\x07\xe0\x20" + b"\0\x09\xe0\x30")
    a = [packet(0x101, 5, pes(b"first")[:10], True, 0x40), packet(0x101, 6, pes(b"first")[10:]), packet(0x101, 7, pes(b"second"), True)]
    stream = tables(0, pat, 3) + tables(0x20, one) + tables(0x30, two) + a[0] + packet(0x1FFF, 0, bytes(184)) + a[1] + a[1] + packet(0x102, 0, pes(b"other"), True) + a[2] + packet(0x201, 3, pes(b"far"), True)
    got = media.parse_stream(stream)
    assert (got["payload"], got["continuity_errors"], got["problem"]) == (b"firstsecond", 0, None) and [u["random_access"] for u in got["units"]] == [True, False]
    assert media.parse_stream(stream, 7, 1)["payload"] == b"other" and media.parse_stream(stream, 9)["payload"] == b"far"
    assert media.parse_stream(stream, 8)["problem"] and media.parse_stream(stream, 9, 3)["problem"]
    assert media.parse_stream(stream.replace(a[1], b"", 2))["problem"]


def test_vectors_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    x[700:] = x[:800] + 0.25 * rng.standard_normal((800, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in a], i, "x") for i, a in enumerate(x)], "vec_id long, embedding array<double>, node long, lead string")
    whole = {r.vec_id: tuple(r) for r in embeddings.similar_vectors(rows).collect()}
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 90)
    assert {r.vec_id: tuple(r) for r in embeddings.similar_vectors(rows).collect()} == whole and sum(r[1] for r in whole.values()) > 500


def test_packing(docs, texts, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 512).collect()
    ids, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = list(struct.unpack(f"<{r.length}I", r.ids))
        assert r.start == len(ids[r.doc_id]) and zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id] += part
        used[r.sequence_id].append((r.offset, r.length))
    for k, t in texts.items():
        want = library.encode(t, add_special_tokens=False).ids + [1]
        assert ids[k] == want and sum(r.doc_id == k for r in rows) == -(-len(want) // 512)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(used) <= max(-(-sum(r.length for r in rows) // 512), packing.least_bins(collections.Counter(r.length for r in rows), 512))
    assert sum(r.length for r in packing.pack_documents(odd, path, 512).collect() if r.doc_id in (2, 3)) == 2
    assert not packing.pack_documents(none, path, 512).collect()


def test_bins_hold_every_length():
    rng = random.Random(3)
    for n in (1, 7, 500):
        counts = collections.Counter(rng.randint(1, 100) for _ in range(n))
        used = collections.Counter()
        for filling, times in packing.pack_histogram(counts, 100):
            assert sum(filling) <= 100
            for x in filling:
                used[x] += times
        assert used == counts


def _fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j, held in enumerate(bins):
            if held + items[i] <= capacity and held not in bins[:j]:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_fewest_bins_of_small_sets():
    rng = random.Random(1)
    for i in range(400):
        capacity = rng.choice([20, 50, 100])
        low, high = ((1, capacity), (capacity // 6, capacity // 2))[i % 2]
        items = [rng.randint(low, high) for _ in range(rng.randint(6, 11))]
        counts = collections.Counter(items)
        fewest = _fewest_bins(items, capacity)
        assert sum(times for _, times in packing.pack_histogram(counts, capacity)) == fewest >= packing.least_bins(counts, capacity)


def test_a_dominated_filling():
    left = packing._Left({3: 1, 4: 1, 5: 1, 6: 1})
    assert left.dominated(((3, 1), (4, 1)), 3) and not left.dominated(((4, 1), (6, 1)), 0)
    assert sorted(f for w, f in left.fillings(10, 0, 100, False)) == [((6, 1), (4, 1))]
    assert left.counts == {3: 1, 4: 1, 5: 1, 6: 1}


@pytest.mark.parametrize("counts", [{1: 100_000}, {1: 50_000}, {4: 20_000}, {n: 20_000 for n in range(2, 15)}, {1: 9_000, 2: 7_000, 3: 5_000, 8: 4_000}, {1: 30_000, 4: 3_000, 700: 40, 3_000: 9}])
def test_short_pieces_fill_their_bins(counts):
    bins = packing.pack_histogram(counts, 4096)
    used = collections.Counter()
    for filling, times in bins:
        assert sum(filling) <= 4096
        for x in filling:
            used[x] += times
    assert used == counts
    assert sum(times for _, times in bins) == -(-sum(x * n for x, n in counts.items()) // 4096)


def test_suffixes_against_brute_force(spark, docs, texts):
    for length, rows in ((200, texts), (24, {1: "abcdefgh" * 9 + "é" * 40, 2: "xx" + "abcdefgh" * 4, 3: None, 4: "", 5: "abcdefgh" * 4, 6: "\0" * 60})):
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        data = {k: (t or "").encode() for k, t in rows.items()}
        count = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
        got = {r.doc_id: r for r in suffixes.remove_repeated_strings(df, length).collect()}
        for k, b in data.items():
            covered = np.zeros(len(b), bool)
            for i in range(len(b) - length + 1):
                if count[b[i : i + length]] > 1:
                    covered[i : i + length] = True
            assert bytes(got[k].kept) == bytes(np.frombuffer(b, np.uint8)[~covered]), k
            assert got[k].n_spans == (np.diff(covered.astype(int), prepend=0) == 1).sum() and got[k].n_removed == covered.sum()


def test_suffixes_take_little_room(spark, monkeypatch, tmp_path):
    """What is dealt by anchors are few bytes a start that may repeat, also where a text repeats itself; groups of many and of few anchors give the same."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    common = " ".join(rng.choice(words) for _ in range(200))
    rows = [(i, " ".join(rng.choice(words) for _ in range(300)) + common + " ".join(rng.choice(words) for _ in range(300))) for i in range(30)] + [(40, "a" * 9000), (41, "-+" * 3000), (42, "a" * 150 + "b" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = {k: sum(any(count[t[j : j + 200]] > 1 for j in range(max(0, i - 199), min(i + 1, len(t) - 199))) for i in range(len(t))) for k, t in rows}
    for many in (1 << 15, 50):
        monkeypatch.setattr(suffixes, "SORTED", many)
        assert {r.doc_id: r.n_removed for r in suffixes.repeated_string_digest(df).collect()} == want
    keyed, distinct = suffixes._keyed(df, "text", "doc_id")
    dealt = suffixes._pieces(keyed, distinct, 200).selectExpr("sum(octet_length(bytes)) AS b").first().b
    live = sum(n for n in count.values() if n > 1)
    assert dealt < 6 * live


def test_suffixes_of_repeated_rows_and_long_regions(spark, monkeypatch):
    """Rows of one key and text lose it; regions cut short and a hash without bits change nothing."""
    monkeypatch.setattr(suffixes, "REGION", 300)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    one, two, tail = text(489), text(2500), text(700)
    rows = [(1, one), (1, one), (2, two + tail), (3, text(90) + two), (4, tail), (5, text(800)), (6, "ab" * 600)]
    got = suffixes.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    data = [t.encode() for _, t in rows]
    count = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for (k, _), b in zip(rows, data):
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                covered[i : i + 200] = True
        want.append((k, len(b), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~covered])))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_id_coder_round_trips():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [65_535] * 5000, [idcoder.MOST_IDS - 1] * 300, rng.integers(0, idcoder.MOST_IDS, 9000), rng.integers(0, 65_536, 9000), np.tile(rng.integers(0, 50_000, 300), 40), rng.zipf(1.3, 9000) % 50_257):
        for block in (64, 4096):
            assert (idcoder.decode_ids(idcoder.encode_ids(ids, block)) == np.asarray(ids)).all()
    chunk = bytearray(idcoder.encode_ids(np.arange(9000) % 977))
    chunk[-40] ^= 1
    with pytest.raises(ValueError, match="block 2"):
        idcoder.decode_ids(bytes(chunk))
    with pytest.raises(ValueError, match="not a chunk"):
        idcoder.decode_ids(b"")
    repeated = np.tile(rng.integers(0, 50_000, 300), 40)
    assert len(idcoder.encode_ids(repeated)) < len(repeated)


def test_id_coder_mixes_the_orders():
    """An id that two orders foresee is likelier than one that either foresees; intervals tile the range in id order."""
    model = idcoder._Model(1, 8)
    for i in [7, 900, 12, 7, 900, 12, 7, 900, 40, 7, 900]:
        model.predict(1)
        model.interval(np.array([i]))
        model.learn(np.array([i]))
    model.predict(1)
    at = 0
    for i in range(1 << 16):
        start, width = model.interval(np.array([i]))
        assert width[0] > 0 and start[0] >= at
        at = start[0] + width[0]
        if i in (0, 12, 40, 41, 65_535):
            for v in (start[0], at - 1):
                found, s, w = model.find(np.array([v]))
                assert (found[0], s[0], w[0]) == (i, start[0], width[0])
    assert at <= idcoder._TOTAL


def test_token_files(spark, docs, texts, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in tokenfiles.token_file_digest(docs, path, str(tmp_path / "a")).collect()}
    at = 0
    for k in sorted(texts):
        want = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    got = tokenfiles.token_file_digest(odd, path, str(tmp_path / "b")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7] and [r.n_tokens for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert not tokenfiles.token_file_digest(none, path, str(tmp_path / "c")).collect()


def _tiktoken():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay(docs, texts, odd, none):
    path, library = public_tokenizers.path("byte_bpe_50k.tiktoken"), _tiktoken()
    for df, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.collect()]), (none, [])):
        want = []
        for k, t in rows:
            ids = np.array(library.encode_ordinary(t or ""), "<u4")
            want.append((k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.round_trip_digest(df, path, public_tokenizers.PATTERN).collect())


def test_chunked_encoders_agree_with_the_libraries():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = ["a", "b ", "  ", "\n", "\t", "'s", "é", "1", "!", "\x1c", "²", "　", " x", "\n ", "中", "́", "İ", ",", ".", "_", ". ", "Σ", "ΑΣ", ", ", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for name, encoder in (("byte_bpe_50k", chunks.byte_bpe), ("word_bpe_49k", chunks.word_bpe)):
        library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        library.encode_special_tokens = True
        ids, count = encoder(public_tokenizers.path(f"{name}.json"))(texts)
        ends = np.cumsum(count)
        for t, e, n in zip(texts, ends, count, strict=True):
            assert ids[e - n : e].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ngrams():
    texts = [b"", b"one", b"one two", b"two  one\n", b"x" * 1000 + b" one", b"\x01"]
    h, n = ngrams.word_hashes(texts)
    assert n.tolist() == [0, 1, 2, 2, 2, 0] and h[0] == h[1] == h[4] == h[6] and h[2] == h[3] and len(set(h.tolist())) == 3
    assert ngrams.ngram_buckets(texts, 16)[1].tolist() == [0, 1, 3, 3, 3, 0]


def test_importance_resampling(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    scores, keep = importance.resample(docs, fit)
    rows = {r.doc_id: r for r in scores.collect()}
    kept = {k for k, r in rows.items() if r.kept}
    assert {r.doc_id for r in keep(docs).collect()} == kept and keep(docs).columns == docs.columns
    assert min(rows[k].gumbel_key for k in kept) > max(r.gumbel_key for k, r in rows.items() if k not in kept)
    good = [r.doc_id in kept for r in held.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in held.where("quality = 0").collect()]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    few, _ = importance.resample(docs, fit, k=10)
    assert few.where("kept").count() == 10
    text = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    model = importance.fit(docs, fit)
    for i, t in enumerate(text):
        assert abs(rows[i].log_weight - model.ratio[ngrams.ngram_buckets([t.encode()], importance.BUCKET_BITS)[0]].sum()) < 1e-6
    plain = {r.doc_id for r in scores.orderBy(scores.log_weight.desc()).limit(len(kept)).collect()}
    other = {r.doc_id for r in importance.resample(docs, fit, k=len(kept), seed=21)[0].where("kept").collect()}
    assert kept != plain and len(kept - other) > 5  # the noise samples


def test_importance_models_by_hand(spark):
    """Both models' counts and a text's weight, from words and pairs counted one by one."""
    rows = [(1, "good plain words here"), (2, "good plain words there"), (3, "bad junk words"), (4, "junk junk junk"), (5, None), (6, "good plain junk")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = importance.fit(df, labels)
    held = {r._key for r in model.labelled.where("_held").collect()}
    size, bits = 1 << importance.BUCKET_BITS, importance.BUCKET_BITS
    raw, target = collections.Counter(), collections.Counter()
    grams = {}
    for k, t in rows:
        words = (t or "").split()
        grams[k] = [int(ngrams.ngram_buckets([w.encode()], bits)[0][0]) for w in words] + [int(ngrams.ngram_buckets([f"{a} {b}".encode()], bits)[0][2]) for a, b in zip(words, words[1:])]
        raw.update(grams[k])
        if k in (1, 2) and k not in held:
            target.update(grams[k])
    if not target:
        assert model.ratio is None
        return
    p_raw = {b: (raw[b] + 1) / (sum(raw.values()) + size) for b in raw}
    p_target = {b: (target[b] + importance.SMOOTHING * size * p_raw[b]) / (sum(target.values()) + importance.SMOOTHING * size) for b in raw}
    got = {r.doc_id: r.log_weight for r in importance.resample(df, labels, k=3)[0].collect()}
    for k, own in grams.items():
        assert abs(got[k] - sum(np.log(p_target[b] / p_raw[b]) for b in own)) < 1e-9


def test_importance_at_the_end(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fit = spark.read.parquet(f"{SF}/labels.parquet")
    assert not importance.resample(none, fit)[0].collect()
    assert importance.resample(docs, fit.limit(0))[0].where("kept").count() == docs.count()


def test_odd_rows_pass_every_operator(odd, none, spark):
    assert len(substring.remove_repeats(odd).collect()) == 9 and set(substring.remove_repeats(odd).columns) == set(odd.columns)
    assert {r.doc_id: r.text for r in substring.remove_repeats(odd).collect()}[2] is None
    for f in (simhash.near_duplicates, simhash.similar_documents):
        groups = [r.component_id for r in f(odd).collect()]
        assert len(groups) == 9 and not f(none).collect()
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(5, 5), (6, 5), (2, 2), (3, 2)} <= got
    removed = suffixes.repeated_string_digest(odd).collect()
    assert len(removed) == 9 and next(r for r in removed if r.doc_id == 4).n_removed > 0
    assert not suffixes.repeated_string_digest(none).collect() and not substring.remove_repeats(none).collect()
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (1, 0)], "doc_id long, quality int")
    assert importance.resample(odd, labels)[0].count() == 9
    assert not embeddings.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    """Null and repeated ids, null texts: the near-dedup stage drops a document only for an earlier one like it."""
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i % 700}" for i in range(3000))
    rows = [(1, long), (1, long + " more"), (None, long), (2, None), (3, ""), (4, "own words here that nothing else has"), (5, long + " end"), (None, None), (6, long.upper())]
    docs = spark.createDataFrame([(k, t, None, None, len(t) if t else None) for k, t in rows], columns)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "2", "4", "None", "None"]  # 3 is as empty as 2; 5 and 6 are like 1
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.count() <= table.count()
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.select("doc_id", "piece").count() >= len(rows) and not corpus_pipeline.packing(spark, docs.limit(0), SF).collect()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            docs = docs.cache()
            assert 0.5 * before < docs.count() <= before
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_large_groups_are_linked_by_one_pair(spark):
    """Two groups of over ``LARGE`` members, whose one link lies between one member of each."""
    a = [f"word{i}" for i in range(300)]
    b = [f"other{i}" if i % 37 == 20 else w for i, w in enumerate(a)]
    copy = lambda own, i: [f"new{i}" if j == 2 * i + 7 else w for j, w in enumerate(own)]
    bridges = [[*a[:20], b[20], *a[21:]], [*b[:57], a[57], *b[58:]]]
    texts = [*[copy(a, i) for i in range(140)], bridges[0], *[copy(b, i) for i in range(140)], bridges[1]]
    sets = [{" ".join(t[i : i + 5]) for i in range(296)} for t in texts]
    assert [(i, j) for i in range(141) for j in range(141, 282) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] == [(140, 281)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_documents(rows).collect()} == {0}


def test_parities_lose_no_link(spark):
    """Pairs of sets from 0.7 to 0.9: what reaches the similarity holds, exactly at it too; most of what does not is left out."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        n, odd = (9, 1) if i < 100 else (int(rng.integers(40, 200)), int(rng.integers(1, 30)))
        both, own, far = np.split(rng.integers(0, 2**64, n + odd, np.uint64), [n - (n == 9), n + (odd - 1) // 2])
        x, y = (np.unique(np.concatenate([both, z])) for z in (own, far))
        common = len(np.intersect1d(x, y))
        rows.append((common, len(x) + len(y) - common, len(x), *simhash._parities(x).tolist(), len(y), *simhash._parities(y).tolist()))
    names = ["common", "all_", *[p + c for p in ("a_", "b_") for c in ("n", *simhash._O)]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    got = df.withColumn("fine", simhash._parities_hold(0.8, lambda c: functions.col(f"a_{c}"), lambda c: functions.col(f"b_{c}"))).collect()
    assert all(r.fine for r in got if r.common >= 0.8 * r.all_) and any(r.common == 0.8 * r.all_ for r in got)
    assert sum(not r.fine for r in got if r.common < 0.75 * r.all_) >= 0.9 * sum(r.common < 0.75 * r.all_ for r in got)
