"""Nucleotide sequences: k-mers, reverse complements, substring search, MinHash sketches and LSH."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ranking import rank_within

# The complements of the IUPAC nucleotide codes.
_CODES, _COMPLEMENTS = "atucgnrykmswbvdh", "taagcnyrmkswvbhd"

SKETCH_K, BANDS, ROWS = 14, 8, 4


def reverse_complement(s: Column) -> Column:
    """In lower case; U is read as T."""
    return F.translate(F.reverse(F.lower(s)), _CODES, _COMPLEMENTS)


def clean(s: Column) -> Column:
    """White space out, upper case."""
    return F.upper(F.regexp_replace(s, r"\s+", ""))


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
#: Bases of a text that are cut into k-mers at once.
_SECTION = 1 << 20
#: Bases of the queries and of the sequences that meet in one task, and pairs that are marked at once. Sequences are shuffled once for each block of queries, of which a task holds about 60 bytes a base.
_BLOCK, _PART, _CELLS = 1 << 23, 1 << 24, 1 << 22
#: Diagonals that are counted together: those of the band of a banded alignment.
DIAGONALS = 13


def _base_codes() -> np.ndarray:
    """Two-bit codes of the bases by byte, 4 for what is ambiguous."""
    table = np.full(256, 4, np.uint8)
    for i, pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
        for c in pair:
            table[ord(c)] = i
    return table


def packed_kmers(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, reverse complement, whether no base is ambiguous) of every window of ``k`` (at most 32) base codes, as 2k-bit words."""
    n = max(len(code) - k + 1, 0)
    f, r = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        c = code[j : j + n].astype(np.uint64) & np.uint64(3)
        f = f << np.uint64(2) | c
        r |= (np.uint64(3) - c) << np.uint64(2 * j)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    return f, r, bad[k : k + n] == bad[:n]


def _spelled(words: np.ndarray, k: int) -> pa.Array:
    """Packed k-mers as text."""
    letters = np.stack([_LETTERS[(words >> np.uint64(2 * (k - 1 - j)) & np.uint64(3)).astype(np.int64)] for j in range(k)], 1)
    offsets = np.arange(0, k * (len(words) + 1), k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def kmers(df: DataFrame, seq: str, key: str, k: int = 8) -> DataFrame:
    """(key, kmer, position, strand): the canonical k-mer of each window without an ambiguous base; U counts as T; positions from 0; k at most 32."""
    if not 0 < k <= 32:
        raise ValueError("k must be 1 to 32")
    kind = df.schema[key].dataType

    def cut_up(batches):
        table = _base_codes()
        for batch in batches:
            for i, t in enumerate(batch.column("_t").to_pylist()):
                code = table[np.frombuffer("".join((t or "").split()).encode("ascii", "replace"), np.uint8)]
                for at in range(0, max(len(code) - k + 1, 0), _SECTION):
                    f, r, fine = packed_kmers(code[at : at + _SECTION + k - 1], k)
                    where = np.flatnonzero(fine)
                    f, r = f[where], r[where]
                    strand = pa.array(f <= r).cast(pa.int8()).take(pa.array(np.arange(len(f))))
                    keys = batch.column(key).take(pa.array(np.full(len(f), i, np.int64)))
                    yield pa.RecordBatch.from_arrays([keys, _spelled(np.minimum(f, r), k), pa.array((where + at).astype(np.int32)), strand], names=[key, "kmer", "position", "plus"])

    rows = df.select(F.col(key), F.col(seq).cast("string").alias("_t")).mapInArrow(cut_up, f"`{key}` {kind.simpleString()}, kmer string, position int, plus tinyint")
    return rows.select(key, "kmer", "position", F.when(F.col("plus") == 1, "+").otherwise("-").alias("strand"))


def kmer_counts(df: DataFrame, seq: str, k: int = 8) -> DataFrame:
    """(kmer, n, plus): how often each canonical k-mer occurs, and how often forward. A batch sends on a row a k-mer it holds."""

    def count(batches):
        table = _base_codes()
        for batch in batches:
            found = []
            for t in batch.column("_t").to_pylist():
                code = table[np.frombuffer("".join((t or "").split()).encode("ascii", "replace"), np.uint8)]
                f, r, fine = packed_kmers(code, k)
                f, r = f[fine], r[fine]
                found.append(np.stack([np.minimum(f, r), (f <= r).astype(np.uint64)], 1))
                if sum(map(len, found)) > 4 * _SECTION:
                    yield total(found)
                    found = []
            if found:
                yield total(found)

    def total(found):
        both = np.concatenate(found)
        words, at = np.unique(both[:, 0], return_inverse=True)
        n, plus = np.bincount(at, minlength=len(words)), np.bincount(at, weights=both[:, 1].astype(float), minlength=len(words)).astype(np.int64)
        return pa.RecordBatch.from_arrays([_spelled(words, k), pa.array(n.astype(np.int64)), pa.array(plus)], names=["kmer", "n", "plus"])

    rows = df.select(F.col(seq).cast("string").alias("_t")).mapInArrow(count, "kmer string, n long, plus long")
    return rows.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("plus").alias("plus"))


def _append(length: int):
    """Adds the start of the next match to those so far, given the text between."""

    def add(starts: Column, between: Column) -> Column:
        last = F.when(F.size(starts) > 0, F.element_at(F.when(F.size(starts) > 0, starts), -1) + length).otherwise(0)
        return F.concat(starts, F.array((last + F.length(between)).cast("int")))

    return add


def substring_hits(df: DataFrame, seq: str, key: str, pattern: str, forward_only: bool = False) -> DataFrame:
    """(key, start, end, strand): matches that do not overlap within a strand, by literal upper-case text; a pattern that is its own reverse complement counts once."""
    p = "".join(pattern.split()).upper()
    back = p[::-1].translate(str.maketrans(_CODES.upper(), _COMPLEMENTS.upper()))
    rows = df.select(F.col(key), clean(F.col(seq)).alias("_t"))
    found = []
    for text, strand in [(p, "+")] + ([] if forward_only or back == p else [(back, "-")]):
        if not text:
            continue
        split = F.split("_t", text)
        pieces = F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))  # what lies before each match
        run = F.aggregate(pieces, F.array().cast("array<int>"), _append(len(text)))
        hits = rows.where(F.contains("_t", F.lit(text))).select(key, F.explode(run).alias("start"))
        found.append(hits.select(key, "start", (F.col("start") + len(text)).alias("end"), F.lit(strand).alias("strand")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _splitmix(x: np.ndarray) -> np.ndarray:
    # Fixed values of the published SplitMix64 generator.
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(seq: Column, k: int = SKETCH_K, slots: int = BANDS * ROWS) -> Column:
    """MinHash signature (array of longs holding unsigned words) of a sequence's canonical k-mers; null if it has none."""

    @F.pandas_udf("array<long>")
    def signature(texts: pd.Series) -> pd.Series:
        table, steps, out = _base_codes(), np.arange(slots, dtype=np.uint64), []
        for t in texts:
            code = table[np.frombuffer("".join((t or "").split()).encode("ascii", "replace"), np.uint8)]
            f, r, fine = packed_kmers(code, k)
            km = np.unique(np.minimum(f, r)[fine])
            if not len(km):
                out.append(None)
                continue
            a, b = _splitmix(km), _splitmix(km ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
            least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(km), 4096):
                np.minimum(least, (a[at : at + 4096, None] + steps * b[at : at + 4096, None]).min(axis=0), out=least)
            out.append(least.view(np.int64).tolist())
        return pd.Series(out, dtype=object)

    return signature(seq)


def jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(df: DataFrame, sig: str, key: str) -> DataFrame:
    """(key, band): a fold of each run of ``ROWS`` slots, seeded by the band's number."""

    @F.pandas_udf("array<long>")
    def fold(signatures: pd.Series) -> pd.Series:
        if not len(signatures):
            return pd.Series([], dtype=object)
        slots = np.stack(signatures.to_list()).astype(np.int64).view(np.uint64).reshape(len(signatures), BANDS, ROWS)
        acc = np.broadcast_to(_splitmix(np.arange(BANDS, dtype=np.uint64) ^ np.uint64(0x243F6A8885A308D3)), (len(signatures), BANDS))  # a fixed seed
        for j in range(ROWS):
            acc = _splitmix(acc ^ slots[:, :, j])
        return pd.Series(acc.view(np.int64).tolist())

    return df.where(F.col(sig).isNotNull()).select(key, F.explode(fold(F.col(sig))).alias("band"))


def lsh_candidates(banded: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """(query, key): others that share a band with a query (a table of bands of few keys)."""
    q = query.select(F.col(key).alias("query"), "band")
    return q.join(banded, "band").where(F.col("query") != F.col(key)).select("query", key).distinct()


def batch_hits(df: DataFrame, seq: str, key: str, patterns: dict[str, str], forward_only: bool = False) -> DataFrame:
    """(pattern, key, start, end, strand): the hits of several patterns by name, in one pass: a text is cleaned once and meets every pattern and reverse complement that it holds. Empty patterns hit nothing."""
    wanted = []
    for n, pattern in patterns.items():
        p = "".join(pattern.split()).upper()
        back = p[::-1].translate(str.maketrans(_CODES.upper(), _COMPLEMENTS.upper()))
        wanted += [(n, p, "+")] + ([] if forward_only or back == p else [(n, back, "-")]) if p else []
    rows = df.select(F.col(key), clean(F.col(seq)).alias("_t"))
    struct = "array<struct<pattern:string,text:string,strand:string>>"
    held = F.filter(F.from_json(F.lit(json.dumps([dict(zip(("pattern", "text", "strand"), w, strict=True)) for w in wanted])), struct), lambda w: F.contains("_t", w["text"]))
    met = rows.select(key, "_t", F.explode(held).alias("w"))
    split = F.split("_t", F.concat(F.lit("\\Q"), F.col("w.text"), F.lit("\\E")))
    pieces = F.slice(split, F.lit(1), F.greatest(F.size(split) - 1, F.lit(0)))  # what lies before each match
    size = F.length("w.text")
    run = F.aggregate(pieces, F.array().cast("array<int>"), lambda starts, between: F.concat(starts, F.array((F.when(F.size(starts) > 0, F.element_at(F.when(F.size(starts) > 0, starts), -1) + size).otherwise(0) + F.length(between)).cast("int"))))
    hits = met.select("w.pattern", key, F.explode(run).alias("start"), size.alias("_n"), "w.strand")
    return hits.select("pattern", key, "start", (F.col("start") + F.col("_n")).alias("end"), "strand")


def align_candidates(stored: DataFrame, seq: str, key: str, queries: DataFrame, k: int = 8, in_band: float | None = None, shortest: float = 0.0) -> DataFrame:
    """(query, key): sequences of ``stored`` that share a canonical k-mer with a query (query, q); a query too short for one gets every sequence. k at most 32.

    Queries and sequences are dealt into blocks of bounded size, and each block of queries meets
    each of sequences in one task, which streams the sequences past the queries' k-mers. So a
    pair is found once, whatever it shares, and what is shuffled are texts, not pairs: each text
    once for every block of the other side.

    With ``in_band`` a pair must share that many k-mers a base of the query, one at least, on one
    strand and within ``2 * DIAGONALS`` neighbouring diagonals, so that any ``DIAGONALS`` of them lie
    within such a run, and the sequence must have ``shortest`` times the query's bases; queries too
    short for a k-mer get none.
    """
    spark = stored.sparkSession
    one = lambda rows, c, t: rows.select(F.col(c), clean(F.coalesce(F.col(t).cast("string"), F.lit(""))).alias("t")).groupBy(c).agg(F.concat_ws("-", F.collect_list("t")).alias("t"), F.bool_or(F.length("t") < k).alias("short"))  # noqa: E731  (rows of one key: no k-mer goes over the "-")
    asked, held = cut(one(queries, "query", "q")), cut(one(stored, key, seq))
    bases = lambda rows: rows.agg(F.coalesce(F.sum(F.length("t") + 32), F.lit(0))).first()[0]
    blocks, parts = -(-bases(asked) // _BLOCK) or 1, max(-(-bases(held) // _PART), spark.sparkContext.defaultParallelism)
    of = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.lit("block")), F.lit(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    kinds = {c: rows.schema[c].dataType for c, rows in (("query", asked), (key, held))}
    left = asked.select(of("query", blocks).alias("block"), over(parts).alias("part"), F.lit(0).alias("side"), "query", F.lit(None).cast(kinds[key]).alias("_key"), "t", "short")
    right = held.select(over(blocks).alias("block"), of(key, parts).alias("part"), F.lit(1).alias("side"), F.lit(None).cast(kinds["query"]).alias("query"), F.col(key).alias("_key"), "t", "short")
    met = left.union(right).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "side")

    def cut_up(texts):
        table, found, owner = _base_codes(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            f, r, fine = packed_kmers(table[np.frombuffer(t.encode("ascii", "replace"), np.uint8)], k)
            own = np.unique(np.minimum(f, r)[fine])
            found.append(own)
            owner.append(np.full(len(own), i, np.int64))
        return np.concatenate(found), np.concatenate(owner)

    def meet(batches):
        now, waiting, index = None, [], None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in ("block", "part", "side")], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if now != tuple(place[lo, :2]):
                    now, waiting, index = tuple(place[lo, :2]), [], None
                run = batch.slice(lo, hi - lo)
                if place[lo, 2] == 0:
                    waiting.append(run)
                    continue
                if not waiting:
                    continue
                if index is None and in_band is not None:
                    rows = pa.Table.from_batches(waiting).combine_chunks()
                    index = rows.column("query"), *sorted_places(rows.column("t").to_pylist())
                if index is None:
                    rows = pa.Table.from_batches(waiting).combine_chunks()
                    words, owner = cut_up(rows.column("t").to_pylist())
                    order = np.argsort(words, kind="stable")
                    held_words, first = np.unique(words[order], return_index=True)
                    index = rows.column("query"), np.flatnonzero(np.asarray(rows.column("short"))), held_words, np.append(first, len(words)), owner[order]
                yield from (pairs_of if in_band is None else pairs_in_band)(run, *index)

    def places(texts):
        """(word, text, place, whether forward) of every k-mer."""
        table, found = _base_codes(), [[np.zeros(0, x) for x in (np.uint64, np.int64, np.int64, bool)]]
        for i, t in enumerate(texts):
            f, r, fine = packed_kmers(table[np.frombuffer(t.encode("ascii", "replace"), np.uint8)], k)
            at = np.flatnonzero(fine)
            found.append([np.minimum(f, r)[at], np.full(len(at), i, np.int64), at, (f <= r)[at]])
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def sorted_places(texts):
        words, owner, at, forward = places(texts)
        order = np.argsort(words, kind="stable")
        held_words, first = np.unique(words[order], return_index=True)
        return np.array([len(t) for t in texts], np.int64), held_words, np.append(first, len(words)), owner[order], at[order], forward[order]

    def pairs_in_band(run, names, size, words, first, owner, at, forward):
        texts = run.column("t").to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        edges = sorted({0, len(texts), *np.searchsorted(ends, np.arange(_SECTION, ends[-1], _SECTION)).tolist()})
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own, who, place, plus = places(texts[lo:hi])
            if not len(words) or not len(own):
                continue
            where = np.searchsorted(words, own)
            hit = np.flatnonzero(words[np.minimum(where, len(words) - 1)] == own)
            n = first[where[hit] + 1] - first[where[hit]]
            bins = (int(size.max()) + max(map(len, texts[lo:hi]))) // DIAGONALS + 3
            cuts = [0, *np.searchsorted(np.cumsum(n), np.arange(_CELLS, n.sum(), _CELLS)).tolist(), len(hit)]
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                each, begun = n[x:y], first[where[hit[x:y]]]
                last = np.cumsum(each)
                if not len(last):
                    continue
                e = np.arange(last[-1]) + np.repeat(begun - (last - each), each)
                h, q = np.repeat(hit[x:y], each), owner[e]
                same = plus[h] == forward[e]
                shift = place[h] - np.where(same, at[e], size[q] - k - at[e]) + int(size.max())
                new, m = np.unique(((who[h] * len(names) + q) * 2 + same) * bins + shift // DIAGONALS, return_counts=True)
                both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                keys, counts = both, np.bincount(back, weights=np.concatenate([counts, m]), minlength=len(both)).astype(np.int64)
            total = counts.copy()
            total[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
            pair = keys // (2 * bins)
            pair = np.unique(pair[total >= np.maximum(1, in_band * size[pair % len(names)])])
            pair = pair[np.array([len(t) for t in texts[lo:hi]])[pair // len(names)] >= shortest * size[pair % len(names)]]
            q = names.take(pa.array(pair % len(names)))
            yield pa.RecordBatch.from_arrays([q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q, run.column("_key").take(pa.array(pair // len(names) + lo))], names=["query", key])

    def pairs_of(run, names, short, words, first, owner):
        step = max(1, _CELLS // len(names))
        for at in range(0, run.num_rows, step):
            rows = run.slice(at, step)
            mark = np.zeros((rows.num_rows, len(names)), bool)
            own, who = cut_up(rows.column("t").to_pylist())
            where = np.searchsorted(words, own)
            hit = np.flatnonzero(words[np.minimum(where, len(words) - 1)] == own) if len(words) else np.zeros(0, np.int64)
            n = first[where[hit] + 1] - first[where[hit]]
            cuts = [0, *np.searchsorted(np.cumsum(n), np.arange(_SECTION, n.sum(), _SECTION)).tolist(), len(hit)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                size, begun = n[x:y], first[where[hit[x:y]]]
                ends = np.cumsum(size)
                if len(ends):
                    mark[np.repeat(who[hit[x:y]], size), owner[np.arange(ends[-1]) + np.repeat(begun - (ends - size), size)]] = True
            mark[:, short] = True
            i, j = np.nonzero(mark)
            for x in range(0, len(i), _SECTION):
                q = names.take(pa.array(j[x : x + _SECTION])).combine_chunks()
                yield pa.RecordBatch.from_arrays([q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q, rows.column("_key").take(pa.array(i[x : x + _SECTION]))], names=["query", key])

    return met.mapInArrow(meet, f"query {kinds['query'].simpleString()}, `{key}` {kinds[key].simpleString()}")


def exact_matches(hits: DataFrame, ranks: DataFrame, key: str, allowed: DataFrame | None = None, most: int = 50) -> DataFrame:
    """(key, identity, rank): each sequence with a hit once, at identity 1, by rank, then key; ``ranks`` is (key, rank), 1 where it has none; ``allowed`` holds the keys that may be seen."""
    rows = hits.select(key).distinct().withColumn("identity", F.lit(1.0))
    return _by_rank(rows, ranks, key, allowed, most)


def _by_rank(rows: DataFrame, ranks: DataFrame, key: str, allowed: DataFrame | None, most: int) -> DataFrame:
    if allowed is not None:
        rows = rows.join(allowed.select(key).distinct(), key, "left_semi")
    rows = rows.join(ranks.select(key, "rank"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(1.0)))
    return rows.orderBy(F.desc(F.col("rank") * F.col("identity")), F.asc(key)).limit(most)


def similar(clusters: DataFrame, ranks: DataFrame, key: str, target, allowed: DataFrame | None = None) -> DataFrame:
    """(key, rank): the other members of the cluster of ``target``, by rank, then key. ``clusters`` is (key, cluster)."""
    own = clusters.where(F.col(key) == target).select("cluster").distinct()
    mates = clusters.join(own, "cluster", "left_semi").where(F.col(key) != target).select(key)
    if allowed is not None:
        mates = mates.join(allowed.select(key).distinct(), key, "left_semi")
    return mates.join(ranks.select(key, "rank"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(1.0))).orderBy(F.desc("rank"), F.asc(key))


def assign_clusters(new: DataFrame, clusters: DataFrame, alike: DataFrame, key: str) -> DataFrame:
    """(key, cluster): clusters (longs) of new sequences (key): the least key among the indexed neighbours of ``alike`` (key, other) that passed alignment gives its cluster; the rest open clusters past the largest in use, in key order."""
    top = clusters.agg(F.coalesce(F.max("cluster"), F.lit(-1)).alias("_top"))
    near = alike.join(clusters.select(F.col(key).alias("other"), "cluster"), "other").groupBy(key).agg(F.min_by("cluster", "other").alias("cluster"))
    known = new.select(key).distinct().join(near, key, "left")
    alone = known.where("cluster is null").select(key)
    numbered = rank_within(alone.withColumn("_all", F.lit(0)), ["_all"], [key], "_n").join(top).select(key, (F.col("_top") + 1 + F.col("_n")).alias("cluster"))
    return known.where("cluster is not null").select(key, "cluster").union(numbered)


def write_kmer_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores (key, kmer, position, strand) by a hash of the k-mer, sorted by it, so that a search reads one bucket a k-mer. A bucket of many postings, as of a common k-mer, is several tasks and files."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("kmer"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "kmer").write.partitionBy("bucket").parquet(path)


def indexed_hits(index: DataFrame, df: DataFrame, seq: str, key: str, pattern: str, k: int = 8, buckets: int = 64, forward_only: bool = False) -> DataFrame:
    """The hits of ``substring_hits``, by a stored index: only texts that hold the first k-mer of the pattern or of its reverse complement are searched. No hits if neither is unambiguous."""
    p = "".join(pattern.split()).upper()
    back = p[::-1].translate(str.maketrans(_CODES.upper(), _COMPLEMENTS.upper()))
    table = _base_codes()
    seeds = []
    for text in [p] + ([] if forward_only else [back]):
        code = table[np.frombuffer(text[:k].encode(), np.uint8)]
        if len(code) == k:
            f, r, fine = packed_kmers(code, k)
            if fine.all():
                seeds.append(_spelled(np.minimum(f, r), k)[0].as_py())
    spark = df.sparkSession
    wanted = spark.createDataFrame([(x,) for x in sorted(set(seeds))], "kmer string").withColumn("bucket", F.pmod(F.xxhash64("kmer"), F.lit(buckets)).cast("int"))
    near = index.join(F.broadcast(wanted), ["bucket", "kmer"], "left_semi").select(key).distinct()  # two k-mers at most
    return substring_hits(df.join(near, key, "left_semi"), seq, key, pattern, forward_only)
