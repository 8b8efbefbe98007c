"""Alignment of two tokenizers' tokens over the same bytes, with counts of linked id pairs over the whole corpus.

A text and the space before it are cut where neither vocabulary can hold a token across, and most
of these chunks repeat: each is tokenized by both and aligned once, as numbers. A document's links
are those of its chunks. Its distinct id pairs with their multiplicities are postings; they are
dealt by the id of side B, meet the corpus's counts of their pairs, and send back what they
contribute to their document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path
from .chunks import MOST_CHUNKS, byte_bpe, byte_letters, slices, spaced_chunks, spread

#: Bytes of text and rows whose postings are stored together.
SLICE_BYTES, SLICE_ROWS = 8_000_000, 50_000
#: Groups of side B's ids, a power of two, and the bytes of postings that one task should meet.
BUCKETS, TASK_BYTES = 16, 32_000_000
#: Bits of an id in a packed pair, and of a row's place in a slice; with a bucket's they fill a 64-bit integer.
_BITS, _ROW_BITS = 21, 16
#: Distinct pairs counted in a task before it sends its counts on.
_HELD = 4_000_000

SLICES = "slice long, bucket int, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs binary, totals binary, rows binary, docs binary, times binary"
_ARROW = pa.schema(
    [("slice", pa.int64()), ("bucket", pa.int32())]
    + [(c, pa.list_(pa.int64())) for c in ("keys", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("pairs", "totals", "rows", "docs", "times")]
)


class _Side:
    """The bytes of a vocabulary's tokens, and an encoder of chunks: ids of all, each chunk's start and size."""

    def __init__(self, tokens: list[bytes], encode):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.encode = encode

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def data(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.start[ids], self.size[ids])]


@functools.lru_cache(2)
def byte_side(path: str) -> _Side:
    """The byte-level side (A), from a ``tokenizers`` file; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    library, letters = Tokenizer.from_file(path), {chr(byte_letters().get(b, b)): b for b in range(256)}
    names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
    tokens = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
    encode = byte_bpe(path).encode

    def ordered(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, start, size = encode(chunks)
        return flat[spread(start, size)].astype(np.int64), size

    return _Side(tokens, ordered)


@functools.lru_cache(2)
def piece_side(path: str) -> tuple[_Side, list[str]]:
    """The piece side (B), from a ``sentencepiece`` file, and the strings across which a chunk's border would cut a piece."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    tokens = [bytes([int(t[3:5], 16)]) if library.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
    crossing = [t.replace("▁", " ") for t in names if re.search(r"[^\W_][.,]|[^▁]▁", t)]
    lead = library.encode("\n")  # the space of its own, and a line's end, which no piece joins with more
    joined = [t for t in names if "\n" in t and len(t) > 1]

    def ordered(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = library.encode(["\n" + c for c in chunks], num_threads=1)
        assert not joined and all(f[: len(lead)] == lead for f in found)
        size = np.array([len(f) for f in found], np.int64) - len(lead)
        flat = np.fromiter(chain.from_iterable(f[len(lead) :] for f in found), np.int64, int(size.sum()))
        return flat, size

    return _Side(tokens, ordered), crossing


def split(text: str, crossing: list[str]) -> list[str]:
    """Chunks of the space and the text that follows it."""
    if any(c in text for c in crossing):
        return [" " + text]
    if text[0] == " ":
        return spaced_chunks(" " + text)
    first, *rest = spaced_chunks(text)
    return [" " + first, *rest]


class Aligner:
    """Aligns texts through a dictionary of their chunks."""

    def __init__(self, a: str, b: str):
        self.a = byte_side(a)
        self.b, self.crossing = piece_side(b)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.fine = np.zeros(0, bool)
        self.start = self.used = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the half most used of the chunks at most, all of them used again since they came."""
        least = max(2, int(np.median(self.used)))
        kept = np.flatnonzero(self.used > least)
        names, size = list(self.known), self.counts[kept, 3]
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.pairs = self.pairs[spread(self.start[kept], size)]
        self.counts, self.fine, self.used = self.counts[kept], self.fine[kept], self.used[kept] >> 1
        self.start = np.cumsum(size) - size

    def _learn(self, chunks: list[str]) -> None:
        """Tokenizes and aligns chunks that are new.

        Between two neighbouring ends, of either side, lies one token of each: those are the links,
        one for each overlapping pair, as the overlap of a pair holds no end inside.
        """
        data = [c.encode() for c in chunks]
        size = np.array([len(d) for d in data], np.int64)
        whole = np.frombuffer(b"".join(data), np.uint8)
        sides, fine = [], np.ones(len(chunks), bool)
        for side in (self.a, self.b):
            ids, count = side.encode(chunks)
            owner = np.repeat(np.arange(len(chunks)), count)
            held = np.bincount(owner, weights=side.size[ids], minlength=len(chunks)).astype(np.int64)
            same = held == size
            kept = same[owner]
            differs = side.data(ids[kept]) != whole[spread((np.cumsum(size) - size)[same], size[same])]
            at = np.repeat(np.flatnonzero(same), size[same])
            same[at[differs]] = False
            fine &= same
            sides.append((ids, count, owner))
        parts = []
        for side, (ids, count, owner) in zip((self.a, self.b), sides, strict=True):
            kept = fine[owner]
            parts.append((ids[kept], np.where(fine, count, 0), owner[kept], side.ends(ids[kept])))
        (ids_a, n_a, _, ends_a), (ids_b, n_b, owner_b, ends_b) = parts
        ends = np.union1d(ends_a, ends_b)
        pairs = ids_b[np.searchsorted(ends_b, ends)] << _BITS | ids_a[np.searchsorted(ends_a, ends)]
        common = np.isin(ends_b, ends_a, assume_unique=True)
        n_groups = np.bincount(owner_b[common], minlength=len(chunks))
        n_links = n_a + n_b - n_groups
        # Where groups end among the tokens of each side.
        last_b = np.flatnonzero(common) + 1
        last_a = np.searchsorted(ends_a, ends_b[common]) + 1
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        text, i, j = [], 0, 0
        for k, m in zip(last_a.tolist(), last_b.tolist(), strict=True):
            left = names_a[i] if k == i + 1 else ",".join(names_a[i:k])
            text.append(left + "|" + (names_b[j] if m == j + 1 else ",".join(names_b[j:m])))
            i, j = k, m
        stop = np.cumsum(n_groups).tolist()
        self.groups += [text[e - n] if n == 1 else ";".join(text[e - n : e]) for n, e in zip(n_groups.tolist(), stop, strict=True)]
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.fine = np.concatenate([self.fine, fine])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(n_a, n_b, n_groups, n_links of each text, its groups as text, the packed pair of every link of all texts in order)."""
        if len(self.known) > MOST_CHUNKS:
            self._forget()
        parts = [split(t, self.crossing) if t else [] for t in texts]
        coded = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.known
        new = [x for x in names if x not in known]
        if new:
            self._learn(new)
        own = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        where = coded.indices.to_numpy()
        self.used[own] += np.bincount(where, minlength=len(names))
        at = own[where]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        good = np.bincount(owner[~self.fine[at]], minlength=len(texts)) == 0
        kept = good[owner]
        at, owner = at[kept], owner[kept]
        counts = np.zeros((len(texts), 4), np.int64)
        held = np.cumsum(np.bincount(owner, minlength=len(texts)))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[at], axis=0)])
        begin = np.concatenate([[0], held[:-1]]) if len(held) else held
        counts += sums[held] - sums[begin]
        text, groups = at.tolist(), self.groups
        shown = [";".join([groups[i] for i in text[a:b]]) for a, b in zip(begin.tolist(), held.tolist(), strict=True)]
        return counts, shown, self.pairs[spread(self.start[at], self.counts[at, 3])]


@functools.lru_cache(2)
def _aligner(a: str, b: str) -> Aligner:
    """One a worker, kept between tasks."""
    return Aligner(a, b)


def _packed(x: np.ndarray, kind: str) -> bytes:
    return pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray | pa.Array, i: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(column[i].as_py(), n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _posted(number: int, keys: list, counts: np.ndarray, groups: list[str], pairs: np.ndarray) -> Iterator[dict]:
    """Rows of a slice: one with what its documents have of their own, and one of postings for each bucket that they reach, sorted by pair and then document."""
    owner = np.repeat(np.arange(len(keys)), counts[:, 3])
    placed = np.sort((((pairs >> _BITS) & (BUCKETS - 1)) << 2 * _BITS | pairs) << _ROW_BITS | owner)
    new = np.ones(len(placed), bool)
    new[1:] = placed[1:] != placed[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(placed)))
    pairs, owner = (placed[at] >> _ROW_BITS) & ((1 << 2 * _BITS) - 1), placed[at] & ((1 << _ROW_BITS) - 1)
    bucket = (pairs >> _BITS) & (BUCKETS - 1)
    edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    named = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T, strict=True))
    yield {"slice": number, "bucket": -1, "keys": keys, **named, "groups": digests}
    for b in range(BUCKETS):
        p, d, t = (x[edges[b] : edges[b + 1]] for x in (pairs, owner, times))
        if not len(p):
            continue
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        blobs = {"pairs": _packed(np.diff(p[head], prepend=0), "<i8"), "totals": _packed(np.add.reduceat(t, head), "<i8"), "rows": _packed(np.diff(np.append(head, len(p))), "<u4"), "docs": _packed(d, "<u2"), "times": _packed(t, "<u4")}
        yield {"slice": number, "bucket": b, "keys": [len(head), len(p)], **blobs}


def align_corpus(df: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a`` is a byte-level ``tokenizers`` file, given a space and the text; ``b`` a ``sentencepiece``
    file, given the text. Where tokens of both end, groups end; overlapping tokens are links. An id
    pair's count is the number of links that hold it in the whole table; n_best counts a row's
    links whose count is the highest of their B id, ties included, and count_sum adds up counts.

    Postings are packed by slice of the table and bucket of B ids, and stored once in the shared
    folder, which fixes the slices whatever is lost later. Counts of pairs are summed before they
    are shuffled and are bounded by the vocabularies. A bucket's counts and then its postings come
    to a task as one sorted stream, which Spark spills; a task holds the counts of a bucket and a
    slice's postings. Buckets with more bytes than a task should meet are dealt over more tasks,
    each with the counts, so no id, however common, is one task's.

    Texts that are null or empty, or that a vocabulary doesn't hold byte by byte, have zeros and
    the digest ''. Rows of one key, and null keys, stay rows of their own. Other columns are not read.
    """
    spark, limit = df.sparkSession, (1 << _BITS) - 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        if max(len(aligner.a.size), len(aligner.b.size)) > limit:
            raise ValueError(f"vocabularies hold {limit} ids at most")
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = rows = 0

        def stored() -> Iterator[pa.RecordBatch]:
            keys, counts, groups, pairs = zip(*held, strict=True)
            for row in _posted(number, [k for part in keys for k in part], np.concatenate(counts), [g for part in groups for g in part], np.concatenate(pairs)):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for piece, texts in slices(batch.slice(at, SLICE_ROWS), "text"):
                    if held and rows + piece.num_rows > SLICE_ROWS:
                        yield from stored()
                        held, size, rows, number = [], 0, 0, number + 1
                    held.append((piece.column("key").to_pylist(), *aligner(texts)))
                    size, rows = size + sum(len(t) for t in texts if t), rows + piece.num_rows
                    if size >= SLICE_BYTES:
                        yield from stored()
                        held, size, rows, number = [], 0, 0, number + 1
        if held:
            yield from stored()

    path = fresh_path(spark, "postings")
    df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(post, SLICES).write.option("compression", "uncompressed").parquet(path)
    posted = spark.read.schema(SLICES).parquet(path)
    postings = posted.where("bucket >= 0").select("slice", "bucket", "keys", "pairs", "rows", "docs", "times")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            p, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(p, kind="stable")
            p, n = p[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            return p[head], np.add.reduceat(n, head)

        def sent() -> pa.RecordBatch:
            p, n = held[0] if len(held) == 1 else merged()
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("keys")[i].as_py()[0]
                held.append((np.cumsum(_unpacked(batch.column("pairs"), i, "<i8", n)), _unpacked(batch.column("totals"), i, "<i8", n)))
                if sum(len(p) for p, _ in held) > 2 * _HELD:
                    held = [merged()]
                    if len(held[0][0]) > _HELD:
                        yield sent()
                        held = []
        if held:
            yield sent()

    id_b = F.shiftright("pair", _BITS)
    counts = posted.where("bucket >= 0").select("keys", "pairs", "totals").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(id_b))  # a B id has as many rows as A has ids, at most
    counts = counts.select("pair", "n", (F.col("n") == highest).alias("best"), id_b.bitwiseAND(BUCKETS - 1).cast("int").alias("bucket"))
    weights = posted.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.octet_length("docs") + F.octet_length("times") + F.octet_length("rows")).alias("bytes")).collect()
    parts = {r.bucket: max(1, -(-r.bytes // TASK_BYTES)) for r in weights}
    if not parts:
        parts = {0: 1}
    shares = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("bucket"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("pairs", "rows", "docs", "times")]
    left = counts.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1)).alias("part"), F.lit(0).alias("kind"), "pair", "n", "best", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("array<long>").alias("keys"), *none)
    right = postings.select("bucket", F.pmod(F.xxhash64("slice"), shares.cast("long")).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), "slice", "keys", "pairs", "rows", "docs", "times")
    stream = left.unionByName(right).repartition(sum(parts.values()), "bucket", "part").sortWithinPartitions("bucket", "part", "kind", "pair", "slice")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs, ns, bests, table = None, [], [], [], None
        for batch in batches:
            group = np.array(batch.column("bucket")).astype(np.int64) << 32 | np.array(batch.column("part"))
            kind = np.array(batch.column("kind"))
            edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1)])) if batch.num_rows else []
            for at, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if kind[at] == 0:
                    if group[at] != own or table is not None:
                        own, pairs, ns, bests, table = group[at], [], [], [], None
                    run = batch.slice(at, end - at)
                    pairs.append(np.array(run.column("pair")))
                    ns.append(np.array(run.column("n")))
                    bests.append(run.column("best").to_numpy(zero_copy_only=False).astype(bool))
                    continue
                if table is None:
                    table = (np.concatenate(pairs), np.concatenate(ns), np.concatenate(bests))
                distinct, rows = batch.column("keys")[at].as_py()
                found = np.searchsorted(table[0], np.cumsum(_unpacked(batch.column("pairs"), at, "<i8", distinct)))
                spans = _unpacked(batch.column("rows"), at, "<u4", distinct)
                n, best = np.repeat(table[1][found], spans), np.repeat(table[2][found], spans)
                docs, times = _unpacked(batch.column("docs"), at, "<u2", rows), _unpacked(batch.column("times"), at, "<u4", rows).astype(np.int64)
                held = np.unique(docs)
                place = np.searchsorted(held, docs)
                total, good = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                np.add.at(total, place, n * times)
                np.add.at(good, place, times * best)
                yield pa.RecordBatch.from_pylist([{"slice": batch.column("slice")[at].as_py(), "docs": held.astype("<u2").tobytes(), "sums": total.tobytes(), "bests": good.tobytes()}], schema=sums_schema)

    sums_schema = pa.schema([("slice", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("bests", pa.binary())])
    sums = stream.mapInArrow(contribute, "slice long, docs binary, sums binary, bests binary")
    of_rows = posted.where("bucket < 0").select("slice", "keys", "n_a", "n_b", "n_groups", "n_links", "groups")

    def finish(rows: pa.Table, added: pa.Table) -> pa.Table:
        """A slice's documents with the sums of what its buckets sent, at most ``BUCKETS`` rows."""
        row = rows.to_pylist()[0]
        total, good = np.zeros(len(row["keys"]), np.int64), np.zeros(len(row["keys"]), np.int64)
        for r in added.to_pylist():
            docs = np.frombuffer(r["docs"], "<u2")
            total[docs] += np.frombuffer(r["sums"], np.int64)
            good[docs] += np.frombuffer(r["bests"], np.int64)
        return pa.table({"doc_id": pa.array(row["keys"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": good, "count_sum": total, "groups_sha256": pa.array(row["groups"], pa.string())})

    return of_rows.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
