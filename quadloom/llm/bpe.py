"""Byte-level BPE by merge replay over the distinct words of a task's slice of the corpus.

All words new to a task are laid out end to end, one token a byte. An inverted index leads from a
rank to the positions whose pair has that rank. The lowest pending rank is taken for all words at
once: its pairs are merged, leftmost first in a word, and only the neighbours that a merge touches
get new index entries. A merge may bring a lower rank up; it is then taken next, as it would be in
each word alone.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, slices, spaced_chunks, spread

SCHEMA = "doc_id long, ids binary, decoded binary"


class Ranks:
    """A rank file: token bytes by rank, and the rank of every pair of tokens that joins to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.base = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair joins to, or -1; a token of -1 joins with nothing."""
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where((self.pair[at] == want) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.start[ids], self.length[ids])].tobytes()


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, each word's start, its number of ids)."""
    whole = np.array([ranks.rank.get(w, -1) for w in words], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    word = np.repeat(np.arange(len(words)), size)
    token = np.append(ranks.base[data], -1)
    after = np.arange(1, n + 2)
    prior = np.arange(-1, n)
    first = np.zeros(n + 1, bool)
    first[np.cumsum(size) - size] = True  # starts of words (and the end); no pair crosses one
    alive = np.ones(n + 1, bool)
    alive[n] = False
    index: dict[int, list[np.ndarray]] = {}
    due: list[int] = []

    def post(at: np.ndarray) -> None:
        """Puts the pairs that start at ``at`` into the index."""
        right = after[at]
        fine = (right < n) & ~first[np.minimum(right, n)]
        at, right = at[fine], right[fine]
        rank = ranks.of_pairs(token[at], token[right])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.diff(rank)) + 1
        for part, r in zip(np.split(at, edges), rank[np.concatenate([[0], edges])].tolist() if len(rank) else [], strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(due, r)
            index[r].append(part)

    post(np.flatnonzero((whole < 0)[word]) if n else np.zeros(0, np.int64))
    while due:
        r = heapq.heappop(due)
        at = np.unique(np.concatenate(index.pop(r)))
        at = at[alive[at]]
        right = after[at]
        fine = (right < n) & ~first[np.minimum(right, n)]
        at, right = at[fine], right[fine]
        fine = ranks.of_pairs(token[at], token[right]) == r
        at, right = at[fine], right[fine]
        if not len(at):
            continue
        lead = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])  # leftmost of its word; the rest wait
        if not lead.all():
            index[r] = [at[~lead]]
            heapq.heappush(due, r)
            at, right = at[lead], right[lead]
        token[at] = r
        alive[right] = False
        beyond = after[right]
        after[at] = beyond
        prior[np.minimum(beyond, n)] = at
        left = prior[at]
        post(np.concatenate([at, left[(left >= 0) & ~first[at]]]))
    heads = np.cumsum(size) - size
    known = np.flatnonzero(whole >= 0)
    alive[spread(heads[known] + 1, size[known] - 1)] = False
    token[heads[known]] = whole[known]
    kept = np.flatnonzero(alive)
    count = np.bincount(word[kept], minlength=len(words))
    return token[kept], np.cumsum(count) - count, count


@functools.lru_cache(2)
def rank_encoder(path: str, pattern: str) -> tuple[Ranks, ChunkEncoder]:
    """The encoder of one rank file and splitting pattern, kept by a worker between tasks."""
    ranks, split = Ranks(path), regex.compile(pattern)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [split.findall(c) for c in chunks]
        vocabulary: dict[str, int] = {}
        for words in found:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        ids, start, count = replay(ranks, [w.encode() for w in vocabulary])
        at = np.fromiter((vocabulary[w] for words in found for w in words), np.int64)
        own = np.bincount(np.repeat(np.arange(len(found)), [len(w) for w in found]), weights=count[at], minlength=len(found)).astype(np.int64) if len(at) else np.zeros(len(found), np.int64)
        return ids[spread(start[at], count[at])], np.cumsum(own) - own, own

    return ranks, ChunkEncoder(spaced_chunks, encode, np.int64)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes got back from the ids).

    Every match of ``pattern`` is merged by itself and characters outside the matches are left
    out, as the rank file's library does; a match that is a token stays whole. No shuffle: each
    task replays the merges over the words new to it. A null text is empty; a null or repeated
    key keeps its row; other columns are not read. Empty table: no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoder = rank_encoder(path, pattern)
        for batch in batches:
            for piece, texts in slices(batch, "text", 6_000_000):
                ids, count = encoder(texts)
                out = np.split(ids, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in out], pa.binary()), pa.array([ranks.decode(x) for x in out], pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, SCHEMA)


def round_trip_digest(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_round_trip(df, path, pattern, text, key).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Ranks", "bpe_round_trip", "rank_encoder", "replay", "round_trip_digest"]
