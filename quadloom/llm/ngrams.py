"""Hashed word n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIERS = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of every white-space delimited word of all texts, words of each text). Only bytes up to 32 delimit."""
    data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = data > 32
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = end - start
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    chars = data[inside].astype(np.uint64) + np.uint64(1)
    values = (chars + (place >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * _MULTIPLIERS[place & 255]
    h = mix(np.add.reduceat(values ^ (values >> np.uint64(29)), ends - size) + size.astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(lengths + 1)
    return h, np.diff(np.searchsorted(start, bounds), prepend=0)


def ngram_buckets(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words and word pairs, n-grams of each text); pairs do not cross texts."""
    h, count = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[1:] == doc[:-1]] if len(h) else h
    where = np.concatenate([doc, doc[:-1][doc[1:] == doc[:-1]]])
    order = np.argsort(where, kind="stable")
    buckets = (np.concatenate([h, pair]) >> np.uint64(64 - bits)).astype(np.int64)[order]
    return buckets, np.bincount(where, minlength=len(texts))
