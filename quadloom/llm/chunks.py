"""Tokenizing whole texts through a dictionary of their space-delimited chunks.

Both vocabularies used here split a text before they merge, and never let a token cross a space
that follows a visible character. Tokens of a text are then the tokens of its chunks, and most
chunks of a corpus repeat: each is encoded once and looked up afterwards.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks kept before a task starts its dictionary anew.
MOST_CHUNKS = 350_000
#: Characters of text in hand at once.
SLICE_CHARS = 2_000_000


class ChunkEncoder:
    """Encodes texts given ``split`` (text to chunks) and ``encode`` (chunks to the ids of all, each chunk's start and size)."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple], dtype=np.uint32):
        self.split, self.encode, self.dtype = split, encode, dtype
        self.known: dict[str, int] = {}
        self.used = self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype)

    def _forget(self) -> None:
        """Keeps the chunks that were met again since they came, the half most used of them at most."""
        least = max(2, int(np.median(self.used[self.used > 1])) if (self.used > 1).any() else 2)
        kept = np.flatnonzero(self.used > least)
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        size = self.size[kept]
        self.ids = self.ids[spread(self.start[kept], size)]
        self.start, self.size, self.used = np.cumsum(size) - size, size, self.used[kept] >> 1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each text); a null text has none."""
        if len(self.known) > MOST_CHUNKS:
            self._forget()
        parts = [self.split(t) if t else [] for t in texts]
        coded = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.known
        new = [x for x in names if x not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            flat, start, size = self.encode(new)
            self.start = np.concatenate([self.start, len(self.ids) + start])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, flat])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        own = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        where = coded.indices.to_numpy()
        self.used[own] += np.bincount(where, minlength=len(names))
        at = own[where]
        size = self.size[at]
        ids = self.ids[spread(self.start[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        chunk_ends = np.cumsum([0, *map(len, parts)])
        return ids, np.diff(ends[chunk_ends])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then the same for each next one."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)


#: A space that does not follow a visible character: only then may a token hold a space and more before it.
_LOOSE = re.compile(r"(?:^|\s) ")
#: A full stop or comma that follows no letter or digit, and so may share a token with what it follows.
_MARKS = re.compile(r"[.,](?<![^\W_].)")
#: White space to Python, not to the tokenizers.
_ODD = re.compile(r"[\x1c-\x1f]")
_CUT = "\x01"


def spaced_chunks(text: str) -> list[str]:
    """Chunks that start with their space, for the byte-level pattern; joined they are the text. Stops and commas at a word's end are chunks."""
    if _LOOSE.search(text):
        return re.findall(r"(?:^|(?<=\S) )(?:(?!(?<=\S) ).)*", text, re.S) or [text]
    if _CUT in text or _MARKS.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    text = text.replace(" ", _CUT + " ").replace("," + _CUT, _CUT + "," + _CUT).replace("." + _CUT, _CUT + "." + _CUT)
    return text.split(_CUT)


_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")


def bare_chunks(text: str) -> list[str]:
    """Chunks between white space, lower-cased where that changes nothing else, for vocabularies that drop both. Stops and commas at a word's end are chunks."""
    if "\u03a3" in text or "\u0130" in text:  # letters that are lower-cased by their surroundings
        return [text]
    if unicodedata.is_normalized("NFC", text):
        text = text.lower()
    if not _MARKS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
    return [x for x in _BLANK.split(text) if x] if _ODD.search(text) else text.split()


#: Latin letters, each alone in normal form, of which a pre-tokenizer makes one piece.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


@functools.lru_cache(2)
def byte_bpe(path: str) -> ChunkEncoder:
    """The byte-level vocabulary of a ``tokenizers`` file; special strings are ordinary text. One a worker, kept between tasks."""
    return ChunkEncoder(spaced_chunks, _library(path, "\n", re.compile(r" ?\S+").fullmatch, re.compile(f" ?[{_LETTERS}]+").fullmatch))


@functools.lru_cache(2)
def word_bpe(path: str) -> ChunkEncoder:
    """The lower-casing vocabulary with word ends of a ``tokenizers`` file; special strings are ordinary text. One a worker, kept between tasks."""
    letters = re.compile(f"[{_LETTERS}]+").fullmatch
    return ChunkEncoder(bare_chunks, _library(path, " \0 ", re.compile(r"[^\s\0]+").fullmatch, lambda x: letters(x) and x == x.lower()))


def byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies write for a byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _library(path: str, between: str, plain: Callable[[str], object], single: Callable[[str], object], run: int = 400) -> Callable[[list[str]], tuple]:
    """Encodes lists of chunks. ``single`` ones are one piece as they stand and go to the model itself; runs of ``plain`` ones go as one text, with ``between`` (one token, never merged) to tell them apart."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    (mark,) = library.encode(between, add_special_tokens=False).ids
    model, letters = library.model.tokenize, byte_letters()

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = [0 if single(x) else 1 if plain(x) else 2 for x in chunks]
        one, easy, hard = ([i for i, k in enumerate(kind) if k == n] for n in range(3))
        order = np.array(one + easy + hard, np.int64)
        flat, sizes = [], []
        pieces: list[int] = []
        count = []
        for i in one:
            x = chunks[i]
            got = model(x if x.isascii() and x[0] != " " else x.encode().decode("latin-1").translate(letters))
            pieces += [t.id for t in got]
            count.append(len(got))
        flat.append(np.array(pieces, np.uint32))
        sizes.append(np.array(count, np.int64))
        runs = [between.join([chunks[i] for i in easy[k : k + run]]) for k in range(0, len(easy), run)]
        for got in library.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.array(got.ids, np.uint32)
            marks = np.flatnonzero(ids == mark)
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(np.delete(ids, marks))
        for got in library.encode_batch_fast([chunks[i] for i in hard], add_special_tokens=False):
            flat.append(np.array(got.ids, np.uint32))
            sizes.append(np.array([len(flat[-1])]))
        size = np.concatenate(sizes).astype(np.int64)
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(size) - size
        ordered = np.empty(len(chunks), np.int64)
        ordered[order] = size
        return np.concatenate(flat), start, ordered

    return encode


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in runs of rows of about ``chars`` bytes of text, a longer text alone, with the texts."""
    sizes = np.array(pc.binary_length(batch.column(text)).fill_null(0)) if batch.num_rows else []
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > chars:
            part = batch.slice(start, i - start)
            yield part, part.column(text).to_pylist()
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        part = batch.slice(start)
        yield part, part.column(text).to_pylist()
