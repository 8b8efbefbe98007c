"""Repeated byte strings by sparse suffix arrays: the suffixes that start at anchors, sorted in both directions.

Every 200-byte string holds a gram of least hash, its anchor; equal strings hold it at the same
place. Strings whose anchor occurs once are no one's and left out first, exactly. What is left of a
text around an anchor is dealt by the anchor. There the suffixes from the anchors on are sorted, and
so is what lies before them, read backwards; of both orders the common prefixes of neighbours are
kept. A string that begins k bytes before its anchor is another's if both agree in k bytes before
and in 200 - k from the anchor on, which the two orders tell for all k at once, so no suffix is
sorted but those at anchors, and none is sorted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .chunks import slices
from .ngrams import mix

LENGTH = 200
GRAM = 32
#: Starts about an anchor that are dealt as one piece at most.
REGION = 1 << 17
#: Anchors whose suffixes are sorted at once, unless one gram has more.
SORTED = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_SECTION = 1 << 20


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE, np.uint64)]))
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), inverse, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    n = len(data) - size + 1
    return mix((sums[size:] - sums[:n]) * back[:n])


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, last start, the gram's place) of the runs of ``length``-byte strings that hold the same gram of least hash."""
    gram = min(GRAM, length)
    grams, lows, highs, places = [], [], [], []
    w = length - gram + 1
    for at in range(0, len(data) - length + 1, _SECTION):
        part = data[at : at + _SECTION + length - 1]
        h = _gram_hashes(part, gram)
        n = len(h) - w + 1
        place = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.concatenate([place, np.full(-len(place) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)
        edge = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
        grams.append(h[least[edge].astype(np.int64)])
        lows.append(at + edge)
        highs.append(at + np.append(edge[1:], n) - 1)
        places.append(at + least[edge].astype(np.int64))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(grams, np.uint64), join(lows, np.int64), join(highs, np.int64), join(places, np.int64)


def _keyed(df: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, h1, h2, text; distinct texts' h1, h2, doc, copies): a text is told by 128 bits and numbered; null texts are empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), F.octet_length(t), t).alias("h2"), t.alias("text"))
    distinct = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).withColumn("doc", F.monotonically_increasing_id()))
    return rows, distinct


def candidate_runs(rows: DataFrame, length: int) -> DataFrame:
    """h1, h2, gram, low, high, place: runs of starts whose ``length``-byte strings may occur elsewhere, with the gram that they hold and where; copies of a text tell nothing by each other, but each gives its runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "gram", "low", "high", "place"]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = []
                for h1, h2, t in zip(part.column("h1").to_pylist(), part.column("h2").to_pylist(), texts, strict=True):
                    g, low, high, place = _anchors(np.frombuffer(t.encode(), np.uint8), length)
                    if len(g):
                        found.append([np.full(len(g), h1), np.full(len(g), h2), g.view(np.int64), low, high, place])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    runs = rows.select("h1", "h2", "text").mapInArrow(find, "h1 long, h2 long, gram long, low long, high long, place long")
    alike = Window.partitionBy("gram")
    told = F.xxhash64("h1", "h2", "low")
    return runs.withColumn("least", F.min(told).over(alike)).withColumn("most", F.max(told).over(alike)).where("least <> most").drop("least", "most")


def _pieces(rows: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """gram, doc, low, before, n, bytes: a row a run of ``n`` starts from ``low``, ``before`` bytes before its anchor, with the bytes of all its strings; one text stands for its copies.

    Runs of one text that are alike, as in "aaaa", give their bytes once; all their starts are repeated, which rows without bytes tell, one for each stretch of them.
    """
    runs = F.struct("low", "high", "place", "gram")
    listed = candidate_runs(rows, length).groupBy("h1", "h2").agg(F.collect_set(runs).alias("runs"))  # no more than a document's starts
    texts = rows.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    found = listed.join(distinct.select("h1", "h2", "doc"), ["h1", "h2"]).join(texts, ["h1", "h2"]).select("doc", "runs", "text")
    arrow = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("low", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            out: list[tuple] = []
            for doc, runs, text in zip(*(batch.column(c) for c in ("doc", "runs", "text")), strict=True):
                data, doc = text.as_py().encode(), doc.as_py()
                low, high, place, gram = (np.asarray(runs.values.field(c)).tolist() for c in ("low", "high", "place", "gram"))
                first, known = {}, []
                for a, b, g, name in zip(low, high, place, gram, strict=True):
                    for at in range(a, b + 1, REGION):
                        end = min(at + REGION, b + 1)
                        piece = data[at : end - 1 + length]
                        told = first.setdefault((g - at, piece), at)
                        if told != at:
                            known += [(told, end - at), (at, end - at)]
                        else:
                            out.append((name, doc, at, g - at, end - at, piece))
                    if len(out) >= SORTED:
                        yield table(out)
                        out = []
                out += [(doc + a, doc, a, 0, n, None) for a, n in _joined(known)]
            if out:
                yield table(out)

    return found.mapInArrow(lay, "gram long, doc long, low long, before long, n long, bytes binary")


def _joined(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs (start, n), those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, n in sorted(runs):
        if out and a <= sum(out[-1]):
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return out


def _ranked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each text in their order, bytes that each place's text shares with the one before it)."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared = np.zeros(len(texts), np.int64)
    size = np.array([len(t) for t in texts])[order]
    wide = max(int(size.max()), 1)
    step = max(2, (1 << 24) // wide)
    for at in range(0, len(order), step - 1):
        some = order[at : at + step]
        rows = np.frombuffer(b"".join(texts[i].ljust(wide, b"\0") for i in some), np.uint8).reshape(len(some), wide)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        shared[at + 1 : at + len(some)] = np.minimum(first, np.minimum(size[at + 1 : at + len(some)], size[at : at + len(some) - 1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, shared


def _repeats(doc: np.ndarray, low: np.ndarray, before: np.ndarray, n: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n): runs of starts whose ``length`` bytes also start in another of the pieces or at another place of the same."""
    on, shared_on = _ranked([t[b:] for t, b in zip(texts, before.tolist(), strict=True)])
    back, shared_back = _ranked([t[b - 1 :: -1] if b else b"" for t, b in zip(texts, before.tolist(), strict=True)])
    width = int(n.max())
    mark = np.zeros((len(texts), width + 1), bool)
    last = before - n + 1  # bytes from a piece's last start to its anchor; fewer than none if it starts after it
    for k in range(int(last.min()), int(before.max()) + 1):
        those = np.flatnonzero((before >= k) & (last <= k))
        if len(those) < 2:
            continue
        code = np.cumsum(shared_on < length - k)[on[those]] * np.int64(len(texts) + 1) + np.cumsum(shared_back < k)[back[those]]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        held = those[order[np.append(same, False) | np.insert(same, 0, False)]]
        mark[held, before[held] - k] = True
    edge = np.flatnonzero(np.diff(mark.ravel(), prepend=False))
    first, end = edge[::2], edge[1::2]
    piece = first // (width + 1)
    return doc[piece], low[piece] + first % (width + 1), end - first


def _starts(pieces: DataFrame, length: int) -> DataFrame:
    """doc, start, n: runs of n places whose ``length`` bytes also start anywhere else."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: pa.Table) -> pa.RecordBatch:
            known = held.filter(held.column("bytes").is_null())
            held = held.filter(held.column("bytes").is_valid())
            found = [np.asarray(known.column(c)) for c in ("doc", "low", "n")]
            if held.num_rows > 1:
                doc, low, before, n = (np.asarray(held.column(c)) for c in ("doc", "low", "before", "n"))
                found = [np.concatenate(x) for x in zip(found, _repeats(doc, low, before, n, held.column("bytes").to_pylist(), length), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc", "start", "n"])

        waiting, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = np.asarray(batch.column("gram"))
            # What waits ends where its last gram does.
            new = 0 if waiting and waiting[-1].column("gram")[-1].as_py() == gram[0] else None
            edges = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            at = 0
            if rows >= SORTED and new is None:
                yield told(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
            for e in edges.tolist():
                if rows + e - at >= SORTED:
                    waiting.append(batch.slice(at, e - at))
                    yield told(pa.Table.from_batches(waiting))
                    waiting, rows, at = [], 0, e
            waiting.append(batch.slice(at))
            rows += batch.num_rows - at
        if waiting:
            yield told(pa.Table.from_batches(waiting))

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "doc long, start long, n long")


def repeated_starts(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, distinct, starts): as ``_keyed`` gives them, and doc, start, n: runs of n places whose ``length`` bytes also start anywhere else."""
    rows, distinct = _keyed(df, text, key)
    return rows, distinct, _starts(_pieces(rows, distinct, length), length)


def remove_repeated_strings(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start, end in bytes), kept (the remaining bytes).

    Bytes under a ``length``-byte string that also starts elsewhere, in this or another row,
    overlapping or not, are removed; all is judged on the input. Of rows of one text, whatever
    their keys, every string starts elsewhere. A null text is empty; null keys keep their rows.
    Empty table: no rows.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    rows, kept = _kept(df, length, text, key)
    return rows.select("doc_id", "h1", "h2").join(kept, ["h1", "h2"]).drop("h1", "h2")


def _kept(df: DataFrame, length: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows as ``_keyed`` gives them; of each distinct text h1, h2, and what ``remove_repeated_strings`` tells). Texts are dealt the same way here and where their pieces are cut out, so they are shuffled once."""
    rows, distinct, starts = repeated_starts(df, length, text, key)
    listed = starts.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"))  # no more than a document's starts
    marked = distinct.join(listed, "doc", "left").select("h1", "h2", "copies", "runs")
    texts = rows.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    joined = marked.join(texts, ["h1", "h2"]).select("h1", "h2", "text", "copies", "runs")
    arrow = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h1, h2, t, copies, runs in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text", "copies", "runs")), strict=True):
                data = t.encode()
                found = [(0, len(data) - length + 1)] if copies > 1 and len(data) >= length else [(r["start"], r["n"]) for r in runs or []]
                spans: list[list[int]] = []
                for a, n in found:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], a + n - 1 + length)
                    else:
                        spans.append([a, a + n - 1 + length])
                kept, done = [], 0
                for a, b in spans:
                    kept.append(data[done:a])
                    done = b
                kept.append(data[done:])
                left = b"".join(kept)
                out.append((h1, h2, len(data), len(data) - len(left), len(spans), spans, left))
            columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows, joined.mapInArrow(remove, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def repeated_string_digest(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, kept = _kept(df, length, text, key)
    digest = kept.select("h1", "h2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.select("doc_id", "h1", "h2").join(digest, ["h1", "h2"]).drop("h1", "h2")
