"""Best-fit packing of documents into fixed-length token sequences by bin completion."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within
from ..plans.lineage import cut
from .chunks import ChunkEncoder, slices, word_bpe

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Steps of the search for one bin's best filling, and for one node's fillings, after the best-fit incumbent.
FILLING_STEPS = 400
#: Nodes of the search over bins, once an incumbent is there.
BIN_NODES = 4000
#: Steps of the fillings of packings that set large pieces aside, and how many such packings are tried.
APART_STEPS, APART_TRIES = 120, 24
#: Pieces of one length that a task numbers.
SALT_ROWS = 500_000
#: Fillings that a node of the search over bins branches to, at most.
BRANCHES = 40

Filling = tuple[tuple[int, int], ...]  # (length, number of pieces), lengths descending


class _Left:
    """The pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, filling: Filling, times: int) -> None:
        for x, n in filling:
            self.counts[x] -= n * times
            if not self.counts[x]:
                del self.counts[x]
                self.lengths.pop(bisect.bisect_left(self.lengths, x))

    def put(self, filling: Filling, times: int) -> None:
        for x, n in filling:
            if x not in self.counts:
                bisect.insort(self.lengths, x)
            self.counts[x] = self.counts.get(x, 0) + n * times

    def times(self, filling: Filling) -> int:
        return min(self.counts[x] // n for x, n in filling)

    def best_fit(self, room: int) -> tuple[Filling, int]:
        """(the largest pieces that fit in turn, as many as there are; the room that they leave)."""
        filling = []
        i = bisect.bisect_right(self.lengths, room) - 1
        while i >= 0:
            x = self.lengths[i]
            n = min(room // x, self.counts[x])
            filling.append((x, n))
            room -= n * x
            i = bisect.bisect_right(self.lengths, room, 0, i) - 1
        return tuple(filling), room

    def fillings(self, room: int, most_waste: int, steps: int, narrowing: bool) -> list[tuple[int, Filling]]:
        """[(waste, filling)] of ``room`` with a waste of at most ``most_waste``, found depth first from the largest lengths in ``steps`` steps.

        A branch ends where all smaller pieces together could not bring the waste down to the
        bound. ``narrowing`` lowers the bound below each filling found, and so leaves the best.
        """
        lengths, counts = self.lengths, self.counts
        low = bisect.bisect_right(lengths, room)
        sums = [0]
        for x in lengths[:low]:
            sums.append(sums[-1] + x * counts[x] if sums[-1] <= room else sums[-1])  # beyond the room it no longer matters
        found: list[tuple[int, Filling]] = []
        path: list[tuple[int, int]] = []
        bound, left_steps = most_waste, steps

        def fill(end: int, left: int) -> None:
            nonlocal bound, left_steps
            left_steps -= 1
            if left <= bound:
                found.append((left, tuple(path)))
                if narrowing:
                    bound = left - 1
            i = bisect.bisect_right(lengths, left, 0, end) - 1
            while i >= 0 and left_steps > 0 and left - sums[i + 1] <= bound:
                x = lengths[i]
                for n in range(min(left // x, counts[x]), 0, -1):
                    path.append((x, n))
                    fill(i, left - n * x)
                    path.pop()
                    if left_steps <= 0 or bound < 0:
                        return
                i -= 1

        fill(low, room)
        return found

    def dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a piece left out could take the place of some pieces of ``filling`` (or of none) within ``waste``, which is never worse."""
        items = [x for x, n in filling for _ in range(min(n, 12))][:12]
        used = dict(filling)
        sums = {0: 0}  # sum: most pieces that make it
        for x in items:
            for s, n in list(sums.items()):
                sums[s + x] = max(sums.get(s + x, 0), n + 1)
        for s, n in sums.items():
            i = bisect.bisect_left(self.lengths, max(s, 1))
            while i < len(self.lengths) and self.lengths[i] <= s + waste:
                x = self.lengths[i]
                if self.counts[x] > used.get(x, 0) and (x > s or n > 1):
                    return True
                i += 1
        return False


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a bin need one each, and what the room beside them cannot hold needs more; smaller pieces than a threshold aside, for every threshold."""
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), np.int64)
    if not len(lengths):
        return 0
    number = np.array([counts[int(x)] for x in lengths], np.int64)
    upto = lambda of: np.concatenate([[0], np.cumsum(of)])
    n, s = upto(number), upto(lengths * number)
    half = int(np.searchsorted(lengths, capacity // 2, "right"))
    best = 0
    for a in range(half + 1):
        least = int(lengths[a]) if a < len(lengths) else capacity
        alone = max(int(np.searchsorted(lengths, capacity - least, "right")), half)
        middle, small = int(n[alone] - n[half]), int(s[half] - s[a])
        room = middle * capacity - int(s[alone] - s[half])
        best = max(best, int(n[-1] - n[half]) + max(0, -(-(small - room) // capacity)))
    return best


def least_by_number(counts: dict[int, int], capacity: int) -> int:
    """A lower bound by how many pieces fit: of the pieces of a length or more, at most k share a bin, and only so many bins can hold k of them, as the least k pieces of each must fit; all others hold k - 1."""
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), np.int64)
    number = np.array([counts[int(x)] for x in lengths], np.int64)
    best = 0
    for a in range(len(lengths)):
        x, n = lengths[a:], np.cumsum(number[a:])
        s = np.cumsum(x * number[a:])
        total, k = int(n[-1]), int(capacity // x[0])

        def least_sum(m: int, x=x, n=n, s=s) -> int:
            """The sum of the ``m`` least pieces."""
            i = int(np.searchsorted(n, m))
            return int(s[i] - (n[i] - m) * x[i])

        while k > 1 and (k > total or least_sum(k) > capacity):
            k -= 1
        if k <= 1:
            best = max(best, total)
            continue
        low, high = 0, total // k
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if least_sum(k * middle) <= middle * capacity else (low, middle - 1)
        best = max(best, low + -(-(total - k * low) // (k - 1)))
    return best


def _apart(counts: dict[int, int], capacity: int, aside: int, steps: int) -> list[tuple[Filling, int]]:
    """Bins of the ``aside`` largest pieces by themselves, and of the rest by themselves: large ones that would spoil fuller bins keep each other company."""
    high, low = {}, dict(counts)
    for x in sorted(counts, reverse=True):
        take = min(aside, counts[x])
        if not take:
            break
        high[x], low[x] = take, counts[x] - take
        aside -= take
    return _incumbent(high, capacity, steps) + _incumbent(low, capacity, steps)


def _best_apart(counts: dict[int, int], capacity: int, least: int) -> list[tuple[Filling, int]]:
    """The best of ``_apart`` over a grid of numbers set aside, refined about the best of them."""
    total, tried = sum(counts.values()), {}

    def bins(aside: int) -> int:
        if aside not in tried:
            packing = _apart(counts, capacity, aside, APART_STEPS)
            tried[aside] = (sum(t for _, t in packing), packing)
        return tried[aside][0]

    step = max(1, total // 8)
    best = min(range(0, total + 1, step), key=bins)
    while step > 1 and len(tried) < APART_TRIES and bins(best) > least:
        step = max(1, step // 2)
        best = min((x for x in (best - step, best, best + step) if 0 <= x <= total), key=bins)
    return tried[best][1]


def _complete(left: _Left, room: int, steps: int) -> tuple[Filling, int]:
    """The filling of least waste that the search finds, with best fit as its incumbent."""
    filling, waste = left.best_fit(room)
    if waste:
        better = left.fillings(room, waste - 1, steps, narrowing=True)
        if better:
            waste, filling = min(better)
    return filling, waste


def _merge(largest: int, filling: Filling) -> Filling:
    return ((largest, filling[0][1] + 1), *filling[1:]) if filling and filling[0][0] == largest else ((largest, 1), *filling)


def _incumbent(counts: dict[int, int], capacity: int, steps: int) -> list[tuple[Filling, int]]:
    """Bins opened by the largest piece left and completed one kind after the other; ``steps`` 0 is plain best fit."""
    left, bins = _Left(counts), []
    while left.lengths:
        largest = left.lengths[-1]
        left.take(((largest, 1),), 1)
        filling = _merge(largest, _complete(left, capacity - largest, steps)[0] if steps else left.best_fit(capacity - largest)[0])
        left.put(((largest, 1),), 1)
        bins.append((filling, times := left.times(filling)))
        left.take(filling, times)
    return bins


def _search(counts: dict[int, int], capacity: int, most: int, least: int, nodes: int) -> list[tuple[Filling, int]] | None:
    """A packing into fewer than ``most`` bins, as good as ``nodes`` nodes find; None if there is none or none is found.

    Depth first over bins: the largest piece left is branched on with its undominated fillings,
    least waste first, as often as the pieces last or once. A branch ends when the waste so far
    leaves no packing below the incumbent.
    """
    total = sum(x * c for x, c in counts.items())
    left, best = _Left(counts), None
    spare = (most - 1) * capacity - total

    def branches(waste: int) -> list[tuple[int, Filling, int]]:
        largest = left.lengths[-1]
        left.take(((largest, 1),), 1)
        found = sorted(left.fillings(capacity - largest, spare - waste, FILLING_STEPS, narrowing=False), key=lambda f: (f[0], sum(n for _, n in f[1])))
        kept = [(w, f) for w, f in found if not left.dominated(f, w)][:BRANCHES]
        left.put(((largest, 1),), 1)
        out = []
        for w, f in kept:
            f = _merge(largest, f)
            times = left.times(f)
            out += [(w, f, t) for t in sorted({times, 1}, reverse=True) if waste + w * t <= spare]
        return out[::-1]

    stack, chosen, waste = [branches(0)] if spare >= 0 and left.lengths else [], [], 0
    while stack and nodes > 0:
        if not stack[-1]:
            stack.pop()
            if chosen:
                w, f, t = chosen.pop()
                left.put(f, t)
                waste -= w * t
            continue
        w, f, t = stack[-1].pop()
        if waste + w * t > spare:
            continue
        nodes -= 1
        left.take(f, t)
        chosen.append((w, f, t))
        waste += w * t
        if left.lengths:
            stack.append(branches(waste))
            continue
        best = [(f, t) for _, f, t in chosen]
        bins = sum(t for _, t in best)
        if bins <= least:
            break
        spare = (bins - 1) * capacity - total
        stack.append([])
    return best


def pack_histogram(counts: dict[int, int], capacity: int, bin_nodes: int = BIN_NODES) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one bin, descending; bins of this kind)] that together hold ``counts`` (length: pieces).

    Bin completion: the largest length left opens a bin, whose undominated fillings are the
    branches; waste beyond that of the incumbent less a bin ends one. Best fit and best completion
    are the first incumbents, and packings that set the largest pieces aside the next. One that
    meets the lower bound, by lengths or by the number of pieces, is optimal and ends the search,
    which otherwise stops after ``bin_nodes`` nodes: the result is then a packing, not proven the
    least. All work is by distinct lengths, at most
    ``capacity``, and a filling is repeated as often as its lengths last, so neither grows with
    the number of documents.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    least = max(least_bins(counts, capacity), least_by_number(counts, capacity))
    number = lambda bins: sum(t for _, t in bins)
    best = _incumbent(counts, capacity, FILLING_STEPS)
    if number(best) > least:
        best = min(best, _incumbent(counts, capacity, 0), key=number)
    if number(best) > least:
        best = min(best, _best_apart(counts, capacity, least), key=number)
    if number(best) > least:
        best = _search(counts, capacity, number(best), least, bin_nodes) or best
    return [(tuple(x for x, n in filling for _ in range(n)), times) for filling, times in best]


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 1, text: str = "text", key: str = "doc_id", with_ids: bool = True, encoder: Callable[[str], ChunkEncoder] = word_bpe) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: each text's ids and ``end_id``, cut every ``capacity`` ids. A null text has only the end id; without one it has no piece."""
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, count = tokens(texts)
                ends = np.cumsum(count)
                rows: list[tuple] = []
                for k, b, n in zip(part.column("doc_id").to_pylist(), ends.tolist(), count.tolist(), strict=True):
                    own = ids[b - n : b] if end_id is None else np.append(ids[b - n : b], np.uint32(end_id))
                    data = own.astype("<u4").tobytes()
                    for j, at in enumerate(range(0, len(own), capacity)):
                        view = data[4 * at : 4 * (at + capacity)]
                        rows.append((k, j, at, len(view) // 4, zlib.crc32(view), view if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: where each piece lies in which sequence.

    Only documents longer than ``capacity`` are cut. The pieces are stored, their lengths counted
    (a number for each of at most ``capacity`` lengths goes to the driver) and packed by
    ``pack_histogram``. Its bins are intervals of piece ranks within a length, so pieces find
    their place by a join on (length, rank); ranks of a hot length are dealt over salts. A
    sequence's pieces fill it from offset 0 without gaps, longest first.

    A null text is empty; null and repeated keys keep their rows; equal pieces are alike and may
    change places. Empty table: no rows. Other columns are not read.
    """
    pieces = cut(token_pieces(df, tokenizer, capacity, end_id, text, key, with_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    taken: Counter[int] = Counter()
    slots, first = [], 0
    for filling, times in pack_histogram(counts, capacity):
        offset = 0
        for x in filling:
            slots.append((x, taken[x], taken[x] + times, first, offset))
            taken[x] += times
            offset += x
        first += times
    places = df.sparkSession.createDataFrame(slots, "length long, low long, high long, first_sequence long, offset long")
    salts = max(32, -(-max(counts.values(), default=0) // SALT_ROWS))
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", salts)
    at = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    # The places hold a few rows for each of at most ``capacity`` lengths, whatever the table holds.
    return ranked.join(F.broadcast(places), at).select(*[ranked[c] for c in pieces.columns], (F.col("first_sequence") + F.col("_rank") - F.col("low")).alias("sequence_id"), "offset")
