"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

Every id's probability is a mixture of three predictions: the id that last followed the same two
ids (order 2), the id that last followed the same id (order 1), and the block's own id
frequencies by class of neighbouring ids (order 0). The weights are learned from how often each
prediction held at the same pair of confidences; predictions that agree add up. Ids keep their
numeric order in the range, so one cumulative sum per order gives an id's interval. A carry-free
64-bit range coder codes the id in one step.

Blocks start from the same state and share nothing, so those of a chunk are coded side by side,
one a row of numpy arrays. A chunk is bytes: magic, ids, ids of a block, blocks, bits of a class,
then per block its words and CRC-32, then the blocks' 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QLID2\0\0\0"
BLOCK_IDS = 4096
#: Ids that a chunk may hold are below this.
MOST_IDS = 1 << 20
_CLASSES = 256
_TOTAL_BITS = 30  # enough for each id of the largest class to keep a width of its own
_TOTAL = 1 << _TOTAL_BITS
_HELD = float(_TOTAL - (_TOTAL >> 4))  # of it, what orders 2 and 1 may take
_SLOTS1, _SLOTS2 = 256, 512
_EVERY = 64  # ids between two updates of the order-0 frequencies
_MASK32 = np.uint64(0xFFFFFFFF)
_U32 = np.uint64(32)
_TOP = np.uint64(1 << 32)


class _Model:
    """Predictions for one id of every row at a time.

    A slot of a table holds a predicted id and, in its two lowest bits, how sure it is. A cell of
    weights holds how many ids met it, and how many of them each order foresaw. Shares are floors
    of doubles, which both directions compute alike.
    """

    def __init__(self, rows: int, shift: int):
        self.shift, self.mask = shift, (1 << shift) - 1
        self.rows = np.arange(rows)
        self.table1 = np.zeros(rows * _SLOTS1, np.int32)
        self.table2 = np.zeros(rows * _SLOTS2, np.int32)
        self.seen = np.ones((rows, 256), np.int64)
        self.cells = np.tile(np.array([16, 2, 2, 12], np.int64), rows * 16)
        self.b2, self.b1 = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.recent: list[np.ndarray] = []
        self.k = -1
        self._sum()

    def _sum(self) -> None:
        self.cum = np.concatenate([np.zeros((len(self.rows), 1)), np.cumsum(self.seen, axis=1)], axis=1).ravel()

    def _take(self, k: int) -> None:
        """Only the first ``k`` rows go on."""
        self.k = k
        r = self.rows[:k]
        self.row1, self.row2, self.row0, self.rowc, self.rows256 = r * _SLOTS1, r * _SLOTS2, r * 257, r * 64, r * 256
        self.b2, self.b1 = self.b2[:k], self.b1[:k]
        self.sum0 = self.cum.take(self.row0 + 256)

    def predict(self, k: int) -> None:
        """Sets the predicted ids and the three shares of the first ``k`` rows."""
        if k != self.k:
            self._flush()
            self._take(k)
        one = self.b1 * 40503
        self.at1 = self.row1 + (one >> 4 & _SLOTS1 - 1)
        one += self.b2 * 60493
        self.at2 = self.row2 + (one >> 4 & _SLOTS2 - 1)
        self.e1, self.e2 = self.table1.take(self.at1), self.table2.take(self.at2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.cell = self.rowc + ((self.e2 & 3) << 4 | (self.e1 & 3) << 2)
        self.whole = self.cells.take(self.cell)
        unit = _HELD / self.whole
        self.w2, self.w1 = (unit * self.cells.take(self.cell + 1)).astype(np.int64), (unit * self.cells.take(self.cell + 2)).astype(np.int64)
        self.unit0 = (_TOTAL - self.w2 - self.w1) / self.sum0

    def _order0(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ``ids`` in the order-0 share alone."""
        at = self.row0 + (ids >> self.shift)
        lo = (self.unit0 * self.cum.take(at)).astype(np.int64)
        at += 1
        width = (self.unit0 * self.cum.take(at)).astype(np.int64)
        width -= lo
        width >>= self.shift
        lo += width * (ids & self.mask)
        return lo, width

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ``ids`` in the mixture."""
        start, width = self._order0(ids)
        start += self.w1 * (self.p1 < ids)
        start += self.w2 * (self.p2 < ids)
        self.hit2, self.hit1 = self.p2 == ids, self.p1 == ids
        width += self.w1 * self.hit1
        width += self.w2 * self.hit2
        return start, width

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold ``value``, with starts and widths."""
        start1, width1 = self._order0(self.p1)
        start2, width2 = self._order0(self.p2)
        same = self.p1 == self.p2
        start1 += self.w2 * (self.p2 < self.p1)
        start2 += self.w1 * (self.p1 < self.p2)
        width1 += self.w1 + self.w2 * same
        width2 += self.w2 + self.w1 * same
        beyond1, beyond2 = value >= start1, value >= start2
        in1, in2 = beyond1 & (value < start1 + width1), beyond2 & (value < start2 + width2)
        before = self.w1 * beyond1
        before += self.w2 * beyond2
        rest = value - before  # of a value outside the two, its place in the order-0 share
        above = rest + 1
        at = self.row0.copy()
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            at += step * (self.unit0 * self.cum.take(at + step) < above)
        start = (self.unit0 * self.cum.take(at)).astype(np.int64)
        width = (self.unit0 * self.cum.take(at + 1)).astype(np.int64) - start >> self.shift
        low = np.minimum(np.maximum(((rest - start) / width).astype(np.int64), 0), self.mask)
        ids = (at - self.row0 << self.shift) + low
        start += width * low + before
        for inside, p, s, w in ((in1, self.p1, start1, width1), (in2, self.p2, start2, width2)):
            np.copyto(ids, p, where=inside)
            np.copyto(start, s, where=inside)
            np.copyto(width, w, where=inside)
        self.hit2, self.hit1 = self.p2 == ids, self.p1 == ids
        return ids, start, width

    def learn(self, ids: np.ndarray) -> None:
        self.cells[self.cell] = self.whole + 24
        self.cells[self.cell + np.where(self.hit2, 1, 3 - self.hit1)] += 24
        fresh = ids.astype(np.int32) << 2
        for hit, e, table, at in ((self.hit1, self.e1, self.table1, self.at1), (self.hit2, self.e2, self.table2, self.at2)):
            sure = e & 3
            table[at] = np.where(hit, e + (sure < 3), np.where(sure > 0, e - 1, fresh))
        self.b2, self.b1 = self.b1, ids
        self.recent.append(self.rows256 + (ids >> self.shift))
        if len(self.recent) == _EVERY:
            self._flush()
            self.sum0 = self.cum.take(self.row0 + 256)

    def _flush(self) -> None:
        """Brings the order-0 frequencies up to date, and halves what full cells hold."""
        if self.recent:
            self.seen += 8 * np.bincount(np.concatenate(self.recent), minlength=self.seen.size).reshape(self.seen.shape)
            self.recent.clear()
            self._sum()
            cells = self.cells.reshape(-1, 4)
            full = np.flatnonzero(cells[:, 0] > 4000)
            halved = (cells[full, 1:] >> 1) + 1
            cells[full, 1:], cells[full, 0] = halved, halved.sum(axis=1)


def _settle(low: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that shift a word out, their ranges cut so that no carry can reach it)."""
    same = ((low ^ (low + (wide - np.uint64(1)))) >> _U32) == 0
    short = wide < _TOP
    wide = np.where(short & ~same, (~low & _MASK32) + np.uint64(1), wide)
    out = same | short
    return out, np.where(out, np.minimum(wide, _MASK32), wide)


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """The chunk that holds ``ids`` (each below ``MOST_IDS``). No ids: a chunk of no blocks."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= MOST_IDS):
        raise ValueError(f"ids must lie in 0..{MOST_IDS - 1}")
    if not 0 < block <= 8000:
        raise ValueError("a block holds 1 to 8000 ids")
    blocks = -(-len(ids) // block)
    sizes = np.minimum(block, len(ids) - block * np.arange(blocks))
    table = np.zeros((blocks, block), np.int64)
    table.reshape(-1)[: len(ids)] = ids
    shift = max(8, int(ids.max(initial=0)).bit_length() - 8)
    model = _Model(blocks, shift)
    low = np.zeros(blocks, np.uint64)
    wide = np.full(blocks, 2**64 - 1, np.uint64)
    words = np.zeros((blocks, block + 3), np.uint32)
    used = np.zeros(blocks, np.int64)
    for t in range(int(sizes[0]) if blocks else 0):
        k = blocks if t < sizes[-1] else blocks - 1  # only the last block may be short
        now = np.ascontiguousarray(table[:k, t])
        model.predict(k)
        start, freq = model.interval(now)
        r = wide[:k] >> np.uint64(_TOTAL_BITS)
        low_k = low[:k] + r * start.astype(np.uint64)
        out, wide_k = _settle(low_k, r * freq.astype(np.uint64))
        at = np.flatnonzero(out)
        words[at, used[at]] = (low_k[at] >> _U32).astype(np.uint32)
        used[at] += 1
        by = out * _U32
        np.left_shift(low_k, by, out=low[:k])
        np.left_shift(wide_k, by, out=wide[:k])
        model.learn(now)
    rows = np.arange(blocks)
    for by in (_U32, np.uint64(0)):
        words[rows, used] = ((low >> by) & _MASK32).astype(np.uint32)
        used += 1
    crc = [zlib.crc32(table[i, : sizes[i]].astype("<u4").tobytes()) for i in range(blocks)]
    head = MAGIC + struct.pack("<QIII", len(ids), block, blocks, shift)
    if blocks:
        head += np.stack([used, crc], 1).astype("<u4").tobytes()
    return head + b"".join(words[i, : used[i]].astype("<u4").tobytes() for i in range(blocks))


def decode_ids(chunk: bytes) -> np.ndarray:
    """The ids of a chunk, as uint32; ValueError for a foreign or damaged one, naming the block."""
    if chunk[:8] != MAGIC or len(chunk) < 28:
        raise ValueError("not a chunk of token ids")
    n, block, blocks, shift = struct.unpack_from("<QIII", chunk, 8)
    index = np.frombuffer(chunk, "<u4", 2 * blocks, 28).reshape(blocks, 2).astype(np.int64)
    body = np.frombuffer(chunk, "<u4", offset=28 + 8 * blocks)
    if index[:, 0].sum() != len(body):
        raise ValueError("the chunk is cut short")
    words = np.zeros((blocks, int(index[:, 0].max(initial=0)) + 2), np.uint64)
    words[np.arange(words.shape[1])[None, :] < index[:, :1]] = body
    sizes = np.minimum(block, n - block * np.arange(blocks, dtype=np.int64))
    model = _Model(blocks, shift)
    table = np.zeros((blocks, block), np.int64)
    low = np.zeros(blocks, np.uint64)
    wide = np.full(blocks, 2**64 - 1, np.uint64)
    code = words[:, 0] << _U32 | words[:, 1]
    at = np.full(blocks, 2, np.int64)
    most = words.shape[1] - 1
    for t in range(int(sizes[0]) if blocks else 0):
        k = blocks if t < sizes[-1] else blocks - 1
        model.predict(k)
        r = wide[:k] >> np.uint64(_TOTAL_BITS)
        value = np.minimum((code[:k] - low[:k]) // r, np.uint64(_TOTAL - 1)).astype(np.int64)
        now, start, freq = model.find(value)
        low_k = low[:k] + r * start.astype(np.uint64)
        out, wide_k = _settle(low_k, r * freq.astype(np.uint64))
        by = out * _U32
        np.left_shift(low_k, by, out=low[:k])
        np.left_shift(wide_k, by, out=wide[:k])
        read = np.flatnonzero(out)
        code[read] = code[read] << _U32 | words[read, np.minimum(at[read], most)]
        at[read] += 1
        table[:k, t] = now
        model.learn(now)
    for i in range(blocks):
        if zlib.crc32(table[i, : sizes[i]].astype("<u4").tobytes()) != index[i, 1]:
            raise ValueError(f"checksum of block {i} differs")
    return table.reshape(-1)[:n].astype(np.uint32)
