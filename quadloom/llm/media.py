"""MPEG transport streams as binary columns: writing, and parsing back with timestamps and random-access points."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 13818-1: packet size, sync byte, table ids, the private stream's type and id, clock, CRC polynomial.
PACKET, SYNC, PAT_ID, PMT_ID, PRIVATE_TYPE, PRIVATE_STREAM, CLOCK_HZ, CRC_POLY = 188, 0x47, 0x00, 0x02, 0x06, 0xBD, 90_000, 0x04C11DB7

PROGRAM, PMT_PID, DATA_PID = 1, 0x100, 0x101
#: Bytes of one access unit, and ticks of the 90 kHz clock between two.
UNIT_BYTES, UNIT_TICKS = 32_768, 3_600
FIRST_PTS = 90_000

PARSED = "payload binary, units array<struct<pts: long, random_access: boolean, offset: long, bytes: long>>, packets long, continuity_errors long, problem string"


@functools.lru_cache(64)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with the polynomial above, most significant bit first, no final xor."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLY if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(pid: int, table: int, number: int, body: bytes) -> bytes:
    """One packet that holds the section whole."""
    rest = number.to_bytes(2, "big") + b"\xc1\0\0" + body
    section = bytes([table]) + (0xB000 | len(rest) + 4).to_bytes(2, "big") + rest
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


@functools.cache
def _tables() -> bytes:
    pat = _section(0, PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(PMT_PID, PMT_ID, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
    return pat + pmt


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def write_stream(payload: bytes, unit: int = UNIT_BYTES) -> bytes:
    """A single-program stream that carries ``payload`` in access units of ``unit`` bytes, each with a timestamp and a random-access point."""
    out, counter = [_tables()], 0
    for i, at in enumerate(range(0, len(payload), unit)):
        pts = FIRST_PTS + i * UNIT_TICKS & (1 << 33) - 1
        body = payload[at : at + unit]
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + body
        data = np.frombuffer(pes, np.uint8)
        head = min(len(data), PACKET - 12)  # the first packet's field holds the clock reference
        more = len(data) - head
        n = 1 + -(-more // (PACKET - 4))
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        rows[:, 3] = 0x10 | counter + np.arange(n) & 15
        rows[0, 1] |= 0x40
        rows[0, 3] |= 0x20
        rows[0, 4], rows[0, 5] = PACKET - 5 - head, 0x50  # random access, clock reference
        rows[0, 6:12] = np.frombuffer((pts << 15 | 0x3F << 9).to_bytes(6, "big"), np.uint8)
        rows[0, PACKET - head :] = data[:head]
        whole = more // (PACKET - 4)
        rows[1 : 1 + whole, 4:] = data[head : head + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if tail := more - whole * (PACKET - 4):
            rows[-1, 3] |= 0x20
            rows[-1, 4] = PACKET - 5 - tail
            if tail < PACKET - 5:
                rows[-1, 5] = 0
            rows[-1, PACKET - tail :] = data[len(data) - tail :]
        counter += n
        out.append(rows.tobytes())
    return b"".join(out)


def _table(rows: np.ndarray, pids: np.ndarray, pid: int, table: int) -> bytes:
    """The body of the first section of ``table`` on ``pid``, over as many packets as it spans, its checksum verified."""
    held: bytes | None = None
    for row in rows[pids == pid]:
        packet = row.tobytes()
        if not packet[3] & 0x10:
            continue
        at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
        if packet[1] & 0x40:  # a section starts here, after the end of the last one
            start = at + 1 + packet[at]
            held = packet[start:] if held is None else held + packet[at + 1 : start]
        elif held is not None:
            held += packet[at:]
        if held is None or len(held) < 3:
            continue
        size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) >= size:
            if held[0] != table or crc32_mpeg(held[:size]):
                raise ValueError(f"bad table on PID {pid}")
            return held[8 : size - 4]
    raise ValueError(f"no table on PID {pid}" if held is None else f"bad table on PID {pid}")


def _programs(rows: np.ndarray, pids: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(program number, [(stream type, PID)])] of all programs."""
    pat = _table(rows, pids, 0, PAT_ID)
    found = []
    for i in range(0, len(pat), 4):
        number, pmt_pid = int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF
        if not number:
            continue
        pmt = _table(rows, pids, pmt_pid, PMT_ID)
        at, streams = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF), []
        while at + 5 <= len(pmt):
            streams.append((pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
        found.append((number, streams))
    return found


def parse_stream(media: bytes, program: int | None = None, stream: int = 0) -> dict:
    """The payload of a stream, of the first program unless one is named, with its units, packets and continuity errors; ``problem`` says why it can't be read."""
    errors = None
    try:
        if not media or len(media) % PACKET:
            raise ValueError("not whole packets")
        rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise ValueError("sync byte missing")
        pids = (rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]
        streams = next((s for number, s in _programs(rows, pids) if program in (None, number)), None)
        if streams is None:
            raise ValueError("no program")
        if stream >= len(streams):
            raise ValueError("no stream in the program")
        pid = streams[stream][1]
        own = rows[pids == pid]
        own = own[own[:, 3] & 0x10 > 0]
        counters = (own[:, 3] & 15).astype(np.int16)
        step = np.diff(counters) & 15
        if (step == 0).any():  # a packet may be sent twice
            again = np.concatenate([[False], (step == 0) & (own[1:, 4:] == own[:-1, 4:]).all(axis=1)])
            own, counters = own[~again], counters[~again]
            step = np.diff(counters) & 15
        field = own[:, 3] & 0x20 > 0
        marked = field & (own[:, 4] > 0)
        jump = marked[1:] & (own[1:, 5] & 0x80 > 0)
        errors = int(((step != 1) & ~jump).sum())
        first = np.where(field, 5 + own[:, 4].astype(np.int32), 4)
        size = np.maximum(PACKET - first, 0)
        data = own[np.arange(PACKET)[None, :] >= first[:, None]].tobytes()
        begins = np.flatnonzero(own[:, 1] & 0x40 > 0)
        offsets = (np.cumsum(size) - size)[begins].tolist() + [len(data)]
        random = (marked & (own[:, 5] & 0x40 > 0))[begins].tolist()
        units, parts, done = [], [], 0
        for k, here in enumerate(random):
            pes = data[offsets[k] : offsets[k + 1]]
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                raise ValueError(f"unit {k} has no start code")
            length = int.from_bytes(pes[4:6], "big")
            body = pes[9 + pes[8] : 6 + length if length else None]
            if length and len(pes) < 6 + length:
                raise ValueError(f"unit {k} is cut short")
            units.append({"pts": _unstamp(pes[9:14]) if pes[7] & 0x80 else None, "random_access": here, "offset": done, "bytes": len(body)})
            parts.append(body)
            done += len(body)
        return {"payload": b"".join(parts), "units": units, "packets": len(rows), "continuity_errors": errors, "problem": None}
    except (ValueError, IndexError) as e:
        return {"payload": None, "units": None, "packets": len(media or b"") // PACKET, "continuity_errors": errors, "problem": str(e)}


def with_streams(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds ``out``: a transport stream of the binary column ``payload`` (null: null; empty: tables only, which parse to an empty payload). A column named ``out`` is replaced."""

    @F.pandas_udf("binary")
    def stream(column):
        return column.map(lambda x: None if x is None else write_stream(x))

    return df.withColumn(out, stream(F.col(payload)))


def with_parsed(df: DataFrame, media: str = "media", out: str = "parsed") -> DataFrame:
    """Adds ``out``: struct of payload, units (pts, random_access, offset, bytes), packets, continuity_errors and problem. Null or damaged media give a null payload and a problem, never an error."""
    fields = F.from_json(F.lit("{}"), PARSED)
    schema = df.sparkSession.range(0).select(fields.alias("x")).schema["x"].dataType

    @F.pandas_udf(schema)
    def parsed(column):
        import pandas as pd

        return pd.DataFrame([parse_stream(x) for x in column], columns=[f.name for f in schema])

    return df.withColumn(out, parsed(F.col(media)))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stream_digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as a stream that is parsed back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (units, random-access points, first and last timestamp in ticks, packets, continuity errors).
    A null text is empty. Null and repeated keys keep their rows. No shuffle.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, media, n in zip(batch.column("doc_id"), batch.column("media"), batch.column("n_bytes"), strict=True):
                media = media.as_py()
                got = parse_stream(media)
                if got["problem"]:
                    raise ValueError(got["problem"])
                payload, units = got["payload"], got["units"]
                feature = f"units={len(units)};random_access={sum(u['random_access'] for u in units)};pts={units[0]['pts']}-{units[-1]['pts']};packets={got['packets']};continuity_errors={got['continuity_errors']}"
                rows.append((k.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                payloads = [x.as_py() or b"" for x in part.column("payload")]
                media = [write_stream(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in payloads]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("payload"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary").mapInArrow(digest, DIGEST)
