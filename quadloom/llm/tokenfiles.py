"""Token-id files: texts tokenized in key order, range-coded into chunks, stored as Parquet, read back."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path
from .chunks import ChunkEncoder, byte_bpe, slices
from .idcoder import decode_ids, encode_ids

#: Ids gathered before a chunk is written; a chunk holds whole documents and one at least.
CHUNK_IDS = 4_000_000
#: Bytes of text that a part holds: a task tokenizes and codes one, whatever the table holds.
PART_BYTES = 16_000_000
#: Ids of a block. A chunk's blocks are coded side by side, a step for all at once, so more of them cost less an id.
BLOCK_IDS = 2048

CHUNK_SCHEMA = "part int, chunk int, before long, n_ids long, keys array<long>, n_tokens array<long>, payload binary"
READ_SCHEMA = "part int, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"


def write_token_files(df: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = 0, parts: int | None = None, encoder: Callable[[str], ChunkEncoder] = byte_bpe) -> None:
    """Writes the ids of every row's text, then ``end_id``, in ascending ``key`` order to ``path``.

    Rows are range-partitioned and sorted by key, once, with their texts; each task tokenizes its
    range and writes chunks of whole documents with an index of (key, tokens). ``before`` counts
    the ids of the part that precede the chunk. Parts follow each other in key order; unless
    given, there are as many as the texts' bytes ask for.

    A null text is empty: its row holds only the end id. Null keys come first; rows of one key
    stay rows, in any order among themselves, and many of them are spread over parts by their texts. Other columns are not read. No rows: no chunks.
    """
    if not parts:
        size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long") + 1)).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        sizes: list[int] = []
        n, before, chunk, part = 0, 0, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "chunk": chunk, "before": before, "n_ids": n, "keys": keys, "n_tokens": sizes, "payload": encode_ids(np.concatenate(held), BLOCK_IDS)}], schema=arrow)

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                ids, count = tokens(texts)
                at = 0
                for k, m in zip(piece.column("key").to_pylist(), count.tolist(), strict=True):
                    own = ids[at : at + m]
                    at += m
                    if end_id is not None:
                        own = np.append(own, np.uint32(end_id))
                    if n and n + len(own) > CHUNK_IDS:
                        yield row()
                        before, chunk, n = before + n, chunk + 1, 0
                        held, keys, sizes = [], [], []
                    held.append(own)
                    keys.append(k)
                    sizes.append(len(own))
                    n += len(own)
        if keys:
            yield row()

    arrow = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
    rows.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids_crc32, ids): the decoded ids of each document as little-endian unsigned 32-bit integers.

    ``before`` counts the ids of all documents before it in the files. Each block's checksum is
    verified. The parts' totals, one number a part, pass through the driver.
    """
    chunks = spark.read.parquet(path)
    total, starts = 0, []
    for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts.append((r.part, total))
        total += r.n
    first = spark.createDataFrame(starts, "part int, part_start long")
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data = decode_ids(r["payload"]).astype("<u4").tobytes()
                ends = np.cumsum([0, *r["n_tokens"]])
                views = [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * len(views), pa.int32()),
                        pa.array(r["keys"], pa.int64()),
                        pa.array(r["before"] + ends[:-1], pa.int64()),
                        pa.array(r["n_tokens"], pa.int64()),
                        pa.array([zlib.crc32(v) for v in views], pa.int64()),
                        pa.array(views if with_ids else [None] * len(views), pa.binary()),
                    ],
                    schema=arrow,
                )

    read = chunks.mapInArrow(decode, READ_SCHEMA)
    return read.join(F.broadcast(first), "part").select("part", "doc_id", (F.col("before") + F.col("part_start")).alias("before"), "n_tokens", "ids_crc32", "ids")


def token_file_digest(df: DataFrame, tokenizer: str, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens (with the end id), ids_crc32."""
    path = path or fresh_path(df.sparkSession, "token-ids")
    write_token_files(df, path, tokenizer, text, key)
    return read_token_files(df.sparkSession, path, with_ids=False).select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")


__all__ = ["BLOCK_IDS", "CHUNK_IDS", "read_token_files", "token_file_digest", "write_token_files"]
