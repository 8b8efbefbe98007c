"""Substring dedup: repeated sentences and lines, by normalised digests grouped over the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .chunks import slices

#: Words that a run of repeated units must hold to be removed.
MIN_WORDS = 10
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")

UNITS = "doc_id long, unit int, start int, end int, words int, d1 long, d2 int, again boolean"
SPAN = "array<struct<start: int, end: int>>"


def split_units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the units that lie between line ends and white space after a sentence's end; characters from 0."""
    at = 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def units(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each unit that has a word, with a 96-bit digest of its lower-cased words; ``again`` if the same document has it before."""
    schema = pa.schema([("doc_id", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("d1", pa.int64()), ("d2", pa.int32()), ("again", pa.bool_())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = []
                for k, t in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    seen, i = set(), 0
                    for a, b in split_units(t or ""):
                        words = t[a:b].lower().split()
                        if words:
                            d = xxhash.xxh3_128_intdigest(" ".join(words).encode())
                            rows.append((k, i, a, b, len(words), (d & (1 << 64) - 1) - (1 << 63), (d >> 64 & (1 << 32) - 1) - (1 << 31), d in seen))
                            seen.add(d)
                            i += 1
                columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rank = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    return df.select(rank.alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(split, UNITS)


def repeated_spans(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, spans: for each document with any, the runs of units to remove, in order of start.

    A unit repeats if a document of smaller key, or an earlier place of its own, holds the same
    words. Runs of consecutive repeating units with at least ``min_words`` words together are
    spans from the first's start to the last's end. The digests are counted with partial
    aggregates, and only those in more than one document are joined back to their units.
    """
    all_units = units(df, text, key)
    first = all_units.where("not again").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    first = cut(first)  # the join then shuffles both sides itself, and may split a very common unit
    place = F.struct("unit", "start", "end", "words")
    repeated = all_units.join(first, ["d1", "d2"], "left").where("again or doc_id > first").select("doc_id", place.alias("u"))
    listed = repeated.groupBy("doc_id").agg(F.sort_array(F.collect_set("u")).alias("units"))  # no more than a document's own units

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = [], []
            for k, found in zip(batch.column("doc_id").to_pylist(), batch.column("units"), strict=True):
                out, words, last = [], 0, None
                for u in found.as_py():
                    if last is not None and u["unit"] == last + 1:
                        out[-1]["end"] = u["end"]
                        words += u["words"]
                    else:
                        if out and words < min_words:
                            out.pop()
                        out.append({"start": u["start"], "end": u["end"]})
                        words = u["words"]
                    last = u["unit"]
                if out and words < min_words:
                    out.pop()
                if out:
                    keys.append(k)
                    spans.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "spans"])

    return listed.mapInArrow(runs, f"doc_id long, spans {SPAN}")


def remove_repeats(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", spans: str = "removed") -> DataFrame:
    """``df`` with ``text`` freed from repeats and ``spans``: what was removed, as offsets in the characters of the original.

    The earliest document by key keeps its units, a null key ranking last. Rows of one key count
    as one document if their texts are equal; of different texts, units are told apart by place
    alone, so keys should be unique. A null text stays null; an emptied one is ''. A column named
    ``spans`` is replaced; others are kept. Empty table: no rows.
    """
    names = [c for c in df.columns if c != spans]
    found = repeated_spans(df, min_words, text, key).select(F.col("doc_id").alias("_rank"), F.col("spans").alias("_spans"))
    rows = df.select(*[F.col(f"`{c}`") for c in names]).withColumn("_rank", F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)))

    @F.pandas_udf("string")
    def cut_out(texts, found):
        import pandas as pd

        out = []
        for t, s in zip(texts, found, strict=True):
            if t is not None and s is not None and len(s):
                at, kept = 0, []
                for a, b in zip(s[::2], s[1::2], strict=True):
                    kept.append(t[at:a])
                    at = max(at, b)
                t = "".join([*kept, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = rows.join(found, "_rank", "left")
    kept = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut_out(F.col(text), F.flatten(F.transform("_spans", lambda x: F.array(x["start"], x["end"])))))
    return joined.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in names], F.coalesce("_spans", F.from_json(F.lit("[]"), SPAN)).alias(spans))
