"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into segments on a ring. Two that differ in at most t bits have a segment
from which every chain of consecutive segments stays within its proportional share of t, so
candidates are looked up by a segment they share and dropped once a chain from it exceeds its
share; only the rest meet the full Hamming check.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import cut
from .chunks import slices
from .ngrams import mix, word_hashes

#: Distinct fingerprints that share a chain's key are compared in pairs up to this number; larger groups go by midpoints.
PAIRED = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half the rows of ``hashes`` (n, words) uint64; no rows: zero."""
    n, words = hashes.shape
    at = hashes.view(np.uint8).reshape(n, words * 8).astype(np.int64) + 256 * np.arange(words * 8)
    sums = np.bincount(at.ravel(), minlength=words * 8 * 256).reshape(words * 8, 256) @ _BITS
    return np.packbits((2 * sums > n).astype(np.uint8), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([[xxhash.xxh64_intdigest(joined, seed)]] if words else np.zeros((0, 1)), np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64)[:, None]


def fingerprints(df: DataFrame, size: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp: the 64-bit SimHash, as a signed long, of a text's word shingles, repeats included.

    A-Z are lower-cased; words are parted by space and \\t to \\r; a shingle is ``size`` words
    joined by a space, hashed by XXH64 of ``seed``. Fewer words make one shingle; none, and a null
    text, give 0.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                fp = [int(majority(_shingle_hashes(t, size, seed))[0].astype(np.int64)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(compute, "doc_id long, fp long")


def _segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


#: Segments of the ring for one and for two differing bits.
RING = {1: 4, 2: 6}


def chain_keys(most: int) -> list[tuple[int, int]]:
    """[(start, mask)]: the bits that two fingerprints within ``most`` bits share on one of these masks at least.

    On a ring of m segments, some start has chains of every length l with at most l * most / m
    differing bits. Its first chains then hold no difference, and in the chain of m - 1 segments
    all but ``most`` - 1 are equal: a mask is one choice of the segments that are.
    """
    m = RING[most]
    width = [64 // m + (i < 64 % m) for i in range(m)]
    low = [sum(width[:i]) for i in range(m)]
    part = [(1 << w) - 1 << b for w, b in zip(width, low, strict=True)]
    clear = sum(most * n // m == 0 for n in range(1, m))
    keys = []
    for i in range(m):
        after = [(i + n) % m for n in range(clear, m - 1)]
        for odd in combinations(after, most - 1):
            keys.append((i, sum(part[s] for s in [*[(i + n) % m for n in range(clear)], *[s for s in after if s not in odd]])))
    return keys


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def link_fingerprints(fps: DataFrame, most: int = 2) -> DataFrame:
    """(src, dst): links whose components are those of all pairs of ``fp`` that differ in at most ``most`` (1 or 2) bits.

    Candidates share the bits of a viable chain (``chain_keys``: 43 bits for two differing ones,
    48 for one), so a group is small unless many fingerprints agree in all of those; pairs of a group are checked
    chain by chain, then whole. Only a group of more than ``PAIRED`` distinct fingerprints makes
    no pairs: its members are tied to every word one bit away, as two within two bits have such a
    word, or one another, in common. That is exact too, and keeps rows in proportion to the
    fingerprints where thousands agree in 43 bits. Such a word may stand as a node of its own.
    """
    if most not in RING:
        raise ValueError("most must be 1 or 2")
    m = RING[most]
    width = [64 // m + (i < 64 % m) for i in range(m)]
    low = [sum(width[:i]) for i in range(m)]
    keys = chain_keys(most)
    distinct = fps.select("fp").distinct()
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for n, (i, mask) in enumerate(keys)])).alias("s")).select("fp", "s.*")
    groups = rows.groupBy("key", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(groups, ["key", "v"]))

    a = shared.where(F.col("n") <= PAIRED).select("key", "i", "v", F.col("fp").alias("src"))
    b = shared.where(F.col("n") <= PAIRED).select("key", "v", F.col("fp").alias("dst"))
    diff = F.col("src").bitwiseXOR(F.col("dst"))
    count = [F.bit_count(_segment(diff, low[i], width[i])) for i in range(m)]
    viable = F.lit(False)
    for i in range(m):
        chain, ok = F.lit(0), F.lit(True)
        for n in range(1, m):
            chain = chain + count[(i + n - 1) % m]
            ok = ok & (chain <= F.lit(most * n // m))
        viable = viable | ((F.col("i") == i) & ok)
    pairs = a.join(b, ["key", "v"]).where((F.col("src") < F.col("dst")) & viable & (F.bit_count(diff) <= most)).select("src", "dst")

    crowded = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    near = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)]]
    balls = crowded.select("fp", F.explode(F.array(*near)).alias("word"))
    if most == 1:
        tied = balls.join(crowded.select(F.col("fp").alias("word")), "word", "left_semi").select(F.col("fp").alias("src"), F.col("word").alias("dst"))
    else:
        met = balls.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
        tied = balls.join(met, "word", "left_semi").select(F.col("fp").alias("src"), F.col("word").alias("dst"))
    return pairs.union(tied.where("src <> dst"))


def near_duplicates(df: DataFrame, size: int = 3, most: int = 2, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, its own included).

    Null, empty and repeated texts are linked like any other by their fingerprints; repeated keys
    keep their rows; null keys are not a smallest id unless alone. Other columns are not read.
    """
    fps = cut(fingerprints(df, size, seed, text, key))
    return _labelled(fps, "fp", connected_components(link_fingerprints(fps, most)))


def _labelled(rows: DataFrame, node: str, components: DataFrame) -> DataFrame:
    """``rows`` with component_id: the smallest doc_id whose ``node`` is in the same component."""
    least = rows.groupBy(node).agg(F.min("doc_id").alias("first"))
    part = least.join(components.withColumnRenamed("node", node), node, "left").select(node, "first", F.coalesce("component", node).alias("component"))
    named = part.groupBy("component").agg(F.min("first").alias("component_id"))
    names = cut(part.join(named, "component").select(node, "component_id"))
    return rows.join(names, node).select(*rows.columns, "component_id")


# Wide fingerprints: similar, not only nearly equal, sets of shingles.

#: 64-bit words of a wide fingerprint, and bits of a segment of its ring.
WORDS, SEGMENT_BITS = 8, 2
#: Words of the chain that follows a start. Seven were tried: they leave out a seventh of the pairs, for two fifths more to be shuffled.
CHAIN = 4
#: Fingerprints that a start should hold on average, as a power of two; the bits of a start follow from it and their number.
START_ROWS_LOG2 = 5
#: Bits that a start of the first pass, in which all meet one leader, has more; and its starts.
LEAD_BITS, LEAD_STARTS = 10, 20
#: Chance aimed at that a pair at the threshold shares a start.
RECALL = 0.99
#: Standard errors added to the bits that are expected to differ: one pair at the threshold of a thousand is beyond.
ERRORS = 3
#: Members from which a group joined so far is large: rows of other large groups first meet one of its members in each long start.
LARGE = 128
#: Rows that a fingerprint meets over all long starts, itself included, from which its parities go with its starts.
CROWDED = 100
#: Fingerprints whose keys are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_BITS_IN_ALL = WORDS * 64
_W = [f"w{i}" for i in range(WORDS)]
_C = [f"c{i}" for i in range(CHAIN)]
_O = [f"o{i}" for i in range(WORDS)]
_PAIR = ["node", "other_node as other", "part", "other_part"]


def rate(similarity: float) -> float:
    """The share of bits expected to differ between fingerprints of sets of that Jaccard similarity and like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differing(similarity: float) -> int:
    """Bits that differ at most: those expected and ``ERRORS`` standard errors, so that nearly all such pairs are within."""
    p = rate(similarity)
    return round(_BITS_IN_ALL * p + ERRORS * math.sqrt(_BITS_IN_ALL * p * (1 - p)))


def start_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(bits of a start, starts) for so many distinct fingerprints: starts hold few rows whatever the table's size, and enough of them are tried for ``RECALL``."""
    bits = min(48, max(8, SEGMENT_BITS * round((math.log2(max(rows, 2)) - START_ROWS_LOG2) / SEGMENT_BITS)))
    same = (1 - rate(similarity)) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def _ring(r: int) -> np.ndarray:
    """The order of the bits on ring ``r``."""
    segments = np.random.default_rng(r).permutation(_BITS_IN_ALL // SEGMENT_BITS) if r else np.arange(_BITS_IN_ALL // SEGMENT_BITS)
    return (segments[:, None] * SEGMENT_BITS + np.arange(SEGMENT_BITS)).ravel()


def _shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The distinct 64-bit hashes of each text's word shingles, ascending; as above, but with a vectorised hash."""
    h, count = word_hashes([(t or "").encode().lower() for t in texts])
    ends = np.cumsum(count)
    for e, n in zip(ends.tolist(), count.tolist(), strict=True):
        own = h[e - n : e]
        span = min(size, n)
        rolled = np.zeros(max(n - span + 1, 0) if n else 0, np.uint64)
        for j in range(span):
            rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[j : j + len(rolled)]
        yield np.unique(rolled)


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether the set holds an odd number of it, as words."""
    odd = np.bincount((shingles >> np.uint64(64 - int(math.log2(_BITS_IN_ALL)))).astype(np.int64), minlength=_BITS_IN_ALL) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_fingerprints(df: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, node, w0, w1, ..., n, o0, o1, ...: a digest of the set of word shingles, the words of its SimHash, its size and its parities."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, WORDS + 1, dtype=np.uint64))
        for batch in batches:
            for part, texts in slices(batch, "text"):
                node, fp, n, odd = [], [], [], []
                for shingles in _shingle_sets(texts, size):
                    node.append(_set_id(shingles))
                    fp.append(majority(mix(shingles[:, None] + salt)))
                    n.append(len(shingles))
                    odd.append(_parities(shingles))
                columns = lambda x: [pa.array(np.ascontiguousarray(c)) for c in np.stack(x).view(np.int64).T] if x else [pa.array([], pa.int64())] * WORDS
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node, pa.int64()), *columns(fp), pa.array(n, pa.int64()), *columns(odd)], names=["doc_id", "node", *_W, "n", *_O])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(compute, ", ".join(f"{c} long" for c in ("doc_id", "node", *_W, "n", *_O)))


_ODD = f"struct<{', '.join(f'{c}: long' for c in ('n', *_O))}>"


def _starts(nodes: DataFrame, bits: int, starts: int, first_ring: int) -> DataFrame:
    """start, node, part, odd, c0, c1, ...: a row a start, by ``bits`` consecutive bits of a ring, with the ``CHAIN`` words that follow on the ring."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _BITS_IN_ALL // bits
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            words = np.stack([np.array(batch.column(w)) for w in _W], 1)
            for r in range(-(-starts // each)):
                flat = np.unpackbits(words.view(np.uint8).reshape(n, WORDS * 8), axis=1, bitorder="little")[:, _ring(first_ring + r)]
                flat = np.concatenate([flat, flat], 1)
                for i in range(min(each, starts - r * each)):
                    at = i * bits
                    start = flat[:, at : at + bits] @ powers | np.int64(r * each + i) << np.int64(bits)
                    chain = np.ascontiguousarray(np.packbits(flat[:, at + bits : at + bits + CHAIN * 64], axis=1, bitorder="little")).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(start), batch.column("node"), batch.column("part"), batch.column("odd"), *[pa.array(chain[:, j].copy()) for j in range(CHAIN)]], names=["start", "node", "part", "odd", *_C])

    return nodes.select("node", "part", "odd", *_W).mapInArrow(cut_out, f"start long, node long, part long, odd {_ODD}, " + ", ".join(f"{c} long" for c in _C))


def _chain_holds(bits: int, most: int) -> Column:
    """Whether the chain of segments after a shared start of ``bits`` bits stays within its proportional share of ``most`` at 16, 32 and 64 bits and after each further word."""
    odd = [F.col(c).bitwiseXOR(F.col(f"other_{c}")) for c in _C]
    low = lambda w, n: F.bit_count(w.bitwiseAND(F.lit((1 << n) - 1)))
    upto = {16: low(odd[0], 16), 32: low(odd[0], 32)}
    count = F.lit(0)
    for i, w in enumerate(odd):
        count = count + F.bit_count(w)
        upto[64 * (i + 1)] = count
    ok = F.lit(True)
    for n, differ in upto.items():
        ok = ok & (differ <= F.lit((bits + n) * most // _BITS_IN_ALL))
    return ok


def _parities_hold(similarity: float, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two sets may have that similarity: each class of different parity holds a shingle that only one of them has, and they have at most (1 - s) / (1 + s) of their sizes' sum. So no pair is lost."""
    odd = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in _O), F.lit(0))
    return odd * (1 + similarity) <= (a("n") + b("n")) * (1 - similarity) + 1e-6


def _near(pairs: DataFrame, words: DataFrame, most: int, similarity: float) -> DataFrame:
    """The ``pairs`` (node, other, ...) with ``apart``: the full Hamming distance, at most ``most``; pairs whose parities rule out the similarity are left out."""
    held = [*_W, "n", *_O]
    other = words.select(F.col("node").alias("other"), *[F.col(w).alias(f"other_{w}") for w in held])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in _W), F.lit(0))
    alike = _parities_hold(similarity, F.col, lambda c: F.col(f"other_{c}"))
    return pairs.join(words.select("node", *held), "node").join(other, "other").withColumn("apart", apart).where((F.col("apart") <= most) & alike).select(*pairs.columns, "apart")


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(src, dst): the ``pairs`` (node, other) whose sets have a Jaccard similarity of ``similarity`` or more, by the texts of ``docs``. Sets travel as 32 bits a shingle."""
    wanted = cut(pairs.select("node").distinct().union(pairs.select(F.col("other").alias("node")).distinct()).distinct().join(distinct.select("node", "first"), "node"))
    ids = wanted.select("first").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = list(_shingle_sets(texts, size))
                short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in found], pa.int64()), pa.array(short, pa.binary())], names=["node", "shingles"])

    none = F.lit(-(2**63))  # stands for a null key, so that the join has one plain key; what it lets in besides is left out below
    read = docs.join(ids, F.coalesce("doc_id", none) == F.coalesce("first", none), "left_semi").select("text").mapInArrow(sets, "node long, shingles binary")
    held = cut(read.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.select("node", "other").join(held.withColumnRenamed("shingles", "a"), "node").join(held.select(F.col("node").alias("other"), F.col("shingles").alias("b")), "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                small, large = sorted((len(a), len(b)))
                common = len(np.intersect1d(a, b, assume_unique=True)) if small >= similarity * large else 0
                fine.append(common > 0 and common >= similarity * (len(a) + len(b) - common))
            mask = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(mask), batch.column("other").filter(mask)], names=["src", "dst"])

    return both.select("node", "other", "a", "b").mapInArrow(check, "src long, dst long")


def _grouped(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """node, part, large, the words: each fingerprint with its group so far, the least node; large if it has over ``LARGE`` members."""
    joined = connected_components(links)
    parts = distinct.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("part"), *_W)
    large = parts.groupBy("part").count().where(F.col("count") > LARGE).select("part", F.lit(True).alias("large"))
    return cut(parts.join(large, "part", "left").select(*parts.columns, F.coalesce("large", F.lit(False)).alias("large")))


def _met_large(shared: DataFrame, parts: DataFrame, distinct: DataFrame, most: int, similarity: float) -> DataFrame:
    """(node, other): of one member of each large group in each start of ``shared``, the nearest to each row of another large group that shares the start."""
    placed = shared.select("start", "node").join(parts.where("large").select("node", "part"), "node")
    one = placed.groupBy("start", F.col("part").alias("other_part")).agg(F.min_by("node", F.xxhash64("node", "start")).alias("other"))
    pairs = placed.join(one, "start").where("part <> other_part").select("node", "other", "other_part").distinct()
    return _near(pairs, distinct, most, similarity).groupBy("node", "other_part").agg(F.min_by("other", F.struct("apart", "other")).alias("other")).select("node", "other")


def similar_documents(df: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, component_id: groups of texts linked by a Jaccard similarity of ``similarity`` or more of their sets of word shingles.

    Candidates come from wide SimHash by pigeonring: two fingerprints that share a start of
    consecutive segments go on if the chain from it stays within its share of the bits that may
    differ, then meet the full Hamming check, and last the shingles themselves (their hashes), so
    no pair below the similarity links. Texts of one set are alike at once.

    First, all that share a long start meet one of them, the one that meets most in all starts,
    which joins most copies of a large group by links in proportion to the rows. Then the rows of
    large groups (``LARGE``) meet one member of each other one in each long start. That only
    spares work: then all that share a start meet, large groups too, but for those in one group
    already. Where a fingerprint meets many (``CROWDED``), the parities of its shingles go with its
    starts, which tell 0.7 from 0.8 where SimHash does not, without loss. Of
    the candidates between two groups the nearest is verified first, and then all that are still
    in different ones. No start is capped; its bits and their number follow from the number of
    fingerprints, so that starts stay small and ``RECALL`` holds at every size. The rows of starts
    grow with about the 1.24th power of the table at 0.8. Where large groups hold many pairs just
    below the similarity and no link, those grow with the product of their sizes.

    Null and empty texts are alike. Null keys are no smallest id unless alone; rows of one key
    keep their own texts.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fps = cut(wide_fingerprints(df, size, text, key))
    distinct = cut(fps.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(w).alias(w) for w in (*_W, "n", *_O)]))
    bits, starts = start_plan(distinct.count(), similarity)
    most = differing(similarity)

    made = _starts(distinct.withColumn("part", F.col("node")).withColumn("odd", F.lit(None).cast(_ODD)), bits + LEAD_BITS, LEAD_STARTS, 0).select("start", "node")
    shared = cut(made.join(made.groupBy("start").agg(F.count("*").alias("n")).where("n > 1"), "start"))
    met_in_all = cut(shared.groupBy("node").agg(F.struct(F.sum("n").alias("met"), F.xxhash64("node").alias("h"), "node").alias("x")))
    leaders = shared.join(met_in_all, "node").groupBy("start").agg(F.max("x")["node"].alias("other"))
    led = cut(_near(shared.join(leaders, "start").where("node <> other").select("node", "other").distinct(), distinct, most, similarity))
    links = cut(_verified(led, distinct, docs, size, similarity))

    renamed = lambda rows: rows.select("start", *[F.col(c).alias(f"other_{c}") for c in ("node", "part", "odd", *_C)])
    fits = _chain_holds(bits, most) & F.coalesce(_parities_hold(similarity, lambda c: F.col("odd")[c], lambda c: F.col("other_odd")[c]), F.lit(True))
    met = lambda rows, others: rows.join(renamed(others), "start").where((F.col("part") != F.col("other_part")) & fits)
    starts_of = lambda rows: _starts(rows, bits, starts, 0)

    parts = _grouped(distinct, links)
    if parts.where("large").select("part").distinct().count() > 1:
        links = cut(links.union(_verified(cut(_met_large(shared, parts, distinct, most, similarity)), distinct, docs, size, similarity)))
        parts = _grouped(distinct, links)
    crowded = met_in_all.where(F.col("x.met") >= CROWDED).select("node")
    parts = cut(parts.join(distinct.join(crowded, "node", "left_semi").select("node", F.struct("n", *_O).cast(_ODD).alias("odd")), "node", "left"))

    few = starts_of(parts.where("not large"))
    pairs = met(few, few).where("node < other_node").selectExpr(*_PAIR)
    if not parts.where("large").isEmpty():
        great = starts_of(parts.where("large"))
        held = great.select("start", "part").distinct()
        facing = held.join(held.withColumnRenamed("part", "other_part"), "start").where("part < other_part")
        between_large = great.join(facing, ["start", "part"]).join(renamed(great), ["start", "other_part"]).where(fits)
        pairs = pairs.union(met(great, few).selectExpr(*_PAIR)).union(between_large.selectExpr(*_PAIR))
    rest = cut(_near(cut(pairs.distinct()), distinct, most, similarity))

    between = [F.least("part", "other_part"), F.greatest("part", "other_part")]
    nearest = rest.groupBy(*between).agg(F.min_by(F.struct("node", "other"), F.struct("apart", "node", "other")).alias("s")).select("s.*")
    links = cut(links.union(_verified(nearest, distinct, docs, size, similarity)))
    joined = cut(connected_components(links))
    ends = rest.select("node", "other").join(joined, "node", "left").withColumnRenamed("component", "c").join(joined.withColumnRenamed("node", "other"), "other", "left")
    apart = cut(ends.where(F.coalesce("c", "node") != F.coalesce("component", "other")).select("node", "other"))
    if not apart.isEmpty():
        joined = connected_components(links.union(_verified(apart, distinct, docs, size, similarity)))
    return _labelled(fps.select("doc_id", "node"), "node", joined).select("doc_id", "component_id")
