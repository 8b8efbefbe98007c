"""Ranked text: tokens, fuzzy matches with boosts, penalties; discovery with facets, dates and sorts."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def allowed_edits(token: str) -> int:
    """Edits that a query token may differ by."""
    return 0 if len(token) <= 2 else 1 if len(token) <= 5 else 2


def _swaps(token: str) -> list[str]:
    """The token with two neighbouring letters changed over, each way that makes another."""
    return sorted({token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)} - {token})


def _near(token: str, edits: int):
    """True for tokens within so many edits, a swap of neighbours being one; lengths are compared first."""

    def close(t: Column) -> Column:
        ok = F.levenshtein(t, F.lit(token), edits) >= 0
        if edits == 1:
            ok = ok | t.isin(_swaps(token))
        for v in _swaps(token) if edits == 2 else []:
            ok = ok | (F.levenshtein(t, F.lit(v), 1) >= 0)
        for v in sorted({w for v in _swaps(token) for w in _swaps(v)}) if edits == 2 else []:
            ok = ok | (t == v)
        return (F.abs(F.length(t) - len(token)) <= edits) & ok

    return close


def edits_of(token: Column) -> Column:
    """``allowed_edits`` of a column."""
    return F.when(F.length(token) <= 2, 0).when(F.length(token) <= 5, 1).otherwise(2)


def swaps_of(token: Column) -> Column:
    """The token with each two neighbouring letters changed over."""
    swap = lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1, F.lit(1)), F.substr(token, i, F.lit(1)), F.substr(token, i + 2))
    return F.when(F.length(token) > 1, F.transform(F.sequence(F.lit(1), F.length(token) - 1), swap)).otherwise(F.array().cast("array<string>"))


def close(word: Column, token: Column, edits: Column) -> Column:
    """True where a token is within so many edits (0 to 2) of a word, a swap of neighbours being one: ``_near`` of two columns."""
    plain = F.levenshtein(token, word) <= edits
    one = (edits >= 1) & F.exists(swaps_of(word), lambda v: (token == v) | ((edits == 2) & (F.levenshtein(token, v) <= 1)))
    two = (edits == 2) & F.exists(swaps_of(word), lambda v: F.exists(swaps_of(v), lambda u: token == u))
    return (F.abs(F.length(token) - F.length(word)) <= edits) & (plain | one | two)


def _one_edit(a: str, b: str) -> bool:
    """Whether at most one letter differs, is added or left out."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return len(b) - len(a) <= 1 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def is_close(word: str, token: str, edits: int) -> bool:
    """``close`` of one pair."""
    if abs(len(word) - len(token)) > edits:
        return False
    if word == token or edits and _one_edit(word, token):
        return True
    if not edits:
        return False
    swaps = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    if edits == 1:
        return token in swaps
    i, n = 0, min(len(word), len(token))
    while i < n and word[i] == token[i]:
        i += 1
    # Two plain edits: one at the first letter that differs, one after it.
    a, b = word[i:], token[i:]
    if _one_edit(a[1:], b[1:]) or _one_edit(a[1:], b) or _one_edit(a, b[1:]):
        return True
    return any(_one_edit(v, token) for v in swaps) or (len(word) == len(token) and any(token == v[:i] + v[i + 1] + v[i] + v[i + 2 :] for v in swaps for i in range(len(v) - 1)))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, as documents are cut."""
    return list(dict.fromkeys(regex.findall(TOKEN, query.lower())))


def text_scores(df: DataFrame, key: str, boosts: dict[str, float], query: str) -> DataFrame:
    """(key, text): each field that has a token close to a query token adds its boost, once per query token."""
    wanted = query_tokens(query)
    score = F.lit(0.0)
    for field, boost in boosts.items():
        for w in wanted:
            n = allowed_edits(w)
            hit = F.array_contains(tokens(F.col(field)), w) if n == 0 else F.exists(tokens(F.col(field)), _near(w, n))
            score = score + F.when(F.coalesce(hit, F.lit(False)), F.lit(float(boost))).otherwise(0.0)
    return df.select("*", score.alias("text")).where("text > 0") if wanted else df.select("*", F.lit(1.0).alias("text"))


def ranked(scored: DataFrame, key: str, rank: str, cluster: str | None = None, sequence: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds base (text * ln(rank + 1)) and score: halved if a better one of its cluster exists, a tenth for sequences.

    The better ones of a cluster are told by one aggregate of its best row, not by a window.
    Rows of several queries are told apart by the columns ``by``.
    """
    by = by or []
    rows = scored.withColumn("base", F.col("text") * F.log1p(F.coalesce(F.col(rank), F.lit(1.0))))
    score = F.col("base")
    if cluster:
        best = rows.where(F.col(cluster).isNotNull()).groupBy(*by, F.col(cluster).alias("_c")).agg(F.min(F.struct((-F.col("base")).alias("b"), F.col(key).alias("k"))).alias("_best"))
        rows = rows.withColumn("_c", F.col(cluster)).join(best, [*by, "_c"], "left")
        score = F.when(F.col("_best").isNotNull() & (F.col("_best.k") != F.col(key)), score / 2).otherwise(score)
    if sequence:
        score = F.when(F.coalesce(F.col(sequence), F.lit(False)), score / 10).otherwise(score)
    return rows.withColumn("score", score).drop("_c", "_best")


def top(rows: DataFrame, score: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page by score descending, then key."""
    return rows.orderBy(F.desc(score), F.asc(key)).offset(offset).limit(limit)


def keywords(display_id: Column, *labels: Column) -> Column:
    """Search words of an object: its display id with spaces for underscores, and labels; nulls left out."""
    return F.concat_ws(" ", F.translate(display_id, "_", " "), *labels)


def within(created: Column, after: str | None, before: str | None) -> Column:
    """Dates between two days, both included; bounding a date requires one."""
    ok = F.lit(True)
    if after:
        ok = ok & (created >= F.to_timestamp(F.lit(f"{after} 00:00:00")))
    if before:
        ok = ok & (created <= F.to_timestamp(F.lit(f"{before} 23:59:59")))
    return F.coalesce(ok, F.lit(False))


def discovery_page(rows: DataFrame, sort: str, key: str, descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of at most 1000 in order of a column; missing values come last either way, ties by key."""
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, F.asc(key)).offset(offset).limit(max(1, min(limit, 1000)))


def reciprocal_rank_fusion(lists: DataFrame, key: str, source: str, score: str, k: int = 60) -> DataFrame:
    """(key, score): 1 / (k + rank) added over the ranked lists of ``source``; a list's rows are ordered by range and numbered part by part, so none is one task's."""
    rows = cut(lists.select(source, key, F.col(score).alias("_s")).repartitionByRange(source, F.desc("_s"), key).withColumn("_part", F.spark_partition_id()))
    size = rows.groupBy(source, "_part").agg(F.count("*").alias("_n"))  # a row a list and part
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(source, "_part").orderBy(F.desc("_s"), key))
    placed = rows.withColumn("_r", within).join(size.select(source, "_part", before.alias("_before")), [source, "_part"])
    return placed.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("_before") + F.col("_r"))).alias("score"))
