"""The SPARQL algebra as functions from solutions to solutions; a solution is a row, a variable a column of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_blank, is_iri
from ..plans.lineage import cut


def match(quads: DataFrame, s: str, p: str, o: str, g: str | None = None) -> DataFrame:
    """Solutions of one pattern over triples or quads; ``?x`` is a variable, all else a term. A repeated variable must agree."""
    found, names = quads, {}
    for column, part in (("s", s), ("p", p), ("o", o), ("g", g)):
        if part is None:
            continue
        if not part.startswith("?"):
            found = found.where(F.col(column) == part)
        elif part[1:] in names:
            found = found.where(F.col(column) == F.col(names[part[1:]]))
        else:
            names[part[1:]] = column
    if g is not None and g.startswith("?"):
        found = found.where("g is not null")
    return found.select(*[F.col(c).alias(v) for v, c in names.items()]) if names else found.select(F.lit(True).alias("_")).limit(1).drop("_")


def bgp(quads: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """A basic graph pattern: inner joins on shared variables, in the order given; all variables are bound."""
    return reduce(join, [match(quads, *p) for p in patterns])


def star(quads: DataFrame, subject: str, predicates: dict[str, str]) -> DataFrame:
    """Patterns of one subject whose predicates are single-valued, by one aggregate instead of joins: {variable: predicate}."""
    cells = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in predicates.items()]
    rows = quads.where(F.col("p").isin(list(predicates.values()))).groupBy(F.col("s").alias(subject)).agg(*cells)
    return rows.dropna(subset=list(predicates))


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def _by_bound(df: DataFrame, keys: list[str]) -> list[tuple[frozenset, DataFrame]]:
    """``df`` in parts by which of ``keys`` are bound, those that hold rows only: [(bound keys, rows)]. It is cut, so that no part works it out again."""
    df = cut(df)
    parts = []
    for r in df.select(*[F.col(k).isNotNull().alias(k) for k in keys]).distinct().collect():  # a row a part
        holds = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if r[k] else F.col(k).isNull() for k in keys])
        parts.append((frozenset(k for k in keys if r[k]), df.where(holds)))
    return parts


def join(a: DataFrame, b: DataFrame, maybe_unbound: tuple[str, ...] = (), how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Compatible solutions joined (``inner`` or ``left``). Shared variables that may be unbound on a side are named.

    An unbound variable is compatible with anything, so each side is parted by which of those are
    bound, and each pair of parts meets in an equi join on what both bind; only parts that bind
    nothing in common, whose every pair is a solution, are crossed. A left join keeps the rows
    that no part joined.
    """
    keys = _shared(a, b)
    if not keys and condition is None and how == "inner":
        return a.crossJoin(b)
    odd = [k for k in keys if k in maybe_unbound]
    if not odd:
        return _equi(a, b, keys, keys, how, condition)
    if how == "left":
        a = cut(a.withColumn("_row", F.monotonically_increasing_id()))
        inner = join(a, b, maybe_unbound, "inner", condition)
        return inner.drop("_row").unionByName(a.join(inner.select("_row").distinct(), "_row", "left_anti").drop("_row"), allowMissingColumns=True).select(*[c for c in a.columns if c != "_row"], *[c for c in b.columns if c not in keys])
    parts, right_parts = [], _by_bound(b, odd)
    for bound_a, left in _by_bound(a, odd):
        for bound_b, right in right_parts:
            on = [k for k in keys if k not in odd or k in bound_a & bound_b]
            parts.append(_equi(left, right, keys, on, "inner", condition))
    return reduce(lambda x, y: x.union(y), parts) if parts else _equi(a, b, keys, keys, "inner", condition)


def _equi(a: DataFrame, b: DataFrame, keys: list[str], on: list[str], how: str, condition: Column | None) -> DataFrame:
    a, b = a.alias("a"), b.alias("b")
    match_on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], F.lit(True) if condition is None else condition)
    left = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in keys else F.col(f"a.{c}") for c in a.columns]
    return a.join(b, match_on, how).select(*left, *[F.col(f"b.{c}") for c in b.columns if c not in keys])


def optional(a: DataFrame, b: DataFrame, condition: Column | None = None, maybe_unbound: tuple[str, ...] = ()) -> DataFrame:
    """OPTIONAL: ``condition`` (on columns of ``a.`` and ``b.``) is part of the join, so rows it refuses stay, unbound."""
    return join(a, b, maybe_unbound, "left", condition)


def union(*parts: DataFrame) -> DataFrame:
    """UNION: a bag; variables that a part lacks are unbound there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def minus(a: DataFrame, b: DataFrame, maybe_unbound: tuple[str, ...] = ()) -> DataFrame:
    """MINUS: drops solutions compatible with one of ``b`` that shares a bound variable; without shared variables nothing goes."""
    keys = _shared(a, b)
    if not keys:
        return a
    if not maybe_unbound:
        return a.join(b.select(*keys).distinct(), keys, "left_anti")
    odd = [k for k in keys if k in maybe_unbound]
    rest, right_parts = [], _by_bound(b, odd)
    for bound_a, left in _by_bound(a, odd):
        for bound_b, right in right_parts:
            on = [k for k in keys if k not in odd or k in bound_a & bound_b]
            if on:  # parts that bind nothing in common share no bound variable
                left = left.join(right.select(*on).distinct(), on, "left_anti").select(*a.columns)
        rest.append(left)
    return reduce(lambda x, y: x.union(y), rest) if rest else a


def exists(a: DataFrame, b: DataFrame, negate: bool = False, condition: Column | None = None) -> DataFrame:
    """FILTER (NOT) EXISTS: semi or anti join on the shared variables; ``condition`` is on columns of ``a.`` and ``b.``."""
    keys = _shared(a, b)
    how = "left_anti" if negate else "left_semi"
    if condition is None and keys:
        return a.join(b.select(*keys).distinct(), keys, how)
    left, right = a.alias("a"), b.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.lit(True) if condition is None else condition)
    return left.join(right, on, how)


def exists_greater(a: DataFrame, b: DataFrame, left: Column, right: Column, negate: bool = False) -> DataFrame:
    """FILTER (NOT) EXISTS with one condition: ``right``, a number of ``b``, greater than ``left``, one of ``a``; null on either side is no match.

    Some number is greater if the greatest is, so ``b`` is reduced to that, a row a binding of the
    shared variables, and what is joined grows with the rows of both sides rather than with their
    pairs. NaN is read as SPARQL does: greater than nothing, and nothing greater than it.
    """
    keys = _shared(a, b)
    number = right.cast("double")
    most = b.select(*keys, F.when(~F.isnan(number), right).alias("_most")).groupBy(*keys).agg(F.max("_most").alias("_most"))
    rows = a.withColumn("_than", left)
    on = (F.col("_most") > F.col("_than")) & ~F.isnan(F.col("_than").cast("double"))
    for k in keys:
        on = on & (rows[k] == most[k])
    return rows.join(most, on, "left_anti" if negate else "left_semi").drop("_than")


def values(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """VALUES: an inline table; None is unbound, and no rows are no solutions."""
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def edges(quads: DataFrame, *predicates: str, inverse: bool = False, negate: bool = False) -> DataFrame:
    """(x, y) pairs of a path step: one predicate, an alternative, its inverse, or any but the named."""
    chosen = F.col("p").isin(list(predicates))
    pairs = quads.where(~chosen if negate else chosen).select(F.col("s").alias("x"), F.col("o").alias("y"))
    return pairs.select(F.col("y").alias("x"), F.col("x").alias("y")) if inverse else pairs


def sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Path ``a/b``: a bag of pairs."""
    middle = second.select(F.col("x").alias("y"), F.col("y").alias("_end"))
    return first.join(middle, "y").select("x", F.col("_end").alias("y"))


def one_or_more(pairs: DataFrame, from_: DataFrame | None = None, to: DataFrame | None = None) -> DataFrame:
    """Path ``a+``: distinct pairs, semi-naive: only pairs that the last round found are led one step on.

    ``from_`` or ``to`` (first column) hold the nodes that one end may be; the walk then starts
    from them, and never makes the pairs of other ends.
    """
    if to is not None and from_ is None:
        back = one_or_more(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")), from_=to)
        return back.select(F.col("y").alias("x"), F.col("x").alias("y"))
    steps = cut(pairs.select("x", "y").distinct())
    front = steps if from_ is None else cut(steps.join(from_.select(F.col(from_.columns[0]).alias("x")).distinct(), "x", "left_semi").select("x", "y"))
    reached = front
    while not front.isEmpty():
        front = cut(sequence(front, steps).distinct().join(reached, ["x", "y"], "left_anti"))
        reached = cut(reached.union(front))
    return reached if to is None else reached.join(to.select(F.col(to.columns[0]).alias("y")).distinct(), "y", "left_semi").select("x", "y")


def zero_or_more(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path ``a*``: ``a+`` and every node of ``nodes`` (its first column) with itself."""
    return one_or_more(pairs).union(_selves(nodes)).distinct()


def zero_or_one(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path ``a?``."""
    return pairs.select("x", "y").union(_selves(nodes)).distinct()


def _selves(nodes: DataFrame) -> DataFrame:
    n = F.col(nodes.columns[0])
    return nodes.select(n.alias("x"), n.alias("y"))


def construct(solutions: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """CONSTRUCT: distinct triples of the template; those with an unbound or ill-placed term are left out."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    parts = [solutions.select(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]
    triples = reduce(lambda x, y: x.union(y), parts)
    return triples.where((is_iri(F.col("s")) | is_blank(F.col("s"))) & is_iri(F.col("p")) & F.col("o").isNotNull()).distinct()


def ask(solutions: DataFrame) -> DataFrame:
    """ASK: one row, whether there is a solution."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def describe(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """DESCRIBE: the triples of ``resources`` (first column) as subjects, and those of blank nodes reached from them."""
    triples = quads.select("s", "p", "o").distinct()
    front = resources.select(F.col(resources.columns[0]).alias("s")).distinct()
    found = cut(triples.join(front, "s", "left_semi"))
    seen = front
    while True:
        blanks = found.where(is_blank(F.col("o"))).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti")
        blanks = cut(blanks)
        if blanks.isEmpty():
            return found.distinct()
        seen = cut(seen.union(blanks))
        found = cut(found.union(triples.join(blanks, "s", "left_semi")))


def aggregate(solutions: DataFrame, by: list[str], **cells: Column) -> DataFrame:
    """GROUP BY with aliased aggregates; without keys, no solutions still make one row."""
    return solutions.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def total(value: Column) -> Column:
    """SUM: 0 of nothing."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def mean(value: Column) -> Column:
    """AVG: 0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def sample(value: Column) -> Column:
    """SAMPLE: any value; here the least, so that it is the same in every run."""
    return F.min(value)


def total_distinct(value: Column) -> Column:
    """SUM(DISTINCT)."""
    return F.coalesce(F.sum_distinct(value), F.lit(0.0))


def mean_distinct(value: Column) -> Column:
    """AVG(DISTINCT)."""
    return F.coalesce(F.try_divide(F.sum_distinct(value), F.count_distinct(value)), F.lit(0.0))


def group_concat(value: Column, separator: str = " ", distinct: bool = False) -> Column:
    """GROUP_CONCAT, sorted, so that it is the same in every run."""
    gathered = F.collect_set(value) if distinct else F.collect_list(value)
    return F.array_join(F.array_sort(gathered), separator)


def slice_(solutions: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """ORDER BY, OFFSET, LIMIT."""
    rows = solutions.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


