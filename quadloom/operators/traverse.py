"""Traversal: neighbourhoods, closures, the link graph and PageRank, level by level over edge joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE
from ..plans.lineage import cut, stored


def _steps(quads: DataFrame, direction: str, predicates: list[str] | None) -> DataFrame:
    e = quads if predicates is None else quads.where(F.col("p").isin(predicates))
    e = e.where(~F.col("o").startswith('"')).select("s", "o").distinct()
    forward, backward = e.select(F.col("s").alias("a"), F.col("o").alias("b")), e.select(F.col("o").alias("a"), F.col("s").alias("b"))
    return {"forward": forward, "backward": backward, "both": forward.union(backward).distinct()}[direction]


def neighborhood(quads: DataFrame, root: str, depth: int = 1, direction: str = "both", predicates: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps with their least depth. ``max_nodes`` keeps those nearest, then least."""
    steps = cut(_steps(quads, direction, predicates))
    seen = quads.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    front = seen
    for d in range(1, depth + 1):
        reached = front.select(F.col("node").alias("a")).join(steps, "a").select(F.col("b").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen if max_nodes is None else seen.orderBy("depth", "node").limit(max_nodes)


def neighborhood_edges(quads: DataFrame, nodes: DataFrame, literals: bool = False) -> DataFrame:
    """Triples between nodes found, and with ``literals`` those from a node to a literal, which never widen the walk."""
    ids = nodes.select("node")
    from_ = quads.join(ids.withColumnRenamed("node", "s"), "s", "left_semi").select("s", "p", "o").distinct()
    inner = from_.join(ids.withColumnRenamed("node", "o"), "o", "left_semi").select("s", "p", "o")
    return inner.union(from_.where(F.col("o").startswith('"'))) if literals else inner


def decorated(nodes: DataFrame, quads: DataFrame, labels: list[str]) -> DataFrame:
    """``nodes`` with ``class`` and ``label`` of IRI nodes: the least type and the least value of the first of ``labels`` there."""
    known = quads.where(F.col("p").isin([RDF_TYPE, *labels])).groupBy(F.col("s").alias("node"))
    of = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    cards = known.agg(of(RDF_TYPE).alias("class"), F.coalesce(*[of(p) for p in labels], F.lit(None).cast("string")).alias("label")).where(F.col("node").startswith("<"))
    return nodes.join(cards, "node", "left")


def collection_download(quads: DataFrame, collection: str, top_level: str, member: str) -> DataFrame:
    """Triples of a collection and of all whose top level is one of its members: two joins in place of a walk."""
    triples = quads.select("s", "p", "o").distinct()
    held = triples.where((F.col("s") == collection) & (F.col("p") == member)).select(F.col("o").alias("t"))
    below = triples.where(F.col("p") == top_level).join(held, F.col("o") == F.col("t"), "left_semi").select("s")
    return triples.where(F.col("s") == collection).union(triples.join(below.where(F.col("s") != collection).distinct(), "s", "left_semi"))


def closure(quads: DataFrame, seeds: DataFrame, prefix: str | None = None, without: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """(node): what the seeds (first column) reach, only IRIs under ``prefix`` or one of ``prefixes`` if given, never over the predicates of ``without``."""
    allowed = [prefix] if prefix else prefixes
    e = quads.where(~F.col("p").isin(without)) if without else quads
    e = e.where(reduce(lambda a, b: a | b, [F.col("o").startswith("<" + p) for p in allowed]) if allowed else ~F.col("o").startswith('"')).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    e = cut(e)
    front = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct())
    seen = front
    while True:
        reached = front.select(F.col("node").alias("a")).join(e, "a").select(F.col("b").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def link_graph(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): distinct links between nodes (first column) in one or two steps; self-links stay."""
    n = nodes.select(F.col(nodes.columns[0]).alias("n")).distinct()
    e = quads.where(~F.col("o").startswith('"')).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    first = e.join(n.withColumnRenamed("n", "a"), "a", "left_semi")
    second = first.select("a", F.col("b").alias("m")).join(e.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
    return first.select("a", "b").union(second).join(n.withColumnRenamed("n", "b"), "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(node, rank): ranks sum to 1; dangling mass is spread evenly; stops when the ranks move by ``tolerance`` in all.

    The links are a set and ends outside ``nodes`` are ignored. Nodes are numbered once, so that a
    round joins, sums and stores numbers, whatever the length of the names; it is a join and an
    aggregate with partial sums, and one number a round goes to the driver.
    """
    n = stored(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    count = n.count()
    if not count:
        return n.select("node", F.lit(0.0).alias("rank"))
    numbered = lambda c: n.select(F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    e = stored(links.select("src", "dst").join(numbered("src"), "src").join(numbered("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "links")
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    state = stored(n.select("id").join(degree, "id", "left").select("id", "degree", F.lit(1.0 / count).alias("rank")), "ranks")
    lost = state.where("degree is null").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(rounds):
        part = state.where("degree is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part"))
        share = e.join(part, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        base = (1 - damping) / count + damping * lost / count
        state2 = stored(state.join(share, "id", "left").select("id", "degree", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")), "ranks")
        whole, lost, moved = state2.agg(F.sum("rank"), F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
        lost = lost / whole
        state = state2.select("id", "degree", (F.col("rank") / F.lit(whole)).alias("rank"))
        if moved <= tolerance:
            break
    return n.join(state, "id").select("node", "rank")
