"""Derived views over quads: object metadata, members and root members, object lists, counts and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, is_iri, str_


@dataclass(frozen=True)
class Vocabulary:
    """The predicates that the views read."""

    display_id: str
    title: str
    description: str
    role: str
    creator: str
    top_level: str
    member: str
    type: str = RDF_TYPE
    version: str = ""


def object_metadata(quads: DataFrame, v: Vocabulary) -> DataFrame:
    """(g, s, display_id, title, description, version, types, roles, creators, top_level): one aggregate per graph and subject; several values of a single-valued field give the least."""
    of = lambda p: F.when(F.col("p") == p, F.col("o"))
    many = lambda p: F.array_sort(F.collect_set(of(p)))
    wanted = [v.display_id, v.title, v.description, v.role, v.creator, v.top_level, v.type, v.version]
    rows = quads.where(F.col("p").isin(wanted)).groupBy("g", "s")
    return rows.agg(
        F.min(of(v.display_id)).alias("display_id"), F.min(of(v.title)).alias("title"), F.min(of(v.description)).alias("description"), F.min(of(v.version)).alias("version"), many(v.type).alias("types"), many(v.role).alias("roles"),
        many(v.creator).alias("creators"), F.coalesce(F.bool_or((F.col("p") == v.top_level) & (F.col("o") == F.col("s"))), F.lit(False)).alias("top_level"),
    )


def members(quads: DataFrame, v: Vocabulary) -> DataFrame:
    """(g, collection, member, is_root): a member is no root if another member of the collection refers to it in one or two steps, whatever is between."""
    m = quads.where(F.col("p") == v.member).select("g", F.col("s").alias("collection"), F.col("o").alias("member")).distinct()
    steps = quads.where(~F.col("o").startswith('"')).select("g", F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    from_member = m.select("g", "collection", F.col("member").alias("a")).join(steps, ["g", "a"])
    second = from_member.select("g", "collection", F.col("a").alias("start"), F.col("b").alias("a")).join(steps, ["g", "a"]).select("g", "collection", "start", F.col("b").alias("member"))
    first = from_member.select("g", "collection", F.col("a").alias("start"), F.col("b").alias("member"))
    hit = first.union(second).where("start <> member").select("g", "collection", "member").distinct().withColumn("_hit", F.lit(True))
    return m.join(hit, ["g", "collection", "member"], "left").select("g", "collection", "member", F.col("_hit").isNull().alias("is_root"))


def in_scope(objects: DataFrame, top_level: bool = False, type_: str | None = None, role: str | None = None, root_of: DataFrame | None = None, collection: str | None = None, root_only: bool = False) -> DataFrame:
    """Objects by top level, type, role and membership, each only if asked for.

    With ``root_of`` (the result of ``members``): members of ``collection``, all or root ones only;
    without a collection, objects that no other object of a collection refers to as its member,
    which are the roots of the corpus.
    """
    if root_of is not None and collection is not None:
        m = root_of.where(F.col("collection") == collection)
        m = m.where("is_root") if root_only else m
        objects = objects.join(m.select("g", F.col("member").alias("s")).distinct(), ["g", "s"], "left_semi")
    elif root_of is not None:
        objects = objects.join(root_of.where("not is_root").select("g", F.col("member").alias("s")).distinct(), ["g", "s"], "left_anti")
    if top_level:
        objects = objects.where("top_level")
    if type_ is not None:
        objects = objects.where(F.array_contains("types", type_))
    return objects if role is None else objects.where(F.array_contains("roles", role))


def object_list(objects: DataFrame, offset: int = 0, limit: int | None = None, prefix: str | None = None, type_prefix: str = "", role_prefix: str = "") -> DataFrame:
    """A row per object and combination of matching types and roles, unbound where none matches; by display id, then IRI, in byte order."""
    if prefix is not None:
        objects = objects.where(F.col("s").startswith("<" + prefix))
    some = lambda c, p: F.explode_outer(F.filter(c, lambda x: x.startswith("<" + p)))
    rows = objects.select("s", "display_id", "title", "description", "roles", some("types", type_prefix).alias("type")).select("s", "display_id", "title", "description", "type", some("roles", role_prefix).alias("role"))
    rows = rows.orderBy(F.asc_nulls_first("display_id"), "s", "type", "role").offset(offset)
    return rows if limit is None else rows.limit(limit)


def count_objects(objects: DataFrame) -> DataFrame:
    return objects.agg(F.countDistinct("s").alias("n"))


def facet_counts(objects: DataFrame, field: str) -> DataFrame:
    """(value, n): distinct objects that have each value of an array field."""
    return objects.select("s", F.explode(field).alias("value")).groupBy("value").agg(F.countDistinct("s").alias("n"))


def facet(objects: DataFrame, field: str) -> DataFrame:
    return objects.select(F.explode(field).alias("value")).distinct()


def keyset_page(objects: DataFrame, after: str | None, n: int) -> DataFrame:
    """The next page by IRI; ``n`` is held to 1..5000."""
    rows = objects if after is None else objects.where(F.col("s") > after)
    return rows.orderBy("s").limit(max(1, min(n, 5000)))


def boolean_first(rows: DataFrame, flag: str, *then: Column | str) -> DataFrame:
    """Rows whose ``flag`` is true before the others, null ones last, then by ``then``."""
    return rows.orderBy(F.desc_nulls_last(flag), *then)


def substring_search(objects: DataFrame, needle: str, fields: tuple[str, ...] = ("title", "display_id", "description"), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Objects whose fields hold ``needle``, case left aside; ``first`` marks those whose first field does. With ``limit`` a page: those marked first, then by display id and subject."""
    hit = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(needle))), F.lit(False))
    any_hit: Column = hit(fields[0])
    for c in fields[1:]:
        any_hit = any_hit | hit(c)
    found = objects.where(any_hit).withColumn("first", hit(fields[0]))
    return found if limit is None else boolean_first(found, "first", F.asc_nulls_first("display_id"), "s").offset(offset).limit(limit)


def object_row(objects: DataFrame, subject: str, required: list[str], optional: list[str]) -> DataFrame:
    """Metadata of one subject: a row for each combination of values; none if a required field has no value, unbound cells for optional ones."""
    rows = objects.where(F.col("s") == subject)
    kinds = dict(rows.dtypes)
    for c in required:
        rows = rows.withColumn(c, F.explode(c)) if kinds[c].startswith("array") else rows.where(F.col(c).isNotNull())
    for c in optional:
        rows = rows.withColumn(c, F.explode_outer(c)) if kinds[c].startswith("array") else rows
    return rows.select("s", *required, *optional).distinct()


def refresh_graph(stored: DataFrame, quads: DataFrame, graph: str, v: Vocabulary) -> DataFrame:
    """Stored object metadata with one graph's rows made anew from its quads; written ``partitionBy("g")`` with dynamic overwrite, only that partition changes."""
    return stored.where(F.coalesce(F.col("g") != graph, F.lit(True))).unionByName(object_metadata(quads.where(F.col("g") == graph), v))


def substring_count(objects: DataFrame, needle: str) -> DataFrame:
    return substring_search(objects, needle).agg(F.countDistinct("s").alias("n"))


def predicate_search(quads: DataFrame, predicate: str, needle: str) -> DataFrame:
    """(s): subjects with a literal of one predicate that holds ``needle``, case left aside."""
    hit = F.contains(F.lower(str_(F.col("o"))), F.lower(F.lit(needle)))
    return quads.where((F.col("p") == predicate) & F.col("o").startswith('"') & hit).select("s").distinct()


def containing_collections(quads: DataFrame, member: str, subject: str) -> DataFrame:
    """(collection): what lists ``subject`` as a member."""
    return quads.where((F.col("p") == member) & (F.col("o") == subject)).select(F.col("s").alias("collection")).distinct()


def object_summary(quads: DataFrame, v: Vocabulary, keys: tuple[str, ...] = ("s",)) -> DataFrame:
    """(``keys``: s, or g and s; display_id, name, description, types, roles, data, hash): one aggregate per IRI subject; ``data`` is the JSON of its sorted values by predicate, ``hash`` the SHA-256 of its lines.

    Quads are dealt by subject once; the sets of values by predicate and the row of the subject are made where they lie.
    """
    of = lambda p: F.min(F.when(F.col("p") == p, F.array_min(F.transform("os", str_))))
    many = lambda p: F.coalesce(F.max(F.when(F.col("p") == p, F.col("os"))), F.array().cast("array<string>"))
    values = quads.where(is_iri(F.col("s"))).select(*keys, "p", "o").repartition(*keys).groupBy(*keys, "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
    return values.groupBy(*keys).agg(
        of(v.display_id).alias("display_id"), of(v.title).alias("name"), of(v.description).alias("description"), many(v.type).alias("types"), many(v.role).alias("roles"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os"))))).alias("data"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", F.lit(" "), F.array_join("os", " ")))), "\n"), 256).alias("hash"),
    )


#: Kinds of typed rows: their class, single and many-valued columns by local names of predicates.
PROJECTIONS = {
    "component": ("Component", {"display_id": "displayId", "name": "name"}, {"types": "type", "roles": "role", "sequences": "hasSequence"}),
    "sequence": ("Sequence", {"display_id": "displayId", "elements": "elements", "encoding": "encoding"}, {}),
    "feature": (("SubComponent", "ComponentReference", "LocalSubComponent", "ExternallyDefined", "SequenceFeature"), {"display_id": "displayId", "orientation": "orientation", "instance_of": "instanceOf"}, {"roles": "role", "types": "type"}),
    "location": (("Range", "Cut", "EntireSequence"), {"start": "start", "end": "end", "at": "at", "orientation": "orientation", "sequence": "hasSequence"}, {}),
    "constraint": ("Constraint", {"subject": "subject", "object": "object", "restriction": "restriction"}, {}),
    "interaction": ("Interaction", {"display_id": "displayId"}, {"types": "type"}),
    "participation": ("Participation", {"participant": "participant"}, {"roles": "role"}),
}


def typed_projection(quads: DataFrame, kind: str, base: str, contains: str | None = None, keys: tuple[str, ...] = ("s",)) -> DataFrame:
    """The typed rows of a kind: (``keys``: s, or g and s; class, parent, its columns). ``base`` is the vocabulary's IRI, ``contains`` the predicate by which a parent holds the object."""
    classes, single, many = PROJECTIONS[kind]
    classes = [f"<{base}{c}>" for c in ([classes] if isinstance(classes, str) else classes)]
    of_kind = quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(classes) & is_iri(F.col("s"))).groupBy(*keys).agg(F.min("o").alias("class"))
    cells = pivot(quads, {n: f"<{base}{p}>" for n, p in single.items()}, {n: f"<{base}{p}>" for n, p in many.items()}, keys)
    rows = of_kind.join(cells, list(keys), "left")
    if contains is None:
        return rows.withColumn("parent", F.lit(None).cast("string"))
    parents = quads.where(F.col("p") == f"<{base}{contains}>").groupBy(*[F.col("o").alias("s") if k == "s" else F.col(k) for k in keys]).agg(F.min("s").alias("parent"))
    return rows.join(parents, list(keys), "left")


def validate(quads: DataFrame, rules: dict[str, tuple[str, Column]], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, runs): ``rows`` (g, s, ...) checked by ``rules`` {name: (severity, condition that must hold)}. A graph's run is failed with any error, warning with any warning, else passed."""
    parts = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(severity).alias("severity"))) for n, (severity, ok) in rules.items()]
    findings = rows.select("g", "s", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("f")).select("g", "s", "f.rule", "f.severity")
    worst = findings.groupBy("g").agg(F.max((F.col("severity") == "error").cast("int") * 2 + (F.col("severity") == "warning").cast("int")).alias("w"))
    graphs = quads.select("g").distinct()
    runs = graphs.join(worst, F.equal_null(graphs["g"], worst["g"]), "left").select(graphs["g"], F.when(F.col("w") >= 2, "failed").when(F.col("w") == 1, "warning").otherwise("passed").alias("status"))
    return findings, runs


def revisions(before: DataFrame, after: DataFrame, key: str = "s", hash_: str = "hash") -> DataFrame:
    """(key, change, hash): what an append-only log of revisions gets when summaries change: created, updated or deleted."""
    b, a = before.select(key, F.col(hash_).alias("_old")), after.select(key, F.col(hash_).alias("_new"))
    both = b.join(a, key, "full")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "updated")
    return both.select(key, change.alias("change"), F.coalesce("_new", "_old").alias(hash_)).where("change is not null")


def graph_overview(quads: DataFrame, top_level: str) -> DataFrame:
    """(g, triples, subjects, predicates, top_levels, classes): the counts of a graph's page."""
    top = (F.col("p") == top_level) & (F.col("o") == F.col("s"))
    return quads.groupBy("g").agg(
        F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"),
        F.countDistinct(F.when(top, F.col("s"))).alias("top_levels"), F.countDistinct(F.when(F.col("p") == RDF_TYPE, F.col("o"))).alias("classes"),
    )


def schema_sample(quads: DataFrame, limit: int = 100) -> DataFrame:
    """(kind, term, n): the classes and predicates used most, each kind up to ``limit``."""
    classes = class_histogram(quads).select(F.lit("class").alias("kind"), F.col("class").alias("term"), "n").orderBy(F.desc("n"), "term").limit(limit)
    predicates = quads.groupBy(F.col("p").alias("term")).agg(F.count("*").alias("n")).select(F.lit("predicate").alias("kind"), "term", "n").orderBy(F.desc("n"), "term").limit(limit)
    return classes.union(predicates)


def quads_page(quads: DataFrame, after: tuple[str | None, str, str, str] | None, n: int, graph: str | None = None) -> DataFrame:
    """The next page of quads, of one graph or all, in the order (g, s, p, o), the default graph first; ``after`` is the last quad seen."""
    rows = quads if graph is None else quads.where(F.col("g") == graph)
    key = F.struct(F.coalesce("g", F.lit("")).alias("g"), "s", "p", "o")
    if after is not None:
        g, s, p, o = after
        rows = rows.where(key > F.struct(F.lit(g or "").alias("g"), F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")))
    return rows.orderBy(F.coalesce("g", F.lit("")), "s", "p", "o").limit(max(1, min(n, 5000)))


def uses(quads: DataFrame, target: str, top_level: str) -> DataFrame:
    """Subjects that refer to ``target`` in one or two steps, other than by the top-level predicate."""
    steps = quads.where((F.col("p") != top_level) & ~F.col("o").startswith('"')).select("s", "o").distinct()
    near = steps.where(F.col("o") == target).select(F.col("s").alias("user"))
    far = steps.join(near.select(F.col("user").alias("o")), "o").select(F.col("s").alias("user"))
    return near.union(far).where(F.col("user") != target).distinct()


def twins(quads: DataFrame, has_sequence: str, elements: str) -> DataFrame:
    """(object, twin, of): pairs joined through the text of their sequences, as (object, elements) groups of two or more; pairs are left to the caller."""
    seq = quads.where(F.col("p") == has_sequence).select(F.col("s").alias("object"), F.col("o").alias("seq"))
    text = quads.where(F.col("p") == elements).select(F.col("s").alias("seq"), F.upper("o").alias("elements"))
    held = seq.join(text, "seq").select("object", "elements").distinct()
    shared = held.groupBy("elements").agg(F.count("*").alias("n")).where("n > 1")
    return held.join(shared, "elements").select("object", F.md5("elements").alias("elements_md5"), "n")


def class_histogram(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n"))


def graph_stats(quads: DataFrame) -> DataFrame:
    """(g, triples, subjects, predicates) of each graph."""
    return quads.groupBy("g").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"))


def pivot(quads: DataFrame, single: dict[str, str], many: dict[str, str] | None = None, keys: tuple[str, ...] = ("s",)) -> DataFrame:
    """Typed rows: per IRI subject the least value of each ``single`` predicate and the sorted set of each of ``many``."""
    of = lambda p: F.when(F.col("p") == p, F.col("o"))
    cells = [F.min(of(p)).alias(n) for n, p in single.items()] + [F.array_sort(F.collect_set(of(p))).alias(n) for n, p in (many or {}).items()]
    chosen = [*single.values(), *(many or {}).values()]
    return quads.where(F.col("p").isin(chosen) & is_iri(F.col("s"))).groupBy(*keys).agg(*cells)
