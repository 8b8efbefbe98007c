"""Ontologies: OBO terms, aliases, and the closure of is_a with least depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, definition, is_a, alt_ids, synonyms, obsolete) of the [Term] stanzas; of terms of one id the first in the file stays."""
    text = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    stanza = text.where(F.col("value").rlike(r"^\s*\[Term\]"))
    one = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: *(.*?) *$", 1), F.lit(""))
    many = lambda tag: F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: *([^\s!]+)"), F.lit(1))
    rows = stanza.select(
        F.struct("file", "block", "row").alias("at"),
        one("id").alias("id"), one("name").alias("name"), F.nullif(F.regexp_extract("value", r'(?m)^def: *"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"), many("is_a").alias("is_a"),
        many("alt_id").alias("alt_ids"), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: *"((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"),
    )
    rows = rows.where("id is not null")
    fields = [c for c in rows.columns if c not in ("id", "at")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*fields), F.col("at")).alias("t")).select("id", "t.*")


def closure(terms: DataFrame, parents: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): every term (first column) with itself at 0 and its ancestors at their least depth; ``parents`` is (child, parent), ends outside the terms are ignored."""
    t = terms.select(F.col(terms.columns[0]).alias("term")).distinct()
    up = parents.select("child", "parent").distinct()
    up = cut(up.join(t.withColumnRenamed("term", "child"), "child", "left_semi").join(t.withColumnRenamed("term", "parent"), "parent", "left_semi").select("child", "parent"))
    front = cut(t.select(F.col("term").alias("ancestor"), F.col("term").alias("descendant"), F.lit(0).alias("depth")))
    seen = front
    while True:
        reached = front.join(up, front.ancestor == up.child).select(F.col("parent").alias("ancestor"), "descendant", (F.col("depth") + 1).alias("depth")).distinct()
        front = cut(reached.join(seen, ["ancestor", "descendant"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def descendants(closed: DataFrame, ancestor: str) -> DataFrame:
    return closed.where(F.col("ancestor") == ancestor).select("descendant", "depth").orderBy("depth", "descendant")


def purl(term: Column) -> Column:
    """The canonical IRI text of a term ``PREFIX:digits``."""
    return F.concat(F.lit("http://purl.obolibrary.org/obo/"), F.translate(term, ":", "_"))


def plan(terms: DataFrame, prefix: str) -> DataFrame:
    """Terms of one prefix, with ``iri``: the canonical PURL. References to others are left out of is_a."""
    own = lambda x: x.startswith(prefix + ":")
    return terms.where(own(F.col("id"))).withColumn("is_a", F.filter("is_a", own)).withColumn("iri", purl(F.col("id")))


def aliases(terms: DataFrame) -> DataFrame:
    """(alias, canonical) of every id and alternative id: as written, as PURL, and as identifiers.org writes it with and without the prefix's path. A term's own id outranks another's alternative id."""
    each = terms.select(F.col("id").alias("canonical"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("r"), F.col("id").alias("a"))), F.transform("alt_ids", lambda x: F.struct(F.lit(1).alias("r"), x.alias("a"))))).alias("n"))
    org = "https://identifiers.org/"
    a = F.col("n.a")
    spelled = F.array(a, purl(a), F.concat(F.lit(org), a), F.concat(F.lit("http://identifiers.org/"), a), F.concat(F.lit(org), F.lower(F.substring_index(a, ":", 1)), F.lit("/"), a), F.concat(F.lit("http://identifiers.org/"), F.lower(F.substring_index(a, ":", 1)), F.lit("/"), a))
    return each.select("canonical", "n.r", F.explode(spelled).alias("alias")).groupBy("alias").agg(F.min_by("canonical", F.struct("r", "canonical")).alias("canonical"))


def canonicalize(found: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``found`` with ``canonical``: the term that the text of ``column`` is an alias of, or null."""
    return found.join(names.withColumnRenamed("alias", column), column, "left")


def with_roles(objects: DataFrame, roles: str, closed: DataFrame, term: str) -> DataFrame:
    """Objects one of whose ``roles`` (array) is ``term`` or a descendant of it, each once."""
    wanted = closed.where(F.col("ancestor") == term).agg(F.collect_set("descendant").alias("_wanted"))  # a subtree of a vocabulary
    return objects.join(F.broadcast(wanted)).where(F.arrays_overlap(roles, "_wanted")).drop("_wanted")


def search(terms: DataFrame, text: str, prefix: str | None = None) -> DataFrame:
    """Terms whose id or name holds ``text``, case left aside, taken literally, of one prefix if given."""
    low = F.lower(F.lit(text))
    found = terms.where(F.contains(F.lower("id"), low) | F.contains(F.lower("name"), low))
    return found if prefix is None else found.where(F.col("id").startswith(prefix + ":"))


def listing(terms: DataFrame, prefix: str | None = None, text: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a page of terms by id, one row: the total) of one prefix and holding ``text`` if given; obsolete terms come last. ``limit`` is held to 1..1000."""
    found = terms if text is None else search(terms, text)
    found = found if prefix is None else found.where(F.col("id").startswith(prefix + ":"))
    order = [F.asc_nulls_first("obsolete")] if "obsolete" in terms.columns else []
    return found.orderBy(*order, "id").offset(offset).limit(max(1, min(limit, 1000))), found.agg(F.count("*").alias("total"))
