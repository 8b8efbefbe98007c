"""FASTA, GFF3 and GenBank flat files: readers that split by record and texts for the writers, all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUALIFIER = r'\n {10,}/(\w+)(?:="((?:[^"]|"")*)"|=([^\n]*))?'


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): a row a record, white space within a sequence dropped; a record of no lines has an empty sequence."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r")).where(F.trim("r") != "")
    head, body = F.regexp_extract("r", r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", "")
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), body.alias("seq"))


def fasta_records(key: Column, seq: Column, description: Column | None = None, width: int = 60) -> Column:
    """A record's text without its last line end, as ``spark.write.text`` takes it; null sequences are empty."""
    head = F.concat(F.lit(">"), key.cast("string"))
    if description is not None:
        head = F.concat(head, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), F.regexp_replace(description, r"[\r\n]+", " "))).otherwise(""))
    return F.concat(head, F.lit("\n"), F.regexp_replace(F.coalesce(seq, F.lit("")), f"(.{{{width}}})(?=.)", "$1\n"))


def _blank(c: Column) -> Column:
    return F.when(c != ".", c)


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, source, type, start, end, score, strand, phase, attributes map): a row a feature; dots are null. Comments, directives and lines of other than nine fields (a FASTA section) are passed over."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f")).where(F.size("f") == 9)
    f = lambda i: _blank(F.col("f")[i])
    pairs = F.transform(F.filter(F.split(F.coalesce(f(8), F.lit("")), ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.url_decode(F.replace(F.substring_index(x, "=", 1), F.lit("+"), F.lit("%2B"))), F.url_decode(F.replace(F.regexp_extract(x, r"(?s)=(.*)$", 1), F.lit("+"), F.lit("%2B")))))
    return rows.select(f(0).alias("seqid"), f(1).alias("source"), f(2).alias("type"), f(3).cast("long").alias("start"), f(4).cast("long").alias("end"), f(5).cast("double").alias("score"), f(6).alias("strand"), f(7).cast("int").alias("phase"), F.map_from_entries(pairs).alias("attributes"))


def gff3_lines(df: DataFrame) -> DataFrame:
    """``value``: a line a feature, of the columns that ``read_gff3`` returns; nulls are dots, attributes in the order of their names with reserved characters escaped."""
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    entries = F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))
    attributes = F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(code(e["key"]), F.lit("="), code(F.coalesce(e["value"], F.lit(""))))), ";"), F.lit(""))
    fields = [F.col(c).cast("string") for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase")]
    return df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit(".")) for c in [*fields, attributes]]).alias("value"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(id, accession, definition, organism, seq, features array of (type, location, qualifiers map)): a row a record, sequences in lower case. Locations that wrap are joined; of a qualifier told twice the first stays."""
    records = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"\r", "").alias("r")).where(F.contains("r", F.lit("LOCUS")))
    get = lambda pattern: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("r", pattern, 1), r"\s+", " ")), F.lit(""))
    section = F.regexp_extract("r", r"(?ms)^FEATURES[^\n]*\n(.*?)(?=^\S|\z)", 1)
    chunks = F.filter(F.split(section, r"(?m)^(?= {5}\S)"), lambda x: F.trim(x) != "")
    location = lambda x: F.regexp_replace(F.regexp_extract(x, r"(?s)^ {5}\S+\s+(.*?)(?=\n\s+/|\s*\z)", 1), r"\s+", "")
    value = lambda q: F.regexp_replace(F.replace(F.concat(F.regexp_extract(q, _QUALIFIER, 2), F.regexp_extract(q, _QUALIFIER, 3)), F.lit('""'), F.lit('"')), r"\n\s+", " ")
    pairs = lambda x: F.transform(F.regexp_extract_all(x, F.lit(_QUALIFIER), F.lit(0)), lambda q: F.struct(F.regexp_extract(q, _QUALIFIER, 1).alias("key"), value(q).alias("value")))
    once = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda o: o["key"] == p["key"]))
    features = F.transform(chunks, lambda x: F.struct(F.regexp_extract(x, r"^ {5}(\S+)", 1).alias("type"), location(x).alias("location"), F.map_from_entries(once(pairs(x))).alias("qualifiers")))
    seq = F.lower(F.regexp_replace(F.regexp_extract("r", r"(?ms)^ORIGIN[^\n]*\n(.*)\z", 1), r"[\s\d]+", ""))
    return records.select(get(r"(?m)^LOCUS +(\S+)").alias("id"), get(r"(?m)^ACCESSION +(\S+)").alias("accession"), get(r"(?ms)^DEFINITION +(.*?)(?=^\S|\z)").alias("definition"), get(r"(?m)^ +ORGANISM +([^\n]*)").alias("organism"), seq.alias("seq"), features.alias("features"))
