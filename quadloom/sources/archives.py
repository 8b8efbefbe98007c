"""Sinks of whole documents: GenBank records, OMEX archives, summary JSON."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OMEX = "http://identifiers.org/combine.specifications/omex"


def genbank_records(id_: Column, definition: Column, seq: Column, features: Column | None = None) -> Column:
    """A GenBank record's text: ``features`` is an array of (type, location, qualifiers map); sequences in lower case, sixty bases a line with their numbers."""
    s = F.lower(F.coalesce(seq, F.lit("")))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / 60) - 1, F.lit(0)).cast("int")), lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.regexp_replace(F.substring(s, i * 60 + 1, F.lit(60)), "(.{1,10})", " $1")))
    text = F.concat(F.lit("LOCUS       "), id_, F.lit(" "), F.length(s).cast("string"), F.lit(" bp    DNA\nDEFINITION  "), F.regexp_replace(F.coalesce(definition, F.lit("")), r"\s+", " "), F.lit("\nACCESSION   "), id_, F.lit("\nFEATURES             Location/Qualifiers\n"))
    if features is not None:
        pair = lambda q: F.concat(F.lit("                     /"), q["key"], F.lit('="'), F.replace(F.coalesce(q["value"], F.lit("")), F.lit('"'), F.lit('""')), F.lit('"\n'))
        one = lambda f: F.concat(F.lit("     "), F.rpad(f["type"], 16, " "), f["location"], F.lit("\n"), F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(f["qualifiers"], F.create_map().cast("map<string,string>")))), pair), ""))
        text = F.concat(text, F.array_join(F.transform(F.coalesce(features, F.array()), one), ""))
    return F.concat(text, F.lit("ORIGIN\n"), F.array_join(rows, "\n"), F.lit("\n//"))


def omex(files: Column) -> Column:
    """The bytes of an OMEX archive of ``files``, an array of (location, format, content): a zip with a manifest first, the same bytes for the same files. A row holds one archive."""

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        from xml.sax.saxutils import quoteattr

        out = []
        for found in rows:
            found = [] if found is None else list(found)
            entries = [(".", _OMEX), ("./manifest.xml", _OMEX + "-manifest"), *((f"./{f['location']}", f["format"]) for f in found)]
            lines = "".join(f"  <content location={quoteattr(a)} format={quoteattr(b)}/>\n" for a, b in entries)
            manifest = f'<?xml version="1.0" encoding="UTF-8"?>\n<omexManifest xmlns="{_OMEX}-manifest">\n{lines}</omexManifest>\n'
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in [("manifest.xml", manifest), *((f["location"], f["content"]) for f in found)]:
                    z.writestr(zipfile.ZipInfo(name), content)
            out.append(held.getvalue())
        return pd.Series(out, dtype=object)

    return pack(files)


def omex_contents(archive: Column) -> Column:
    """(location, content) of the files of an archive, the manifest left out."""

    @F.pandas_udf("array<struct<location: string, content: string>>")
    def unpack(rows: pd.Series) -> pd.Series:
        out = []
        for data in rows:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                out.append([{"location": n, "content": z.read(n).decode()} for n in z.namelist() if n != "manifest.xml"])
        return pd.Series(out, dtype=object)

    return unpack(archive)


def summary_json(*columns: str) -> Column:
    """A row's columns as one JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
