"""RDF terms as strings in N-Triples form, and the SPARQL functions on them, as Column expressions.

``<iri>``, ``_:label`` and ``"text"``, ``"text"@tag`` or ``"text"^^<datatype>`` are terms; equal
strings are equal terms, so joins, DISTINCT and GROUP BY use term identity. NULL is unbound, and
an expression error is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
INTEGERS = [f"{XSD}{x}" for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]
NUMERIC = [f"{XSD}{x}" for x in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]


def iri(value: Column | str) -> Column:
    """An IRI term of a string column, or of a constant."""
    v = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit("<"), v, F.lit(">"))


def literal(value: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    """A literal of the column's text; the lexical form is kept as it is."""
    v = value.cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(raw), F.lit(escaped))
    end = f'"@{lang}' if lang else f'"^^<{datatype}>' if datatype else '"'
    return F.concat(F.lit('"'), v, F.lit(end))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def str_(t: Column) -> Column:
    """STR: an IRI's text, or a literal's lexical form; NULL for a blank node."""
    body = F.regexp_extract(t, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    mark = F.lit("\u0000")
    for escaped, raw in (("\\\\", None), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        body = F.replace(body, F.lit(escaped), F.lit(raw) if raw else mark)
    body = F.replace(body, mark, F.lit("\\"))
    return F.when(is_iri(t), t.substr(F.lit(2), F.length(t) - 2)).when(is_literal(t), body)


def lang(t: Column) -> Column:
    """LANG: '' without a tag; NULL for what is no literal."""
    return F.when(is_literal(t), F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(t: Column) -> Column:
    """DATATYPE as text."""
    tagged = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(t), F.when(lang(t) != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(tagged != "", tagged).otherwise(F.lit(XSD + "string")))


def lang_matches(tag: Column, wanted: str) -> Column:
    """LANGMATCHES: ``*`` is any tag; else the tag or a subtag of it, case left aside."""
    if wanted == "*":
        return tag != ""
    w = wanted.lower()
    return (F.lower(tag) == w) | F.lower(tag).startswith(w + "-")


def number(t: Column) -> Column:
    """The value of a numeric literal, else NULL."""
    return F.when(datatype(t).isin(NUMERIC), str_(t).try_cast("double"))


def exact(t: Column) -> Column:
    """The value of an integer or decimal literal as a decimal, so that large integers keep their digits; else NULL."""
    return F.when(datatype(t).isin(*INTEGERS, XSD + "decimal"), str_(t).try_cast("decimal(38,10)"))


def _rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double."""
    d = datatype(t)
    return F.when(d.isin(INTEGERS), 0).when(d == XSD + "decimal", 1).when(d == XSD + "float", 2).when(d == XSD + "double", 3)


def arithmetic(a: Column, b: Column, op: str) -> Column:
    """The literal of ``a op b`` for + - * /: of the wider type of integer < decimal < float < double; integers divide to a decimal; division of exact numbers by zero is an error."""
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}
    wide = F.greatest(_rank(a), _rank(b))
    whole = ops[op](exact(a).cast("decimal(38,0)"), exact(b).cast("decimal(38,0)")) if op != "/" else None
    dec = ops[op](exact(a).cast("decimal(28,8)"), exact(b).cast("decimal(28,8)")).cast("decimal(38,8)")
    plain = F.regexp_replace(F.regexp_replace(dec.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    real = ops[op](number(a), number(b))
    out = F.when(wide >= 2, literal(real.cast("string"))).otherwise(literal(plain))
    if whole is not None:
        out = F.when(wide == 0, literal(whole.cast("decimal(38,0)").cast("string"))).otherwise(out)
    kind = F.when(wide == 0, XSD + ("decimal" if op == "/" else "integer")).when(wide == 1, XSD + "decimal").when(wide == 2, XSD + "float").otherwise(XSD + "double")
    known = wide.isNotNull() & _rank(a).isNotNull() & _rank(b).isNotNull()
    return F.when(known, F.concat(out, F.lit("^^<"), kind, F.lit(">")))


def is_numeric(t: Column) -> Column:
    return F.coalesce(number(t).isNotNull(), F.lit(False))


def timestamp(t: Column) -> Column:
    """The value of an xsd:dateTime or xsd:date literal, else NULL."""
    return F.when(datatype(t).isin(XSD + "dateTime", XSD + "date"), str_(t).try_cast("timestamp"))


def effective_boolean(t: Column) -> Column:
    """The effective boolean value: booleans, numbers and strings have one; all else is an error."""
    d = datatype(t)
    return (
        F.when(d == XSD + "boolean", str_(t).isin("true", "1"))
        .when(d.isin(NUMERIC), F.coalesce((number(t) != 0) & ~F.isnan(number(t)), F.lit(False)))
        .when(d.isin(XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), str_(t) != "")
    )


def equal(a: Column, b: Column) -> Column:
    """``=``: by value for two numbers or times, else by term; unequal literals of unknown types are an error."""
    known = [*NUMERIC, XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date"]
    return (
        F.when(exact(a).isNotNull() & exact(b).isNotNull(), exact(a) == exact(b))
        .when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b))
        .when(timestamp(a).isNotNull() & timestamp(b).isNotNull(), timestamp(a) == timestamp(b))
        .when(a == b, F.lit(True))
        .when(is_literal(a) & is_literal(b) & (~datatype(a).isin(known) | ~datatype(b).isin(known)) & (lang(a) == "") & (lang(b) == ""), F.lit(None).cast("boolean"))
        .otherwise(a == b)
    )


def less(a: Column, b: Column) -> Column:
    """``<`` of two numbers, two times or two plain strings; NULL otherwise."""
    plain = (datatype(a) == XSD + "string") & (datatype(b) == XSD + "string")
    return F.coalesce(exact(a) < exact(b), number(a) < number(b), timestamp(a) < timestamp(b), F.when(plain, str_(a) < str_(b)))


def order_keys(t: Column, descending: bool = False) -> list[Column]:
    """ORDER BY: unbound, blank nodes, IRIs, literals; numbers by value, then text."""
    keys = [F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3), number(t), F.coalesce(str_(t), t)]
    return [k.desc() if descending else k.asc() for k in keys]


def str_before(s: Column, part: str) -> Column:
    """STRBEFORE: '' if ``part`` is absent."""
    return F.when(s.contains(part), F.split_part(s, F.lit(part), F.lit(1)) if part else F.lit("")).otherwise(F.when(s.isNotNull(), F.lit("")))


def str_after(s: Column, part: str) -> Column:
    """STRAFTER: '' if ``part`` is absent."""
    at = F.locate(part, s) if part else F.lit(1)
    return F.when(s.contains(part), s.substr(at + F.lit(len(part)), F.length(s))).otherwise(F.when(s.isNotNull(), F.lit("")))


def encode_for_uri(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def round_half_up(x: Column) -> Column:
    """ROUND: halves go toward positive infinity."""
    return F.floor(x + F.lit(0.5))


def regex(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(f"(?{flags}){pattern}" if flags else pattern)


def _clock(t: Column, group: int) -> Column:
    """A part of the lexical form of an xsd:dateTime: hours, minutes, seconds, offset. The session's zone plays no part."""
    return F.when(datatype(t) == XSD + "dateTime", F.regexp_extract(str_(t), r"T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$", group))


def hours(t: Column) -> Column:
    return _clock(t, 1).try_cast("int")


def minutes(t: Column) -> Column:
    return _clock(t, 2).try_cast("int")


def seconds(t: Column) -> Column:
    return _clock(t, 3).try_cast("decimal(18,9)")


def tz(t: Column) -> Column:
    """TZ: the offset as written, '' without one."""
    return _clock(t, 4)


def timezone(t: Column) -> Column:
    """TIMEZONE: the offset as a duration; an error (NULL) without one."""
    z = tz(t)
    sign = F.when(z.startswith("-"), "-").otherwise("")
    h, m = z.substr(2, 2).try_cast("int"), z.substr(5, 2).try_cast("int")
    parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", F.concat(sign, F.lit("PT"), parts))


def now() -> Column:
    """NOW: one moment for the whole query, in UTC."""
    return F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(f'Z"^^<{XSD}dateTime>'))


def uuid_iri() -> Column:
    """UUID: a fresh IRI for each row."""
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def str_uuid() -> Column:
    return literal(F.uuid())


def rand() -> Column:
    return F.rand()


def bnode(label: Column | None = None) -> Column:
    """BNODE: one node for each label, or a fresh one for each row."""
    return F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if label is None else F.md5(label))


def str_lang(text: Column, tag: Column) -> Column:
    """STRLANG: tags are lower-cased; an empty one is an error."""
    return F.when(tag != "", F.concat(literal(text), F.lit("@"), F.lower(tag)))


def str_dt(text: Column, datatype_iri: Column) -> Column:
    """STRDT; a datatype of xsd:string is a plain literal."""
    return F.when(datatype_iri == F.lit(f"<{XSD}string>"), literal(text)).otherwise(F.concat(literal(text), F.lit("^^"), datatype_iri))


def same_term(a: Column, b: Column) -> Column:
    return a == b
