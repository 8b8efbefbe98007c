"""RDF documents that no line of text can be read without the others: Turtle, TriG, RDF/XML, JSON-LD.

Files are read whole, one a row, and parsed in Arrow-batched tasks, so a corpus of many files is
spread over the cluster; a single file is one task's work.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, XSD
from .quads import SCHEMA, distinct_quads, read_nquads

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
Quad = tuple[str | None, str, str, str]

#: Format by file ending.
ENDINGS = {"nt": "nquads", "nq": "nquads", "ttl": "turtle", "trig": "turtle", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}


def quoted(text: str, tag: str | None = None, datatype: str | None = None) -> str:
    """A literal term of Python text."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, escaped)
    return f'"{text}"' + (f"@{tag.lower()}" if tag else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


def _unescape(text: str) -> str:
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), text, flags=re.S)


def _resolve(base: str, ref: str) -> str:
    from urllib.parse import urljoin

    return ref if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) or not base else urljoin(base, ref)


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)|(?P<long>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[^\s;,.()\[\]{}<>"'\#]+(?:\.+[^\s;,.()\[\]{}<>"'\#]+)*)|(?P<name>[^\W\d_][\w-]*(?:\.[\w-]+)*?:(?:[\w:%-]|\\.)*(?:\.+(?:[\w:%-]|\\.)+)*|:(?:[\w:%-]|\\.)*(?:\.+(?:[\w:%-]|\\.)+)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,()\[\]{}])""",
    re.X | re.S,
)


class _Turtle:
    """One Turtle or TriG document."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.base, self.scope, self.prefixes = base, scope, {}
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.fresh, self.out, self.graph = 0, 0, [], None

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token[1] != mark:
            raise ValueError(f"{mark!r} is missing before {token[1]!r}")
        self.i += 1
        return token

    def node(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}g{self.fresh}"

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            return f"<{_resolve(self.base, _unescape(text[1:-1]))}>"
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"the prefix {prefix!r} is not declared")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        raise ValueError(f"no IRI: {text!r}")

    def read(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix", "@base", "base") and kind in ("at", "word"):
                self.take()
                if text.lower().endswith("prefix"):
                    prefix = self.take()[1][:-1]
                    self.prefixes[prefix] = self.iri(self.take())[1:-1]
                else:
                    self.base = self.iri(self.take())[1:-1]
                if text.startswith("@"):
                    self.take(".")
                continue
            if kind == "word" and text.lower() == "graph":
                self.take()
                kind, text = self.peek()
            if text == "{" or kind in ("iri", "name", "blank") and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][1] == "{":
                self.graph = None if text == "{" else self.subject()
                self.take("{")
                while self.peek()[1] != "}":
                    self.statement()
                    if self.peek()[1] == ".":
                        self.take()
                self.take("}")
                self.graph = None
                continue
            self.statement()
            self.take(".")
        return self.out

    def statement(self) -> None:
        alone = self.peek()[1] == "["
        s = self.subject()
        if not (alone and self.peek()[1] in (".", "}")):
            self.verbs(s)

    def subject(self) -> str:
        kind, text = self.peek()
        if text in ("[", "("):
            return self.object()
        self.take()
        return f"_:{self.scope}u{text[2:]}" if kind == "blank" else self.iri((kind, text))

    def verbs(self, s: str) -> None:
        while True:
            token = self.take()
            p = RDF_TYPE if token == ("word", "a") else self.iri(token)
            while True:
                self.out.append((self.graph, s, p, self.object()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] not in (";", ".", "]", "}", ""):
                    break
            else:
                return

    def object(self) -> str:
        kind, text = self.take()
        if text == "[" and kind == "mark":
            b = self.node()
            if self.peek()[1] != "]":
                self.verbs(b)
            self.take("]")
            return b
        if text == "(" and kind == "mark":
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.take(")")
            head = f"<{_RDF}nil>"
            for item in reversed(items):
                b = self.node()
                self.out += [(self.graph, b, f"<{_RDF}first>", item), (self.graph, b, f"<{_RDF}rest>", head)]
                head = b
            return head
        if kind in ("text", "long"):
            body = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return quoted(body, tag=self.take()[1][1:])
            if self.peek()[0] == "type":
                self.take()
                return quoted(body, datatype=self.iri(self.take())[1:-1])
            return quoted(body)
        if kind == "number":
            return quoted(text, datatype=XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return quoted(text, datatype=XSD + "boolean")
        return f"_:{self.scope}u{text[2:]}" if kind == "blank" else self.iri((kind, text))


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a Turtle or TriG document; ``scope`` starts the labels of its blank nodes."""
    return _Turtle(text, base, scope).read()


def parse_rdfxml(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of an RDF/XML document: node elements, property elements and attributes, resources, literals, collections and containers' members."""
    out: list[Quad] = []
    count = 0
    xml = "{http://www.w3.org/XML/1998/namespace}"
    own = {f"{{{_RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}
    name = lambda tag: "<" + tag[1:].replace("}", "") + ">"

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}x{count}"

    def node(e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        get = lambda a: e.get(f"{{{_RDF}}}{a}")
        s = f"<{_resolve(base, get('about'))}>" if get("about") is not None else f"<{base}#{get('ID')}>" if get("ID") else f"_:{scope}u{get('nodeID')}" if get("nodeID") else fresh()
        if e.tag != f"{{{_RDF}}}Description":
            out.append((None, s, RDF_TYPE, name(e.tag)))
        for a, v in e.attrib.items():
            if a not in own and not a.startswith(xml):
                out.append((None, s, name(a), f"<{_resolve(base, v)}>" if name(a) == RDF_TYPE else quoted(v, lang)))
        member = 0
        for p in e:
            if p.tag == f"{{{_RDF}}}li":
                member += 1
                prop(s, f"<{_RDF}_{member}>", p, base, lang)
            else:
                prop(s, name(p.tag), p, base, lang)
        return s

    def prop(s: str, p: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        get = lambda a: e.get(f"{{{_RDF}}}{a}")
        kind = get("parseType")
        others = {a: v for a, v in e.attrib.items() if a not in own and not a.startswith(xml)}
        if get("resource") is not None or get("nodeID"):
            o = f"<{_resolve(base, get('resource'))}>" if get("resource") is not None else f"_:{scope}u{get('nodeID')}"
            out.extend((None, o, name(a), quoted(v, lang)) for a, v in others.items())
        elif kind == "Resource":
            o = fresh()
            for inner in e:
                prop(o, name(inner.tag), inner, base, lang)
        elif kind == "Collection":
            o = f"<{_RDF}nil>"
            for item in [node(x, base, lang) for x in e][::-1]:
                b = fresh()
                out.extend([(None, b, f"<{_RDF}first>", item), (None, b, f"<{_RDF}rest>", o)])
                o = b
        elif kind == "Literal":
            o = quoted((e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e), datatype=_RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], base, lang)
        elif others:
            o = fresh()
            out.extend((None, o, name(a), quoted(v, lang)) for a, v in others.items())
        else:
            o = quoted(e.text or "", None if get("datatype") else lang, get("datatype"))
        out.append((None, s, p, o))

    root = ET.fromstring(text)
    base = root.get(xml + "base", base)
    for e in root if root.tag == f"{{{_RDF}}}RDF" else [root]:
        node(e, base, root.get(xml + "lang"))
    return out


def parse_jsonld(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a JSON-LD document with an inline context of terms, prefixes, @vocab, @base, @language, types and containers; contexts elsewhere are not fetched."""
    out: list[Quad] = []
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}j{count}"

    def expand(v: str, c: dict, vocab: bool) -> str:
        if v.startswith("@"):
            return v
        term = c.get(v)
        if vocab and term is not None:
            v = term.get("@id", v) if isinstance(term, dict) else term
            return v if v.startswith("@") else expand(v, {k: x for k, x in c.items() if k != v}, True)
        head, colon, rest = v.partition(":")
        if colon and head == "_":
            return f"_:{scope}u{rest}"
        if colon and not rest.startswith("//") and head in c:
            start = c[head].get("@id") if isinstance(c[head], dict) else c[head]
            return start + rest
        return v if colon else c["@vocab"] + v if vocab and c.get("@vocab") else v if vocab else _resolve(c.get("@base", base), v)

    def term(v: str) -> str:
        return v if v.startswith("_:") else f"<{v}>"

    def value(v, c: dict, g: str | None, how: dict) -> str | None:
        if isinstance(v, dict):
            if "@value" in v:
                v, how = v["@value"], {"@type": v.get("@type"), "@language": v.get("@language", "")}
            elif "@list" in v:
                items = [x for x in (value(i, c, g, how) for i in v["@list"]) if x]
                o = f"<{_RDF}nil>"
                for item in reversed(items):
                    b = fresh()
                    out.extend([(g, b, f"<{_RDF}first>", item), (g, b, f"<{_RDF}rest>", o)])
                    o = b
                return o
            else:
                return node(v, c, g)
        if v is None:
            return None
        kind = how.get("@type")
        if kind in ("@id", "@vocab"):
            return term(expand(str(v), c, kind == "@vocab"))
        kind = expand(kind, c, True) if kind else None
        if isinstance(v, bool):
            return quoted("true" if v else "false", datatype=kind or XSD + "boolean")
        if isinstance(v, int):
            return quoted(str(v), datatype=kind or XSD + "integer")
        if isinstance(v, float):
            digits, power = f"{v:.15E}".split("E")
            return quoted(f"{digits.rstrip('0')}{'0' if digits.rstrip('0').endswith('.') else ''}E{int(power)}", datatype=kind or XSD + "double")
        return quoted(v, None if kind else how.get("@language", c.get("@language")) or None, kind)

    def node(v: dict, c: dict, g: str | None) -> str:
        c = merged(c, v.get("@context"))
        keys = {expand(k, c, True): k for k in v if k != "@context"}
        s = term(expand(v[keys["@id"]], c, False)) if "@id" in keys else fresh()
        for full, k in keys.items():
            items = v[k] if isinstance(v[k], list) else [v[k]]
            how = c.get(k) if isinstance(c.get(k), dict) else {}
            if full == "@type":
                out.extend((g, s, RDF_TYPE, term(expand(t, c, True))) for t in items)
            elif full == "@graph":
                inner = None if len(keys) == 1 else s
                for x in items:
                    node(x, c, inner)
            elif full == "@reverse":
                for p, xs in v[k].items():
                    out.extend((g, node(x, c, g), term(expand(p, c, True)), s) for x in (xs if isinstance(xs, list) else [xs]))
            elif not full.startswith("@") and ":" in full:
                if how.get("@container") == "@list":
                    items = [{"@list": items}]
                for x in items:
                    o = value(x, c, g, how)
                    if o is not None:
                        out.append((g, s, term(full), o))
        return s

    def merged(c: dict, more) -> dict:
        for part in more if isinstance(more, list) else [more]:
            if isinstance(part, dict):
                c = c | part
            elif isinstance(part, str):
                raise ValueError(f"the context {part} is not in the document")
        return c

    data = json.loads(text)
    for top in data if isinstance(data, list) else [data]:
        node(top, {}, None)
    return out


PARSERS = {"turtle": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}


def read_rdf(spark: SparkSession, path: str, format: str, base: str = "", graph: str | None = None) -> DataFrame:
    """The set of quads of the files at ``path`` in one of the formats nquads, turtle (TriG too), rdfxml, jsonld.

    Blank nodes are kept apart by file. Triples without a graph go to ``graph``. A file that does
    not parse fails the read, naming it.
    """
    if format == "nquads":
        return read_nquads(spark, path).withColumn("g", F.coalesce("g", F.lit(graph).cast("string")))
    parse = PARSERS[format]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                scope = "f" + hashlib.md5(file.encode()).hexdigest()[:12]
                try:
                    quads = parse(bytes(content).decode("utf-8-sig"), base, scope)
                except Exception as e:
                    raise ValueError(f"{file}: {e}") from e
                yield pd.DataFrame([(g if g is not None else graph, s, p, o) for g, s, p, o in quads], columns=["g", "s", "p", "o"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return distinct_quads(files.mapInPandas(read, SCHEMA))
