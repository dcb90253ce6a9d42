"""RDF terms as Spark columns.

A term is one canonical N-Triples string, which is the join key: ``<iri>``, ``_:b``, ``"lex"``,
``"lex"@lang`` (lower case) or ``"lex"^^<datatype>`` (none for xsd:string). Everything here is an
expression that stays inside code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import RDF, XSD, literal, unescape

#: Fixed value: the graph that quads without a named graph are in; not empty, so that partition columns keep it.
DEFAULT_GRAPH = "<urn:x-default:default-graph>"

#: Numeric datatypes (fixed values of the XML Schema recommendation).
INTEGERS = [XSD + n for n in (
    "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger",
    "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
)]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "double", XSD + "float"]

LITERAL = r'^"(.*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^<>]*)>)?$'


def kind(t: Column) -> Column:
    """'I', 'B' or 'L'."""
    head = F.substring(t, 1, 1)
    return F.when(head == "<", "I").when(head == "_", "B").when(head == '"', "L")


def escape(c: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape_column(c: Column) -> Column:
    """The inverse of ``escape``. A stand-in keeps double backslashes apart from other escapes.

    The stand-in is a private character and a digit; the character itself, should the text hold it, gets another digit.
    """
    mark = "\ue001"
    c = F.replace(F.replace(c, F.lit(mark), F.lit(mark + "0")), F.lit("\\\\"), F.lit(mark + "1"))
    for code, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.replace(F.replace(c, F.lit(mark + "1"), F.lit("\\")), F.lit(mark + "0"), F.lit(mark))


def _part(t: Column, group: int) -> Column:
    return F.regexp_extract(t, "(?s)" + LITERAL, group)


def lexical(t: Column) -> Column:
    """STR(): the IRI, or the literal's lexical form; null for blank nodes."""
    return F.when(t.startswith("<"), F.substring(t, F.lit(2), F.char_length(t) - 2)).when(t.startswith('"'), unescape_column(_part(t, 1)))


def language(t: Column) -> Column:
    """LANG(): empty for literals without one, null for other terms."""
    return F.when(t.startswith('"'), _part(t, 2))


def datatype(t: Column) -> Column:
    """DATATYPE(), as a plain IRI; null for other terms than literals."""
    dt = _part(t, 3)
    return F.when(t.startswith('"'), F.when(_part(t, 2) != "", RDF + "langString").when(dt == "", XSD + "string").otherwise(dt))


def number(t: Column) -> Column:
    """The numeric value as a double; null unless the term is a valid numeric literal."""
    return F.when(datatype(t).isin(NUMERIC), _part(t, 1).try_cast("double"))


#: A time zone at the end of a date or dateTime.
ZONE = r"(Z|[+-]\d\d:\d\d)$"


def instant(t: Column) -> Column:
    """A date or dateTime literal in universal time, for comparisons; one without a zone counts as universal."""
    zone = F.regexp_extract(_part(t, 1), ZONE, 1)
    sign = F.when(zone.startswith("-"), 1).otherwise(-1)
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"), F.lit(0))
    return moment(t) + F.make_dt_interval(mins=sign * minutes)


def moment(t: Column) -> Column:
    """The value of a date or dateTime literal as it is written, without its zone; null for all other terms."""
    return F.when(datatype(t).isin(XSD + "dateTime", XSD + "date"), _part(t, 1).try_cast("timestamp_ntz"))


def make_literal(lex: Column, dt: str) -> Column:
    tail = '"' if dt == XSD + "string" else f'"^^<{dt}>'
    return F.concat(F.lit('"'), escape(lex), F.lit(tail))


def make_iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def order_keys(t: Column) -> list[Column]:
    """Keys of SPARQL's order: unbound, blank nodes, IRIs, literals; numbers by value, the rest by form."""
    rank = F.when(t.isNull(), 0).when(t.startswith("_"), 1).when(t.startswith("<"), 2).otherwise(3)
    return [rank, number(t), F.coalesce(lexical(t), t), t]


def decode(term: str) -> tuple[str, str, str, str]:
    """(kind, lexical form, datatype, language) of a canonical term."""
    if term.startswith("<"):
        return "I", term[1:-1], "", ""
    if term.startswith("_:"):
        return "B", term[2:], "", ""
    m = re.match(LITERAL, term, re.S)
    if not m:
        raise ValueError(f"not a term: {term!r}")
    lang = m[2] or ""
    return "L", unescape(m[1]), RDF + "langString" if lang else m[3] or XSD + "string", lang


def encode(kind: str, lex: str, dt: str = "", lang: str = "") -> str:
    if kind == "I":
        return f"<{lex}>"
    if kind == "B":
        return f"_:{lex}"
    return literal(lex, dt or None, lang or None)


def from_stored(c: Column) -> Column:
    """Canonical terms of plainly stored strings: bare IRIs, ``<iri>``, ``_:b``, quoted literals.

    Anything else is a plain literal; the empty string is a blank node named by its place.
    """
    absolute = c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$")
    quoted = c.rlike("(?s)" + LITERAL)
    plain = F.concat(F.lit('"'), escape(c), F.lit('"'))
    inner = F.substring(c, F.lit(2), F.char_length(c) - 2)
    return (
        F.when(c == "", F.concat(F.lit("_:e"), F.monotonically_increasing_id()))
        .when(c.startswith("_:") | (c.rlike(r"^<[^<>\s]*>$") & inner.contains(":")), c)
        .when(absolute, make_iri(c))
        .when(quoted, F.regexp_replace(c, r"\^\^<" + re.escape(XSD + "string") + ">$", ""))
        .otherwise(plain)
    )


def to_stored(t: Column) -> Column:
    """The plain form: bare IRIs, everything else as it is."""
    return F.when(t.startswith("<"), F.substring(t, F.lit(2), F.char_length(t) - 2)).otherwise(t)
