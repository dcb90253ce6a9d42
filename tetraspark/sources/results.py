"""Answers as text: SPARQL JSON results and Turtle.

Each row becomes its line inside Spark, so the text of a large answer can be written by the executors or
streamed, and no process holds it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import terms as T
from ..plans.parser import RDF, XSD

#: Media types of the two formats.
JSON_TYPE, TURTLE_TYPE = "application/sparql-results+json", "text/turtle"

#: Names that need no escapes in Turtle; a subset of what its grammar allows.
LOCAL = r"^[A-Za-z_][A-Za-z0-9_\-]*$"


def json_term(t: Column) -> Column:
    """A canonical term as the struct that the JSON format asks for; null if unbound."""
    dt = T.datatype(t)
    return F.when(t.isNotNull(), F.struct(
        F.when(t.startswith("<"), "uri").when(t.startswith("_"), "bnode").otherwise("literal").alias("type"),
        F.when(t.startswith("_"), F.substr(t, F.lit(3))).otherwise(T.lexical(t)).alias("value"),
        F.when(T.language(t) != "", T.language(t)).alias("xml:lang"),
        F.when(~dt.isin(XSD + "string", RDF + "langString"), dt).alias("datatype"),
    ))


def json_rows(answer: DataFrame) -> DataFrame:
    """A column ``value``: the JSON object of each solution, unbound variables left out."""
    plain = answer.toDF(*[f"c{i}" for i in range(len(answer.columns))])
    if not answer.columns:
        return plain.select(F.lit("{}").alias("value"))
    row = F.struct(*[json_term(F.col(f"c{i}")).alias(n) for i, n in enumerate(answer.columns)])
    return plain.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))


def _lines(df: DataFrame) -> Iterator[str]:
    return (r.value for r in df.toLocalIterator(prefetchPartitions=True))


def json_text(answer: DataFrame) -> Iterator[str]:
    """The JSON document of a SELECT answer, piece by piece in the answer's order."""
    yield '{"head":{"vars":' + json.dumps(answer.columns) + '},"results":{"bindings":['
    for i, line in enumerate(_lines(json_rows(answer))):
        yield ("," if i else "") + "\n" + line
    yield "]}}\n"


def json_boolean(value: bool) -> str:
    """The JSON document of an ASK answer."""
    return json.dumps({"head": {}, "boolean": value}) + "\n"


def _shorten(t: Column, prefixes: dict[str, str]) -> Column:
    out = t
    for name, space in sorted(prefixes.items(), key=lambda x: len(x[1])):  # the longest name space is asked first
        local = F.substr(t, F.lit(len(space) + 2), F.char_length(t) - len(space) - 2)
        out = F.when(t.startswith("<" + space) & local.rlike(LOCAL), F.concat(F.lit(name + ":"), local)).otherwise(out)
    return out


def turtle_rows(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A column ``value``: one Turtle statement for each triple of s, p, o."""
    for name, space in (prefixes or {}).items():
        if not re.match(r"^([A-Za-z][A-Za-z0-9_\-]*)?$", name) or re.search(r'[\s<>"{}|\\^`]', space):
            raise ValueError(f"not a prefix: {name!r} {space!r}")
    s, p, o = (_shorten(F.col(n), prefixes or {}) for n in "spo")
    verb = F.when(F.col("p") == f"<{RDF}type>", "a").otherwise(p)
    typed = F.concat(F.regexp_extract("o", r'(?s)^(".*"\^\^)<[^<>]*>$', 1), _shorten(F.regexp_extract("o", r'(?s)^".*"\^\^(<[^<>]*>)$', 1), prefixes or {}))
    return triples.select(F.concat(s, F.lit(" "), verb, F.lit(" "), F.when(typed != "", typed).otherwise(o), F.lit(" .")).alias("value"))


def turtle_text(triples: DataFrame, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """A Turtle document, piece by piece: the prefixes, then the statements."""
    rows = turtle_rows(triples, prefixes)
    for name, space in (prefixes or {}).items():
        yield f"@prefix {name}: <{space}> .\n"
    for line in _lines(rows):
        yield line + "\n"


def write_turtle(triples: DataFrame, path: str) -> None:
    """Turtle files without prefixes, so that each of them stands alone."""
    turtle_rows(triples).write.text(path)
