"""TriG documents as quads, and quads as N-Triples or N-Quads text.

A document is parsed whole, in its own task, before any of its quads is returned, so a faulty one adds
nothing. Blank nodes are named after their document, so those of two documents never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.terms import DEFAULT_GRAPH
from ..plans.parser import RDF, TOKENS, Parser, SparqlError

SCHEMA = "s string, p string, o string, g string"


class TrigError(ValueError):
    """The document is not TriG."""


class TrigParser(Parser):
    def __init__(self, text: str, scope: str, base: str = "http://example.org/base/"):
        self.source, self.scope, self.triples_out = text, scope, []
        super().__init__(text)
        self.base = base

    def blank(self, label: str | None = None) -> str:
        """Named labels and generated ones have names that cannot be equal."""
        if label is None:
            self.fresh += 1
            return f"_:{self.scope}.g{self.fresh}"
        return f"_:{self.scope}.l{label}"

    def verb(self) -> str:
        if self.kind == "word" and self.text == "a":
            self.take()
            return f"<{RDF}type>"
        return self.iri()

    def term(self, variables: bool = False):
        if self.kind == "op" and self.text == "<":
            raise SparqlError("triple terms are not supported")
        if self.kind == "word" and self.text not in ("true", "false"):
            raise SparqlError(f"expected a term, found {self.text!r}")
        return super().term(False)

    def directive(self) -> bool:
        at = self.kind == "lang" and self.text in ("@prefix", "@base", "@version")
        if not at and not self.word("PREFIX", "BASE", "VERSION"):
            return False
        what = self.take().lower().lstrip("@")
        if what == "prefix":
            name = self.take()
            if not name.endswith(":") or self.kind != "iri":
                raise SparqlError("a prefix needs a name and an IRI")
            self.prefixes[name[:-1]] = self.resolve(self.take()[1:-1])
        elif what == "base":
            if self.kind != "iri":
                raise SparqlError("a base needs an IRI")
            self.base = self.resolve(self.take()[1:-1])
        else:
            self.string()
        if at:
            self.expect(".")
        return True

    def block(self, graph: str) -> None:
        self.expect("{")
        while not self.accept("}"):
            out: list = []
            at = self.i
            self.statement(out)
            if self.i == at:
                raise SparqlError(f"unexpected {self.text or 'end'!r}")
            self.triples_out += [(*t, graph) for t in out]
            if not self.accept("."):
                self.expect("}")
                return

    def statement(self, out: list) -> None:
        opened = self.text == "[" and self.kind == "op"
        s = self.node(out)
        if s.startswith('"'):
            raise SparqlError("a literal is not allowed as a subject")
        alone = opened and self.tokens[self.i - 2][1] != "["
        if not (alone and self.kind == "op" and self.text in (".", "}")):
            self.properties(s, out)

    def document(self) -> list[tuple[str, str, str, str]]:
        while self.kind != "end":
            if self.directive():
                continue
            if self.kind == "op" and self.text == "{":
                self.block(DEFAULT_GRAPH)
                continue
            named = self.accept("GRAPH")
            start, out = self.i, []
            if named or self.kind in ("iri", "pname", "bnode") or self.text == "[" and self.tokens[self.i + 1][1] == "]":
                label = self.node(out)
                if named or self.kind == "op" and self.text == "{":
                    self.block(label)
                    continue
                self.i, out = start, []
            self.statement(out)
            self.expect(".")
            self.triples_out += [(*t, DEFAULT_GRAPH) for t in out]
        return self.triples_out

    def place(self) -> tuple[int, int]:
        """Line and column of the current token."""
        n = -1
        at = 0
        while at < len(self.source):
            m = TOKENS.match(self.source, at)
            n += m.lastgroup != "ws"
            if n == self.i:
                break
            at = m.end()
        return self.source.count("\n", 0, at) + 1, at - self.source.rfind("\n", 0, at) - 1


def parse_trig(text: str, scope: str = "d", base: str = "http://example.org/base/") -> list[tuple[str, str, str, str]]:
    """The quads of a document, as canonical terms."""
    try:
        p = TrigParser(text, scope, base)
    except SparqlError as e:
        raise TrigError(f"Syntax error at {e}") from e
    try:
        return p.document()
    except (SparqlError, IndexError) as e:
        line, column = p.place()
        raise TrigError(f"Syntax error at line {line}, position {column}: {e}") from e


def read_string(spark: SparkSession, text: str, base: str = "http://example.org/base/") -> DataFrame:
    """A document given as text."""
    if text is None:
        raise ValueError("a text is needed")
    return spark.createDataFrame(parse_trig(text, hashlib.md5(text.encode()).hexdigest()[:12], base), SCHEMA)


def read_reader(spark: SparkSession, reader: TextIO, base: str = "http://example.org/base/") -> DataFrame:
    """A document from an open text source; one document is parsed whole, on the driver."""
    if reader is None:
        raise ValueError("a reader is needed")
    return read_string(spark, reader.read(), base)


def read_stream(spark: SparkSession, stream: BinaryIO, base: str = "http://example.org/base/") -> DataFrame:
    """A document from an open byte source in UTF-8, with or without a byte order mark."""
    if stream is None:
        raise ValueError("a stream is needed")
    return read_string(spark, stream.read().decode("utf-8-sig"), base)


def read_files(spark: SparkSession, path: str, base: str = "http://example.org/base/") -> DataFrame:
    """All documents that ``path`` names, each parsed by the task that reads it."""
    if not path or not path.strip():
        raise ValueError("a path is needed")

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, text in zip(batch["name"], batch["value"]):
                try:
                    rows = parse_trig(text, hashlib.md5(name.encode()).hexdigest()[:12], base)
                except TrigError as e:
                    raise TrigError(f"{name}: {e}") from e
                for i in range(0, len(rows), 10000):
                    yield pd.DataFrame(rows[i : i + 10000], columns=["s", "p", "o", "g"])

    docs = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name"))
    return docs.mapInPandas(parse, SCHEMA)


def write_lines(quads: DataFrame, path: str, graphs: bool = True) -> None:
    """N-Quads, or N-Triples (which is Turtle), as distributed text; the default graph has no name in N-Quads."""
    g = F.when(F.col("g") == DEFAULT_GRAPH, "").otherwise(F.concat(F.lit(" "), F.col("g"))) if graphs else F.lit("")
    quads.select(F.concat(F.concat_ws(" ", "s", "p", "o"), g, F.lit(" .")).alias("value")).write.text(path)
