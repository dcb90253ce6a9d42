"""Solutions: a DataFrame with a column for each variable, and how each column stands for terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parser import XSD


@dataclass(frozen=True)
class Rep:
    """kind 'iri': keys of IRIs with the prefix ``meta``; 'lit': native values of datatype ``meta``; 'term': canonical terms."""

    kind: str
    meta: str = ""


TERM = Rep("term")


def column_name(var: str) -> str:
    """A column for a variable; variables are told apart by case, columns are not."""
    upper = "".join(str(i) + "_" for i, c in enumerate(var) if c != c.lower())
    return "v_" + re.sub(r"\W", lambda m: f"_{ord(m[0])}_", var) + (f"__{upper}" if upper else "")


@dataclass
class Solution:
    df: DataFrame
    reps: dict[str, Rep] = field(default_factory=dict)
    certain: set[str] = field(default_factory=set)  # variables that no row leaves unbound

    def col(self, var: str) -> Column:
        return F.col(column_name(var))


def lex_of(c: Column, rep: Rep) -> Column:
    """The lexical form (of an IRI: the IRI)."""
    if rep.kind == "iri":
        return F.concat(F.lit(rep.meta), c.cast("string")) if rep.meta else c.cast("string")
    if rep.meta == XSD + "dateTime":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if rep.meta == XSD + "boolean":
        return F.when(c, "true").otherwise(F.when(~c, "false"))
    return c.cast("string")


def as_term(c: Column, rep: Rep) -> Column:
    """The canonical term; null stays null."""
    from ..operators.terms import make_iri, make_literal

    if rep.kind == "term":
        return c
    lex = lex_of(c, rep)
    return make_iri(lex) if rep.kind == "iri" else make_literal(lex, rep.meta)
