"""The simple pattern engine: several patterns select the quads that match each of them.

It is no join: a quad has to match all patterns. Modifiers, filters and projections are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.parser import Group, Var, parse_query


def _forms(x: str) -> list[str]:
    """An IRI with and without its brackets; other terms as they are."""
    if x.startswith(('"', "_:")):
        return [x]
    return [x, x[1:-1] if x.startswith("<") and x.endswith(">") else f"<{x}>"]


def pattern(s=None, p=None, o=None) -> Column:
    """A condition for quads that hold the given terms in either form; true if none is given."""
    conds = [F.col(n).isin(_forms(x)) for n, x in zip("spo", (s, p, o)) if x is not None]
    return reduce(Column.__and__, conds) if conds else F.lit(True)


def intersect_patterns(quads: DataFrame, patterns: list) -> DataFrame:
    """Patterns of three terms or None; columns are the variable places of the first pattern."""
    if patterns is None:
        raise ValueError("patterns are needed")
    if not patterns:
        return quads.limit(0).select("s", "p", "o")
    hits = quads.where(reduce(lambda a, b: a & b, [pattern(*t) for t in patterns]))
    if len(patterns) > 1:
        hits = hits.distinct()
    return hits.select(*[n for n, x in zip("spo", patterns[0]) if x is None])


def simple_query(quads: DataFrame, text: str) -> DataFrame:
    """The root patterns' rows, then those of each child group; ``GRAPH ?g`` adds a column of its own."""
    parts: list[DataFrame] = []

    def triples(g: Group) -> list:
        found = [t for e in g.items if e.kind == "bgp" for t in e.a]
        return [tuple(None if isinstance(x, Var) or isinstance(x, str) and x.startswith('"') else x for x in t) for t in found]

    def walk(g: Group) -> None:
        if own := triples(g):
            parts.append(intersect_patterns(quads, own))
        for e in g.items:
            if e.kind == "graph":
                own = triples(e.b)
                if isinstance(e.a, Var):
                    if own:
                        hits = quads.where(reduce(lambda a, b: a & b, [pattern(*t) for t in own]))
                        cols = [hits[n] for n, x in zip("spo", own[0]) if x is None and n != e.a.name]
                        parts.append((hits.distinct() if len(own) > 1 else hits).select(*cols, hits["g"].alias(e.a.name)))
                elif own:
                    parts.append(intersect_patterns(quads.where(quads["g"].isin(_forms(e.a))), own))
            elif e.kind in ("optional", "group", "minus"):
                walk(e.a)
            elif e.kind == "union":
                for x in e.a:
                    walk(x)

    walk(parse_query(text).where)
    if not parts:
        return quads.limit(0).select("s", "p", "o")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
