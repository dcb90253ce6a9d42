"""Relational tables viewed as RDF, without materialising a triple.

Every property of a table is a branch of its own with a constant predicate and graph, so a pattern
prunes to the tables that can match; subjects stay integer keys and objects native columns, so joins,
filters and Parquet pushdown work on base columns. Patterns that share a subject read their table once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.terms import decode
from ..plans.parser import RDF, XSD
from ..plans.solution import Rep

TYPE = f"<{RDF}type>"


@dataclass(frozen=True)
class Property:
    """A predicate of a table: ``column`` is a literal of datatype ``dt``, or a key of IRIs ``prefix``."""

    predicate: str
    column: str
    rep: Rep


@dataclass
class TableView:
    """``key`` is unique and not null; the subject is prefix + key, the graph is one for the table."""

    df: DataFrame
    key: str
    prefix: str
    graph: str
    cls: str
    properties: list[Property]


def _native(rep: Rep, term: str, df: DataFrame, column: str):
    """A filter that ``column``, seen as ``rep``, is ``term``; None if it never is."""
    kind, lex, dt, _ = decode(term)
    c = F.col(column)
    if rep.kind == "iri":
        if kind != "I" or not lex.startswith(rep.meta):
            return None
        key = lex[len(rep.meta):]
        of = df.schema[column].dataType.simpleString()
        if of == "string":
            return c == key
        return c == F.lit(int(key)).cast(of) if key.isdigit() and str(int(key)) == key else None
    if kind != "L" or dt != rep.meta:
        return None
    if dt == XSD + "string":
        return c == lex
    return c == F.lit(lex).try_cast(df.schema[column].dataType)


class RelationalSource:
    """Patterns over a list of table views. No triple is in two graphs, so patterns need no distinct."""

    disjoint = True

    def __init__(self, views: list[TableView]):
        self.views = views

    def graphs(self) -> list[str]:
        return [v.graph for v in self.views]

    def _rows(self, view: TableView, s, pairs: list) -> DataFrame | None:
        """``view`` filtered by constant subject and (property, constant or None) pairs."""
        df = view.df
        if s is not None:
            cond = _native(Rep("iri", view.prefix), s, df, view.key)
            if cond is None:
                return None
            df = df.where(cond)
        for prop, o in pairs:
            if prop is None:
                if o is not None and o != view.cls:
                    return None
                continue
            if o is not None:
                cond = _native(prop.rep, o, view.df, prop.column)
                if cond is None:
                    return None
                df = df.where(cond)
            elif view.df.schema[prop.column].nullable:
                df = df.where(F.col(prop.column).isNotNull())
        return df

    def match(self, s, p, o, graphs) -> list[tuple[DataFrame, dict[str, Rep]]]:
        """Branches of a pattern: frames with columns s, p, o, g and their representations."""
        out = []
        for v in self.views:
            if graphs is not None and v.graph not in graphs:
                continue
            for prop in [None, *v.properties]:
                pred = TYPE if prop is None else prop.predicate
                if p is not None and p != pred:
                    continue
                df = self._rows(v, s, [(prop, o)])
                if df is None:
                    continue
                obj = F.lit(v.cls[1:-1]) if prop is None else F.col(prop.column)
                reps = {"s": Rep("iri", v.prefix), "p": Rep("iri", ""), "o": Rep("iri", "") if prop is None else prop.rep, "g": Rep("iri", "")}
                out.append((df.select(F.col(v.key).alias("s"), F.lit(pred[1:-1]).alias("p"), obj.alias("o"), F.lit(v.graph[1:-1]).alias("g")), reps))
        return out

    def star(self, s, pairs: list, graphs) -> list[tuple[DataFrame, dict[str, Rep]]]:
        """All (predicate, object constant or None) of one subject in one scan of each table that has them all.

        Frames have columns s, o0, o1, ... and g. Subjects of two tables never meet, so a table
        without one of the predicates has no part in the answer.
        """
        out = []
        for v in self.views:
            by = {TYPE: None} | {x.predicate: x for x in v.properties}
            if graphs is not None and v.graph not in graphs or not all(p in by for p, _ in pairs):
                continue
            df = self._rows(v, s, [(by[p], o) for p, o in pairs])
            if df is None:
                continue
            cols, reps = [F.col(v.key).alias("s"), F.lit(v.graph[1:-1]).alias("g")], {"s": Rep("iri", v.prefix), "g": Rep("iri", "")}
            for i, (p, _) in enumerate(pairs):
                prop = by[p]
                cols.append((F.lit(v.cls[1:-1]) if prop is None else F.col(prop.column)).alias(f"o{i}"))
                reps[f"o{i}"] = Rep("iri", "") if prop is None else prop.rep
            out.append((df.select(*cols), reps))
        return out


EX = "http://example.org/"

#: The driver's tables: table, key, and (predicate, column, datatype or table referred to).
TABLES = {
    "region": ("r_regionkey", [("name", "r_name", "string")]),
    "nation": ("n_nationkey", [("name", "n_name", "string"), ("region", "n_regionkey", "@region")]),
    "customer": ("c_custkey", [("name", "c_name", "string"), ("nation", "c_nationkey", "@nation"), ("balance", "c_acctbal", "double"), ("segment", "c_mktsegment", "string")]),
    "supplier": ("s_suppkey", [("name", "s_name", "string"), ("nation", "s_nationkey", "@nation"), ("balance", "s_acctbal", "double")]),
    "part": ("p_partkey", [("name", "p_name", "string"), ("brand", "p_brand", "string"), ("kind", "p_type", "string"), ("size", "p_size", "integer"), ("retail", "p_retailprice", "double")]),
    "orders": ("o_orderkey", [("customer", "o_custkey", "@customer"), ("status", "o_orderstatus", "string"), ("price", "o_totalprice", "double"), ("date", "o_orderdate", "dateTime"), ("priority", "o_orderpriority", "string")]),
    "events": ("event_id", [("at", "ts", "dateTime"), ("user", "user_id", "integer"), ("eventType", "event_type", "string"), ("value", "value", "double")]),
}


def example_views(spark, sf_dir: str, tables=None) -> RelationalSource:
    """The driver's tables as RDF: subjects ``.../<table>/<key>``, graphs ``.../g/<table>``."""
    views = []
    for t in tables or TABLES:
        key, props = TABLES[t]
        own = [Property(f"<{EX}{n}>", c, Rep("iri", f"{EX}{k[1:]}/") if k[0] == "@" else Rep("lit", XSD + k)) for n, c, k in props]
        views.append(TableView(spark.read.parquet(f"{sf_dir}/{t}.parquet"), key, f"{EX}{t}/", f"<{EX}g/{t}>", f"<{EX}class/{t}>", own))
    return RelationalSource(views)
