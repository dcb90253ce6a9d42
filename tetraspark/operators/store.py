"""A quad store of immutable snapshots.

The state is a lazy DataFrame of canonical terms s, p, o, g, repeated quads included. Appends are
unions, deletions filters; ``save`` writes a new version next to the old ones, and readers of an older
version are never disturbed. A version counts once Spark has marked it as complete.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import parser as P
from ..plans.compiler import Compiler, nodes, run_query
from ..plans.parser import Command, Element, Group, SparqlError, Unsupported, Var
from ..sources.quads import QuadSource
from .durable import durable
from .terms import DEFAULT_GRAPH

SCHEMA = "s string, p string, o string, g string"
COLUMNS = ["s", "p", "o", "g"]
#: Unions and filters pile up in the plan; after so many changes the state is checkpointed.
CHANGES = 20


class StoreError(RuntimeError):
    """An update cannot be carried out."""


def pattern(s=None, p=None, o=None, g=None) -> Column:
    """A condition for quads that agree with the given terms; true if none is given."""
    conds = [F.col(n) == x for n, x in zip(COLUMNS, (s, p, o, g)) if x is not None]
    return reduce(Column.__and__, conds) if conds else F.lit(True)


def _send(df: DataFrame, handler, each) -> None:
    handler.start()
    ok = False
    try:
        for row in df.toLocalIterator(prefetchPartitions=True):
            if each(*row) is False:
                break
        ok = True
    finally:
        handler.end(ok)


class SnapshotStore:
    """A closed store refuses all use; closing saves nothing, and a ``with`` block closes at its end."""

    #: What a store offers.
    read_only = False
    can_update = can_delete = can_list_graphs = True

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.changes = spark, path, 0
        self.quads = spark.createDataFrame([], SCHEMA)
        if path:
            self.load()

    @property
    def quads(self) -> DataFrame:
        if self._quads is None:
            raise StoreError("the store is closed")
        return self._quads

    @quads.setter
    def quads(self, df: DataFrame | None) -> None:
        self._quads = df

    @property
    def ready(self) -> bool:
        return self._quads is not None

    def close(self) -> None:
        self.quads = None

    def __enter__(self) -> SnapshotStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- versions
    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, complete: bool = True) -> list[int]:
        path, fs = self._files()
        if not fs.exists(path(self.path)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and (not complete or fs.exists(path(f"{self.path}/{n}/_SUCCESS"))))

    def save(self) -> str:
        """Writes the state, ranged and sorted by predicate and subject so that scans skip row groups."""
        if not self.path:
            raise StoreError("the store has no path")
        made = f"{self.path}/_{uuid.uuid4().hex}"  # of no one else, whatever other writers do or left behind
        self.quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(made)
        path, fs = self._files()
        while True:
            to = f"{self.path}/v{max(self._versions(complete=False), default=0) + 1}"
            if not fs.exists(path(to)) and fs.rename(path(made), path(to)):
                break
        self.load()
        return to

    def load(self) -> None:
        """The newest complete version; an empty store if there is none."""
        found = self._versions()
        self.quads = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)
        self.changes = 0

    def _set(self, df: DataFrame) -> None:
        self.changes += 1
        self.quads = df
        if self.changes >= CHANGES:
            self.quads, self.changes = durable(df), 0

    # -- quads
    def append(self, quads) -> None:
        """A DataFrame or rows of four terms; nulls are refused, repeated quads kept."""
        if not isinstance(quads, DataFrame):
            rows = [tuple(q) for q in quads]
            if any(len(r) != 4 or None in r for r in rows):
                raise ValueError("a quad has four terms")
            quads = self.spark.createDataFrame(rows, SCHEMA)
        else:
            quads = quads.select(*COLUMNS)
            nullable = [F.col(f.name).isNull() for f in quads.schema if f.nullable]
            if nullable and not quads.where(reduce(Column.__or__, nullable)).isEmpty():  # once, so that later scans stay plain
                raise ValueError("a quad has four terms")
        self._set(self.quads.unionByName(quads))

    def query(self, s=None, p=None, o=None, g=None) -> DataFrame:
        return self.quads.where(pattern(s, p, o, g))

    def count(self) -> int:
        """All quads of the store, copies included."""
        return self.quads.count()

    def delete(self, s=None, p=None, o=None, g=None) -> int:
        """Removes all matching quads, copies included, and returns how many there were."""
        cond = pattern(s, p, o, g)
        n = self.quads.where(cond).count()
        if n:
            self._set(self.quads.where(~cond))
        return n

    def remove(self, quads: DataFrame) -> None:
        """Removes exactly these quads where they are present."""
        self._set(self.quads.join(quads.select(*COLUMNS).distinct(), COLUMNS, "left_anti"))

    # -- graphs
    def load_graph(self, g: str | None = None) -> DataFrame:
        """The set of triples of a graph; of all graphs, if none is named."""
        return self.query(g=g).select("s", "p", "o").distinct()

    def save_graph(self, triples: DataFrame, g: str = DEFAULT_GRAPH) -> None:
        self.append(triples.select("s", "p", "o", F.lit(g).alias("g")))

    def update_graph(self, g: str = DEFAULT_GRAPH, additions: DataFrame | None = None, removals: DataFrame | None = None) -> None:
        """Removals come first."""
        if removals is not None:
            self.remove(removals.select("s", "p", "o", F.lit(g).alias("g")))
        if additions is not None:
            self.save_graph(additions, g)

    def delete_graph(self, g: str = DEFAULT_GRAPH) -> int:
        return self.delete(g=g)

    def graph_names(self) -> DataFrame:
        return self.quads.select("g").distinct()

    def list_graphs(self) -> DataFrame:
        """Named graphs with IRIs as names."""
        return self.graph_names().where(F.col("g").startswith("<") & (F.col("g") != DEFAULT_GRAPH))

    # -- pushed to a handler, row by row, without holding the answer
    def send_graph(self, handler, g: str | None = None) -> None:
        """``handler``: ``start()``, ``triple(s, p, o)`` for each triple until one returns False, ``end(ok)``."""
        _send(self.load_graph(g), handler, handler.triple)

    def send_query(self, text: str, triples, rows) -> None:
        """CONSTRUCT and DESCRIBE go to ``triples``; others to ``rows``: ``row(bindings)`` without unbound names, or ``answer(bool)``."""
        form, df = P.parse_query(text).form, self.sparql(text)
        if form == "select":
            _send(df, rows, lambda *r: rows.row({n: v for n, v in zip(df.columns, r) if v is not None}))
        elif form == "ask":
            _send(df, rows, rows.answer)
        else:
            _send(df, triples, triples.triple)

    # -- SPARQL
    def sparql(self, text: str, native: bool = False) -> DataFrame:
        return run_query(self.spark, QuadSource(self.quads), text, native)

    def update(self, text: str) -> None:
        """Commands in order, without a transaction: an error leaves the earlier ones done."""
        try:
            commands = P.parse_update(text)
        except Unsupported as e:
            raise StoreError(str(e)) from e
        except SparqlError as e:
            raise StoreError(f"cannot parse the update: {e}") from e
        for c in commands:
            self._run(c)

    def _run(self, c: Command) -> None:
        if c.kind in ("drop", "clear"):
            return self._drop(c)
        if c.kind == "insert data":
            fresh = {x: f"_:u{uuid.uuid4().hex}" for q in c.insert for x in q if isinstance(x, Var)}
            return self.append([tuple(fresh.get(x, x) for x in q[:3]) + (q[3] or DEFAULT_GRAPH,) for q in c.insert])
        if c.kind == "delete data":
            return self.remove(self.spark.createDataFrame([(*q[:3], q[3] or DEFAULT_GRAPH) for q in c.delete], SCHEMA))
        compiler = Compiler(self.spark, QuadSource(self.quads), c.using or ([c.graph] if c.graph and not c.using_named else []), c.using_named)
        if c.graph and not c.using and not c.using_named:
            # WITH sets the default graph of the pattern and hides no named one
            compiler.named = [r.g for r in self.list_graphs().collect()] if self._names_graphs(c.where) else []
        sol = compiler.recast_all(compiler.group(c.where))
        sol.df = durable(sol.df)  # one evaluation, on the state before the update
        home = c.graph or DEFAULT_GRAPH
        both = [compiler.template(sol, [(*q[:3], q[3] or home) for q in quads]) if quads else None for quads in (c.delete, c.insert)]
        if both[0] is not None:
            if any(isinstance(x, Var) and x.name.startswith("_:") and x.name not in sol.reps for q in c.delete for x in q):
                raise StoreError("a blank node is not allowed in a DELETE template")
            self.remove(both[0])
        if both[1] is not None:
            self.append(durable(both[1]))

    def _names_graphs(self, g: Group) -> bool:
        return any(isinstance(x, Element) and x.kind == "graph" for x in nodes(g))

    def _drop(self, c: Command) -> None:
        if c.target == "all":
            self.quads, self.changes = self.spark.createDataFrame([], SCHEMA), 0
        elif c.target == "default":
            self.delete(g=DEFAULT_GRAPH)
        elif c.target == "named":
            self._set(self.quads.where(F.col("g") == DEFAULT_GRAPH))
        elif not self.delete(g=c.target) and not c.silent:
            raise StoreError(f"The graph {c.target} does not exist")
