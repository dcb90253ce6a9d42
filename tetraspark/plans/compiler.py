"""SPARQL algebra to lazy DataFrames.

Patterns with one subject become one scan where the source offers it, joins are equi-joins on native
columns wherever both sides surely bind a variable, and everything else is left to Catalyst. Only
``?``, ``*`` and ``+`` paths run jobs while compiling: their fixpoints stop when a round adds nothing.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import terms as T
from ..operators.durable import durable
from .expressions import DECIMAL, DOUBLE, INTEGER, STRING, Expressions, constant, is_number, number_term, numeric, rank
from .parser import XSD, Element, Group, Query, SparqlError, Unsupported, Var, parse_query
from .solution import TERM, Rep, Solution, as_term, column_name, lex_of


def hidden(name: str) -> bool:
    return name.startswith("_:")


def variables(x) -> list[str]:
    """Names of the variables in a triple, in order, without repeats."""
    return list(dict.fromkeys(y.name for y in x if isinstance(y, Var)))


def nodes(x):
    """All parts of an expression or group, itself included."""
    yield x
    if isinstance(x, Group):
        inner = x.items
    elif isinstance(x, Element):
        inner = (x.a, x.b)
    else:
        inner = x if isinstance(x, (tuple, list)) else ()
    for y in inner:
        yield from nodes(y)


def is_exists(e) -> bool:
    return isinstance(e, tuple) and len(e) == 2 and e[0] == "exists" and isinstance(e[1], Group)


def conjuncts(e) -> list:
    return conjuncts(e[1]) + conjuncts(e[2]) if isinstance(e, tuple) and e[0] == "&&" else [e]


class Compiler:
    def __init__(self, spark: SparkSession, source, froms: list | None = None, named: list | None = None):
        self.spark, self.source = spark, source
        self.froms, self.named = (froms or []), (named or [])
        self.dataset = bool(self.froms or self.named)
        self.ids = itertools.count()

    # -- solutions
    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("unit")).drop("unit"))

    def nothing(self, names: list[str]) -> Solution:
        df = self.spark.range(0).select(*[F.lit(None).cast("string").alias(column_name(n)) for n in names])
        return Solution(df, {n: TERM for n in names}, set(names))

    def fresh(self) -> Var:
        return Var(f"_:.{next(self.ids)}")

    def env(self, sol: Solution):
        return lambda name: (sol.col(name), sol.reps[name]) if name in sol.reps else None

    def union(self, parts: list[Solution]) -> Solution:
        """All rows of ``parts``; a variable keeps a native column where all parts agree on it."""
        names = list(dict.fromkeys(n for p in parts for n in p.reps))
        reps = {}
        for n in names:
            of = {p.reps[n] for p in parts if n in p.reps}
            reps[n] = of.pop() if len(of) == 1 else Rep("iri", "") if all(r.kind == "iri" for r in of) else TERM
        frames = []
        for p in parts:
            cols = []
            for n in names:
                if n not in p.reps:
                    c = F.lit(None)
                elif p.reps[n] == reps[n]:
                    c = p.col(n)
                else:
                    c = lex_of(p.col(n), p.reps[n]) if reps[n].kind == "iri" else as_term(p.col(n), p.reps[n])
                cols.append(c.alias(column_name(n)))
            frames.append(p.df.select(*cols))
        return Solution(reduce(DataFrame.unionByName, frames), reps, {n for n in names if all(n in p.certain for p in parts)})

    def project(self, sol: Solution, names: list[str]) -> Solution:
        names = [n for n in names if n in sol.reps]
        return Solution(sol.df.select(*[sol.col(n) for n in names]), {n: sol.reps[n] for n in names}, sol.certain & set(names))

    # -- joins
    def align(self, a: Solution, b: Solution) -> tuple[Solution, Solution, list[str], dict[str, Column]]:
        """Both sides with shared variables in the same representation, and the right side's columns renamed."""
        shared = [n for n in a.reps if n in b.reps]
        for n in shared:
            r, q = a.reps[n], b.reps[n]
            if r == q:
                continue
            both = Rep("iri", "") if r.kind == q.kind == "iri" else TERM
            a, b = (self.recast(x, n, both) for x in (a, b))
        tag = f"__{next(self.ids)}"
        right = b.df.select(*[b.col(n).alias(column_name(n) + tag) for n in b.reps])
        return a, Solution(right, b.reps, b.certain), shared, {n: F.col(column_name(n) + tag) for n in b.reps}

    def recast(self, s: Solution, n: str, rep: Rep) -> Solution:
        if s.reps[n] == rep:
            return s
        c = lex_of(s.col(n), s.reps[n]) if rep.kind == "iri" else as_term(s.col(n), s.reps[n])
        return Solution(s.df.withColumn(column_name(n), c), s.reps | {n: rep}, s.certain)

    def compatible(self, a: Solution, b: Solution, shared: list[str], right: dict[str, Column]) -> Column | None:
        """Whether two solutions agree; None where they share nothing."""
        out = None
        for n in shared:
            x, y = a.col(n), right[n]
            c = x == y
            if n not in a.certain:
                c = c | x.isNull()
            if n not in b.certain:
                c = c | y.isNull()
            out = c if out is None else out & c
        return out

    def join(self, a: Solution, b: Solution, how: str = "inner", on: list | None = None) -> Solution:
        a, b, shared, right = self.align(a, b)
        cond = self.compatible(a, b, shared, right)
        merged = {n: (a.col(n) if n in a.certain or n not in b.reps else F.coalesce(a.col(n), right[n])) if n in a.reps else right[n] for n in [*a.reps, *[x for x in b.reps if x not in a.reps]]}
        reps = b.reps | a.reps
        for e in on or []:
            c = Expressions(lambda n: (merged[n], reps[n]) if n in merged else None).condition(e)
            cond = c if cond is None else cond & c
        if how == "inner" and cond is None:
            df = a.df.crossJoin(b.df)  # patterns without a common variable: the product is the answer
        else:
            df = a.df.join(b.df, F.lit(True) if cond is None else cond, how)
        if how in ("left_semi", "left_anti"):
            return Solution(df, a.reps, a.certain)
        df = df.select(*[c.alias(column_name(n)) for n, c in merged.items()])
        return Solution(df, {n: reps[n] for n in merged}, a.certain | b.certain if how == "inner" else a.certain)

    def minus(self, a: Solution, b: Solution) -> Solution:
        x, y, shared, right = self.align(a, b)
        if not shared:
            return a
        cond = self.compatible(x, y, shared, right)
        if not any(n in x.certain and n in y.certain for n in shared):
            cond = cond & reduce(Column.__or__, [x.col(n).isNotNull() & right[n].isNotNull() for n in shared])
        return Solution(x.df.join(y.df, cond, "left_anti"), x.reps, x.certain)

    # -- scans
    def graphs(self, ctx) -> list[str] | None:
        """The graphs a pattern may read; None for all."""
        if isinstance(ctx, str):
            return [ctx] if not self.dataset or ctx in self.named else []
        if isinstance(ctx, Var):
            return self.named if self.dataset else None
        return self.froms if self.dataset else None

    def branch(self, df: DataFrame, reps: dict, places: dict, ctx) -> Solution:
        """A frame of matches as a solution: ``places`` maps its columns to pattern terms."""
        if isinstance(ctx, Var):
            places = places | {"g": ctx}
            default = T.DEFAULT_GRAPH[1:-1] if reps["g"].kind == "iri" else T.DEFAULT_GRAPH
            if not self.dataset:
                df = df.where(F.col("g") != default)
        cols: dict[str, Column] = {}
        kinds: dict[str, Rep] = {}
        for at, v in places.items():
            if not isinstance(v, Var):
                continue
            if v.name in cols:
                df = df.where(as_term(F.col(at), reps[at]) == as_term(cols[v.name], kinds[v.name]))
            else:
                cols[v.name], kinds[v.name] = F.col(at), reps[at]
        out = df.select(*[c.alias(column_name(n)) for n, c in cols.items()])
        return Solution(out, kinds, set(kinds))

    def pattern(self, s, p, o, ctx) -> Solution:
        const = [None if isinstance(x, Var) else x for x in (s, p, o)]
        names = variables((s, p, o, ctx))
        parts = []
        for df, reps in self.source.match(*const, self.graphs(ctx)):
            if not self.source.disjoint and not isinstance(ctx, str):
                df = df.select(*(["s", "p", "o", "g"] if isinstance(ctx, Var) else ["s", "p", "o"]))
            if not self.source.disjoint:
                df = df.distinct()  # a graph is a set, and so is the union of graphs
            parts.append(self.branch(df, reps, {"s": s, "p": p, "o": o}, ctx))
        return self.union(parts) if parts else self.nothing(names)

    def star(self, s, pairs: list, ctx) -> Solution:
        const = [(p, None if isinstance(o, Var) else o) for p, o in pairs]
        found = self.source.star(None if isinstance(s, Var) else s, const, self.graphs(ctx))
        places = {"s": s} | {f"o{i}": o for i, (_, o) in enumerate(pairs)}
        parts = [self.branch(df, reps, places, ctx) for df, reps in found]
        return self.union(parts) if parts else self.nothing(variables([*places.values(), ctx]))

    def bgp(self, triples: list, ctx) -> Solution:
        """Stars first; then joins in an order that keeps to shared variables, most constants first."""
        stars: dict = {}
        parts: list[tuple[int, Solution]] = []
        for s, p, o in triples:
            if isinstance(p, tuple):
                parts.append((9, self.path(s, p, o, ctx)))
            elif isinstance(p, str) and hasattr(self.source, "star"):
                stars.setdefault(s, []).append((p, o))
            else:
                parts.append((sum(isinstance(x, Var) for x in (s, p, o)) * 2, self.pattern(s, p, o, ctx)))
        for s, pairs in stars.items():
            sol = self.pattern(s, *pairs[0], ctx) if len(pairs) == 1 else self.star(s, pairs, ctx)
            parts.append((isinstance(s, Var) * 4 - sum(not isinstance(o, Var) for _, o in pairs), sol))
        if not parts:
            return self.unit()
        parts.sort(key=lambda x: x[0])
        out = parts.pop(0)[1]
        while parts:
            i = next((i for i, (_, x) in enumerate(parts) if set(x.reps) & set(out.reps)), 0)
            out = self.join(out, parts.pop(i)[1])
        return out

    # -- paths
    def path(self, s, p, o, ctx) -> Solution:
        if isinstance(p, str):
            return self.pattern(s, p, o, ctx)
        op = p[0]
        if op == "inv":
            return self.path(o, p[1], s, ctx)
        if op == "seq":
            mid = self.fresh()
            sol = self.join(self.path(s, p[1], mid, ctx), self.path(mid, p[2], o, ctx))
            return self.project(sol, [n for n in sol.reps if n != mid.name])
        if op == "alt":
            return self.union([self.path(s, p[1], o, ctx), self.path(s, p[2], o, ctx)])
        if op == "not":
            parts = []
            for ban, x, y in ((p[1], s, o), (p[2], o, s)):
                if ban or not p[2] and x is s:
                    v = self.fresh()
                    sol = self.recast(self.pattern(x, v, y, ctx), v.name, TERM)
                    kept = Solution(sol.df.where(~sol.col(v.name).isin(ban)) if ban else sol.df, sol.reps, sol.certain)
                    parts.append(self.project(kept, [n for n in sol.reps if n != v.name]))
            return self.union(parts)
        return self.closure(s, p[1], o, ctx, op)

    def closure(self, s, inner, o, ctx, op: str) -> Solution:
        """``?``, ``+`` and ``*``: pairs are a set. From a constant, a frontier grows; otherwise paths double."""
        if not isinstance(s, Var) and isinstance(o, Var):
            return self.closure_from(s, inner, o, ctx, op, False)
        if isinstance(s, Var) and not isinstance(o, Var):
            return self.closure_from(o, inner, s, ctx, op, True)
        edges, per = self.edges(inner, ctx)
        if op == "opt":
            pairs = edges
        else:
            pairs = durable(edges)
            n = pairs.count()
            while True:
                a, b = pairs.alias("a"), pairs.alias("b")
                on = F.col("a.y") == F.col("b.x")
                for g in per:
                    on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
                more = a.join(b, on).select("a.x", "b.y", *[F.col(f"a.{g}") for g in per])
                pairs = durable(pairs.unionByName(more).distinct())
                m, n = n, pairs.count()
                if m == n:
                    break
        if op != "plus":
            any_ = self.recast_all(self.pattern(Var("_:.s"), Var("_:.p"), Var("_:.o"), ctx))
            gs = [any_.col(ctx.name).alias("g")] if per else []
            for n in ("_:.s", "_:.o"):
                pairs = pairs.unionByName(any_.df.select(any_.col(n).alias("x"), any_.col(n).alias("y"), *gs))
            if not isinstance(s, Var) and not per:
                pairs = pairs.unionByName(self.spark.range(1).select(F.lit(s).alias("x"), F.lit(s).alias("y")))
            pairs = pairs.distinct()
        return self.pairs(pairs, s, o, ctx, per)

    def closure_from(self, start: str, inner, to: Var, ctx, op: str, backwards: bool) -> Solution:
        edges, per = self.edges(inner, ctx)
        if backwards:
            edges = edges.select(F.col("y").alias("x"), F.col("x").alias("y"), *per)
        seen = new = edges.where(F.col("x") == start).distinct()
        if op != "opt":
            edges = durable(edges)
            seen = new = durable(edges.where(F.col("x") == start).distinct())
            while not new.isEmpty():
                a, b = new.alias("a"), edges.alias("b")
                on = F.col("a.y") == F.col("b.x")
                for g in per:
                    on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
                reached = a.join(b, on).select(F.lit(start).alias("x"), "b.y", *[F.col(f"a.{g}") for g in per]).distinct()
                new = durable(reached.join(seen.select("y", *per), ["y", *per], "left_anti").select("x", "y", *per))
                seen = durable(seen.unionByName(new))
        if op != "plus":
            if per:
                names = self.recast_all(self.pattern(Var("_:.s"), Var("_:.p"), Var("_:.o"), ctx))
                self_ = names.df.select(names.col(ctx.name).alias("g")).distinct()
            else:
                self_ = self.spark.range(1)
            seen = seen.unionByName(self_.select(F.lit(start).alias("x"), F.lit(start).alias("y"), *per)).distinct()
        return self.pairs(seen, start, to, ctx, per)

    def edges(self, inner, ctx) -> tuple[DataFrame, list[str]]:
        x, y = self.fresh(), self.fresh()
        sol = self.recast_all(self.path(x, inner, y, ctx))
        per = ["g"] if isinstance(ctx, Var) else []
        cols = [sol.col(x.name).alias("x"), sol.col(y.name).alias("y")] + ([sol.col(ctx.name).alias("g")] if per else [])
        return sol.df.select(*cols).distinct(), per

    def recast_all(self, sol: Solution) -> Solution:
        return Solution(sol.df.select(*[as_term(sol.col(n), r).alias(column_name(n)) for n, r in sol.reps.items()]), dict.fromkeys(sol.reps, TERM), sol.certain)

    def pairs(self, df: DataFrame, s, o, ctx, per) -> Solution:
        if not isinstance(s, Var):
            df = df.where(F.col("x") == s)
        if not isinstance(o, Var):
            df = df.where(F.col("y") == o)
        if isinstance(s, Var) and isinstance(o, Var) and s == o:
            df = df.where("x = y")
        cols = {v.name: F.col(c) for c, v in (("y", o), ("x", s)) if isinstance(v, Var)} | ({ctx.name: F.col("g")} if per else {})
        return Solution(df.select(*[c.alias(column_name(n)) for n, c in cols.items()]), dict.fromkeys(cols, TERM), set(cols))

    # -- groups
    def group(self, g: Group, ctx=None, filters: bool = True) -> Solution:
        out: Solution | None = None

        def add(x: Solution) -> Solution:
            return x if out is None else self.join(out, x)

        for e in g.items:
            if e.kind == "filter":
                continue
            if e.kind == "bgp":
                out = add(self.bgp(e.a, ctx))
            elif e.kind == "group":
                out = add(self.group(e.a, ctx))
            elif e.kind == "union":
                out = add(self.union([self.group(x, ctx) for x in e.a]))
            elif e.kind == "graph":
                out = add(self.group(e.b, e.a))
            elif e.kind == "subselect":
                out = add(self.select(e.a, ctx))
            elif e.kind == "values":
                out = add(self.values(e))
            elif e.kind == "optional":
                own = [c for x in e.a.items if x.kind == "filter" for c in conjuncts(x.a)]
                out = self.join(out or self.unit(), self.group(e.a, ctx, False), "left", own)
            elif e.kind == "minus":
                out = self.minus(out or self.unit(), self.group(e.a, ctx))
            elif e.kind == "bind":
                out = out or self.unit()
                if e.a.name in out.reps:
                    raise SparqlError(f"?{e.a.name} is bound already")
                out = self.bind(out, e.a.name, e.b, ctx)
        out = out or self.unit()
        if filters:
            for e in g.items:
                if e.kind == "filter":
                    for c in conjuncts(e.a):
                        out = self.filter(out, c, ctx)
        return out

    def bind(self, sol: Solution, name: str, e, ctx) -> Solution:
        sol, marks = self.mark_exists(sol, e, ctx)
        c, rep = Expressions(self.env(sol), marks).value(e)
        df = sol.df.select(*[sol.col(n) for n in sol.reps], c.alias(column_name(name)))
        return Solution(df, sol.reps | {name: rep}, set(sol.certain))

    def filter(self, sol: Solution, e, ctx) -> Solution:
        negated = isinstance(e, tuple) and e[0] == "!" and is_exists(e[1])
        if negated or is_exists(e):
            inner = (e[1] if negated else e)[1]
            return self.semi(sol, inner, ctx, "left_anti" if negated else "left_semi")
        keep = list(sol.reps)
        sol, marks = self.mark_exists(sol, e, ctx)
        df = sol.df.where(Expressions(self.env(sol), marks).condition(e))
        return Solution(df.select(*[sol.col(n) for n in keep]), {n: sol.reps[n] for n in keep}, sol.certain & set(keep))

    def semi(self, sol: Solution, inner: Group, ctx, how: str) -> Solution:
        own = [c for x in inner.items if x.kind == "filter" for c in conjuncts(x.a)]
        later = [c for c in own if not any(map(is_exists, nodes(c)))]
        right = self.group(Group([x for x in inner.items if x.kind != "filter"]), ctx)
        for c in own:
            if c not in later:
                right = self.filter(right, c, ctx)
        return self.join(sol, right, how, later)

    def mark_exists(self, sol: Solution, e, ctx):
        """EXISTS inside a larger expression: a flag for each row, from a left join with distinct keys."""
        marks: list[tuple[object, Column]] = []

        def walk(x) -> None:
            nonlocal sol
            if is_exists(x):
                right = self.group(x[1], ctx)
                shared = [n for n in right.reps if n in sol.reps]
                if not all(n in sol.certain and n in right.certain for n in shared):
                    raise Unsupported("EXISTS inside an expression needs variables that are always bound")
                right = self.project(right, shared)
                name = f"_:.{next(self.ids)}"
                right = Solution(right.df.distinct().withColumn(column_name(name), F.lit(True)), right.reps | {name: TERM}, right.certain | {name})
                if not shared:
                    right = Solution(right.df.limit(1), right.reps, right.certain)
                sol = self.join(sol, right, "left")
                marks.append((x[1], F.coalesce(F.col(column_name(name)), F.lit(False))))
            elif isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)

        walk(e)
        return sol, (lambda inner: next(c for g, c in marks if g is inner)) if marks else None

    def values(self, e: Element) -> Solution:
        """Inline rows; a variable with constants of one datatype stays native."""
        reps = {}
        for i, n in enumerate(e.a):
            of = {constant(row[i])[1] for row in e.b if row[i] is not None}
            reps[n] = of.pop() if len(of) == 1 and all(row[i] is not None for row in e.b) else TERM
        if not e.b:
            return self.nothing(e.a)
        frame = self.spark.createDataFrame([tuple(row) for row in e.b], ", ".join(f"c{i} string" for i in range(len(e.a))))
        cols = []
        for i, n in enumerate(e.a):
            c = F.col(f"c{i}")
            if reps[n].kind == "iri":
                c = F.substring(c, F.lit(2), F.char_length(c) - 2)
            elif reps[n] == STRING:
                c = T.lexical(c)
            elif reps[n].kind == "lit":
                native = {INTEGER: "bigint", DECIMAL: "decimal(38,10)", DOUBLE: "double"}.get(reps[n])
                if native:
                    c = T.lexical(c).try_cast(native)
                else:
                    reps[n] = TERM
            cols.append(c.alias(column_name(n)))
        return Solution(frame.select(*cols), reps, {n for i, n in enumerate(e.a) if all(row[i] is not None for row in e.b)})

    # -- queries
    def select(self, q: Query, ctx=None) -> Solution:
        sol = self.group(q.where, ctx)
        aggregates = q.group or q.having or any(self.has_aggregate(e) for _, e in q.select) or any(self.has_aggregate(e) for e, _ in q.order)
        order = q.order
        if aggregates:
            sol, rewritten = self.aggregate(sol, q, ctx)
            order = [(rewritten(e), d) for e, d in order]
            for v, e in q.select:
                if e is not None:
                    sol = self.bind(sol, v.name, rewritten(e), ctx)
            for e in q.having:
                sol = self.filter(sol, rewritten(e), ctx)
        else:
            for v, e in q.select:
                if e is not None:
                    sol = self.bind(sol, v.name, e, ctx)
        names = [v.name for v, _ in q.select] if q.select else [n for n in sol.reps if not hidden(n)]
        for n in names:
            if n not in sol.reps:
                sol = Solution(sol.df.withColumn(column_name(n), F.lit(None).cast("string")), sol.reps | {n: TERM}, sol.certain)
        keys = self.order_columns(sol, order)
        out = self.project(sol, names)
        if q.distinct and any(isinstance(x, Var) and x.name not in names for e, _ in order for x in nodes(e)):
            # keys that are not projected: of equal rows the first in the order counts
            first = Window.partitionBy(*[out.col(n) for n in out.reps]).orderBy(*keys)
            df = sol.df.withColumn("__first", F.row_number().over(first)).where("__first = 1").orderBy(*keys).select(*[out.col(n) for n in out.reps])
        elif q.distinct:
            out = Solution(out.df.distinct(), out.reps, out.certain)
            keys = self.order_columns(out, order)
            df = out.df.orderBy(*keys) if keys else out.df
        else:
            df = (sol.df.orderBy(*keys) if keys else sol.df).select(*[out.col(n) for n in out.reps])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solution(df, out.reps, out.certain)

    def order_columns(self, sol: Solution, order: list) -> list[Column]:
        keys = []
        for e, down in order:
            c, rep = Expressions(self.env(sol)).value(e)
            cols = T.order_keys(c) if rep == TERM else [lex_of(c, rep) if rep.kind == "iri" else c]
            keys += [x.desc_nulls_last() if down else x.asc_nulls_first() for x in cols]
        return keys

    def has_aggregate(self, e) -> bool:
        return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(self.has_aggregate(x) for x in e))

    def aggregate(self, sol: Solution, q: Query, ctx):
        """GROUP BY: keys and each different aggregate as a column of its own."""
        for v, e in q.group:
            if e is not None:
                sol = self.bind(sol, v.name, e, ctx)
        keys = [v.name for v, _ in q.group]
        found: list[tuple[tuple, str]] = []

        def rewrite(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                for old, name in found:
                    if old == e:
                        return Var(name)
                found.append((e, name := f"_:.{next(self.ids)}"))
                return Var(name)
            if isinstance(e, tuple):
                return tuple(rewrite(x) for x in e)
            return [rewrite(x) for x in e] if isinstance(e, list) else e

        for e in [*[e for _, e in q.select], *q.having, *[e for e, _ in q.order]]:
            rewrite(e)
        cols, reps = [], {n: sol.reps.get(n, TERM) for n in keys}
        for e, name in found:
            c, reps[name] = self.one_aggregate(sol, e)
            cols.append(c.alias(column_name(name)))
        by = [sol.col(n) if n in sol.reps else F.lit(None).cast("string").alias(column_name(n)) for n in keys]
        if cols:
            df = sol.df.groupBy(*by).agg(*cols)
        else:
            df = sol.df.select(*by).distinct() if by else sol.df.limit(1)
        return Solution(df, reps, {n for n in keys if n in sol.certain}), rewrite

    def one_aggregate(self, sol: Solution, e):
        _, name, distinct, arg, sep = e
        if arg is None:
            c = F.struct(*[sol.col(n) for n in sol.reps if not hidden(n)]) if distinct else F.lit(1)
            return (F.count_distinct(c) if distinct else F.count(c)), INTEGER
        v = Expressions(self.env(sol)).value(arg)
        c, rep = v
        if name == "COUNT":
            return (F.count_distinct(c) if distinct else F.count(c)), INTEGER
        if name == "SAMPLE":
            return F.first(c, ignorenulls=True), rep
        if name in ("MIN", "MAX"):
            if rep != TERM:
                return (F.min(c) if name == "MIN" else F.max(c)), rep
            got = (F.min if name == "MIN" else F.max)(F.when(c.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(T.order_keys(c))])))
            return got.getField("k3"), TERM
        if name == "GROUP_CONCAT":
            s = T.lexical(c) if rep == TERM else lex_of(c, rep)
            parts = F.collect_set(s) if distinct else F.collect_list(s)
            return F.array_join(F.array_sort(parts), sep), STRING
        n = numeric(v)
        if n is None:
            return F.first(F.lit(None).cast("double")), DOUBLE
        x = n[0]
        # one value that is no number spoils the whole
        bad = F.max(c.isNotNull() & x.isNull())
        if name == "SUM":
            # a sum beyond the type is an error, and errors leave the value unbound
            total = F.sum_distinct(x.cast("decimal(38,0)")).try_cast("bigint") if distinct and rep == INTEGER else F.sum_distinct(x) if distinct else F.try_sum(x)
        else:
            y = x.cast("decimal(28,10)") if rep == INTEGER else x
            total = F.sum_distinct(y) / F.count_distinct(y) if distinct else F.avg(y)
        total = F.when(~F.coalesce(bad, F.lit(False)), F.when(F.count(x) == 0, 0).otherwise(total))
        if is_number(rep):
            return total, (DECIMAL if rep == INTEGER and name == "AVG" else rep)
        top = F.coalesce(F.max(F.when(c.isNotNull(), rank(v))), F.lit(1))
        return number_term(total.cast("double"), F.greatest(top, F.lit(2)) if name == "AVG" else top)[0], TERM

    def template(self, sol: Solution, triples: list, graph: str | None = None) -> DataFrame:
        """Template triples for each solution, as distinct terms; incomplete or impossible ones are left out."""
        row = F.sha2(F.concat_ws("\x01", *[F.coalesce(as_term(sol.col(n), r), F.lit("\x02")) for n, r in sol.reps.items()]), 256) if sol.reps else F.lit("0")
        blanks = any(isinstance(x, Var) and hidden(x.name) and x.name not in sol.reps for t in triples for x in t)
        df = sol.df
        if blanks:
            # two equal solutions are two solutions: their blank nodes differ
            df = df.withColumn("row_name", F.concat(row, F.lit("-"), F.monotonically_increasing_id().cast("string")))

        def term(x) -> Column:
            if not isinstance(x, Var):
                return F.lit(x)
            if x.name in sol.reps:
                return as_term(sol.col(x.name), sol.reps[x.name])
            if hidden(x.name):
                return F.concat(F.lit("_:c"), F.substring(F.sha2(F.concat(F.col("row_name"), F.lit(x.name)), 256), 1, 32))
            return F.lit(None).cast("string")

        names = ["s", "p", "o", "g"]
        rows = F.array(*[F.struct(*[term(x).cast("string").alias(n) for n, x in zip(names, t)]) for t in triples])
        out = df.select(F.explode(rows).alias("t")).select("t.*")
        keep = reduce(Column.__and__, [F.col(c).isNotNull() for c in out.columns])
        keep = keep & ~F.col("s").startswith('"') & F.col("p").startswith("<")
        return out.where(keep).distinct()

    def describe(self, q: Query) -> DataFrame:
        """Triples of the resources and, through blank nodes, of what they hold."""
        fixed = [x for x in q.describe if isinstance(x, str)]
        parts = [self.spark.createDataFrame([(x,) for x in fixed], "s string")] if fixed else []
        if q.where:
            q2 = Query("select", where=q.where, order=q.order, limit=q.limit, offset=q.offset)
            q2.select = [(x, None) for x in q.describe if isinstance(x, Var)]
            sol = self.recast_all(self.select(q2))
            parts += [sol.df.select(sol.col(n).alias("s")) for n in sol.reps]
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        new = reduce(DataFrame.unionByName, parts).where("s is not null").distinct()
        all_ = self.recast_all(self.pattern(Var("s"), Var("p"), Var("o"), None))
        triples = all_.df.select(*[all_.col(n).alias(n) for n in "spo"])
        done = out = None
        while True:
            got = durable(triples.join(new, "s", "left_semi"))
            out = got if out is None else durable(out.unionByName(got).distinct())
            done = new if done is None else done.unionByName(new)
            new = durable(got.where(F.col("o").startswith("_:")).select(F.col("o").alias("s")).distinct().join(done, "s", "left_anti"))
            if new.isEmpty():
                return out


def run_query(spark: SparkSession, source, text_: str, native: bool = False) -> DataFrame:
    """The answer to a SPARQL query.

    SELECT: a column for each variable, canonical terms (``native``: numbers, times and texts as such,
    IRIs without brackets), unbound as null. ASK: one row, ``answer``. CONSTRUCT and DESCRIBE: s, p, o.
    """
    q = parse_query(text_)
    c = Compiler(spark, source, q.froms, q.named)
    if q.form == "select":
        sol = c.select(q)
        cols = [(sol.col(n) if native and (r.kind == "lit" or r == TERM) else lex_of(sol.col(n), r) if native else as_term(sol.col(n), r)).alias(n) for n, r in sol.reps.items()]
        return sol.df.select(*cols)
    if q.form == "ask":
        found = c.group(q.where).df.limit(1)
        return found.groupBy().agg((F.count(F.lit(1)) > 0).alias("answer"))
    if q.form == "construct":
        body = Query("select", where=q.where, order=q.order, limit=q.limit, offset=q.offset)
        inner = c.select(body)
        if not q.template:
            return spark.createDataFrame([], "s string, p string, o string")
        return c.template(inner, q.template)
    return c.describe(q)
