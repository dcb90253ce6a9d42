"""SPARQL expressions as Spark columns.

A value is a column and its ``Rep``; null stands for unbound and for errors. Native columns are
compared and computed natively; canonical terms are decoded by expressions, never by Python code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import terms as T
from .parser import XSD, SparqlError, Unsupported, Var
from .solution import TERM, Rep, as_term, lex_of

STRING, BOOLEAN, INTEGER = Rep("lit", XSD + "string"), Rep("lit", XSD + "boolean"), Rep("lit", XSD + "integer")
DECIMAL, DOUBLE, MOMENT = Rep("lit", XSD + "decimal"), Rep("lit", XSD + "double"), Rep("lit", XSD + "dateTime")
RANK = {XSD + "integer": 1, XSD + "decimal": 2, XSD + "double": 3}

Value = tuple[Column, Rep]


def is_number(rep: Rep) -> bool:
    return rep.kind == "lit" and rep.meta in RANK


def constant(term: str) -> Value:
    """A constant as natively as its datatype allows."""
    kind, lex, dt, lang = T.decode(term)
    if kind == "I":
        return F.lit(lex), Rep("iri", "")
    # what its native type cannot hold stays a term: a zone, an integer beyond 64 bits
    wide = dt == INTEGER.meta and re.fullmatch(r"[+-]?\d+", lex) and not -(2**63) <= int(lex) < 2**63
    if kind == "L" and not lang and not wide and not (dt == MOMENT.meta and re.search(T.ZONE, lex)):
        native = {STRING.meta: "string", BOOLEAN.meta: "boolean", INTEGER.meta: "bigint", DECIMAL.meta: "decimal(38,10)", DOUBLE.meta: "double", MOMENT.meta: "timestamp_ntz"}
        if dt in native:
            return (F.lit(lex) if dt == STRING.meta else F.lit(lex).try_cast(native[dt])), Rep("lit", dt)
    return F.lit(term), TERM


def numeric(v: Value) -> Value | None:
    """The value as a native number; None where it can never be one."""
    c, rep = v
    if is_number(rep):
        return v
    return (T.number(c), DOUBLE) if rep == TERM else None


def truth(v: Value) -> Column:
    """The effective boolean value."""
    c, rep = v
    if rep == BOOLEAN:
        return c
    if is_number(rep):
        return (c != 0) & ~F.isnan(c.cast("double"))
    if rep == STRING:
        return c != ""
    if rep == TERM:
        dt, lex = T.datatype(c), T.lexical(c)
        return (
            F.when(dt == BOOLEAN.meta, lex.isin("true", "1"))
            .when(dt.isin(T.NUMERIC), F.coalesce((T.number(c) != 0) & ~F.isnan(T.number(c)), F.lit(False)))
            .when((dt == STRING.meta) | (T.language(c) != ""), lex != "")
        )
    return F.lit(None).cast("boolean")


def text(v: Value) -> Column:
    """The lexical form of a literal."""
    c, rep = v
    if rep == TERM:
        return F.when(c.startswith('"'), T.lexical(c))
    return lex_of(c, rep) if rep.kind == "lit" else F.lit(None).cast("string")


def like_first(v: Value, lex: Column) -> Value:
    """A string with the language of ``v``."""
    c, rep = v
    if rep != TERM:
        return lex, STRING
    lang = T.language(c)
    return F.concat(F.lit('"'), T.escape(lex), F.lit('"'), F.when(lang == "", "").otherwise(F.concat(F.lit("@"), lang))), TERM


def instant(v: Value) -> Column:
    c, rep = v
    return T.instant(c) if rep == TERM else moment(v)


def moment(v: Value) -> Column:
    c, rep = v
    return c if rep == MOMENT else T.moment(c) if rep == TERM else F.lit(None).cast("timestamp_ntz")


def equal(a: Value, b: Value) -> Column:
    (x, r), (y, q) = a, b
    if is_number(r) and is_number(q) or r == q and r != TERM:
        return x == y
    if TERM not in (r, q):
        if r.kind == q.kind == "iri":
            short, long = ((x, r), (y, q)) if r.meta == "" else ((y, q), (x, r))
            if short[1].meta == "":
                # compare the keys, so that a constant reaches the scan
                key = F.when(short[0].startswith(long[1].meta), F.substring(short[0], F.lit(len(long[1].meta) + 1), F.char_length(short[0])))
                return lex_of(*long) == F.concat(F.lit(long[1].meta), key)
        if r.kind == q.kind == "lit":
            return F.lit(None).cast("boolean")  # literals of different types: an error
        return F.when(x.isNotNull() & y.isNotNull(), F.lit(False))
    s, t = as_term(x, r), as_term(y, q)
    m, n = numeric(a), numeric(b)
    out = F.when(m[0].isNotNull() & n[0].isNotNull(), m[0] == n[0]) if m and n else F.when(F.lit(False), F.lit(False))
    p, w = instant(a), instant(b)
    out = out.when(p.isNotNull() & w.isNotNull(), p == w).when(s == t, F.lit(True))
    apart = s.startswith('"') & t.startswith('"') & (T.datatype(s) != T.datatype(t))
    return out.when(apart, F.lit(None).cast("boolean")).otherwise(s == t)


ORDER = {
    "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def compare(op: str, a: Value, b: Value) -> Column:
    (x, r), (y, q) = a, b
    f = ORDER[op]
    if is_number(r) and is_number(q) or r == q and r.kind == "lit":
        return f(x, y)
    if TERM not in (r, q):
        return F.lit(None).cast("boolean")
    m, n = numeric(a), numeric(b)
    out = F.when(m[0].isNotNull() & n[0].isNotNull(), f(m[0], n[0])) if m and n else F.when(F.lit(False), F.lit(False))
    p, w = instant(a), instant(b)
    s, t = as_term(x, r), as_term(y, q)
    same = (T.datatype(s) == T.datatype(t)) & ~T.datatype(s).isin(T.NUMERIC)
    return out.when(p.isNotNull() & w.isNotNull(), f(p, w)).when(same, f(T.lexical(s), T.lexical(t)))


def rank(v: Value) -> Column | int:
    """1 integer, 2 decimal, 3 double."""
    c, rep = v
    if is_number(rep):
        return RANK[rep.meta]
    dt = T.datatype(c)
    return F.when(dt.isin(T.INTEGERS), 1).when(dt == DECIMAL.meta, 2).otherwise(3)


def number_term(c: Column, r: Column) -> Value:
    """A double as a term of the datatype that rank ``r`` says."""
    return (
        F.when(r == 1, T.make_literal(c.try_cast("decimal(38,0)").cast("string"), INTEGER.meta))
        .when(r == 2, T.make_literal(c.try_cast("decimal(38,10)").cast("double").cast("string"), DECIMAL.meta))
        .otherwise(T.make_literal(c.cast("string"), DOUBLE.meta)),
        TERM,
    )


def arithmetic(op: str, a: Value, b: Value) -> Value:
    m, n = numeric(a), numeric(b)
    if m is None or n is None:
        return F.lit(None).cast("double"), DOUBLE
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    p, q = rank(a), rank(b)
    if isinstance(p, int) and isinstance(q, int):
        top = max(p, q)
        x, y = m[0], n[0]
        if op == "/" and top == 1:
            return F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")), DECIMAL
        if top == 3:
            x, y = x.cast("double"), y.cast("double")
        elif p != q:
            x, y = (z.cast("decimal(20,0)") if k == 1 else z for z, k in ((x, p), (y, q)))
        return f(x, y), (INTEGER, DECIMAL, DOUBLE)[top - 1]
    top = F.greatest(F.lit(p) if isinstance(p, int) else p, F.lit(q) if isinstance(q, int) else q)
    if op == "/":
        top = F.greatest(top, F.lit(2))
    return number_term(f(m[0].cast("double"), n[0].cast("double")), top)


CASTS = {
    "integer": ("decimal(38,0)", "bigint", INTEGER), "decimal": ("decimal(38,10)", None, DECIMAL), "double": ("double", None, DOUBLE),
    "float": ("float", "double", DOUBLE), "boolean": ("boolean", None, BOOLEAN), "dateTime": ("timestamp_ntz", None, MOMENT),
}


def cast(name: str, v: Value) -> Value:
    c, rep = v
    if name == "string":
        return lex_of(c, rep) if rep != TERM else T.lexical(c), STRING
    if name == "date":
        return T.make_literal(F.date_format(F.coalesce(moment(v), text(v).try_cast("timestamp_ntz")), "yyyy-MM-dd"), XSD + "date"), TERM
    if name not in CASTS:
        raise Unsupported(f"no cast to {name}")
    via, then, out = CASTS[name]
    if is_number(rep) and name == "decimal":
        # money and the like: exact to two digits, so that sums don't depend on the order
        return c.cast("decimal(28,10)"), out
    src = c if rep.kind == "lit" else text(v)
    if name == "integer" and rep != INTEGER and not is_number(rep):
        src = F.when(F.trim(src).rlike(r"^[+-]?\d+$"), F.trim(src))
    if name == "integer" and is_number(rep):
        return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint"), out
    got = src.try_cast(via)
    return (got.try_cast(then) if then else got), out


class Expressions:
    """Compiles expressions; ``look`` gives a variable's value or None, ``exists`` a column for EXISTS."""

    def __init__(self, look: Callable[[str], Value | None], exists=None):
        self.look, self.exists = look, exists

    def condition(self, e) -> Column:
        return truth(self.value(e))

    def value(self, e) -> Value:
        if isinstance(e, Var):
            return self.look(e.name) or (F.lit(None).cast("string"), TERM)
        op = e[0]
        if op == "const":
            return constant(e[1])
        if op in ("&&", "||"):
            x, y = self.condition(e[1]), self.condition(e[2])
            return (x & y if op == "&&" else x | y), BOOLEAN
        if op == "!":
            return ~self.condition(e[1]), BOOLEAN
        if op == "=":
            return equal(self.value(e[1]), self.value(e[2])), BOOLEAN
        if op == "!=":
            return ~equal(self.value(e[1]), self.value(e[2])), BOOLEAN
        if op in ORDER:
            return compare(op, self.value(e[1]), self.value(e[2])), BOOLEAN
        if op in "+-*/":
            return arithmetic(op, self.value(e[1]), self.value(e[2]))
        if op == "neg":
            return arithmetic("-", constant(f'"0"^^<{XSD}integer>'), self.value(e[1]))
        if op == "in":
            x = self.value(e[1])
            out = F.lit(False)
            for y in e[2]:
                out = out | equal(x, self.value(y))
            return out, BOOLEAN
        if op == "exists":
            if self.exists is None:
                raise Unsupported("EXISTS is not supported here")
            return self.exists(e[1]), BOOLEAN
        if op == "agg":
            raise SparqlError("an aggregate is not allowed here")
        return self.call(e[1], e[2])

    def call(self, name: str, args: list) -> Value:
        if name.startswith("<"):
            if not name[1:-1].startswith(XSD) or len(args) != 1:
                raise Unsupported(f"no function {name}")
            return cast(name[1 + len(XSD):-1], self.value(args[0]))
        if name == "BOUND":
            return self.value(args[0])[0].isNotNull(), BOOLEAN
        if name in ("IF", "COALESCE"):
            values = [self.value(a) for a in args]
            picks = values[1:] if name == "IF" else values
            same = len({r for _, r in picks}) == 1
            cols = [c if same else as_term(c, r) for c, r in picks]
            rep = picks[0][1] if same else TERM
            if name == "COALESCE":
                return F.coalesce(*cols), rep
            test = truth(values[0])
            return F.when(test, cols[0]).when(~test, cols[1]), rep
        if name == "REGEX" and self._broken(args[1:]) or name == "REPLACE" and self._broken([args[1], *args[3:]]):
            return F.lit(None).cast("string"), TERM
        f = getattr(self, "f_" + name.lower(), None)
        if f is None:
            raise Unsupported(f"no function {name}")
        return f(*(self.value(a) for a in args))

    # -- terms
    def f_str(self, v):
        return (T.lexical(v[0]) if v[1] == TERM else lex_of(*v)), STRING

    def f_lang(self, v):
        return (T.language(v[0]) if v[1] == TERM else F.when(v[0].isNotNull(), F.lit("")) if v[1].kind == "lit" else F.lit(None).cast("string")), STRING

    def f_datatype(self, v):
        c, rep = v
        return (T.datatype(c) if rep == TERM else F.when(c.isNotNull(), F.lit(rep.meta)) if rep.kind == "lit" else F.lit(None).cast("string")), Rep("iri", "")

    def f_iri(self, v):
        return self.f_str(v)[0], Rep("iri", "")

    f_uri = f_iri

    def f_bnode(self, v=None):
        return F.concat(F.lit("_:"), F.md5(text(v).cast("binary")) if v else F.replace(F.uuid(), F.lit("-"), F.lit(""))), TERM

    def f_strdt(self, v, dt):
        d = lex_of(*dt) if dt[1] != TERM else T.lexical(dt[0])
        tail = F.when(d == STRING.meta, '"').otherwise(F.concat(F.lit('"^^<'), d, F.lit(">")))
        return F.concat(F.lit('"'), T.escape(text(v)), tail), TERM

    def f_strlang(self, v, lang):
        return F.concat(F.lit('"'), T.escape(text(v)), F.lit('"@'), F.lower(text(lang))), TERM

    def f_uuid(self):
        return F.concat(F.lit("urn:uuid:"), F.uuid()), Rep("iri", "")

    def f_struuid(self):
        return F.uuid(), STRING

    def f_sameterm(self, a, b):
        return as_term(*a) == as_term(*b), BOOLEAN

    def _kind(self, v, letter):
        c, rep = v
        if rep == TERM:
            return T.kind(c) == letter, BOOLEAN
        return F.when(c.isNotNull(), F.lit({"iri": "I", "lit": "L"}[rep.kind] == letter)), BOOLEAN

    def f_isiri(self, v):
        return self._kind(v, "I")

    f_isuri = f_isiri

    def f_isblank(self, v):
        return self._kind(v, "B")

    def f_isliteral(self, v):
        return self._kind(v, "L")

    def f_isnumeric(self, v):
        n = numeric(v)
        return F.when(v[0].isNotNull(), n[0].isNotNull() if n else F.lit(False)), BOOLEAN

    def f_langmatches(self, a, b):
        lang, want = F.lower(text(a)), F.lower(text(b))
        return F.when(want == "*", lang != "").otherwise((lang == want) | F.startswith(lang, F.concat(want, F.lit("-")))), BOOLEAN

    # -- strings
    def f_strlen(self, v):
        return F.char_length(text(v)).cast("bigint"), INTEGER

    def f_substr(self, v, start, length=None):
        within = lambda c: F.greatest(F.least(c.cast("double"), F.lit(2.0**30)), F.lit(-(2.0**30))).cast("int")  # noqa: E731  no text is longer
        at, n = within(numeric(start)[0]), (within(numeric(length)[0]) if length else F.lit(2**30))
        # a start before the text uses up length, as in XPath
        first = F.greatest(at, F.lit(1))
        keep = F.greatest(F.when(at < 1, n + at - 1).otherwise(n), F.lit(0)) if length else n
        return like_first(v, F.substring(text(v), first, keep))

    def f_ucase(self, v):
        return like_first(v, F.upper(text(v)))

    def f_lcase(self, v):
        return like_first(v, F.lower(text(v)))

    def f_strstarts(self, a, b):
        return F.startswith(text(a), text(b)), BOOLEAN

    def f_strends(self, a, b):
        return F.endswith(text(a), text(b)), BOOLEAN

    def f_contains(self, a, b):
        return F.contains(text(a), text(b)), BOOLEAN

    def f_concat(self, *vs):
        return F.concat(*(text(v) for v in vs)) if vs else F.lit(""), STRING

    def f_strbefore(self, a, b):
        at = F.call_function("locate", text(b), text(a))
        return F.when(at > 0, F.substring(text(a), F.lit(1), at - 1)).when(at == 0, ""), STRING

    def f_strafter(self, a, b):
        at = F.call_function("locate", text(b), text(a))
        return F.when(at > 0, F.substring(text(a), at + F.char_length(text(b)), F.char_length(text(a)))).when(at == 0, ""), STRING

    def f_encode_for_uri(self, v):
        return F.replace(F.replace(F.replace(F.url_encode(text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), STRING

    def _pattern(self, pattern, flags):
        p = text(pattern)
        if flags is None:
            return p
        f = text(flags)
        quoted = F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.concat(F.lit("(?"), F.replace(f, F.lit("q"), F.lit("")), F.lit(")"), F.when(F.contains(f, F.lit("q")), quoted).otherwise(p))

    def _broken(self, args: list) -> bool:
        """Whether constant pattern and flags are no regular expression."""
        lex = [T.decode(a[1])[1] if isinstance(a, tuple) and a[0] == "const" else None for a in args[:2]]
        spark = SparkSession.getActiveSession()
        if None in lex or not lex or spark is None or len(lex) > 1 and "q" in lex[1]:
            return False
        try:
            spark._jvm.java.util.regex.Pattern.compile((f"(?{lex[1]})" if len(lex) > 1 else "") + lex[0])
        except Exception:  # noqa: BLE001  whatever the JVM says of it
            return True
        return False

    def f_regex(self, v, pattern, flags=None):
        return F.call_function("rlike", text(v), self._pattern(pattern, flags)), BOOLEAN

    def f_replace(self, v, pattern, by, flags=None):
        return like_first(v, F.call_function("regexp_replace", text(v), self._pattern(pattern, flags), text(by)))

    # -- numbers
    def _number(self, v, f):
        n = numeric(v)
        if n is None:
            return F.lit(None).cast("double"), DOUBLE
        c, r = n[0], rank(v)
        if isinstance(r, int):
            out = f(c)
            return (out.cast("bigint") if r == 1 else out.cast("double") if r == 3 else out), v[1]
        return number_term(f(c).cast("double"), r)

    def f_abs(self, v):
        return self._number(v, F.abs)

    def f_ceil(self, v):
        return self._number(v, F.ceil)

    def f_floor(self, v):
        return self._number(v, F.floor)

    def f_round(self, v):
        return self._number(v, lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")) if v[1] == DECIMAL else F.floor(c + 0.5))

    def f_rand(self):
        return F.rand(), DOUBLE

    # -- time
    def f_now(self):
        return F.current_timestamp().cast("timestamp_ntz"), MOMENT

    def f_year(self, v):
        return F.year(moment(v)).cast("bigint"), INTEGER

    def f_month(self, v):
        return F.month(moment(v)).cast("bigint"), INTEGER

    def f_day(self, v):
        return F.day(moment(v)).cast("bigint"), INTEGER

    def f_hours(self, v):
        return F.hour(moment(v)).cast("bigint"), INTEGER

    def f_minutes(self, v):
        return F.minute(moment(v)).cast("bigint"), INTEGER

    def f_seconds(self, v):
        return F.extract(F.lit("SECOND"), moment(v)).cast("decimal(8,6)"), DECIMAL

    def f_tz(self, v):
        return F.regexp_extract(text(v), r"T.*?(Z|[+-]\d\d:\d\d)$", 1), STRING

    def f_timezone(self, v):
        z = self.f_tz(v)[0]
        span = F.concat(F.when(z.startswith("-"), "-P").otherwise("P"), F.lit("T"), F.substring(z, 2, 2).try_cast("int").cast("string"), F.lit("H"))
        return F.when(z == "Z", F.lit(f'"PT0S"^^<{XSD}dayTimeDuration>')).when(z != "", T.make_literal(span, XSD + "dayTimeDuration")), TERM

    # -- digests
    def f_md5(self, v):
        return F.md5(text(v).cast("binary")), STRING

    def f_sha1(self, v):
        return F.sha1(text(v).cast("binary")), STRING

    def f_sha256(self, v):
        return F.sha2(text(v), 256), STRING

    def f_sha384(self, v):
        return F.sha2(text(v), 384), STRING

    def f_sha512(self, v):
        return F.sha2(text(v), 512), STRING
