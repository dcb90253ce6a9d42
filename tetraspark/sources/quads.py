"""A DataFrame of canonical terms s, p, o, g as the source of patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.solution import TERM


class QuadSource:
    """``quads`` may hold repeated rows and a triple in many graphs; the compiler makes sets of them."""

    disjoint = False

    def __init__(self, quads: DataFrame):
        self.quads = quads

    def match(self, s, p, o, graphs):
        conds = [F.col(n) == x for n, x in (("s", s), ("p", p), ("o", o)) if x is not None]
        if graphs is not None:
            conds.append(F.col("g").isin(graphs) if graphs else F.lit(False))
        df = self.quads.where(reduce(Column.__and__, conds)) if conds else self.quads
        return [(df.select("s", "p", "o", "g"), dict.fromkeys("spog", TERM))]
