"""Every registered query of the package against the same in SQL."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tetraspark.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders events".split()


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = Counter(tuple(plain(v) for _, v in sorted(zip(columns, row))) for row in cur.fetchall())
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
