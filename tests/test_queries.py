"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridloom.operators import ranges
from gridloom.plans import queries, queries_files, queries_more, queries_scale  # noqa: F401
from gridloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return str(a) == str(b) or a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    ranges.release()
    assert rows
    if name not in ORACLE_SQL:
        return
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(r[k] for k in at) for r in cursor.fetchall()]
    assert len(rows) == len(expected)

    def order(r):
        return [_key([v]) if not isinstance(v, float) or math.isnan(v) else (f"{v:+.3e}",) for v in r]

    for a, b in zip(sorted(rows, key=order), sorted(expected, key=order), strict=True):
        assert all(_same(x, y) for x, y in zip(a, b, strict=True)), (a, b)
