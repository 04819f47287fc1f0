"""Each registered query of the algebra against its SQL, over the small tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from plankit.plans import relational

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 3)
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", relational.QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    df = relational.QUERIES[name](spark, FOLDER)
    found = tables.execute(relational.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())
