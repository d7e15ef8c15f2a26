"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from fathomlens import plans

SF = "/root/testdata/sf0.001"
NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in plans.SQL:
        assert rows
        return
    found = duck.execute(plans.SQL[name])
    kinds = {x[0]: str(x[1]) for x in found.description}
    assert {c: NAMES.get(t, t) for c, t in df.dtypes} == kinds
    order = [[x[0] for x in found.description].index(c) for c in names]
    assert rows == sorted((tuple(cell(x[i]) for i in order) for x in found.fetchall()), key=repr)
