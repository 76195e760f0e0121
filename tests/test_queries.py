"""Every registered query of the library against its oracle in DuckDB, and operators on odd inputs."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from stratalens import plans
from stratalens.registry import ORACLE, QUERIES

plans.load()
SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e5 else str(v)
    return str(v)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE:
        found = con.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
