from pathlib import Path

import duckdb
import pytest

from stratalens.llm import queries


@pytest.mark.parametrize("name", ["llm_mix_targets", "llm_pii_counts"])
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    rows = queries.QUERIES[name](spark, sf)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == sorted(found.fetchall())
