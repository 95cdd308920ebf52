"""The newest queries against their SQL on the smallest tables."""

import duckdb
import pytest

from spanloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_give_the_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted(str(r) for r in rel.select(*[f'"{c}"' for c in got.columns]).fetchall())
    assert sorted(str(tuple(r)) for r in got.collect()) == want and want
