"""Every query has rows and a stable shape; a sample is compared with DuckDB here,
all of them by tools/check.py."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "execution_summary", "timeline_positions", "sequence_text", "invariants_long", "logging_gaps",
    "compare_deltas", "normalized_spans", "fact_sheets", "redacted_documents", "stitch_groups", "chains",
    "agent_spans", "suite_summary", "stream_executions",
]


def test_every_query_but_a_few_has_a_twin():
    queries, twins = entry_module.queries(), entry_module.oracle_sql()
    assert set(twins) <= set(queries)
    # Training-data operators (op*, pipeline) have tests of their own.
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own - set(twins) <= {"field_values"}


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "exec_id" and df.limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    twin = db.sql(entry_module.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(str(v) for v in row) for row in twin.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
