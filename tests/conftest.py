import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanloom.functions.values import with_times  # noqa: E402
from spanloom.schema import SPAN_SCHEMA  # noqa: E402
from spanloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_spans(spark):
    """Spans out of dicts; missing fields are null, all belong to execution `t`."""

    def make(*rows, exec_id="t"):
        full = []
        for i, row in enumerate(rows):
            row = {"component": "lambda:a", "operation": "op", "span_id": f"s{i}", **row}
            values = {f.name: None for f in SPAN_SCHEMA.fields}
            values.update(seq=i, is_async=False, is_one_way=False)
            values.update({k: v for k, v in row.items() if k in values})
            full.append(tuple(values[f.name] for f in SPAN_SCHEMA.fields) + (row.get("exec_id", exec_id),))
        df = spark.createDataFrame(full, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPAN_SCHEMA.fields) + ", exec_id string")
        return with_times(df)

    return make


@pytest.fixture
def lines(tmp_path):
    """Write JSON lines (dicts) or text lines to a file and return its path."""

    def write(*rows, name="in.jsonl"):
        path = tmp_path / name
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
        return str(path)

    return write
