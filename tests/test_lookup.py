"""Look-ups read the row groups that hold what they look for, not all history."""

import glob
import json
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from helpers import T0, span, trace_body

from spanforge.engine import Engine

BATCHES, SPANS = 3, 3000


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("lookup")))
    for b in range(BATCHES):
        # Trace ids of all batches share one range, so their ends alone leave nothing out.
        spans = [span(f"{(BATCHES * i + b) * 2654435761 % 2**32:032x}", str(i), a={"user": f"{b}-{i:05d}", "zone": "a"}) for i in range(SPANS)]
        body = json.dumps(trace_body(("web", spans))).encode()
        e.ingest(spark.createDataFrame([("traces", "application/json", None, body)], "signal string, content_type string, content_encoding string, body binary"), T0 - timedelta(seconds=b))
    return e


def scanned(df):
    """Rows that the scans below a filter gave, after the run."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = df.collect()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_trace(engine):
    want = f"{(BATCHES * 17 + 1) * 2654435761 % 2**32:032x}"
    rows, read = scanned(engine.spans().where(f"trace_id = '{want}'"))
    assert [r.span_id for r in rows] == ["17"] and read <= SPANS
    # Inside the range of all files: only their Bloom filters can leave it out.
    rows, read = scanned(engine.spans().where(f"trace_id = '{2**31 + 12345:032x}'"))
    assert rows == [] and read == 0
    assert engine.trace(want).count() == 1 and engine.spans().count() == BATCHES * SPANS


def test_one_attribute_value(engine):
    rows, read = scanned(engine.table("attributes").where("key = 'user' and value = '2-00007'"))
    assert len(rows) == 1 and read <= 2 * SPANS
    assert [r.value for r in engine.attribute_values("user", "1-0000").collect()][:2] == ["1-00000", "1-00001"]


def test_values_are_not_in_dictionaries(engine):
    """So what leaves a value out above is a Bloom filter."""
    for table, column in (("spans", "trace_id"), ("attributes", "value")):
        for path in glob.glob(f"{engine.root}/{table}/batch=*/day=*/*.parquet"):
            group = pq.ParquetFile(path).metadata.row_group(0)
            names = [group.column(i).path_in_schema for i in range(group.num_columns)]
            assert "PLAIN" in group.column(names.index(column)).encodings
