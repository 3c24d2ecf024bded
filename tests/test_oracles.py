import pytest
from compare import same

from spanforge.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
