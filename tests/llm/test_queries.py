import os

import pytest

from mossgrid.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    n = df.count()
    assert n > 0
    if name.endswith("_found"):
        assert n == df.distinct().count()
