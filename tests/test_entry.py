"""Every registered query against its SQL on the smallest tables, and the layout of the package."""

import math
import os
import re
from collections import Counter
from decimal import Decimal

import pytest

from mossgrid.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = Counter(plain(tuple(r)) for r in df.select(*cols).collect())
    if name not in registry.sql():
        assert rows
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as from '{DATA}/{f}'")
    want = Counter(plain(r) for r in c.sql(f"select {', '.join(cols)} from ({registry.sql()[name]})").fetchall())
    assert rows == want


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "mossgrid")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert not re.search(r"mossgrid\.llm|from mossgrid import llm", f.read()), n
