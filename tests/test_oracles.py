import math
import os

import pytest

import __spark_entry__ as entry
from jobforge.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(float(f"{v:.12g}"))
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, int):
        return repr(float(v))
    s = str(v)
    return s[:10] if s.endswith(" 00:00:00") else s


def table(df, cols):
    return sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got, sorted(want.columns)) == table(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
