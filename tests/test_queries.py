"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

from quarrymill.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(map(plain, v.tolist()))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: No link of these tables' bodies leads to a document of theirs.
WITHOUT_ROWS = {"graph_link_components"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows_without_sql(spark, name):
    """These are held against brute force or small fixtures elsewhere; here they run over whole tables, twice alike."""
    first, again = (rows(registry.QUERIES[name](spark, DATA).toPandas()) for _ in range(2))
    assert (not first) == (name in WITHOUT_ROWS)
    assert first == again
