"""Every registered query of the catalog against its SQL, on the smallest test tables."""

import math
import os

import duckdb
import pytest

from rillstone.plans import catalog, catalog_runs  # noqa: F401  registers its queries too

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    found = con.execute(catalog.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted([tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()], key=repr)
    assert got == want


def test_synthetic_is_the_same_every_time(spark):
    a, b = (catalog.QUERIES["synthetic_people"](spark, DATA).collect() for _ in range(2))
    assert a == b
    assert all(r["manager"] is None or r["manager"] < r["id"] for r in a)
    assert 0.85 < sum(r["salary"] is not None for r in a) / len(a) < 0.95
    assert all(r["account"] == f"{r['department']}.{r['number']}{r['id']}" for r in a)
