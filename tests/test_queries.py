"""Every registered query of the library against its SQL, and the row count of the others."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__
from lodestrata import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return float(v) + 0.0
    return v if isinstance(v, (int, str)) else v.item() if hasattr(v, "item") else str(v)


def rows(df):
    """Rows in an order that the last decimals do not change."""
    out = [[plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 3) for v in r if isinstance(v, float)], str(r)))


def alike(x, y):
    """Equal but for the last bits of a number."""
    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
        return abs(x - y) <= 1e-9 * max(1.0, abs(x))
    return x == y


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    differ = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(alike, x, y))]
    assert not differ, differ[:3]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_library_stands_without_the_corpus_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("lodestrata.llm", "corpus_pipeline") else find(n, *a))
    assert set(__spark_entry__.queries()) == set(plans.QUERIES)
