"""Every registered query against its SQL on the smallest tables."""

import importlib.util
import os
from collections import Counter
from pathlib import Path

import pytest

FOLDER = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from tessera.plans import catalogue  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in Path(FOLDER).iterdir():
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def _bag(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(t[i], 6) if isinstance(t[i], float) else t[i] for i in order) for t in tuples)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["old_snapshot_id", "new_snapshot_id", "path", "change_kind"]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert got == _bag(want.columns, want.fetchall())
