"""The registered text queries on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import pytest

from tessera.llm import queries

FOLDER = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["file_id"], "p2_found": ["table_name", "record_id", "line_no"], "p7_found": ["file_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert max(Counter(got).values(), default=1) == 1
    if name in queries.ORACLES:
        import duckdb

        c = duckdb.connect()
        c.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
        assert sorted(got) == sorted(c.sql(queries.ORACLES[name]).fetchall())


def test_packing_is_close_to_the_least_possible(spark):
    rows = queries.p8_packed(spark, FOLDER).collect()
    load = Counter()
    for r in rows:
        load[r.container] += r.n_tokens
    assert max(load.values()) <= 2048
    assert len(load) <= sum(load.values()) / 2048 * 1.05 + 1
    use = queries.p8_use(spark, FOLDER).first()
    assert (use.n_containers, use.n_pieces, use.used) == (len(load), len(rows), sum(load.values())) and use.fill == round(use.used / 2048 / len(load), 6)
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, queries.p8_packed(spark, FOLDER).collect()))


def test_redacted_texts_hold_no_credential(spark):
    from tessera.llm.credentials import scan_text

    for r in queries.p2_redacted(spark, FOLDER).where("n_cases > 0").collect():
        assert scan_text(r.redacted)[0] == []
