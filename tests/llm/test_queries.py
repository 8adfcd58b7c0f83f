import os

import pytest

from folioflow.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
COLUMNS = {
    "p1_found": ["para_id", "end_char"], "p2_found": ["record_kind", "record_key"], "p3_found": ["para_id"], "p4_found": ["para_id_a", "para_id_b"],
    "p5_found": ["item_kind", "item_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_runs(spark, name):
    df = llm.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = llm.QUERIES[name](spark, DATA)
    want = c.execute(llm.SQL[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.values.tolist()))
