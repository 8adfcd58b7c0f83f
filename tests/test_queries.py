import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from folioflow.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
QUERIES, SQL = plans.QUERIES, plans.SQL


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (np.integer, bool, np.bool_)) else v
    clean = df[cols].astype(object).where(df[cols].notna(), None).map(plain)
    return cols, pd.Series(list(map(tuple, clean.values)), dtype=object).value_counts().to_dict()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, DATA).toPandas().columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_needs_nothing_of_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioflow.llm'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
