import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_every_item_once_and_nothing_over(sizes):
    demands = np.column_stack([sizes, np.ones(len(sizes)), sizes]).astype(float)
    limits = np.array([100.0, 8.0, 90.0 if max(sizes) <= 90 else 100.0])
    got = P.packed(demands, limits)
    assert sorted(i for c in got for i in c) == list(range(len(sizes)))
    for c in got:
        assert (demands[c].sum(axis=0) <= limits + 1e-9).all()
    assert len(got) <= 2 * max(sum(sizes) / 90, len(sizes) / 8) + 1


def test_all_limits_bind():
    demands = np.array([[1.0, 1, 0]] * 9 + [[1.0, 1, 5]] * 3)
    assert len(P.packed(demands, np.array([100.0, 4, 100]))) == 3
    assert len(P.packed(demands, np.array([100.0, 100, 5]))) == 3


@pytest.fixture
def kinds(spark):
    return spark.createDataFrame([("small", 32, 1, "x"), ("none", 0, 1, "x"), (None, 64, 1, "x")], "container_kind string, capacity_tokens int, separator_tokens int, doc_id string")


def test_assignment(spark, kinds):
    rows = [(i, "word " * (i % 40), 0) for i in range(300)] + [(500, "long " * 100, 0), (501, None, 0), (502, "", 0), (0, "", 0), (None, "x", 0), (503, "Q: a question here\nA: yes", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = P.assigned(docs, kinds).toPandas()
    assert set(got.container_kind) == {"small"}
    assert set(got.doc_id) == {*range(300), 500, 502, 503}
    got["n"] = got.end_token - got.start_token
    used = got.groupby("container_id").agg(n=("n", "sum"), k=("n", "size"))
    assert ((used.n + used.k - 1) <= 32).all()
    assert got.groupby("container_id").position.apply(lambda p: sorted(p) == list(range(len(p)))).all()
    parts = got.groupby("doc_id").agg(k=("n", "size"), n=("n", "sum"), a=("start_token", "min"))
    assert (parts.k[parts.n <= 32] == 1).all() and (parts.a == 0).all()
    long = got[got.doc_id == 500].sort_values("start_token")
    assert (long.start_token.iloc[1:].values == long.end_token.iloc[:-1].values).all() and (long.n.iloc[:-1] == 32).all()
    filled = P.fill(P.assigned(docs, kinds), kinds).first()
    assert filled.filled > 0.9


def test_edges(spark, kinds):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.assigned(none, kinds).count() == 0
    some = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert P.assigned(some, kinds.limit(0)).count() == 0


def test_loss(spark):
    r = P.sized(spark.createDataFrame([(1, "Q: what is it\nA: yes"), (2, "plain text")], "doc_id long, text string")).collect()
    by = {x.doc_id: x for x in r}
    assert 0 < by[1].loss_tokens < by[1].tokens and by[2].loss_tokens == by[2].tokens
