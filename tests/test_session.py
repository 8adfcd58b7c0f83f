import pytest
from pyspark.sql import functions as F

from folioflow import session


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_broadcast_is_counted_as_the_driver_builds_it(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1 << 20)
    words = spark.range(60_000).select(F.concat(F.lit("w"), "id").alias("word"))  # values of 0.8 MB, a table of over 7
    rows = spark.range(120_000).select("id", F.concat(F.lit("w"), "id").alias("word"))
    found = session.known_rows(rows, words, "word", how="left_semi")
    assert "Broadcast" not in plan(found)
    assert found.agg(F.count("*"), F.countDistinct("id"), F.max("id")).first()[:] == (60_000, 60_000, 59_999)
    few = session.known_rows(rows, words.limit(1000), "word", how="left_semi")
    assert "BroadcastHashJoin" in plan(few)
    assert few.count() == 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_large_side_stays_off_the_driver(spark, monkeypatch, how):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (4, "a")], "id long, word string")
    known = spark.sql("select * from values ('a', 7), ('c', 8), (null, 9) as known(word, says)")
    want = sorted(map(tuple, session.known_rows(rows, known, "word", how=how).collect()), key=str)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)  # the optimizer takes sides of this size for small
    found = session.known_rows(rows, known, "word", how=how)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert "Broadcast" not in plan(found)
