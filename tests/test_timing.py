import math

import pytest
from pyspark.sql import functions as F

from folioflow.functions import timing as M


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, kind, para, chapter, want",
    [("One.", "body", False, False, 0.25), ("One,", "body", False, False, 0.1), ("One,”", "body", False, False, 0.1), ("One.", "body", True, False, 0.4), ("One,", "heading", False, False, 0.8), ("One.", "body", True, True, 0.8)],
)
def test_gap(spark, text, kind, para, chapter, want):
    assert value(spark, M.gap(F.lit(text), F.lit(kind), F.lit(para), F.lit(chapter))) == want


@pytest.mark.parametrize("seconds, want", [(0.0, "00:00:00.000"), (3661.0005, "01:01:01.000"), (0.0015, "00:00:00.002"), (360000.0, "100:00:00.000")])
def test_stamp(spark, seconds, want):
    assert value(spark, M.stamp(F.lit(seconds))) == want


def test_guard(spark):
    assert value(spark, M.long_limit(F.lit(100))) == 12.0
    assert value(spark, M.short_limit(F.lit(19))) == 0.0
    assert value(spark, M.window_miss(F.lit(100), F.lit(13.5))) == 1.5
    assert value(spark, M.window_miss(F.lit(100), F.lit(5.0))) == 0.0
    assert math.isinf(value(spark, M.clip_miss(F.lit(10), F.lit(9.0), F.lit(True))))
    assert value(spark, M.max_chars_within(F.lit(32.0))) == 300 and value(spark, M.max_chars_within(F.lit(0.5))) == 1
    assert value(spark, M.max_new_tokens(F.lit(100), 12.5)) == 188


def test_samples(spark):
    assert value(spark, M.silence_samples(F.lit("ab"))) == 4800 and value(spark, M.silence_samples(F.lit("x" * 30))) == 48000
    assert value(spark, M.gap_samples(F.lit(2.9999), 1)) == 2
    assert value(spark, M.hms(F.lit(3725.9))) == "1:02:05"
