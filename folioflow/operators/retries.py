"""Takes that miss their duration window are spoken again; the best take of each text is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import timing
from folioflow.session import cut

TAKES = "key string, text string, attempt int, capped boolean, seconds double"


def missed(takes: DataFrame, guard: timing.Guard = timing.Guard()) -> DataFrame:
    """Takes (key, text, attempt, capped, seconds) with ``miss``."""
    return takes.withColumn("miss", timing.clip_miss(F.length("text"), F.col("seconds"), F.col("capped"), guard))


def best_takes(takes: DataFrame, guard: timing.Guard = timing.Guard()) -> DataFrame:
    """One row a key: the take with the smallest miss, the earliest of equal ones, and a note on what became of it."""
    rows = missed(takes, guard)
    best = rows.groupBy("key").agg(F.min_by(F.struct("text", "attempt", "capped", "seconds", "miss"), F.struct("miss", "attempt")).alias("t"), F.max("attempt").alias("attempts"))
    kept = best.select("key", "t.*", "attempts")
    note = (
        F.when(F.col("attempts") == 0, F.lit(None).cast("string"))
        .when(F.col("miss") == 0, F.format_string("recovered at attempt %d", F.col("attempt")))
        .otherwise(F.format_string("kept attempt %d of %d", F.col("attempt"), F.col("attempts")))
    )
    return kept.withColumn("note", note)


def unsettled(takes: DataFrame, guard: timing.Guard = timing.Guard()) -> DataFrame:
    """(key, text, attempt, capped): what the next round speaks. After the last capped round a text of which no take ended
    gets one round without a cap."""
    best = best_takes(takes, guard).where("miss > 0")
    tries = best.where(F.col("attempts") < guard.retries).select("key", "text", (F.col("attempts") + 1).alias("attempt"), F.lit(True).alias("capped"))
    last = best.where((F.col("attempts") == guard.retries) & (F.col("miss") == F.lit(float("inf"))) & (F.lit(guard.retries) > 0))
    return tries.unionByName(last.select("key", "text", (F.col("attempts") + 1).alias("attempt"), F.lit(False).alias("capped")))


def settled(first: DataFrame, speak: Callable[[DataFrame], DataFrame], guard: timing.Guard = timing.Guard()) -> DataFrame:
    """Best takes after at most ``retries`` + 1 further rounds, with all their columns and a ``note``. ``speak`` takes (key, text,
    attempt, capped) and adds the other columns of ``first``.

    Each round is written to the shared folder, so that a lost executor doesn't make earlier rounds run again."""
    takes = cut(first)
    for _ in range(guard.retries + 1):
        again = cut(unsettled(takes, guard))
        if again.isEmpty():
            break
        takes = cut(takes.unionByName(speak(again).select(*takes.columns)))
    return takes.join(best_takes(takes, guard).select("key", "attempt", "note"), ["key", "attempt"])
