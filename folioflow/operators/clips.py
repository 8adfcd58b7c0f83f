"""Clips: keys, first uses, what is still to be spoken, batches, chapter plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import timing
from folioflow.operators.engines import Engine, spoken
from folioflow.operators.retries import settled

BATCH = 64


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key; which one is kept doesn't depend on partitions where repeated rows are equal in the used columns."""
    return df.dropDuplicates(list(keys))


def with_gaps(sentences: DataFrame, gaps: timing.Gaps = timing.Gaps()) -> DataFrame:
    """Sentences (sent_id, book_id, chapter_idx, sent_idx, para_id, kind, text) with the ``gap`` after each."""
    order = W.partitionBy("book_id", "chapter_idx").orderBy("sent_idx", "sent_id")
    after = F.lead("sent_id").over(order)
    other = F.coalesce(F.lead("para_id").over(order) != F.col("para_id"), F.lit(False))
    return sentences.withColumn("gap", timing.gap(F.col("text"), F.coalesce("kind", F.lit("body")), other, after.isNull(), gaps))


def first_uses(sentences: DataFrame) -> DataFrame:
    """(key, text, uses, first_use): every distinct text once, with the first place it stands at."""
    place = F.struct("book_id", "chapter_idx", "sent_idx", "sent_id")
    keyed = sentences.where(F.col("text").isNotNull()).select(T.clip_key(F.col("text")).alias("key"), "text", place.alias("place"))
    return keyed.groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("uses"), F.min("place").getField("sent_id").alias("first_use"))


def pending(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (key, ...) whose key isn't among the readable clips of ``cached`` (key, n_samples)."""
    return wanted.join(cached.where("n_samples > 0").select("key").distinct(), "key", "left_anti")


def chapter_counts(sentences: DataFrame, cached: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, cached, missing): a text repeated in several chapters counts in each."""
    keys = sentences.where(F.col("text").isNotNull()).select("book_id", "chapter_idx", T.clip_key(F.col("text")).alias("key")).distinct()
    have = cached.where("n_samples > 0").select("key").distinct().withColumn("there", F.lit(1))
    return keys.join(have, "key", "left").groupBy("book_id", "chapter_idx").agg(F.count("there").alias("cached"), (F.count("*") - F.count("there")).alias("missing"))


def ranked(df: DataFrame, size: Column, key: str) -> DataFrame:
    """``df`` with ``rank``: the row's place, from 0, by size downwards, then key. No partition holds more than one size and
    key prefix; only the counts of those are summed in one place."""
    cells = df.withColumns({"_size": size, "_prefix": F.substring(key, 1, 2)})
    counts = cells.groupBy("_size", "_prefix").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(F.desc("_size"), "_prefix").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_size", "_prefix").orderBy(key))
    return cells.withColumn("_inside", inside).join(offsets, ["_size", "_prefix"]).withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_size", "_prefix", "_inside", "_before")


def batches(clips: DataFrame, max_batch: int = BATCH) -> DataFrame:
    """Clips (key, text) with ``batch``: longest first, slices of ``max_batch``."""
    if max_batch < 1:
        raise ValueError("a batch holds at least one clip")
    return ranked(clips, F.length("text"), "key").withColumn("batch", F.floor(F.col("rank") / max_batch)).drop("rank")


def batch_caps(batched: DataFrame, frame_rate: float = 12.5) -> DataFrame:
    """(batch, clips, most_chars, new_tokens): the generation cap of each batch."""
    most = F.max(F.length("text"))
    return batched.groupBy("batch").agg(F.count("*").alias("clips"), most.alias("most_chars"), timing.max_new_tokens(most, frame_rate).alias("new_tokens"))


def heard(missing: DataFrame, engine: Engine, guard: timing.Guard = timing.Guard()) -> DataFrame:
    """The clip kept of each text of ``missing`` (key, text, batch): the first take, or, where an engine is told to try again, the
    best of all takes of those that miss their duration. Retries are batched anew, longest first."""
    takes = spoken(missing, engine)
    if engine.retries < 1:
        return takes
    return settled(takes, lambda again: spoken(batches(again, engine.max_batch), engine), replace(guard, retries=engine.retries))


def chapter_plans(sentences: DataFrame, fingerprint: str, rate: int = timing.RATE, gaps: timing.Gaps = timing.Gaps()) -> DataFrame:
    """(book_id, chapter_idx, fingerprint, sample_rate, clip_keys, gap_after): what each chapter should consist of, in order."""
    rows = with_gaps(sentences.where(F.col("text").isNotNull()), gaps)
    each = F.struct("sent_idx", "sent_id", T.clip_key(F.col("text")).alias("key"), "gap")
    ordered = rows.groupBy("book_id", "chapter_idx").agg(F.array_sort(F.collect_list(each)).alias("s"))
    return ordered.select("book_id", "chapter_idx", F.lit(fingerprint).alias("fingerprint"), F.lit(rate).alias("sample_rate"), F.col("s.key").alias("clip_keys"), F.col("s.gap").alias("gap_after"))


def stale(plans: DataFrame, manifests: DataFrame) -> DataFrame:
    """Plans whose manifest is missing or differs in fingerprint, rate, keys or gaps."""
    keys = ["book_id", "chapter_idx", "fingerprint", "sample_rate", "clip_keys", "gap_after"]
    return plans.join(manifests.select(*keys).distinct(), keys, "left_anti")


class Progress:
    """Tells each time another step of the whole is done, and once at the end."""

    def __init__(self, total: float, tell: Callable[[int], None], step_percent: int = 10):
        self.total, self.tell, self.step = total, tell, step_percent
        self.told = 0

    def __call__(self, done: float) -> None:
        percent = min(100, int(done * 100 / self.total)) if self.total > 0 else 100
        reached = 100 if percent == 100 else percent - percent % self.step
        if reached > self.told:
            self.told = reached
            self.tell(reached)
