"""Timeline: sample offsets, cues, chapter marks, and the text files written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import timing


def offsets(clips: DataFrame, rate: int = timing.RATE) -> DataFrame:
    """Clips (book_id, chapter_idx, sent_idx, n_samples, gap) with ``start``, ``end`` in seconds and ``start_sample``.

    Seconds add the gaps as they are; samples add each gap cut to whole samples. Both are kept, as they may differ."""
    before = W.partitionBy("book_id", "chapter_idx").orderBy("sent_idx", "sent_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_samples") / rate + F.col("gap")).over(before), F.lit(0.0))
    sample = F.coalesce(F.sum(F.col("n_samples") + timing.gap_samples(F.col("gap"), rate)).over(before), F.lit(0))
    return clips.withColumns({"start": start, "start_sample": sample}).withColumn("end", F.col("start") + F.col("n_samples") / rate)


def chapter_lengths(clips: DataFrame, chapters: DataFrame | None = None, rate: int = timing.RATE) -> DataFrame:
    """(book_id, chapter_idx, samples): whole length with all gaps; a chapter of ``chapters`` without clips has a tenth of a second."""
    each = clips.groupBy("book_id", "chapter_idx").agg(F.sum(F.col("n_samples") + timing.gap_samples(F.col("gap"), rate)).alias("samples"))
    if chapters is None:
        return each
    known = chapters.select("book_id", "chapter_idx").distinct().join(each, ["book_id", "chapter_idx"], "left")
    return known.withColumn("samples", F.coalesce("samples", F.lit(int(timing.EMPTY_CHAPTER_S * rate)).cast("long")))


def book_timeline(lengths: DataFrame, rate: int = timing.RATE) -> DataFrame:
    """Chapters with the sample they begin at in their book, and chapter marks in whole milliseconds."""
    order = W.partitionBy("book_id").orderBy("chapter_idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ms = F.rint(F.col("samples") / rate * 1000).cast("long")
    return lengths.withColumns(
        {
            "book_start": F.coalesce(F.sum("samples").over(before), F.lit(0)),
            "mark_start": F.coalesce(F.sum(ms).over(before), F.lit(0)),
            "mark_end": F.sum(ms).over(order.rowsBetween(W.unboundedPreceding, 0)),
        }
    )


def cues(placed: DataFrame, timeline: DataFrame, rate: int = timing.RATE) -> DataFrame:
    """(book_id, chapter_idx, sent_idx, sent_id, cue): the lines of each utterance, on the book's time.

    Times are taken from samples, so that they don't depend on the order of additions."""
    on_book = placed.join(timeline.select("book_id", "chapter_idx", "book_start"), ["book_id", "chapter_idx"])
    begin = (F.col("book_start") + F.col("start_sample")) / rate
    end = (F.col("book_start") + F.col("start_sample") + F.col("n_samples")) / rate
    line = F.concat(timing.stamp(begin), F.lit(" --> "), timing.stamp(end), F.lit("\n"), F.col("text"))
    return on_book.select("book_id", "chapter_idx", "sent_idx", "sent_id", line.alias("cue"))


def vtt(cue_rows: DataFrame) -> DataFrame:
    """(book_id, vtt): the transcript file of each book. Cues of one book are gathered, as the file is one text."""
    each = F.struct("chapter_idx", "sent_idx", "sent_id", "cue")
    ordered = cue_rows.groupBy("book_id").agg(F.array_sort(F.collect_list(each)).alias("c"))
    body = F.array_join(F.col("c.cue"), "\n\n")
    return ordered.select("book_id", F.concat(F.lit("WEBVTT\n"), F.when(body == "", "").otherwise(F.concat(F.lit("\n"), body, F.lit("\n")))).alias("vtt"))


def metadata(marks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, metadata): the chapter metadata file of each book. ``marks``: book_id, chapter_idx, title, mark_start, mark_end."""
    block = F.concat(
        F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("mark_start").cast("string"), F.lit("\nEND="), F.col("mark_end").cast("string"),
        F.lit("\ntitle="), T.meta_escape(F.coalesce("title", F.lit(""))), F.lit("\n"),
    )
    blocks = marks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", block.alias("block")))).alias("b"))
    title, author = T.meta_escape(F.coalesce("title", F.lit(""))), T.meta_escape(F.col("author"))
    artist = F.when(F.trim(F.coalesce("author", F.lit(""))) != "", F.concat(F.lit("artist="), author, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\n"), artist, F.lit("album="), title, F.lit("\n"))
    return books.join(blocks, "book_id", "left").select("book_id", F.concat(head, F.array_join(F.coalesce(F.col("b.block"), F.array().cast("array<string>")), "")).alias("metadata"))


def concat_list(paths: DataFrame) -> DataFrame:
    """(book_id, listing): the list of chapter files (book_id, chapter_idx, path) a concatenation reads."""
    line = F.concat(F.lit("file '"), F.replace(F.col("path"), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    ordered = paths.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", line.alias("line")))).alias("l"))
    return ordered.select("book_id", F.concat(F.lit("ffconcat version 1.0\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("listing"))
