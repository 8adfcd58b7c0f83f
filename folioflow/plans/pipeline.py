"""The whole way from books to clips and a timeline, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import speech
from folioflow.functions import text as T
from folioflow.functions import timing
from folioflow.operators import chapters as C
from folioflow.operators import clips as K
from folioflow.operators import engines as E
from folioflow.operators import state, timeline
from folioflow.session import cut


def utterances(members: DataFrame, paragraphs: DataFrame, max_chars: int = T.MAX_CHARS, say: bool = False) -> DataFrame:
    """(sent_id, book_id, chapter_idx, sent_idx, para_id, kind, text): the utterances of all chapters, in order.

    ``sent_idx`` numbers them by document, paragraph and piece; numbers rise but may leave gaps."""
    rows = members.join(paragraphs, ["book_id", "doc_pos", "para_pos"])
    text = speech.spoken_udf("text") if say else F.col("text")
    pieces = rows.select("book_id", "chapter_idx", "doc_pos", "para_pos", "kind", F.posexplode(T.clips(text, max_chars)).alias("piece_pos", "piece"))
    place = (F.col("doc_pos").cast("long") * (1 << 40)) + (F.col("para_pos").cast("long") * (1 << 16)) + F.col("piece_pos")
    para = F.col("doc_pos").cast("long") * (1 << 24) + F.col("para_pos")
    return pieces.select(F.xxhash64("book_id", "doc_pos", "para_pos", "piece_pos").alias("sent_id"), "book_id", "chapter_idx", place.alias("sent_idx"), para.alias("para_id"), "kind", F.col("piece").alias("text"))


def convert(spark: SparkSession, tables: dict[str, DataFrame], root: str, engine: E.Engine, gaps: timing.Gaps = timing.Gaps(), say: bool = False) -> dict[str, DataFrame]:
    """Speaks what isn't spoken yet, writes clips, then manifests, and returns chapters, cues, transcripts and metadata.

    Run again with nothing changed, it speaks nothing and writes nothing."""
    chapters, members = C.detected(tables["spine_docs"], tables["paragraphs"], tables["toc"], tables["books"])
    sents = cut(utterances(members, tables["paragraphs"], min(T.MAX_CHARS, engine.max_chars), say))
    fp = E.digest(engine.fingerprint())
    fp16, rate = fp[:16], engine.sample_rate
    plans = cut(K.chapter_plans(sents, fp, rate, gaps))
    current = state.manifests(spark, root, fp)
    todo = cut(K.stale(plans, current))
    wanted = sents.join(todo.select("book_id", "chapter_idx"), ["book_id", "chapter_idx"], "left_semi")
    missing = cut(K.batches(K.pending(K.first_uses(wanted), state.clip_index(spark, root, fp16)), engine.max_batch))
    if not missing.isEmpty():
        with E.ready(engine):
            state.store_clips(K.heard(missing, engine), root)
    index = state.clip_index(spark, root, fp16)
    placed = timeline.offsets(K.with_gaps(sents.withColumn("key", T.clip_key(F.col("text"))).join(index, "key"), gaps), rate)
    lengths = timeline.chapter_lengths(placed, chapters, rate)
    if not todo.isEmpty():
        offset = F.struct("sent_idx", "sent_id", F.col("start"), F.col("end"))
        at = placed.groupBy("book_id", "chapter_idx").agg(F.array_sort(F.collect_list(offset)).alias("o"))
        made = todo.join(at, ["book_id", "chapter_idx"]).join(lengths, ["book_id", "chapter_idx"])
        offsets = F.transform("o", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        state.store_manifests(made.select("fingerprint", "book_id", "chapter_idx", "sample_rate", "clip_keys", "gap_after", offsets.alias("offsets"), (F.col("samples") / rate).alias("duration")), root)
    on_book = timeline.book_timeline(lengths, rate)
    cue_rows = timeline.cues(placed, on_book, rate)
    marks = on_book.join(chapters, ["book_id", "chapter_idx"])
    return {"chapters": chapters, "cues": cue_rows, "vtt": timeline.vtt(cue_rows), "metadata": timeline.metadata(marks, tables["books"]), "missing": missing, "stale": todo, "timeline": on_book, "placed": placed}


def dump_text(members: DataFrame, paragraphs: DataFrame, say: bool = False, split: bool = False, chapter: int | None = None, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """(book_id, chapter_idx, doc_pos, para_pos, piece_pos, line): the text of chapters, headings marked with ``# ``."""
    rows = members.join(paragraphs, ["book_id", "doc_pos", "para_pos"])
    if chapter is not None:
        rows = rows.where(F.col("chapter_idx") == chapter)
    text = speech.spoken_udf("text") if say or split else F.col("text")
    lines = rows.withColumn("lines", T.clips(text, max_chars) if split else F.array(text))
    mark = F.when(F.col("kind") == "heading", "# ").otherwise("")
    return lines.select("book_id", "chapter_idx", "doc_pos", "para_pos", F.posexplode("lines").alias("piece_pos", "t"), mark.alias("m")).select("book_id", "chapter_idx", "doc_pos", "para_pos", "piece_pos", F.concat("m", "t").alias("line"))
