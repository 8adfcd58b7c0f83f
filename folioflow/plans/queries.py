"""The queries of the engine's own operators, over the whole tables."""

from __future__ import annotations

import html
import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import markup, speech, timing
from folioflow.functions import text as T
from folioflow.operators import chapters as C
from folioflow.operators import clips as K
from folioflow.operators import engines, retries, timeline
from folioflow.plans import pipeline
from folioflow.plans.oracle import SQL as SQL
from folioflow.session import scanned, spread
from folioflow.sources import epub
from folioflow.sources.tables import table

FRAME_RATE = 12.5


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs once each; copies differ in their time of arrival only."""
    return spread(table(spark, sf_dir, "paragraphs").select("para_id", "book_id", "doc_pos", "para_pos", "kind", "text"), "para_id").distinct()


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book as it was loaded last."""
    b = table(spark, sf_dir, "books").groupBy("book_id").agg(F.max_by(F.struct("title", "author"), F.struct("loaded_at", "title", "author")).alias("b"))
    return b.select("book_id", "b.title", "b.author")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences once each; copies are equal in all these columns, so hashing whole rows needs no sort."""
    return spread(table(spark, sf_dir, "sentences").select("sent_id", "book_id", "chapter_idx", "sent_idx", "para_id", "kind", "text"), "sent_id").distinct()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("text is not null")


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances and their characters for every document: the flagship of the native text chain."""
    lines = scanned(_documents(spark, sf_dir)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    each = lines.select("doc_id", F.explode(T.clips(F.col("line"))).alias("clip"))
    return each.groupBy("doc_id").agg(F.count("*").alias("clips"), F.sum(F.length("clip")).alias("chars"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).where("text is not null").select("para_id", F.posexplode(T.sentences(F.col("text"))).alias("piece_pos", "piece"))
    return rows.select("para_id", F.col("piece_pos").cast("long").alias("piece_pos"), "piece")


def clip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).where("text is not null").select("para_id", F.posexplode(T.clips(F.col("text"))).alias("clip_pos", "clip"))
    return rows.select("para_id", F.col("clip_pos").cast("long").alias("clip_pos"), "clip")


def clip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_uses(_sentences(spark, sf_dir)).select("key", "uses", "first_use")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have their key in the table are taken as spoken."""
    return table(spark, sf_dir, "sentences").where("clip_key is not null").select(F.col("clip_key").alias("key"), F.lit(1).alias("n_samples"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pending(K.first_uses(_sentences(spark, sf_dir)), _cached(spark, sf_dir)).select("key", "uses", "first_use")


def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chapter_counts(_sentences(spark, sf_dir), _cached(spark, sf_dir))


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.batches(K.first_uses(_sentences(spark, sf_dir)), K.BATCH).select("key", "batch")


def token_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.batch_caps(K.batches(K.first_uses(_sentences(spark, sf_dir)), K.BATCH), FRAME_RATE)


def sentence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_gaps(_sentences(spark, sf_dir).where("text is not null")).select("sent_id", "gap")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.offsets(K.with_gaps(_sentences(spark, sf_dir).where("text is not null")).withColumn("n_samples", timing.silence_samples(F.col("text"))))


def silence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("sent_id", "n_samples", "start_sample")


def _on_book(placed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.book_timeline(timeline.chapter_lengths(placed, table(spark, sf_dir, "chapters")))


def book_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_book(_placed(spark, sf_dir), spark, sf_dir).select("book_id", "chapter_idx", "samples", "book_start", "mark_start", "mark_end")


def book_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long every book is, as hours, minutes and seconds."""
    whole = _on_book(_placed(spark, sf_dir), spark, sf_dir).groupBy("book_id").agg(F.sum("samples").alias("samples"))
    return whole.select("book_id", timing.hms(F.col("samples") / timing.RATE).alias("length"))


def concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of chapter files that the encoder joins, for every book."""
    path = F.concat(F.lit("/it's here/"), "book_id", F.lit("-"), F.col("chapter_idx").cast("string"), F.lit(".wav"))
    listed = timeline.concat_list(table(spark, sf_dir, "chapters").select("book_id", "chapter_idx", path.alias("path")).distinct())
    return listed.select("book_id", F.md5("listing").alias("digest"))


def vtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    return timeline.cues(placed, _on_book(placed, spark, sf_dir)).select("sent_id", "cue")


def vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    made = timeline.vtt(timeline.cues(placed, _on_book(placed, spark, sf_dir)))
    return made.select("book_id", F.md5("vtt").alias("digest"))


def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").select("book_id", "chapter_idx", "title")
    marks = _on_book(_placed(spark, sf_dir), spark, sf_dir).join(chapters, ["book_id", "chapter_idx"])
    return timeline.metadata(marks, _books(spark, sf_dir))


def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "spine_docs"), _paragraphs(spark, sf_dir))


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of every text: how long they are follows from the text and the attempt, some too long, some too short."""
    uses = K.first_uses(_sentences(spark, sf_dir)).select("key", "text")
    each = uses.withColumn("attempt", F.explode(F.array(*map(F.lit, range(3)))))
    factor = F.pmod(F.length("text") + F.col("attempt") * 3, F.lit(7)) + 1
    seconds = F.length("text") * factor * 0.0235
    return each.withColumns({"seconds": seconds, "capped": F.pmod(F.length("text"), F.lit(5)) == 0})


def guard_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retries.missed(_takes(spark, sf_dir))
    limits = rows.withColumns({"long_s": timing.long_limit(F.length("text")), "short_s": timing.short_limit(F.length("text"))})
    miss = F.when(F.col("miss") == float("inf"), -1.0).otherwise(F.round("miss", 4))
    return limits.select("key", "attempt", F.round("long_s", 4).alias("long_s"), F.round("short_s", 4).alias("short_s"), miss.alias("miss"))


def retry_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.best_takes(_takes(spark, sf_dir)).select("key", "attempt", "note")


def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is spoken next when one, two or three takes of a text are there."""
    takes = _takes(spark, sf_dir).where(F.col("attempt") <= F.pmod(F.length("text"), F.lit(3)))
    return retries.unsettled(takes).select("key", "attempt", "capped")


def retry_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The take kept after all rounds, where how long a take is follows from the text and the attempt."""
    seconds = F.length("text") * (F.pmod(F.length("text") + F.col("attempt") * 3, F.lit(7)) + 1) * 0.0235
    first = K.first_uses(_sentences(spark, sf_dir)).select("key", "text", F.lit(0).alias("attempt"), F.lit(True).alias("capped"), F.lit(0.0).alias("seconds")).withColumn("seconds", seconds)
    return retries.settled(first, lambda again: again.withColumn("seconds", seconds)).select("key", "attempt", "note")


def chapter_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chapter should consist of, its keys and gaps as digests."""
    plans = K.chapter_plans(_sentences(spark, sf_dir), "silence")
    gaps = F.array_join(F.transform("gap_after", lambda g: F.round(g * 100).cast("int").cast("string")), " ")
    return plans.select("book_id", "chapter_idx", F.size("clip_keys").alias("clips"), F.md5(F.array_join("clip_keys", " ")).alias("keys"), F.md5(gaps).alias("gaps"))


def stale_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose plan differs from one of the sentences that are voiced."""
    all_of = K.chapter_plans(_sentences(spark, sf_dir), "silence")
    voiced = table(spark, sf_dir, "sentences").where("clip_key is not null").select("sent_id", "book_id", "chapter_idx", "sent_idx", "para_id", "kind", "text").distinct()
    return K.stale(all_of, K.chapter_plans(voiced, "silence")).select("book_id", "chapter_idx")


def engine_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characters that fit so many seconds, for the limits of every engine."""
    return table(spark, sf_dir, "engine_limits").select("engine", timing.max_chars_within(F.col("max_sentence") / 4.0).alias("chars"))


def trimmed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with quiet ends of many lengths: how many samples a chapter takes of each."""
    uses = K.first_uses(_sentences(spark, sf_dir)).select("key", F.length("text").alias("n"))

    def cut(batches):
        for pdf in batches:
            sizes = []
            for n in pdf["n"]:
                parts = (np.zeros(n * 13 % 1900), np.full(n * 29 % 4000, 0.5), np.zeros(n * 7 % 1500))
                sizes.append(len(engines.trimmed(np.concatenate(parts).astype(np.float32), 8000)))
            yield pdf.assign(samples=sizes)

    return uses.mapInPandas(cut, "key string, n int, samples long").select("key", "samples")


def _packed_book(key: int, kind: str | None, text: str) -> bytes:
    """A book of one document, as a file."""
    body = html.escape(text)
    body = f"<h2>{body}</h2>" if kind == "heading" else f"<table><tr><td>{body}</td></tr></table>" if kind == "row" else f"<div><p>{body}</p></div>"
    files = {
        "META-INF/container.xml": "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='o/b.opf'/></rootfiles></container>",
        "o/b.opf": "<package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata>"
        f"<dc:title>Book  {key}</dc:title><dc:creator> </dc:creator><dc:creator>Writer {key % 7}</dc:creator></metadata><manifest><item id='n' href='t.ncx' media-type='application/x-dtbncx+xml'/>"
        f"<item id='p' href='c.jpg' media-type='image/jpeg' properties='cover-image'/><item id='d{key % 5}' href='a%20{key}.xhtml' media-type='application/xhtml+xml'/></manifest><spine toc='n'><itemref idref='d{key % 5}'/><itemref idref='gone'/></spine></package>",
        "o/t.ncx": f"<ncx xmlns='http://www.daisy.org/z3986/2005/ncx/'><navMap><navPoint><navLabel><text>Part</text></navLabel><navPoint><navLabel><text>Entry {key}</text></navLabel><content src='a%20{key}.xhtml#x'/></navPoint></navPoint></navMap></ncx>",
        "o/c.jpg": f"picture {key}",
        f"o/a {key}.xhtml": f"<html xmlns='http://www.w3.org/1999/xhtml'><head><title>t</title></head><body><nav>left out</nav>{body}</body></html>",
    }
    held = BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return held.getvalue()


def epub_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph packed as a book and read again: title, author, cover, document, contents, kind and text."""
    rows = _paragraphs(spark, sf_dir).where("text is not null").select("para_id", "kind", "text")

    def read(batches):
        for pdf in batches:
            made = []
            for key, kind, text in pdf.itertuples(index=False):
                b = epub.read_book(_packed_book(key, kind, text), "stem")
                doc, entry = b["docs"][0], b["toc"][0]
                head = (key, b["title"], b["author"], b["cover"].decode(), doc["doc_id"], doc["href"], entry["title"], entry["href"], entry["depth"])
                made += [(*head, p["kind"], p["text"]) for p in doc["paras"]]
            yield pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "para_id long, title string, author string, cover string, doc_id string, href string, entry string, target string, depth int, kind string, text string"
    return rows.mapInPandas(read, schema)


def doc_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept_docs(table(spark, sf_dir, "spine_docs"), _paragraphs(spark, sf_dir)).select("book_id", "doc_pos", "body_chars")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.running_headers(table(spark, sf_dir, "spine_docs"), _paragraphs(spark, sf_dir), _books(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.toc_targets(table(spark, sf_dir, "toc"), table(spark, sf_dir, "spine_docs"))


def running_headers_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every document with an odd place in its book begins with the book's title."""
    books = _books(spark, sf_dir)
    titles = books.where("title is not null").select("book_id", "title")
    odd = table(spark, sf_dir, "spine_docs").where("doc_pos % 2 = 1").join(titles, "book_id")
    planted = odd.select(F.lit(None).cast("long").alias("para_id"), "book_id", "doc_pos", F.lit(-1).alias("para_pos"), F.lit("heading").alias("kind"), F.upper("title").alias("text"))
    return C.running_headers(table(spark, sf_dir, "spine_docs"), _paragraphs(spark, sf_dir).unionByName(planted), books)


def toc_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("book_id", "toc_pos", "doc_pos")


def toc_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.monotone(_targets(spark, sf_dir)).select("book_id", "toc_pos", "doc_pos")


def section_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.folded_sections(C.monotone(_targets(spark, sf_dir))).select("book_id", "toc_pos", "doc_pos", "title")


def chapter_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "spine_docs").join(C.body_chars(_paragraphs(spark, sf_dir)), ["book_id", "doc_pos"])
    return C.by_contents(docs, C.monotone(_targets(spark, sf_dir)))


def heading_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.heading_islands(_paragraphs(spark, sf_dir)).select("para_id", "island")


def chapters_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = C.detected(table(spark, sf_dir, "spine_docs"), _paragraphs(spark, sf_dir), table(spark, sf_dir, "toc"), _books(spark, sf_dir))
    return found.select("book_id", "chapter_idx", "title", F.array_join("source_ids", " ").alias("source_ids"))


def dump_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = _paragraphs(spark, sf_dir).where("text is not null")
    ids = table(spark, sf_dir, "chapters").select("book_id", "chapter_idx", F.explode("source_ids").alias("doc_id"))
    members = ids.join(table(spark, sf_dir, "spine_docs").select("book_id", "doc_pos", "doc_id"), ["book_id", "doc_id"]).join(paras.select("book_id", "doc_pos", "para_pos"), ["book_id", "doc_pos"]).drop("doc_id")
    return pipeline.dump_text(members, paras).select("book_id", "chapter_idx", "doc_pos", "para_pos", "line")


def label_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _paragraphs(spark, sf_dir).where("text is not null and kind = 'body'")
    return body.select("para_id", F.when(T.is_label(F.col("text")), "heading").otherwise("body").alias("kind"))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).where("text is not null").select("para_id", T.collapse(F.col("text")).alias("text"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, heading key, escaped and shortened title of every book."""
    t = F.coalesce("title", F.lit(""))
    return _books(spark, sf_dir).select("book_id", T.slug(t).alias("slug"), T.heading_key(t).alias("key"), T.meta_escape(t).alias("escaped"), T.shortened(t, 20).alias("short"))


def title_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cut to a number of bytes, at a word."""
    return _books(spark, sf_dir).select("book_id", T.truncated(F.coalesce("title", F.lit("")), 24).alias("cut"))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _paragraphs(spark, sf_dir).where("text is not null").select(F.col("para_id").cast("string").alias("doc_key"), F.col("text").alias("xhtml"))
    return markup.paragraphs_of(pages).select("doc_key", "para_pos", "kind", "text")


def spoken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).where("text is not null").select("para_id", speech.spoken_udf("text").alias("spoken"))


QUERIES = {
    f.__name__: f
    for f in (
        document_report, sentence_split, clip_fill, clip_keys, pending, chapter_counts, batch_assign, token_caps, sentence_gaps, silence_timeline, book_timeline, book_lengths, concat_files, vtt_cues, vtt_files,
        metadata_files, chapter_report, guard_window, retry_best, doc_exclusion, running_headers, running_headers_planted, retry_rounds, retry_settled, chapter_plans, stale_chapters, engine_chars, trimmed_samples, epub_round_trip, toc_targets, toc_monotone, section_fold, chapter_mode, heading_islands,
        chapters_detected, dump_text, label_promotion, collapsed, title_keys, title_bytes, page_paragraphs, spoken_text,
    )
}
