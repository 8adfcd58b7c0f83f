"""The queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import encoding, leakage, lookalikes, markup, packing, pieces, sentences, stuffing
from folioflow.session import cut, known_rows, scanned, spread
from folioflow.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted over all paragraphs; the body of published documents is asked for its ends."""
    published = table(spark, sf_dir, "spine_docs").where(F.col("origin") == "publisher").select("book_id", "doc_pos")
    every = table(spark, sf_dir, "paragraphs").where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("para_id", "book_id", "doc_pos", "text", (F.col("kind") == "body").alias("asked"))
    return sentences.sentence_ends(scanned(every), published)


def _hosted_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of the paragraphs, hosted by the way their document came in. They are joined with it, texts are not."""
    paragraphs = table(spark, sf_dir, "paragraphs").select(F.col("para_id").alias("id"), "book_id", "doc_pos", "text")
    origins = table(spark, sf_dir, "spine_docs").groupBy("book_id", "doc_pos").agg(F.min("origin").alias("host"))
    return known_rows(cut(markup.streams(scanned(paragraphs))), origins, "book_id", "doc_pos", how="left").select("id", "host", "stream", "th")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.marked(_hosted_streams(spark, sf_dir)).select(F.col("id").alias("para_id")).distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = table(spark, sf_dir, "paragraphs").select(F.col("para_id").alias("id"), "kind", "text")
    return markup.cleaned(paragraphs, markup.marked(_hosted_streams(spark, sf_dir))).withColumnRenamed("id", "para_id")


def p3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.wrappers(cut(markup.distinct_streams(_hosted_streams(spark, sf_dir)))).withColumnRenamed("host", "origin")


PRINT_LEAST = 60


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "paragraphs").select(F.col("para_id").alias("id"), "text")
    return lookalikes.equal_print_pairs(scanned(items), PRINT_LEAST).select(F.col("a").alias("para_id_a"), F.col("b").alias("para_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: every paragraph that prints like one with another text, with its class and its number of links."""
    items = table(spark, sf_dir, "paragraphs").select(F.col("para_id").alias("id"), "text")
    return lookalikes.print_classes(scanned(items), PRINT_LEAST).withColumnRenamed("id", "para_id")


def p4_clip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with the clip key of its one form, and whether its stored key was made from another form."""
    sents = spread(table(spark, sf_dir, "sentences").select("sent_id", "text", "clip_key"), "sent_id").distinct()
    made = lookalikes.unified(sents).withColumn("form_key", lookalikes.clip_key(F.col("one_form")))
    return made.select("sent_id", "form_key", (F.col("clip_key").isNotNull() & (F.col("clip_key") != F.col("form_key"))).alias("rekeyed"))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence and paragraph that may be too long, with the limit of the engine of its spine document."""
    limits = table(spark, sf_dir, "engine_limits").where("engine is not null").dropDuplicates(["engine"])
    least = limits.agg(F.min("max_sentence"), F.min("max_paragraph")).first()  # a fixed table of five rows
    engines = table(spark, sf_dir, "spine_docs").select("book_id", "doc_pos", "engine").dropDuplicates(["book_id", "doc_pos"]).join(F.broadcast(limits), "engine")
    paragraphs = table(spark, sf_dir, "paragraphs").select("para_id", "book_id", "doc_pos", "text")
    # no unit counts more than UTF-8 bytes, so short texts leave before any shuffle
    sents = table(spark, sf_dir, "sentences").select("sent_id", "para_id", "text").where(F.octet_length("text") > (least[0] or 0))
    homes = paragraphs.select("para_id", "book_id", "doc_pos").dropDuplicates(["para_id"])
    sents = sents.join(homes, "para_id").select(F.lit("sentence").alias("item_kind"), F.col("sent_id").alias("item_id"), "book_id", "doc_pos", "text")
    paras = paragraphs.where(F.octet_length("text") > (least[1] or 0)).select(F.lit("paragraph").alias("item_kind"), F.col("para_id").alias("item_id"), "book_id", "doc_pos", "text")
    most = F.when(F.col("item_kind") == "sentence", F.col("max_sentence")).otherwise(F.col("max_paragraph"))
    return sents.unionByName(paras).join(engines, ["book_id", "doc_pos"]).withColumn("max_size", most)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_pieces(_limited(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece_idx = 1").select("item_kind", "item_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, paragraphs = table(spark, sf_dir, "books"), table(spark, sf_dir, "paragraphs")
    of = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return of(books, "title", "book_id", "title").unionByName(of(books, "author", "book_id", "author")).unionByName(of(paragraphs, "paragraph", "para_id", "text"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(_records(spark, sf_dir)).toDF("record_kind", "record_key", "transformation", "restored")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    found = encoding.garbled_texts(cut(encoding.distinct_texts(records))).select("th")
    own = records.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(F.col("kind").alias("record_kind"), F.col("key").alias("record_key"), F.md5("text").alias("th"))
    return known_rows(own, found, "th", how="left_semi").drop("th").distinct()


def p2_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.learned(_records(spark, sf_dir))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assigned(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_pack(spark, sf_dir), table(spark, sf_dir, "containers"))


TIGHT = {"tokens_a_segment": 100, "loss_share": 0.75}  # limits on segments and loss-bearing tokens that bind


def p6_tight_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill under limits that all bind, as for instruction data."""
    kinds = table(spark, sf_dir, "containers")
    packs = packing.assigned(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")), kinds, **TIGHT)
    return packing.fill(packs, kinds, **TIGHT)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _leaks(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed(_pages(spark, sf_dir)).select("doc_id")


def p8_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of every page, and how it differs from those of its like."""
    fitted = stuffing.compared(cut(stuffing.curves(_pages(spark, sf_dir))))
    return fitted.select("doc_id", "lang", "band", "words", *[F.round(c, 6).alias(c) for c in ("apart", "linked", *stuffing.MEASURES, "steeper", "rougher", "higher")])


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p2_transformations": p2_transformations,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p3_wrappers": p3_wrappers,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p4_clip_keys": p4_clip_keys,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_tight_fill": p6_tight_fill,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_curves": p8_curves,
}
SQL: dict[str, str] = {
    "p5_found": r"""
WITH homes AS (SELECT DISTINCT para_id, book_id, doc_pos FROM paragraphs),
items AS (
  SELECT 'sentence' AS item_kind, s.sent_id AS item_id, h.book_id, h.doc_pos, s.text FROM sentences s JOIN homes h USING (para_id)
  UNION ALL SELECT 'paragraph', para_id, book_id, doc_pos, text FROM paragraphs
), sized AS (
  SELECT i.item_kind, i.item_id, CASE WHEN i.item_kind = 'sentence' THEN l.max_sentence ELSE l.max_paragraph END AS most,
    CASE l.size_unit WHEN 'chars' THEN length(i.text) WHEN 'bytes' THEN strlen(i.text)
      ELSE length(i.text) + length(regexp_replace(i.text, '[\x{0000}-\x{FFFF}]', '', 'g')) END AS size
  FROM items i JOIN (SELECT DISTINCT book_id, doc_pos, engine FROM spine_docs) d USING (book_id, doc_pos) JOIN engine_limits l USING (engine)
)
SELECT DISTINCT item_kind, item_id FROM sized WHERE size > most
""",
}
