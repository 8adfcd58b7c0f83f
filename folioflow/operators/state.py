"""State kept between runs: spoken clips, chapter manifests, encode stamps, all as Parquet folders.

Rows are keyed by content, so that a repeated append changes nothing that is read: reading takes one row a key. Audio is
written before the manifest that names it; a run that breaks off leaves a chapter stale, never falsely done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CLIPS = "fp16 string, clip_key string, sample_rate int, n_samples long, n_trimmed long, pcm binary"
MANIFESTS = "fp string, book_id string, chapter_idx int, manifest string, written_at timestamp"
STAMPS = "book_id string, digest string, written_at timestamp"
MANIFEST = "sample_rate int, clip_keys array<string>, gap_after array<double>, offsets array<struct<start:double,end:double>>, duration double"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The folder's rows, or none where it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clips(spark: SparkSession, root: str, fp16: str) -> DataFrame:
    """Readable clips of one engine. A clip without samples or with a wrong size is a miss."""
    rows = _read(spark, f"{root}/clips", CLIPS).where((F.col("fp16") == fp16) & (F.col("n_samples") > 0))
    return rows.where(F.octet_length("pcm") == 2 * F.col("n_samples")).dropDuplicates(["fp16", "clip_key"])


def clip_index(spark: SparkSession, root: str, fp16: str) -> DataFrame:
    """(key, n_samples) of an engine's clips, without reading audio; the samples are those a chapter takes, without quiet ends."""
    rows = _read(spark, f"{root}/clips", CLIPS).where((F.col("fp16") == fp16) & (F.col("n_samples") > 0))
    return rows.select(F.col("clip_key").alias("key"), F.coalesce("n_trimmed", "n_samples").alias("n_samples")).dropDuplicates(["key"])


def store_clips(rows: DataFrame, root: str) -> None:
    """Appends clips as ``engines.spoken`` gives them."""
    rows.select("fp16", F.col("key").alias("clip_key"), "sample_rate", "n_samples", "n_trimmed", "pcm").write.mode("append").partitionBy("fp16").parquet(f"{root}/clips")


def manifests(spark: SparkSession, root: str, fp: str) -> DataFrame:
    """The latest manifest of each chapter; one that can't be parsed counts as missing."""
    rows = _read(spark, f"{root}/manifests", MANIFESTS).where(F.col("fp") == fp)
    last = rows.groupBy("fp", "book_id", "chapter_idx").agg(F.max_by("manifest", "written_at").alias("manifest"))
    m = last.withColumn("m", F.from_json("manifest", MANIFEST, {"mode": "PERMISSIVE"}))
    return m.where("m.clip_keys is not null").select(F.col("fp").alias("fingerprint"), "book_id", "chapter_idx", "m.*")


def store_manifests(chapters: DataFrame, root: str) -> None:
    """``chapters``: fingerprint, book_id, chapter_idx and the fields of a manifest."""
    fields = [c.split()[0] for c in MANIFEST.split(", ")]
    body = F.to_json(F.struct(*fields))
    chapters.select(F.col("fingerprint").alias("fp"), "book_id", "chapter_idx", body.alias("manifest"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(f"{root}/manifests")


def stamps(spark: SparkSession, root: str) -> DataFrame:
    """(book_id, digest) of the last finished encode; an empty digest stands for one that was cleared."""
    rows = _read(spark, f"{root}/stamps", STAMPS)
    return rows.groupBy("book_id").agg(F.max_by("digest", "written_at").alias("digest")).where("digest <> ''")


def stamp(books: DataFrame, root: str) -> None:
    """Appends (book_id, digest); an empty digest clears, as is done before encoding begins."""
    books.select("book_id", F.coalesce("digest", F.lit("")).alias("digest"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(f"{root}/stamps")


def to_encode(books: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Books (book_id, digest, ...) whose last encode is missing or was made with other settings or chapters."""
    return books.join(stamps(spark, root), ["book_id", "digest"], "left_anti")
