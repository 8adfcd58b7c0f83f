"""New sentences as a stream: each micro-batch speaks only texts no earlier one spoke."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import clips as K
from folioflow.operators import engines as E
from folioflow.operators import state


def speak_batch(batch: DataFrame, root: str, engine: E.Engine) -> None:
    """Appends the clips of one micro-batch. Keys are hashes of the text, so a batch that runs again adds nothing that is read."""
    fp16 = E.digest(engine.fingerprint())[:16]
    missing = K.batches(K.pending(K.first_uses(batch), state.clip_index(batch.sparkSession, root, fp16)), engine.max_batch)
    state.store_clips(K.heard(missing, engine), root)


def start(spark: SparkSession, source: str, root: str, engine: E.Engine, checkpoint: str) -> StreamingQuery:
    """Watches a folder of Parquet files with sentences and speaks what is new; resumes from ``checkpoint``."""
    schema = "sent_id long, book_id string, chapter_idx int, sent_idx int, para_id long, kind string, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source).where(F.col("text").isNotNull())
    return stream.writeStream.foreachBatch(lambda df, _: speak_batch(df, root, engine)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
