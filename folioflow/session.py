"""Settings every job shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
BROADCAST_BYTES = 16 << 20
SALTS = 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where none is set (local tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="folioflow-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; safe when an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """Tasks for a Python stage: ``FANOUT`` a core or what the shuffle setting says, whichever is more."""
    return max(FANOUT * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over ``tasks`` partitions. Later steps on the same keys (a join, one row a key) find the rows
    in place and don't shuffle again."""
    return df.repartition(tasks(df.sparkSession), *keys)


def scanned(df: DataFrame) -> DataFrame:
    """A plain scan (columns and filters only) with a partition for each core at least. A table of many files stays as it is
    read; only one that comes as a file or two, as small ones do, is dealt out over more tasks."""
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if parts >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks(df.sparkSession))


def small(df: DataFrame, *keys: str) -> bool:
    """Whether the rows of ``df``, as counted, take at most ``BROADCAST_BYTES`` as a broadcast table that is looked up by ``keys``.

    Such a table is built on the driver and takes several times what its values do. Every row stands there with its key beside
    it: 16 bytes of lengths and links, 8 bytes a field and 8 more for each of the two, texts in whole words of 8 bytes, and up
    to four slots of 16 bytes in the index."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    words = [F.coalesce(F.sum(F.ceil(F.octet_length(c) / 8)), F.lit(0)) for c in texts]
    n, *sizes = df.agg(F.count("*"), *words).first()
    fixed = 16 + 8 * (1 + len(df.columns)) + 8 * (1 + len(keys)) + 4 * 16
    return n * fixed + sum(8 * int(size) * (2 if c in keys else 1) for c, size in zip(texts, sizes, strict=True)) <= BROADCAST_BYTES


def known_rows(rows: DataFrame, known: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known`` (few rows a key) on ``keys``. A ``known`` of at most ``BROADCAST_BYTES``, as counted, goes to all
    executors, and ``rows`` stay where they are. A larger one is salted, so that a key that a third of ``rows`` share is no
    hot task; it never passes through the driver, whatever size the optimizer takes it for. Both ways give the same rows."""
    known = cut(known)
    if small(known, *keys):
        return rows.join(F.broadcast(known), list(keys), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread_out = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread_out.hint("merge"), [*keys, "_salt"], how).drop("_salt")


__all__ = ["FANOUT", "checkpoint_dir", "cut", "known_rows", "scanned", "small", "spread", "tasks"]
