"""Reuse of earlier work by key: what can be restored, what must be made, what goes into the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import chunk_key


def keyed(chunks: DataFrame, fingerprint: str) -> DataFrame:
    return chunks.withColumn("key", chunk_key(F.lit(fingerprint), F.col("speed"), F.col("text")))


def reusable(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose key has valid audio in ``cache(key, valid, ...)``."""
    return chunks.join(cache.where("valid").select("key"), "key", "left_semi")


def to_make(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.where("valid").select("key"), "key", "left_anti")


def restored(state: DataFrame, cache: DataFrame) -> DataFrame:
    """State with hits completed: measurements come back, the verdict does not, and retries are the attempts.

    ``cache(key, valid, wer, ratio, attempts)`` has at most one row for a key.
    """
    hits = cache.where("valid").select("key", F.col("wer").alias("_wer"), F.col("ratio").alias("_ratio"), F.col("attempts").alias("_attempts"), F.lit(True).alias("_hit"))
    rows = state.join(hits, "key", "left")
    measured = F.col("_hit") & F.col("_wer").isNotNull()
    qc = F.struct(F.col("_wer").alias("wer"), F.col("_ratio").alias("ratio"), F.col("_attempts").cast("int").alias("attempts"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("error"))
    return rows.withColumns({
        "status": F.when(F.col("_hit"), "completed").otherwise(F.col("status")),
        "reused": F.coalesce(F.col("_hit"), F.col("reused")),
        "retries": F.when(measured, F.coalesce(F.col("_attempts").cast("int"), F.lit(0))).otherwise(F.col("retries")),
        "qc": F.when(measured, qc).otherwise(F.col("qc")),
    }).select(*state.columns)


def published(cache: DataFrame, new: DataFrame, evicted: DataFrame | None = None) -> DataFrame:
    """The cache with ``new`` rows over old ones of their keys, and without ``evicted(key)``."""
    rows = cache.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("_age"))).where("_n = 1").drop("_age", "_n")
    return rows if evicted is None else rows.join(evicted.select("key").distinct(), "key", "left_anti")
