"""Trees of chunks split for retries, by the paths their ids spell ("3", "3_0", "3_0_1")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path(chunk_id: Column) -> Column:
    """An id as an array of numbers; arrays order as the ids do, a shorter prefix first."""
    return F.transform(F.split(chunk_id, "[_.]"), lambda x: x.cast("int"))


def parent(chunk_id: Column) -> Column:
    """The id of the chunk that one was split from, or null."""
    return F.when(F.instr(chunk_id, "_") > 0, F.regexp_replace(chunk_id, "_[^_]*$", ""))


def _with_ancestors(chunks: DataFrame, by: list[str]) -> DataFrame:
    """A row for each chunk and each prefix of its path (itself included): (by, chunk_id, ancestor, depth).

    Paths are short, so this is a join on equal ids instead of a recursion.
    """
    parts = F.split("chunk_id", "_")
    rows = chunks.select(*by, "chunk_id", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    return rows.select(*by, "chunk_id", "depth", F.array_join(F.slice(F.split("chunk_id", "_"), F.lit(1), F.col("depth")), "_").alias("ancestor"))


def with_inherited(chunks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunk state (by, chunk_id, speed, pause_ms, ends_paragraph) with what chunks have from those they were split from.

    own_speed: the speed of the nearest chunk up the tree that has one.
    extra_pause_ms: the pauses of the chunk and of all those whose last part it
    is.  paragraph_end: whether any of those ends a paragraph.
    """
    by = list(by)
    rank = F.row_number().over(Window.partitionBy(*by, "_up").orderBy(path(F.col("chunk_id")).desc()))
    marked = chunks.withColumn("_up", parent(F.col("chunk_id"))).withColumn("_last", F.col("_up").isNull() | (rank == 1))
    own = marked.select(*by, F.col("chunk_id").alias("ancestor"), F.col("speed").alias("_speed"), F.coalesce("pause_ms", F.lit(0)).alias("_pause"), F.coalesce("ends_paragraph", F.lit(False)).alias("_ends"), "_last")
    rows = _with_ancestors(chunks, by).join(own, [*by, "ancestor"], "left")
    # Going up stops below an ancestor that is missing, and for pauses and paragraph ends also above the first that is not the last part of its own parent.
    w = Window.partitionBy(*by, "chunk_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reaches", F.coalesce(F.bool_and(F.coalesce("_last", F.lit(False))).over(w), F.lit(True)))
    rows = rows.withColumn("_joined", F.coalesce(F.bool_and(F.col("_last").isNotNull()).over(w), F.lit(True)))
    found = rows.groupBy(*by, "chunk_id").agg(
        F.max_by("_speed", F.when(F.col("_joined") & F.col("_speed").isNotNull(), F.col("depth"))).alias("own_speed"),
        F.sum(F.when(F.col("_reaches"), F.coalesce("_pause", F.lit(0))).otherwise(0)).cast("int").alias("extra_pause_ms"),
        F.bool_or(F.col("_reaches") & F.coalesce("_ends", F.lit(False))).alias("paragraph_end"),
    )
    return chunks.join(found, [*by, "chunk_id"])


def leaves_in_order(chunks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Completed chunks with their place in the reading order; all their ancestors must be split."""
    by = list(by)
    states = chunks.select(*by, F.col("chunk_id").alias("ancestor"), F.col("status").alias("_status"))
    own = _with_ancestors(chunks.where("status = 'completed'"), by).where("ancestor <> chunk_id")
    stray = own.join(states, [*by, "ancestor"], "left").where("not _status <=> 'split'").select(*by, "chunk_id").distinct()
    rows = chunks.where("status = 'completed'").join(stray, [*by, "chunk_id"], "left_anti")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(path(F.col("chunk_id")))) - 1)
