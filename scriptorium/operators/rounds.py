"""Rounds of making, checking and making again, until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment, state
from .metrics import expected_seconds

MEASURED = "doc_id long, chunk_id string, wer double, ratio double, expected double"


def checked(chunks: DataFrame, measured: DataFrame, stored: DataFrame, retry_budget: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """State after one check of ``measured``, and its steps (doc_id, chunk_id, step).

    A failed chunk is tried again while its budget lasts, then split while it can
    be, and given up last; splitting adds pending chunks.
    """
    judged = state.judged(measured, stored)
    rows = judged.join(chunks.select("doc_id", "chunk_id", "text", "retries"), ["doc_id", "chunk_id"])
    failed = rows.where("verdict = 'fail'").select("doc_id", "chunk_id", "text")
    keyed = failed.select(F.concat_ws("|", "doc_id", "chunk_id").alias("chunk_id"), "text")
    pieces = segment.retry_pieces(keyed).select(
        F.split_part("chunk_id", F.lit("|"), F.lit(1)).cast("long").alias("doc_id"), F.split_part("chunk_id", F.lit("|"), F.lit(2)).alias("chunk_id"),
        F.split_part("sub_id", F.lit("|"), F.lit(2)).alias("sub_id"), "text",
    )
    counted = pieces.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("_pieces"))
    depth = F.size(F.split("chunk_id", "_")) - 1
    step = state.transition(F.col("verdict"), F.col("retries"), depth, F.coalesce("_pieces", F.lit(0)), retry_budget, max_depth)
    steps = rows.join(counted, ["doc_id", "chunk_id"], "left").withColumn("step", step)
    qc = F.struct("wer", "ratio", F.col("retries").alias("attempts"), "verdict", F.lit(None).cast("string").alias("error"))
    found = steps.select("doc_id", "chunk_id", "step", qc.alias("_qc"))
    again = F.coalesce(F.col("step") == "retry", F.lit(False))
    after = chunks.join(found, ["doc_id", "chunk_id"], "left").withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "retries": F.col("retries") + F.when(again, 1).otherwise(0),
        "qc": F.coalesce("_qc", "qc"),
    }).select(*chunks.columns)
    split = pieces.join(steps.where("step = 'split'").select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
    return state.with_pieces(after, split), steps.select("doc_id", "chunk_id", "step")


def settled(chunks: DataFrame, make: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], retry_budget: int = 2, max_depth: int = 2, most_rounds: int = 20) -> DataFrame:
    """State once no chunk is tried again or split.

    ``make`` gives the changes (see ``state.updated``) of pending chunks,
    ``measure`` the measurements of completed ones without a verdict, and
    ``keep`` writes a round's state and reads it back, which cuts its lineage.
    Budget and depth bound the rounds a chunk needs; more than ``most_rounds``
    are an error.
    """
    for _ in range(most_rounds):
        chunks = keep(state.updated(chunks, make(state.with_status("pending", chunks))))
        measured = measure(state.unchecked(chunks))
        stored = chunks.where("qc.ratio is not null").select("doc_id", F.col("qc.ratio").alias("ratio"), expected_seconds(F.col("text"), F.col("speed")).alias("expected"))
        after, steps = checked(chunks, measured, stored, retry_budget, max_depth)
        chunks, quiet = keep(after), steps.where("step in ('retry', 'split')").isEmpty()
        if quiet:
            return chunks
    raise RuntimeError(f"chunks did not settle in {most_rounds} rounds")
