"""Chunk state: statuses, batches, quality rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import MIN_CHECKED_SECONDS, calibration_median, verdict

STATUSES = ("completed", "failed", "pending", "split")
STATE = (
    "doc_id long, chunk_id string, parent_id string, text string, status string, error string, retries int, seed long, key string, "
    "reused boolean, speed double, pause_ms int, ends_paragraph boolean, qc struct<wer:double,ratio:double,attempts:int,verdict:string,error:string>"
)


def initial(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, pos, text, pause_ms, speed, ends_paragraph) as pending state; a pause of 0 is stored as none."""
    have = {"chunk_id": F.col("pos").cast("string"), "status": F.lit("pending"), "retries": F.lit(0), "pause_ms": F.when(F.col("pause_ms") != 0, F.col("pause_ms"))}
    kept = {"doc_id", "text", "speed", "ends_paragraph"}
    fields = [f.split(" ", 1) for f in STATE.split(", ")]
    return chunks.select(*[(have.get(n, F.col(n) if n in kept else F.lit(None)).cast(t)).alias(n) for n, t in fields])


def with_status(status: str, chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce("status", F.lit("pending")) == status)


def unchecked(chunks: DataFrame) -> DataFrame:
    """Completed chunks without a verdict, or whose check failed to run."""
    return chunks.where((F.col("status") == "completed") & (F.coalesce(F.col("qc.verdict"), F.lit("error")) == "error"))


def progress(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, total, completed, failed, pending, split): total counts top-level chunks, the others all of them."""
    status = F.coalesce("status", F.lit("pending"))
    return chunks.groupBy(by).agg(F.count_if(F.instr("chunk_id", "_") == 0).alias("total"), *[F.count_if(status == s).alias(s) for s in STATUSES])


def updated(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """State after ``changes(doc_id, chunk_id, new_status, new_error, new_seed)``.

    Completing a chunk clears its error and check; failing counts a retry.
    """
    rows = chunks.join(changes, ["doc_id", "chunk_id"], "left")
    done, failed = F.col("new_status") == "completed", F.col("new_status") == "failed"
    return rows.withColumns({
        "error": F.when(F.col("new_error").isNotNull(), F.col("new_error")).when(done, None).otherwise(F.col("error")),
        "qc": F.when(done, None).otherwise(F.col("qc")),
        "retries": F.coalesce("retries", F.lit(0)) + F.when(failed, 1).otherwise(0),
        "seed": F.coalesce("new_seed", "seed"),
        "status": F.coalesce("new_status", "status"),
    }).select(*chunks.columns)


def reset_invalid(chunks: DataFrame, valid: DataFrame) -> DataFrame:
    """Completed chunks whose audio is not among ``valid(doc_id, chunk_id)`` are pending again."""
    rows = chunks.join(valid.select("doc_id", "chunk_id", F.lit(True).alias("_valid")), ["doc_id", "chunk_id"], "left")
    bad = (F.col("status") == "completed") & F.col("_valid").isNull()
    return rows.withColumn("status", F.when(bad, "pending").otherwise(F.col("status"))).select(*chunks.columns)


def with_pieces(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """State with new pending chunks ``pieces(doc_id, chunk_id, sub_id, text)``; those they come from are split."""
    parents = pieces.select("doc_id", "chunk_id", F.lit(True).alias("_split")).distinct()
    marked = chunks.join(parents, ["doc_id", "chunk_id"], "left").withColumn("status", F.when(F.col("_split"), "split").otherwise(F.col("status"))).select(*chunks.columns)
    types = dict(chunks.dtypes)
    new = {"doc_id": F.col("doc_id"), "chunk_id": F.col("sub_id"), "parent_id": F.col("chunk_id"), "text": F.col("text"), "status": F.lit("pending"), "retries": F.lit(0)}
    return marked.unionByName(pieces.select(*[new.get(c, F.lit(None)).cast(types[c]).alias(c) for c in chunks.columns]))


def batches(chunks: DataFrame, width: int, by: str = "doc_id") -> DataFrame:
    """Add batch: chunks of one speed, shortest first, in groups of ``width``; ties in the order of pos."""
    w = Window.partitionBy(by, "speed").orderBy(F.length("text"), "pos")
    return chunks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / width).cast("int"))


def batch_width(free_gb: Column, accelerated: Column) -> Column:
    """How many chunks one batch takes, by free memory."""
    return F.when(~accelerated, 2).when(free_gb < 2, 1).when(free_gb < 6, 2).when(free_gb < 12, 4).otherwise(8)


def judged(measured: DataFrame, stored: DataFrame, by: str = "doc_id") -> DataFrame:
    """Add median and verdict to ``measured(by, chunk_id, wer, ratio, expected)``.

    The median is over the measured ratios of chunks long enough and those that
    ``stored(by, ratio, expected)`` has already; a chunk in both counts twice.
    """
    samples = measured.select(by, "ratio", "expected").unionAll(stored.select(by, "ratio", "expected"))
    medians = samples.where(F.col("expected") >= MIN_CHECKED_SECONDS).groupBy(by).agg(calibration_median(F.col("ratio")).alias("median"))
    rows = measured.join(medians, by, "left")
    return rows.withColumn("verdict", verdict(F.col("wer"), F.col("ratio"), F.col("expected"), F.col("median")))


def transition(verdict_: Column, retries: Column, depth: Column, pieces: Column, retry_budget: int, max_depth: int) -> Column:
    """What a check leads to: passed, retry, split or gave_up."""
    return (
        F.when(verdict_ == "pass", "passed")
        .when(retries < retry_budget, "retry")
        .when((depth < max_depth) & (pieces > 1), "split")
        .otherwise("gave_up")
    )


def counters(transitions: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, checked, flipped, gave_up) of ``transitions(by, step)``."""
    return transitions.groupBy(by).agg(F.count("*").alias("checked"), F.count_if(F.col("step").isin("retry", "split")).alias("flipped"), F.count_if(F.col("step") == "gave_up").alias("gave_up"))
