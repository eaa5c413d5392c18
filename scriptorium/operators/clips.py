"""Silences of a recording and the clip to take from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in seconds.
TARGET, LONGEST, SHORTEST, LEAD = 7.0, 10.0, 3.0, 1.0


def silences(log: DataFrame, by: str = "doc_id") -> DataFrame:
    """Silences (by, start, end) from the lines (by, pos, line) of a detector's log: each end with the last open start."""
    rows = log.select(by, "pos", F.regexp_extract("line", r"silence_start:\s*([\d.]+)", 1).try_cast("double").alias("s"), F.regexp_extract("line", r"silence_end:\s*([\d.]+)", 1).try_cast("double").alias("e"))
    rows = rows.where("s is not null or e is not null")
    w = Window.partitionBy(by).orderBy("pos")
    open_at = F.last(F.when(F.col("s").isNotNull(), F.col("pos")), True).over(w)
    rows = rows.withColumns({"_start": F.last("s", True).over(w), "_at": open_at})
    used = F.row_number().over(Window.partitionBy(by, "_at").orderBy("pos"))
    rows = rows.where("e is not null and _start is not null").withColumn("_n", used).where("_n = 1")
    return rows.select(by, F.col("_start").alias("start"), F.col("e").alias("end"))


def clip_windows(quiet: DataFrame, totals: DataFrame, by: str = "doc_id") -> DataFrame:
    """The clip (by, from, to) of each recording in ``totals(by, total)``.

    A short recording is taken whole.  Else the clip runs from the end of one
    silence to the start of another, 3 to 10 seconds, nearest to 7; the first of
    equals.  Else ten seconds from the end of a silence that starts the
    recording.  Pairs of edges meet by whole seconds, so an edge only meets those
    at most ten seconds on.
    """
    ends = quiet.select(by, "start", "end").unionByName(totals.select(by, F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))).unionByName(totals.select(by, F.col("total").alias("start"), F.col("total").alias("end")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("start", "end")).alias("n")
    ends = ends.select(by, "start", "end", rank)
    second = F.floor("end").cast("int")
    opening = ends.select(by, F.col("end").alias("a"), F.col("n").alias("i"), F.explode(F.sequence(second, second + int(LONGEST))).alias("_s"))
    closing = ends.select(by, F.col("start").alias("b"), F.col("n").alias("j"), F.floor("start").cast("int").alias("_s"))
    pairs = opening.join(closing, [by, "_s"]).where((F.col("b") - F.col("a")).between(SHORTEST, LONGEST))
    best = pairs.groupBy(by).agg(F.min_by(F.struct("a", "b"), F.struct(F.abs(F.col("b") - F.col("a") - TARGET), "i", "j")).alias("best"))
    lead = quiet.where(F.col("start") < LEAD).groupBy(by).agg(F.min_by("end", "start").alias("lead"))
    rows = totals.join(best, by, "left").join(lead, by, "left")
    start = F.coalesce("lead", F.lit(0.0))
    whole = F.col("total") <= LONGEST
    return rows.select(
        by,
        F.when(whole, 0.0).when(F.col("best").isNotNull(), F.col("best.a")).otherwise(start).alias("from"),
        F.when(whole, F.col("total")).when(F.col("best").isNotNull(), F.col("best.b")).otherwise(F.least(start + LONGEST, F.col("total"))).alias("to"),
    )
