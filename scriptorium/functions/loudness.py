"""Loudness measurements against presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, integrated loudness, true peak, range, tolerance, whether the peak is enforced.
PRESETS = (("default", -18.0, -2.0, 11.0, 2.0, False), ("acx", -19.0, -3.0, 11.0, 1.0, True))
MEASURED = "input_i string, input_tp string, input_lra string, input_thresh string"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, lufs double, true_peak double, range double, tolerance double, enforce_peak boolean")


def parsed(log: Column) -> Column:
    """The measurement that ends a log: the last JSON object in it."""
    found = F.from_json(F.regexp_extract(log, r"(?s).*(\{.*\})", 1), MEASURED)
    return F.struct(*[found[a].cast("double").alias(b) for a, b in (("input_i", "integrated"), ("input_tp", "true_peak"), ("input_lra", "range"), ("input_thresh", "threshold"))])


def needs_normalizing(integrated: Column, true_peak: Column, preset: Column) -> Column:
    return (F.abs(integrated - preset["lufs"]) > preset["tolerance"]) | (preset["enforce_peak"] & (true_peak > preset["true_peak"]))


def peak_warning(true_peak: Column, preset: Column) -> Column:
    return ~preset["enforce_peak"] & (true_peak > preset["true_peak"])


def filter_string(preset: Column) -> Column:
    return F.format_string("loudnorm=I=%s:TP=%s:LRA=%s:print_format=json", *[F.format_number(preset[x], "0.##") for x in ("lufs", "true_peak", "range")])


def first_ceiling(preset: Column) -> Column:
    return preset["true_peak"] - 1


def lower_ceiling(ceiling: Column, true_peak: Column, preset: Column) -> Column:
    return ceiling - (true_peak - preset["true_peak"]) - 0.5


def raised_target(target: Column, integrated: Column, preset: Column) -> Column:
    return F.least(F.greatest(target + preset["lufs"] - integrated, preset["lufs"]), preset["lufs"] + preset["tolerance"])
