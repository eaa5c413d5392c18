"""Run folders, jobs, covers and request validation as tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_NAME = r"^(\d{4}-\d{2}-\d{2}-\d{4})(?:\.(\d+))?-(.+)$"
# Fixed values.
MODELS, FORMATS = ("omni", "pocket", "kani", "espeech", "qwen"), ("m4b", "mp3")
COVER_PREFERENCE, MAX_COVER_BYTES = (".jpg", ".jpeg", ".png"), 8 << 20
MAX_INSTRUCT_CHARS, LOG_TAIL_CHARS = 300, 8000


def named_runs(runs: DataFrame) -> DataFrame:
    """Add stamp, serial (1 where the name has none) and tag to ``runs(name, ...)``; other names go."""
    rows = runs.where(F.col("name").rlike(RUN_NAME))
    return rows.withColumns({
        "stamp": F.regexp_extract("name", RUN_NAME, 1),
        "serial": F.coalesce(F.expr("try_cast(regexp_extract(name, r'^\\d{4}-\\d{2}-\\d{2}-\\d{4}\\.(\\d+)-', 1) as int)"), F.lit(1)),
        "tag": F.regexp_extract("name", RUN_NAME, 3),
    })


def newest_first(runs: DataFrame) -> DataFrame:
    return named_runs(runs).orderBy(F.desc("stamp"), F.desc("serial"))


def resumable(runs: DataFrame, by: str = "book") -> DataFrame:
    """The newest unfinished run of each book and tag that began with the same source or none: ``runs(by, name, finished, source, wanted_source)``."""
    rows = named_runs(runs).where(~F.col("finished") & (F.col("source").isNull() | (F.trim("source") == F.col("wanted_source"))))
    w = Window.partitionBy(by, "tag").orderBy(F.desc("stamp"), F.desc("serial"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def free_names(runs: DataFrame, wanted: DataFrame, by: str = "book") -> DataFrame:
    """The first free name (by, stamp, tag, name) for each of ``wanted(by, stamp, tag)``: serials from 2 where the plain one is taken."""
    taken = named_runs(runs).groupBy(by, "stamp", "tag").agg(F.collect_set("serial").alias("_taken"))
    rows = wanted.join(taken, [by, "stamp", "tag"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    serial = F.element_at(F.filter(F.sequence(F.lit(1), F.size("_taken") + 1), lambda s: ~F.array_contains(F.col("_taken"), s)), 1)
    return rows.withColumn("_s", serial).select(by, "stamp", "tag", F.when(F.col("_s") == 1, F.concat_ws("-", "stamp", "tag")).otherwise(F.concat("stamp", F.lit("."), "_s", F.lit("-"), "tag")).alias("name"))


def settled_jobs(jobs: DataFrame, alive: DataFrame, outputs: DataFrame) -> DataFrame:
    """Running jobs whose process is gone: succeeded where the output exists, failed elsewhere; newest first."""
    rows = jobs.join(alive.select("pid", F.lit(True).alias("_alive")), "pid", "left").join(outputs.select("id", F.lit(True).alias("_out")), "id", "left")
    gone = (F.col("state") == "running") & F.col("_alive").isNull()
    rows = rows.withColumn("state", F.when(gone & F.col("_out").isNotNull(), "succeeded").when(gone, "failed").otherwise(F.col("state")))
    return rows.select(*jobs.columns).orderBy(F.desc("created_at"))


def job_views(jobs: DataFrame, hidden_path: str) -> DataFrame:
    """What a job shows: the end of its log while running or failed, without paths; downloads once it succeeded."""
    log = F.right(F.replace("log", F.lit(hidden_path), F.lit("")), F.lit(LOG_TAIL_CHARS))
    return jobs.withColumns({"log": F.when(F.col("state").isin("running", "failed"), log), "downloadable": F.col("state") == "succeeded"})


def forwarded(environment: Column, *prefixes: str) -> Column:
    """The variables of a map that are handed on: those whose names begin with one of ``prefixes``."""
    return F.map_filter(environment, lambda name, _: functools.reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes]))


def option_error(model: Column, format_: Column, workers: Column, language: Column, instruct: Column) -> Column:
    """Why options are refused, or null."""
    return (
        F.when(~model.isin(*MODELS), "unknown model")
        .when(~format_.isin(*FORMATS), "unknown format")
        .when(workers.isNull() | (workers != F.floor(workers)) | ~workers.between(1, 4), "workers must be 1 to 4")
        .when(~language.rlike("^[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})*$"), "bad language")
        .when((F.length(instruct) > 0) & (model != "omni"), "only one model takes a voice description")
        .when(F.length(instruct) > MAX_INSTRUCT_CHARS, "voice description too long")
    )


def valid_job_id(job_id: Column) -> Column:
    return job_id.rlike("^[0-9a-f-]{36}$")


def upload_limit_mb(setting: Column) -> Column:
    """A setting of 1 to 500 MB, else 100."""
    value = setting.try_cast("double")
    return F.when(value.between(1, 500), value).otherwise(F.lit(100.0))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its folder."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct(*(lambda d: (d.alias("d"), F.least(s["low"], d).alias("low")))(s["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))),
        lambda s: s["low"],
    )
    return ~path.startswith("/") & (depth >= 0)


def image_kind(content: Column) -> Column:
    """.jpg or .png by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), ".jpg").when(head == "89504E470D0A1A0A", ".png")


def chosen_covers(files: DataFrame, by: str = "book") -> DataFrame:
    """One cover of each book from ``files(by, extension, content)``: a small enough image, by preference of extension."""
    order = F.array_position(F.array(*map(F.lit, COVER_PREFERENCE)), F.lower("extension"))
    rows = files.where((order > 0) & image_kind(F.col("content")).isNotNull() & (F.octet_length("content") <= MAX_COVER_BYTES))
    return rows.groupBy(by).agg(F.min_by("extension", order).alias("extension"), F.min_by("content", order).alias("content"))
