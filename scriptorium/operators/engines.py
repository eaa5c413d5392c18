"""Speech engines, transcribers and stress markers as plug-ins, with stand-ins that no model is behind.

Models can't be had here.  A plug-in is a factory that a worker calls once; what
it makes is called for batches of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, sample rate, most characters in a chunk, takes a speed, takes batches.
LIMITS = (("pocket", 24000, 250, False, False), ("kani", 22000, 500, False, False), ("omni", 24000, 300, True, True), ("espeech", 24000, 500, False, False), ("qwen", 24000, 300, False, False))

FACTORIES: dict[str, Callable[[], Callable]] = {}


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "engine string, sample_rate int, max_chars int, supports_speed boolean, supports_batches boolean")


def register(name: str, factory: Callable[[], Callable]) -> None:
    FACTORIES[name] = factory


def engine(name: str) -> Callable[[], Callable]:
    if name not in FACTORIES:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name]


def silent_stub() -> Callable:
    """A stand-in: silence as long as a text takes at 20 characters a second."""
    return lambda texts, speeds, rate: [[0.0] * int(rate * len(t or "") / 20 / (s or 1.0)) for t, s in zip(texts, speeds)]


register("stub", silent_stub)


def rendered(chunks: DataFrame, name: str, sample_rate: int) -> DataFrame:
    """``chunks(text, speed, ...)`` with samples from an engine.  Where a batch fails its rows are tried one by one."""
    factory = engine(name)

    @F.pandas_udf("struct<samples:array<float>,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        say = None
        for texts, speeds in batches:
            say = say or factory()
            speeds = [None if pd.isna(s) else s for s in speeds]
            try:
                rows = [(x, None) for x in say(list(texts), speeds, sample_rate)]
            except Exception:
                rows = []
                for t, s in zip(texts, speeds):
                    try:
                        rows.append((say([t], [s], sample_rate)[0], None))
                    except Exception as error:
                        rows.append((None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["samples", "error"])

    return chunks.withColumn("_r", run("text", "speed")).select("*", "_r.samples", F.col("_r.error").alias("render_error")).drop("_r")
