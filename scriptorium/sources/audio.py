"""WAV files: header facts, samples, and files made from samples."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow

HEADER_BYTES = 44
FACTS = "struct<frames:bigint,width:int,channels:int,rate:int,duration_ms:bigint,valid:boolean>"


@arrow(FACTS)
def wav_facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What a WAV file's header says; valid if it has frames and as many bytes as they need.  Nulls for other files."""
    names = ["frames", "width", "channels", "rate", "duration_ms", "valid"]
    for contents in batches:
        rows = []
        for content in contents:
            try:
                with wave.open(io.BytesIO(content or b"")) as f:
                    n, width, channels, rate = f.getnframes(), f.getsampwidth(), f.getnchannels(), f.getframerate()
                rows.append((n, width, channels, rate, round(n / rate * 1000), n > 0 and len(content) >= HEADER_BYTES + n * width * channels))
            except (EOFError, wave.Error, struct.error, ZeroDivisionError):
                rows.append((None, None, None, None, None, False))
        yield pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in names[:-1]})


@arrow("array<float>")
def wav_samples(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """16-bit samples over 32767 as floats."""
    for contents in batches:
        out = []
        for content in contents:
            with wave.open(io.BytesIO(content)) as f:
                out.append(np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / np.float32(32767.0))
        yield pd.Series(out)


@arrow("binary")
def wav_file(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Mono 16-bit WAV files of 16-bit samples and sample rates."""
    for samples, rates in batches:
        out = []
        for values, rate in zip(samples, rates):
            held = io.BytesIO()
            with wave.open(held, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(int(rate))
                f.writeframes(np.asarray(values, "<i2").tobytes())
            out.append(held.getvalue())
        yield pd.Series(out)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, facts of the header) of WAV files."""
    return spark.read.format("binaryFile").load(path).select("path", wav_facts("content").alias("f")).select("path", "f.*")
