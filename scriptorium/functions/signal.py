"""Signals as arrays of samples, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SILENCE_DB, FLOOR_DB, BELOW_PEAK_DB = -40.0, -50.0, -20.0
FRAME_MS, EDGE_MARGIN_MS, MAX_GAP_MS, TIGHT_MARGIN_MS = 10, 40, 300, 50


def gain(db: float) -> float:
    return 10 ** (db / 20)


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def silence_threshold(level: Column) -> Column:
    """40 dB below the loudest level, but no lower than -50 dB or 20 dB below it, whichever is less."""
    return F.greatest(level * gain(SILENCE_DB), F.least(F.lit(gain(FLOOR_DB)), level * gain(BELOW_PEAK_DB)))


def frame_size(rate: Column) -> Column:
    return F.greatest(F.floor(rate * FRAME_MS / 1000).cast("int"), F.lit(1))


def frame_levels(samples: Column, rate: Column) -> Column:
    """Root mean square of each frame of 10 ms; zeros fill up the last one."""
    size = frame_size(rate)
    frames = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))

    def level(i: Column) -> Column:
        part = F.slice(samples, i * size + 1, size)
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / size)

    return F.transform(frames, level)


def trimmed(samples: Column, rate: Column, margin_ms: int = EDGE_MARGIN_MS) -> Column:
    """Without silence at both ends but for a margin; a silent signal keeps its first margin."""
    margin, size, levels = F.floor(rate * margin_ms / 1000).cast("int"), frame_size(rate), frame_levels(samples, rate)
    threshold = silence_threshold(F.array_max(levels))
    loud = F.filter(F.transform(levels, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())
    start = F.greatest(F.element_at(loud, 1) * size - margin, F.lit(0))
    stop = F.least((F.element_at(loud, -1) + 1) * size + margin, F.size(samples))
    return F.when(F.size(samples) == 0, samples).when(F.size(loud) == 0, F.slice(samples, F.lit(1), margin)).otherwise(F.slice(samples, start + 1, stop - start))


def capped_silence(samples: Column, rate: Column, threshold: Column, max_gap_ms: int = MAX_GAP_MS) -> Column:
    """Quiet runs after the first loud sample cut to a length."""
    most = F.floor(rate * max_gap_ms / 1000).cast("int")
    quiet = F.transform(samples, lambda x: F.abs(x) <= threshold)

    def step(seen: Column, x: Column) -> Column:
        run = F.when(~x["q"], 0).when(seen["run"] < 0, -1).otherwise(seen["run"] + 1)
        keep = (run <= most)
        return F.struct(run.alias("run"), F.concat(seen["keep"], F.array(keep)).alias("keep"))

    start = F.struct(F.lit(-1).alias("run"), F.array().cast("array<boolean>").alias("keep"))
    kept = F.aggregate(F.transform(quiet, lambda q: F.struct(q.alias("q"))), start, step, lambda s: s["keep"])
    return F.transform(F.filter(F.arrays_zip(samples.alias("x"), kept.alias("k")), lambda p: p["k"]), lambda p: p["x"])


def silence(rate: Column, ms: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.floor(rate * ms / 1000).cast("int"))


def joined(parts: Column, rate: Column, pause_ms: int) -> Column:
    """Signals one after the other with silence between them."""
    gap = silence(rate, F.lit(pause_ms))
    return F.flatten(F.transform(parts, lambda x, i: F.when(i > 0, F.concat(gap, x)).otherwise(x)))


def to_pcm16(samples: Column) -> Column:
    """Samples in -1..1 as 16-bit integers, cut toward zero; floats stay floats on the way."""
    return F.transform(samples, lambda x: (x * F.lit(32767).cast("float")).cast("int").cast("short"))


def from_pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / 32767.0).cast("float"))


def mono(channels: Column) -> Column:
    """The mean over channels, given as an array of equally long arrays."""
    n = F.size(channels)
    places = F.sequence(F.lit(1), F.size(channels[0]))
    return F.transform(places, lambda i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.element_at(c, i)) / n)
