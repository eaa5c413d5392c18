"""Seeds, keys and fingerprints that tell whether earlier work can be used again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_seed(base: Column, text: Column, attempt: Column) -> Column:
    """A seed below 2**31 from a base seed, the text's checksum and the attempt."""
    total = base.cast("long") + F.crc32(text.cast("binary")) + attempt.cast("long") * F.lit(2654435761)
    return F.pmod(total, F.lit(1 << 31))


def chunk_key(fingerprint: Column, speed: Column, text: Column) -> Column:
    """SHA-1 of run fingerprint, speed (``None`` if there is none) and text, with NUL between."""
    parts = F.concat_ws("\0", fingerprint, F.coalesce(speed.cast("double").cast("string"), F.lit("None")), text)
    return F.sha1(parts.cast("binary"))


def run_fingerprint(*settings: Column) -> Column:
    """SHA-1 of the settings that decide what a run makes, as a JSON array."""
    return F.sha1(F.to_json(F.array(*[s.cast("string") for s in settings]), {"ignoreNullFields": "false"}).cast("binary"))


def file_fingerprint(content: Column) -> Column:
    return F.concat(F.octet_length(content).cast("string"), F.lit("-"), F.sha1(content))


def needs_regeneration(exists: Column, stored: Column, current: Column) -> Column:
    return ~exists | ~F.trim(stored).eqNullSafe(current)


def requested_narrator(voice_sha1: Column, model: Column, language: Column, seed: Column, instruct: Column) -> Column:
    """Where a narrator's voice comes from: a sample, a designed voice, or null if the model has neither."""
    base = F.split(F.lower(language), "[-_]")[0]
    designed = F.concat(F.lit("designed:"), seed, F.lit(":"), F.sha1(F.concat(instruct, language).cast("binary")))
    return F.when(voice_sha1.isNotNull() & (voice_sha1 != ""), F.concat(F.lit("sample:"), voice_sha1)).when((model == "omni") & base.isin("en", "ru"), designed)


def narrator_plan(source: Column, reference_exists: Column, redesign: Column, stored: Column) -> Column:
    return (
        F.when(source.isNull(), "none")
        .when(reference_exists & ~redesign & stored.eqNullSafe(source), "reuse")
        .when(source.startswith("designed:"), "design")
        .otherwise("clone")
    )
