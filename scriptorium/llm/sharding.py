"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

A record hashes into one of ``SLOTS`` virtual slots, for good.  Bytes are
summed per slot, and a map gives each slot a shard.  The map is a small table
with a version (a row for each slot, whatever the data's size); rebalancing
writes a new version that moves few slots.  A table starts with slots dealt out
evenly, before anything is known of the data (version 1); the bytes of the slots
then edit it (version 2), so the law that holds is ``bytes``: shards above the
mean give slots to the lightest.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

SLOTS = 8192


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): UTF-8 bytes of the text plus 1; a null text has none.

    The slot comes from doc_id, size and checksum, so a doc_id shared by many
    records does not put them all into one slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> dict[int, int]:
    """Bytes of each used slot: at most ``SLOTS`` numbers."""
    return {r[0]: int(r[1]) for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots to shards in equal runs."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return {slot: slot * shards // slots for slot in range(slots)}


def rebalanced(old: dict[int, int], totals: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for new totals or more shards: slots leave only shards above the mean.

    Each heavy shard gives slots, largest first, as long as it stays at the mean
    or above; they go to the lightest shards, and no other slot moves.
    """
    out = {slot: shard if shard < shards else None for slot, shard in old.items()}
    load = [0] * shards
    for slot, shard in out.items():
        if shard is not None:
            load[shard] += totals.get(slot, 0)
    mean = sum(totals.values()) / shards
    homeless = [s for s, shard in out.items() if shard is None]
    spare = []
    for shard in range(shards):
        for slot in sorted((s for s, x in out.items() if x == shard), key=lambda s: (-totals.get(s, 0), s)):
            if load[shard] - totals.get(slot, 0) >= mean:
                load[shard] -= totals.get(slot, 0)
                spare.append(slot)
    heap = [(size, shard) for shard, size in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(homeless + spare, key=lambda s: (-totals.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + totals.get(slot, 0), shard))
    return out


def map_table(spark, mapping: dict[int, int], version: int, totals: dict[int, int] | None = None) -> DataFrame:
    """The map as a table (version, virtual_slot, shard, bytes)."""
    rows = [(version, slot, shard, (totals or {}).get(slot, 0)) for slot, shard in sorted(mapping.items())]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long")


def edited_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The stored map of ``rows(virtual_slot, size)``: the even one, and its edition by the bytes of the slots."""
    spark, totals, first = rows.sparkSession, slot_totals(rows), even_map(shards, slots)
    versions = map_table(spark, first, 1).unionAll(map_table(spark, rebalanced(first, totals, shards), 2, totals))
    return stored(versions.coalesce(1), "slot-map")


def latest(table: DataFrame) -> dict[int, tuple[int, int]]:
    """(shard, version) of each slot in the map's newest version: a row for each slot."""
    rows = table.groupBy("virtual_slot").agg(F.max(F.struct("version", "shard")).alias("x")).select("virtual_slot", "x.shard", "x.version").collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its shard and its place there.

    ``slot`` counts the rows of a shard from 0 without gaps: virtual slots in
    order, and within one by doc_id, size and checksum (ties in any order: they
    are equal rows).  Places come from the rows of each virtual slot, so no task
    holds more than one virtual slot.  Null and empty texts have size 1.
    Repeated rows get places of their own, in one virtual slot.  A text of any
    length is one row.  Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    spark, rows = docs.sparkSession, sized(docs, slots)
    mapping = latest(edited_map(rows, shards, slots))
    found = {r[0]: r[1] for r in rows.groupBy("virtual_slot").count().collect()}
    filled, starts = [0] * shards, []
    for slot, (shard, version) in sorted(mapping.items()):
        starts.append((slot, shard, filled[shard], version))
        filled[shard] += found.get(slot, 0)
    places = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, shard int, first long, map_version int"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("place", place).join(places, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op6(spark, sf_dir):
    return assign(documents(spark, sf_dir))
