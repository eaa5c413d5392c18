"""Tables of 64-bit hashes partitioned by hash, for passes over chunks of documents.

Documents are dealt into chunks of bounded size.  A pass asks, for the distinct
hashes of a chunk, what all chunks hold of them: each chunk sends a sorted run of
its hashes to every bucket (a range of hash values), a bucket brings the runs
together and answers each chunk in the order of its run.  That is the relational
plan (explode, count by key, join back) in columns: one row carries a whole run, a
hash costs some bytes on the way and an answer a part of one.  A key that every
document holds reaches a bucket once for each chunk, already counted.

The shuffle of documents into chunks is one exchange that all passes of a query
reuse; texts travel compressed.  Chunks and buckets grow in number with the
input, not in size, and a run without hashes is no row.  Beyond ``DIRECT`` chunks
runs take two steps: a chunk sends to ranges of buckets, a relay between some
chunks and one range of buckets bundles what they send each of these buckets into
a row, and answers go back the same way.  With n chunks that makes n**1.5 rows
a round rather than n**2, and no task holds more than a chunk's worth of hashes
several times over.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, text_buffer

CHUNK_BYTES = 6 << 20
PACK_BYTES = 16 << 20
#: Chunks up to this many send their runs straight to buckets.
DIRECT = 1024
RUN = "bucket int, sender int, round int, runs binary"
_NAMES = ["bucket", "sender", "round", "runs"]


def chunked(docs: DataFrame, chunk_bytes: int, *sums_: F.Column) -> tuple[DataFrame, int, list[int]]:
    """(chunk, packed) with all rows of ``docs``, the number of chunks, and the sums of further columns.

    The input partition of a row counts in its chunk, so rows that are equal
    are dealt apart too; a partition's rows are the same whenever it is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, *more = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), *map(F.sum, sums_)).first()
    chunks = max(1, -(-int(total or 0) // chunk_bytes))

    def pack(batches):
        for batch in batches_of(batches, PACK_BYTES):
            order = np.argsort(batch.column("chunk").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            chunk = batch.column("chunk").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]]).tolist()
            blobs = [packed_rows(batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array(blobs, pa.binary())], ["chunk", "packed"])

    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk")
    return rows.select(chunk, "doc_id", "text").mapInArrow(pack, "chunk int, packed binary"), chunks, [int(x or 0) for x in more]


def packed_rows(batch: pa.RecordBatch) -> bytes:
    """Ids and texts of some rows as compressed bytes."""
    data, bounds = text_buffer(batch.column("text"))
    ids = batch.column("doc_id")
    parts = [ids.fill_null(0).to_numpy().tobytes(), ids.is_null().cast(pa.uint8()).to_numpy().tobytes(), np.diff(bounds).tobytes(), data.tobytes()]
    return batch.num_rows.to_bytes(8, "little") + _compressor().compress(b"".join(parts))


def unpacked_rows(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of a chunk's documents, the bytes of their texts, and the bounds of each text."""
    ids, nulls, sizes, data = [], [], [], []
    for blob in table.column("packed"):
        blob = blob.as_py()
        n, raw = int.from_bytes(blob[:8], "little"), _decompressor().decompress(blob[8:])
        ids.append(np.frombuffer(raw, np.int64, n))
        nulls.append(np.frombuffer(raw, np.uint8, n, 8 * n))
        sizes.append(np.frombuffer(raw, np.int64, n, 9 * n))
        data.append(np.frombuffer(raw, np.uint8, -1, 17 * n))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.array(np.concatenate(ids), mask=np.concatenate(nulls) > 0), np.concatenate(data), bounds


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes of equal weight together, the zero ones left out, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize) if len(values) else np.zeros((0, 1), np.uint8)
    used = int(-(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([used]) + _compressor().compress(raw[:, :used].T.tobytes())


def unplaned(data: bytes, n: int, kind) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    used = data[0]
    out[:, :used] = np.frombuffer(_decompressor().decompress(data[1:]), np.uint8).reshape(used, n).T
    return out.view(kind)[:, 0]


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1, write_content_size=True)


@functools.lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def bundled(labels: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Runs as bytes: a label and a size for each, and their columns one run after the other."""
    parts = [planes(np.asarray(x)) for x in (labels.astype(np.uint32), sizes.astype(np.uint32), *columns)]
    head = len(labels).to_bytes(4, "little") + int(sizes.sum()).to_bytes(8, "little")
    return head + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundled(data: bytes, kinds: tuple) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    runs, n, at, out = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little"), 12, []
    for k, kind in enumerate((np.uint32, np.uint32, *kinds)):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unplaned(data[at + 8 : at + 8 + size], n if k > 1 else runs, kind))
        at += 8 + size
    return out[0].astype(np.int64), out[1].astype(np.int64), out[2:]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], _NAMES)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Differences modulo 2**64; ``np.cumsum`` takes them back."""
    return np.diff(keys, prepend=np.uint64(0))


class Deal:
    """Who sends to whom: ``chunks`` chunks, as many buckets, and ``side`` relays of each kind beyond ``direct`` chunks."""

    def __init__(self, chunks: int, direct: int = DIRECT):
        self.side = math.isqrt(chunks - 1) + 1 if chunks > direct else 0
        self.buckets = self.side**2 or chunks
        self.width = (1 << 64) // self.buckets + 1

    def sent(self, chunk: int, number: int, keys: np.ndarray, *columns: np.ndarray, whole: bool = True) -> pa.Table:
        """Rows of a chunk for one round: what it has for each bucket, dealt by sorted ``keys``, which travel too if ``whole``."""
        bucket = (keys // np.uint64(self.width)).astype(np.int64) if self.buckets > 1 else np.zeros(len(keys), np.int64)
        to = bucket // self.side if self.side else bucket
        cuts, rows = [*_heads(to).tolist(), len(keys)], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = _heads(bucket[a:b])
            labels = bucket[a:b][heads] % self.side if self.side else np.array([chunk])
            own = [gaps(keys[a:b])] if whole else []
            rows.append((int(to[a]), chunk, number, bundled(labels, np.diff([*heads, b - a]), own + [c[a:b] for c in columns])))
        return _table(rows)

    def relayed(self, requests: DataFrame, kinds: tuple, whole: bool = True) -> DataFrame:
        """The rows as buckets get them."""
        if not self.side:
            return requests

        def forward(key, table):
            relay, labels, senders, columns = key[0].as_py(), [], [], []
            for sender, data in sorted(zip(table.column("sender").to_pylist(), table.column("runs").to_pylist())):
                of, sizes, found = unbundled(data, kinds)
                labels.append(np.repeat(of, sizes))
                senders.append(np.full(len(labels[-1]), sender))
                columns.append([np.cumsum(found[0], dtype=np.uint64), *found[1:]] if whole else found)
            label, sender = np.concatenate(labels), np.concatenate(senders)
            order = np.argsort(label, kind="stable")
            label, sender, columns = label[order], sender[order], [np.concatenate(c)[order] for c in zip(*columns)]
            cuts, rows = [*_heads(label).tolist(), len(label)], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                heads, own = _heads(sender[a:b]), [c[a:b] for c in columns]
                own[0] = gaps(own[0]) if whole else own[0]
                rows.append((relay % self.side * self.side + int(label[a]), relay, number_of(table), bundled(sender[a:b][heads], np.diff([*heads, b - a]), own)))
            return _table(rows)

        return requests.withColumn("relay", (F.floor(F.col("sender") / self.side) * self.side + F.col("bucket")).cast("int")).groupBy("relay").applyInArrow(forward, RUN)

    def answered(self, requests: DataFrame, kinds: tuple, merge: Callable, answer_kind, whole: bool = True, beside: tuple | None = None) -> DataFrame:
        """Answers as rows for chunks: ``merge(*columns)`` over all runs of a bucket, in the order of chunks, cut by chunk again.

        ``requests`` come from ``relayed``.  ``beside`` has such rows of another
        round and their kinds; their columns, keys first, follow in ``merge``.
        """

        other_rows, other_kinds = beside or (None, ())
        del beside
        side = self.side

        def opened(table, kinds, whole):
            rows = sorted(zip(table.column("sender").to_pylist(), table.column("runs").to_pylist()))
            runs = [unbundled(data, kinds) for _, data in rows]
            columns = [[np.cumsum(c[0], dtype=np.uint64), *c[1:]] if whole else c for *_, c in runs]
            return [s for s, _ in rows], runs, [np.concatenate(c) for c in zip(*columns)] or [np.zeros(0, k) for k in kinds]

        def run(key, table, other=None):
            senders, runs, columns = opened(table, kinds, whole)
            if not senders:
                return _table([])
            found = merge(*columns, *(opened(other, other_kinds, True)[2] if other is not None else [])).astype(answer_kind)
            cuts = np.cumsum([0, *(int(sizes.sum()) for _, sizes, _ in runs)])
            return _table([(key[0].as_py(), sender, number_of(table), bundled(labels, sizes, [found[a:b]])) for sender, (labels, sizes, _), a, b in zip(senders, runs, cuts[:-1], cuts[1:])])

        def back(key, table):
            relay, labels, found = key[0].as_py(), [], []
            for _, data in sorted(zip(table.column("bucket").to_pylist(), table.column("runs").to_pylist())):
                of, sizes, (own,) = unbundled(data, (answer_kind,))
                labels.append(np.repeat(of, sizes))
                found.append(own)
            label, found = np.concatenate(labels), np.concatenate(found)
            order = np.argsort(label, kind="stable")
            label, found = label[order], found[order]
            cuts = [*_heads(label).tolist(), len(label)]
            return _table([(relay % side, int(label[a]), number_of(table), bundled(np.zeros(1, np.int64), np.array([b - a]), [found[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])])

        grouped = requests.groupBy("bucket")
        if other_rows is not None:
            found = grouped.cogroup(other_rows.groupBy("bucket")).applyInArrow(lambda key, table, other: run(key, table, other), RUN)
        else:
            found = grouped.applyInArrow(lambda key, table: run(key, table), RUN)
        return found.groupBy("sender").applyInArrow(back, RUN) if self.side else found


def number_of(table: pa.Table) -> int:
    return table.column("round")[0].as_py()


def answers_of(table: pa.Table, number: int, kind) -> np.ndarray:
    """A chunk's answers to one round, in the order of its keys."""
    rows = [(b, r) for b, k, r in zip(table.column("bucket").to_pylist(), table.column("round").to_pylist(), table.column("runs")) if k == number]
    parts = [unbundled(r.as_py(), (kind,))[2][0] for _, r in sorted(rows, key=lambda x: x[0])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def sums(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry the sum of the counts of its key."""
    order = np.argsort(keys, kind="stable")
    starts = _heads(keys[order])
    found = np.add.reduceat(counts[order].astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(found, np.diff(np.concatenate([starts, [len(keys)]])))
    return out


class Leading:
    """Sorted keys by as many leading bits as keep chance meetings of ``total`` keys rare, for a first round that sends few bytes."""

    def __init__(self, total: int, slots: int = 64):
        self.bits = min(64, max(8, (total * slots).bit_length()))
        self.shift = np.uint64(64 - self.bits)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading bits (in place, lower ones 0), and whether each is the first key that has them."""
        short = keys >> self.shift << self.shift
        return short, np.concatenate([[True], short[1:] != short[:-1]]) if len(short) else np.zeros(0, bool)

    def rest(self, keys: np.ndarray) -> np.ndarray:
        return keys & ((np.uint64(1) << self.shift) - np.uint64(1)) if self.shift else np.zeros(len(keys), np.uint64)
