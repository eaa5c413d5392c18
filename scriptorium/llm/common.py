"""Shared helpers: tables in the shared folder, fresh names, word arrays."""

from __future__ import annotations

import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set, a temporary one of the machine serves a local session;
    on a cluster executors would each write to their own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Every executor reads the same files, so a lost executor costs only its own
    running tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (made := _MADE.get()) is not None:
        made.append(path)
    return out


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of ``make``; tables that it has stored on the way are removed."""
    before = _MADE.set([])
    try:
        out = stored(make(), name)
        for path in _MADE.get():
            if path != out._stored_at:
                _remove(out.sparkSession, path)
    finally:
        _MADE.reset(before)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` made and nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        _remove(df.sparkSession, path)


#: Ids up to this many (some 30 MB with what goes with them) are sent to every executor; more are joined by shuffling.
BROADCAST_IDS = 250_000


def with_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """``df`` joined to ``ids(_id)`` on a column of longs, by broadcast only if the ids are few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(f"`{column}`").cast("long") == F.col("_id"), how)


#: Rows from which on a key counts as hot.
HOT_ROWS = 1000


def hot_joined(rows: DataFrame, of: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``of(key, n, ...)``, which has one row for each key of at most ``total`` rows, n being how many.

    Keys of more than ``HOT_ROWS`` rows, and more than their ``BROADCAST_IDS``-th
    part, are broadcast: there are fewer than ``BROADCAST_IDS`` of them whatever
    the data.  All others are joined by shuffling.
    """
    least = max(HOT_ROWS, total // BROADCAST_IDS + 1)
    hot = of.where(F.col("n") > least)
    common = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(of.where(F.col("n") <= least), key)
    return common.unionByName(rest).drop("n")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever case its own are in."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes, and the bounds of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For loose words: every ASCII byte that is no letter or digit ends a word, and A-Z count as a-z.
LOOSE_ENDS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOOSE_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 5


def _spread(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@functools.lru_cache(maxsize=4)
def byte_values(seed: int = 1, fold: bytes | None = None) -> np.ndarray:
    """A scattered 64-bit value for each byte, the same for bytes that ``fold`` makes equal."""
    return _spread(256, seed)[np.frombuffer(fold, np.uint8) if fold else np.arange(256)]


@functools.lru_cache(maxsize=2)
def powers(n: int = 2 * _PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64, and of its inverse."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return up, down


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, ends: np.ndarray = SPACES, fold: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: 64-bit hash, first byte, byte after the last; and the bounds of each text's words.

    The hash is polynomial over scattered byte values, for words of any length;
    a text's bounds always end a word.
    """
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~ends[data]
    turn = np.diff(inside)
    cut = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]) if len(cut) else cut
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if len(cut):
        first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
    values = byte_values(1, fold.tobytes() if fold is not None else None)
    up, down = powers()
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        origin = int(first[at])
        to = max(int(np.searchsorted(last, origin + _PIECE, side="right")), at + 1)
        length = int(last[to - 1]) - origin
        if length > len(up):
            word = data[origin : int(last[at])]
            out[at] = np.uint64(xxhash.xxh64_intdigest((fold[word] if fold is not None else word).tobytes(), 7))
            to = at + 1
        else:
            sums = np.zeros(length + 1, np.uint64)
            np.cumsum(values[data[origin : origin + length]] * up[:length], out=sums[1:])
            a, b = first[at:to] - origin, last[at:to] - origin
            out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mix64(out), first, last, np.searchsorted(first, bounds)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, by where it starts."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


def within(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """For runs of ``n`` items by where they start, whether one text holds the whole run."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cross = bounds[1:-1] - k
        ok[cross[(cross >= 0) & (cross < len(ok))]] = False
    return ok


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.concatenate([at, [len(values)]]))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's way to hand free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def release_memory() -> None:
    """Hand what this worker has freed back to the machine: workers outlive their tasks and serve other stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def batches_of(rows, most_bytes: int = 4 << 20, column: str = "text"):
    """Cut record batches so that each piece has few bytes of text, or one row; free memory goes back at the end."""
    for batch in rows:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size + 64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def doc_key(column: str = "doc_id") -> F.Column:
    return F.col(column).cast("long")
