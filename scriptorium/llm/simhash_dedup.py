"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded
with zeros to a 23-bit word of the perfect binary Golay code.  Decoding maps
every 23-bit word to the one codeword within three bits, so a segment has a
codeword index; flipping each of its bits and decoding again gives at most six
indices, and two segments that differ in one bit share the index of one and
one of the indices of the other.

Four differing bits over three segments leave, by pigeonhole, either a segment
without an error, or two segments with at most one error each.  The keys are
therefore the three whole segments (a codeword index with its error pattern is
the segment itself) and, for each two segments, every pair of their indices.
Fingerprints that share a key are compared exactly.

Scale: equal fingerprints are one row before keys are made.  A bucket of a key
emits links that span it, never all its pairs.  A bucket beyond ``BUCKET``
members is dealt again as pairs of blocks, so that none has to fit one task.
Fingerprints of very many rows get their component by broadcast.
"""

from __future__ import annotations

import functools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, hot_joined, stored, text_bytes
from .components import connected_components

RADIUS = 4
BUCKET = 20_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


@functools.lru_cache(maxsize=1)
def golay_indices() -> np.ndarray:
    """The codeword index of each 23-bit word."""
    messages = np.arange(4096, dtype=np.int64)
    rest = messages << 11
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    codewords = (messages << 11) | rest
    table = np.full(1 << 23, -1, np.int16)
    one = [1 << i for i in range(23)]
    errors = {0} | {a | b | c for a in one for b in one for c in one}
    for error in errors:
        table[codewords ^ error] = messages
    return table


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if over half of the 64-bit hashes set it; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return simhash(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches_of(batches):
            found = [fingerprint(t, shingle) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_indices(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of each segment, and up to six indices within one flipped bit (-1 fills up)."""
    table = golay_indices()
    own = table[values].astype(np.int64)
    near = np.sort(np.stack([own] + [table[values ^ (1 << i)] for i in range(width)], axis=1).astype(np.int64), axis=1)
    again = np.zeros(near.shape, bool)
    again[:, 1:] = near[:, 1:] == near[:, :-1]
    near[again] = 1 << 40
    near = np.sort(near, axis=1)[:, :6]
    near[near == 1 << 40] = -1
    return own, near


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position of the fingerprint, own): own marks the key of the segments as they are."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows = np.arange(len(fps))
    out = [((k << 56) | part, rows, np.ones(len(fps), bool)) for k, part in enumerate(parts)]
    coded = [segment_indices(part, width) for part, (_, width) in zip(parts, SEGMENTS)]
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        near = (coded[a][1][:, :, None] << 12) | coded[b][1][:, None, :]
        used = (coded[a][1][:, :, None] >= 0) & (coded[b][1][:, None, :] >= 0)
        own = (coded[a][0] << 12) | coded[b][0]
        at = np.nonzero(used)
        out.append((((3 + k) << 56) | near[at], at[0], near[at] == own[at[0]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _keys(batches):
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(values), 5000):
            fps = values[at : at + 5000]
            key, row, own = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(own)], ["key", "fp", "own"])


def spanning_links(fps: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links between own ones and any others."""
    label, links = np.arange(len(fps)), []
    for i in np.flatnonzero(own):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius)
        for other in near[label[near] != label[i]]:
            if label[other] != label[i]:
                links.append((int(fps[i]), int(fps[other])))
                label[label == label[other]] = label[i]
    return links


def _linker(radius: int, bucket: int):
    """Over rows sorted by key: links (a, b, 0) and, for buckets that are too large, (key, members, 1)."""

    def bucket_links(key, fps, own, out):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        for size in range(2, 9):
            at = starts[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    x, y = fps[at + i], fps[at + j]
                    ok = (own[at + i] | own[at + j]) & (np.bitwise_count(x ^ y) <= radius)
                    out.append((x[ok].view(np.int64), y[ok].view(np.int64), np.zeros(ok.sum(), np.int8)))
        for at, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            if size > bucket:
                out.append((key[at : at + 1], np.array([size]), np.ones(1, np.int8)))
            elif links := spanning_links(fps[at : at + size], own[at : at + size], radius):
                a, b = np.array(links, np.uint64).T
                out.append((a.view(np.int64), b.view(np.int64), np.zeros(len(a), np.int8)))

    def run(batches):
        held, size, large = [], 0, None
        for batch in batches:
            key, fps, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = fps.view(np.uint64)
            if large is not None:  # the rest of a bucket that is too large already
                to = int(np.searchsorted(key, large[0], side="right"))
                large[1] += to
                key, fps, own = key[to:], fps[to:], own[to:]
                if not len(key):
                    continue
                yield _links([(np.array([large[0]]), np.array([large[1]]), np.ones(1, np.int8))])
                large = None
            held.append((key, fps, own))
            size += len(key)
            if size and key[-1] != held[0][0][0]:
                key, fps, own = (np.concatenate(x) for x in zip(*held))
                last = int(np.searchsorted(key, key[-1]))
                out = []
                bucket_links(key[:last], fps[:last], own[:last], out)
                held, size = [(key[last:], fps[last:], own[last:])], len(key) - last
                if out:
                    yield _links(out)
            if size > bucket:
                large, held, size = [held[0][0][0], size], [], 0
        if large is not None:
            yield _links([(np.array([large[0]]), np.array([large[1]]), np.ones(1, np.int8))])
        if size:
            out = []
            bucket_links(*(np.concatenate(x) for x in zip(*held)), out)
            if out:
                yield _links(out)

    return run


def _links(out):
    a, b, kind = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(kind)], ["a", "b", "kind"])


def fingerprint_links(distinct_fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect what all pairs within ``radius`` bits connect."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys hold for at most {RADIUS} differing bits")
    keys = distinct_fps.select("fp").mapInArrow(_keys, "key long, fp long, own boolean")
    linker = _linker(radius, bucket)
    first = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(linker, "a long, b long, kind byte"), "fp-links")
    links, large = first.where("kind = 0").select("a", "b"), first.where("kind = 1")
    if not large.isEmpty():
        blocks = large.select(F.col("a").alias("key"), F.ceil(F.col("b") / (bucket // 4)).alias("blocks"))
        rows = keys.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp", "own")
        more = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(radius, 1 << 62), "a long, b long, kind byte")
        links = links.unionAll(stored(more, "fp-links").select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the least doc_id that links reach.  A null, empty or blank
    text has fingerprint 0, which is linked like any other; a text of any length
    counts whole.  Repeated rows and equal texts share a component.  A null
    doc_id is never the component's unless all its ids are null.  Other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle), "fps")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fp-reps")
    links = stored(connected_components(fingerprint_links(reps, radius, bucket)).select(F.col("node").alias("fp"), "root"), "roots")
    linked = links.join(reps, "fp")
    roots = linked.groupBy("root").agg(F.min("rep").alias("least"))
    joined = linked.join(roots, "root").select("fp", "least")
    of = stored(reps.join(joined, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"), "components")
    return hot_joined(fps, of, "fp", fps.count()).select("doc_id", "fp", "component_id")


def op8(spark, sf_dir):
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
