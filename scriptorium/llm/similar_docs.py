"""One document of each group of similar ones: SimHash by Golay-code fuzzy hashing, then exact set similarity.

Two texts are similar if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.  Each text has the SimHash fingerprint of its set;
texts whose fingerprints the Golay keys of ``simhash_dedup`` link are compared
exactly, and those that are similar make the first groups.

Fingerprints of similar texts often differ in more bits than the code corrects,
so an exact completion follows over texts that are still in separate groups.
Similar sets share at least 80 % of either, so in any
one order of all shingles the first 20 % of both, and one more, have a shingle
in common (the prefix filter); these are a text's keys, and no similar pair is
without a common one.  Shingles that are common in a sample come last in the
order, which decides how many pairs are compared but not which are found.
Pairs that share a key are dropped by sizes and by parity sketches, whose
differing bits never exceed the differing shingles; the rest are compared
exactly.  Groups are what similar pairs connect.

Rows are told apart by doc_id and text, so different texts under one doc_id, or
under none, are different documents.  Equal texts are one node of the graph.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, fresh, hot_joined, release_memory, stored, text_bytes, with_ids
from .components import connected_components
from .simhash_dedup import fingerprint_links, simhash

SHINGLE = 5
SIMILARITY = 0.8
#: Documents looked at for common shingles, and how many of these are sent to executors at most.
SAMPLE = 5000
COMMON = 100_000
#: Bits of the least sketch, and of that which texts of more than ``LONG`` shingles have beside it.
SKETCH, WIDE = 512, 8192
LONG = 500
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 50_000
#: Texts of a key that are compared with each other in one task.
BLOCK = 4000


def runs(text: bytes, size: int) -> set[bytes]:
    """Distinct runs of words, A-Z in lower case; all words as one if there are fewer, none without words."""
    words = text.lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    parts = runs(text, SHINGLE)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))


def keys_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order, ``common`` (sorted) coming last; 0 for no shingles."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    last = np.append(common, np.uint64(0))[np.searchsorted(common, hashes)] == hashes
    size = len(hashes) - math.ceil(SIMILARITY * len(hashes) - 1e-6) + 1
    return np.concatenate([hashes[~last], hashes[last]])[:size]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes fall on each bit; at least two bits for each hash."""
    width = max(WIDE if len(hashes) > LONG else SKETCH, 1 << (2 * len(hashes)).bit_length())
    ones = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((ones & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch of ``size`` bytes of the same hashes."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0).tobytes()


def may_be_similar(x: bytes, y: bytes, most: float) -> bool:
    """False only for sketches of sets with more than ``most`` elements in just one of them."""
    size = min(len(x), len(y))
    return (int.from_bytes(folded(x, size)) ^ int.from_bytes(folded(y, size))).bit_count() <= most


def similarity(a: bytes, b: bytes) -> float:
    x, y = runs(a, SHINGLE), runs(b, SHINGLE)
    return len(x & y) / len(x | y) if x or y else 1.0


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that most often occur in a sample of about ``SAMPLE`` documents."""

    def run(batches):
        for batch in batches_of(batches):
            for text in text_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text).view(np.int64))], ["key"])

    share = math.ceil(min(1, SAMPLE / max(docs.count(), 1)) * (1 << 30))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("text")
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().where("count >= 3")
    found = [r.key for r in counts.orderBy(F.desc("count"), "key").limit(COMMON).select("key").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def classes_of(docs: DataFrame) -> DataFrame:
    """(node, first, size, keys, sketch, fp) of each different text: its number, its first row (``no_id, doc_id, h``: by least doc_id, none last), its shingles and their fingerprint."""
    common = common_shingles(docs)

    def run(batches):
        for batch in batches_of(batches):
            given = text_bytes(batch.column("text"))
            hashes = list(map(shingle_hashes, given))
            contents = pa.array([xxhash.xxh3_128_digest(t) for t in given], pa.binary())
            keys = pa.array([keys_of(h, common).view(np.int64) for h in hashes], pa.list_(pa.int64()))
            sketches = pa.array(list(map(sketch_of, hashes)), pa.binary())
            prints = pa.array(np.array(list(map(simhash, hashes)), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), contents, pa.array(list(map(len, hashes)), pa.int32()), keys, sketches, prints], ["doc_id", "h", "content", "size", "keys", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, content binary, size int, keys array<long>, sketch binary, fp long")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    least = rows.groupBy("content").agg(F.min(row).alias("first"), F.min_by(F.struct("size", "keys", "sketch", "fp"), row).alias("of"))
    return stored(least.select(F.monotonically_increasing_id().alias("node"), "first", "of.*"), "classes")


def fuzzy_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints Golay-code fuzzy hashing links, and of each text with the least one of its fingerprint."""
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    equal = hot_joined(classes.select("node", "fp"), prints, "fp", classes.count()).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    # Several buckets find the same link; each is taken once before it is joined to anything.
    near = fingerprint_links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    for own in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(own), F.col("least").alias(f"_{own}")), own)
    return equal.unionAll(near.select(F.least("_a", "_b"), F.greatest("_a", "_b")))


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, prev, node, size, first) of each key that several texts have: the key before it in the text (its own mark for none), and the least of these texts with its size."""
    key = Window.partitionBy("key")
    none = F.xxhash64("node", F.lit("none"))
    before = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get("keys", i - 1), none).alias("prev")))
    rows = classes.select("node", "size", F.inline(before))
    rows = rows.withColumn("first", F.min(F.struct("node", "size")).over(key)).withColumn("last", F.max("node").over(key))
    return stored(rows.where("first.node < last").drop("last"), "keys")


def of_like_size(x: str, y: str) -> F.Column:
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-6


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sketches leave."""

    def run(batches):
        for batch in batches_of(batches, column="x"):
            most = batch.column("most").to_pylist()
            good = list(map(may_be_similar, batch.column("x").to_pylist(), batch.column("y").to_pylist(), most))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    for own, of, size in (("a", "x", "m"), ("b", "y", "n")):
        pairs = pairs.join(classes.select(F.col("node").alias(own), F.col("sketch").alias(of), F.col("size").alias(size)), own)
    most = (F.col("m") + F.col("n")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return pairs.where(of_like_size("m", "n")).select("a", "b", "x", "y", most.alias("most")).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar; only texts of paired documents are moved."""

    def run(batches):
        for batch in batches_of(batches, column="x"):
            x, y = text_bytes(batch.column("x")), text_bytes(batch.column("y"))
            good = pa.array([similarity(s, t) >= SIMILARITY for s, t in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first"), "node")
    texts = of_rows(docs.select("doc_id", "text"), stored(involved, "paired"), "_node").select(F.col("_node").alias("id"), "text").dropDuplicates(["id"])
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def of_rows(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` that ``wanted(node, first)`` names, with the node as ``name``; equal rows all of them."""
    wanted = wanted.select(F.col("first.h").alias("_id"), F.col("first.doc_id").alias("_doc"), F.col("node").alias(name))
    (h,) = fresh(docs, "_h")
    found = with_ids(docs.withColumn(h, F.xxhash64("text")), h, wanted, "inner").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def similar_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``."""
    return stored(verified(stored(sketched(pairs.distinct(), classes), "candidates"), classes, docs), "similar")


def spanning_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least text of a key with the key's others, of texts that ``roots(node, root)`` leaves in separate groups."""
    pairs = shared.where("node <> first.node").where(of_like_size("size", "first.size")).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    for own in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(own), F.col("root").alias(f"_{own}")), own, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def separate_pairs(shared: DataFrame, roots: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that share a key and may be similar, of texts that ``roots(node, root)`` leaves in separate groups.

    A pair is left out where both texts have the same key before, as it is found
    there, or yet before: once for each run of keys in common rather than for
    each key.  A key of more than ``block`` texts is dealt as pairs of blocks, so
    that none has to fit one task.
    """

    def small(batches):
        for batch in batches:
            sketches, sizes = batch.column("sketch").to_pylist(), batch.column("size").to_pylist()
            least = [folded(x, SKETCH // 8) for x in sketches]
            wide = [folded(x, WIDE // 8) if n > LONG else b"" for x, n in zip(sketches, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(least, pa.binary()), pa.array(wide, pa.binary())], ["node", "sketch", "wide"])

    def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def near(key, block, whole, rep, group, size, prev, sketch, wide):
        """Of rows sorted by key."""
        out, held = [], 0
        has = np.array([len(w) > 0 for w in wide])
        place = np.cumsum(has) - 1
        bits = np.frombuffer(b"".join(wide), np.uint64).reshape(-1, WIDE // 64)
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for at, to in zip(bounds[:-1], bounds[1:]):
            for i in range(at, to - 1):
                j = np.arange(i + 1, to)
                j = j[(group[j] != group[i]) & (prev[j] != prev[i]) & ((block[j] != block[i]) | whole[i])]
                j = j[np.minimum(size[j], size[i]) >= SIMILARITY * np.maximum(size[j], size[i]) - 1e-6]
                most = (size[j] + size[i]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
                fits = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64) <= most
                if has[i]:
                    # The sketches of long texts are full of ones; wide ones tell them apart.
                    long = np.flatnonzero(fits & has[j])
                    fits[long] = np.bitwise_count(bits[place[j[long]]] ^ bits[place[i]]).sum(1, dtype=np.int64) <= most[long]
                j = j[fits]
                if len(j):
                    out.append(np.stack([np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])], 1))
                    held += len(j)
                if held > HELD_PAIRS:
                    yield pairs_of(out)
                    out, held = [], 0
        if out:
            yield pairs_of(out)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            rows.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            rows.append(np.array(batch.column("wide").to_pylist(), object))
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            to = int(np.searchsorted(held[0], held[0][-1]))
            if to:
                yield from near(*(x[:to] for x in held))
                held = [x[to:] for x in held]
        if held is not None:
            yield from near(*held)
        release_memory()

    key = Window.partitionBy("key")
    rows = shared.join(roots, "node", "left").select("key", "prev", "node", F.coalesce("root", "node").alias("group"), "size")
    rows = rows.withColumn("least", F.min("group").over(key)).withColumn("most", F.max("group").over(key)).withColumn("blocks", F.ceil(F.count("*").over(key) / block))
    rows = rows.where("least < most").join(classes.select("node", "size", "sketch").mapInArrow(small, "node long, sketch binary, wide binary"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("key"))
    rows = rows.select(dealt.alias("key"), "block", (F.col("block") == F.col("other")).alias("whole"), "node", "group", "size", "prev", "sketch", "wide")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the groups that ``links(a, b)`` make of those of ``roots``."""
    if links.isEmpty():
        return roots
    return stored(connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(links)), "roots")


def representatives(docs: DataFrame) -> DataFrame:
    """(node, first) of one text of each group of similar documents, the one of the least first row."""
    classes = classes_of(docs)
    roots = stored(connected_components(similar_pairs(fuzzy_pairs(classes), classes, docs)), "roots")
    shared = shared_keys(classes)
    roots = joined(roots, similar_pairs(spanning_pairs(shared, roots), classes, docs))
    # Pairs of a key that its least text does not join are compared too, but for those joined already.
    roots = joined(roots, similar_pairs(separate_pairs(shared, roots, classes), classes, docs))
    groups = classes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
    return groups.agg(F.min(F.struct("first", "node")).alias("of")).select("of.node", "of.first")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar documents, all its columns kept.

    The row of the least doc_id stays (none counts as the greatest; of different
    texts under it, that of the least hash).  Rows that share a doc_id but not
    their text are documents of their own; equal rows are one.  Null and empty
    texts, and others without words, are similar to each other.  A text of any
    length is compared whole.  An empty table gives no rows.
    """
    (name,) = fresh(docs, "_node")
    kept = of_rows(docs, stored(representatives(docs), "kept"), name)
    return kept.dropDuplicates([name]).drop(name)
