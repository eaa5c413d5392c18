"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased.
A window of as many words as an item has gets a 64-bit SimHash of its shingles
of five words (an item of fewer words is one shingle), each weighted by how
often it occurs.  Item fingerprints are kept in a multi-index: their 64 bits in
four blocks of 16, each block under every value within four bits of its own.
Two fingerprints that differ in at most ``RADIUS`` = 19 bits agree in some block
up to four bits, so the index returns every item within the radius.  Candidates
are verified exactly: the weighted Jaccard similarity of the two multisets of
shingles must be 0.8 or more.

Documents are scanned once, however many items there are.  A window without any
shingle of any item has similarity 0 with all of them; a sieve of ``SIEVE`` bits
(the one thing sent to executors) tells which documents may hold one.  Items lie
in groups of bounded size, and those documents, in parts of bounded size, go to
the groups that they share a shingle with, by a join on shingles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import LOOSE_ENDS, LOOSE_FOLD, batches_of, documents, fresh, grams, mix64, stored, text_buffer, with_ids, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
#: Items and bytes of their texts in a group on average, and bytes of documents that a task compares with a group.
GROUP_ITEMS = 1000
GROUP_BYTES = 1 << 20
PART_BYTES = 1 << 20
SIEVE = 22
_NEAR = np.array(sorted({sum(1 << b for b in bits) for n in range(RADIUS // 4 + 1) for bits in itertools.combinations(range(16), n)}), np.int64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class ItemIndex:
    """Items with equal numbers of words: fingerprints, shingle weights and the multi-index."""

    def __init__(self, length: int, ids: list[int], words: list[np.ndarray]):
        self.length, self.ids = length, ids
        self.size = min(SHINGLE, length)
        self.shingles = [grams(w, self.size) for w in words]
        self.prints = np.concatenate([packed(bits_of(s).sum(0, keepdims=True)) for s in self.shingles])
        self.weights = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in self.shingles]
        self.blocks = []
        for block in range(4):
            own = ((self.prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            values = (own[:, None] ^ _NEAR).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << 16) + 1))
            self.blocks.append((starts.astype(np.int32), np.repeat(np.arange(len(own)), len(_NEAR))[order].astype(np.int32)))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) whose fingerprints differ in at most ``RADIUS`` bits."""
        pairs = []
        for block, (starts, items) in enumerate(self.blocks):
            value = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            count = starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(prints)), count)
            at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[value], count)
            pairs.append(window * len(self.ids) + items[at])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.ids), pair % len(self.ids)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        found, counts = np.unique(shingles, return_counts=True)
        weights = self.weights[item]
        shared = sum(min(c, weights.get(s, 0)) for s, c in zip(found.tolist(), counts.tolist()))
        return shared / (len(shingles) + len(self.shingles[item]) - shared)


def words_of(text: str) -> np.ndarray:
    return word_hashes(*text_buffer(pa.array([text], pa.string())), LOOSE_ENDS, LOOSE_FOLD)[0]


class Items:
    """The items of one group, by number of words; items without words are left out."""

    def __init__(self, rows: list[tuple[int, str]]):
        by: dict[int, list] = {}
        for item, text in rows:
            words = words_of(text)
            if len(words):
                by.setdefault(len(words), []).append((item, words))
        self.indexes = [ItemIndex(n, [r[0] for r in found], [r[1] for r in found]) for n, found in sorted(by.items())]
        self.known: dict[int, np.ndarray] = {}
        for size in {x.size for x in self.indexes}:
            self.known[size] = np.unique(np.concatenate([s for x in self.indexes if x.size == size for s in x.shingles]))

    def matches(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(item_id, first word of the best window, similarity) of one document, for each item that it has."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        shingles = {size: grams(words, size) for size in self.known}
        held = {size: np.flatnonzero(np.isin(shingles[size], known)) for size, known in self.known.items()}
        for number, index in enumerate(self.indexes):
            size, marks = index.size, held[index.size]
            if not len(marks) or len(words) < index.length * SIMILARITY - SHINGLE:
                continue
            span = min(index.length, len(words)) - size + 1
            own = shingles[size]
            marked = np.zeros(len(own) - span + 2, np.int32)
            np.add.at(marked, np.clip(marks - span + 1, 0, len(marked) - 1), 1)
            np.add.at(marked, np.minimum(marks + 1, len(marked) - 1), -1)
            starts = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
            for at in range(0, len(starts), 1 << 14):
                part = starts[at : at + (1 << 14)]
                low, high = int(part[0]), int(part[-1]) + span
                if high - low > 4 * len(part) * span:
                    sums = np.stack([bits_of(own[s : s + span]).sum(0) for s in part])
                else:
                    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits_of(own[low:high]), axis=0, dtype=np.int32)])
                    sums = total[part - low + span] - total[part - low]
                for window, item in zip(*index.candidates(packed(sums))):
                    start = int(part[window])
                    found = index.similarity(own[start : start + span], int(item))
                    if found >= SIMILARITY and (found, -start) > best.get((number, int(item)), (0.0, 0)):
                        best[number, int(item)] = (found, -start)
        return [(self.indexes[number].ids[item], -start, found) for (number, item), (found, start) in best.items()]


def grouped_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, item_group) of each different item; groups grow in number with the benchmark, not in size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-rows // GROUP_ITEMS), -(-int(size or 0) // GROUP_BYTES))
    return stored(items.withColumn("item_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")), "items")


def item_shingles(items: DataFrame) -> DataFrame:
    """(key, size, item_group) of the different shingles of each group."""

    def run(batches):
        for batch in batches_of(batches):
            for text, group in zip(batch.column("text").to_pylist(), batch.column("item_group").to_pylist()):
                if len(words := words_of(text)):
                    size = min(SHINGLE, len(words))
                    keys = np.unique(keyed(grams(words, size), size)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), size), pa.int32()), pa.array(np.full(len(keys), group), pa.int32())], ["key", "size", "item_group"])

    return stored(items.mapInArrow(run, "key long, size int, item_group int").distinct(), "item-shingles")


def keyed(shingles: np.ndarray, size: int) -> np.ndarray:
    return mix64(shingles + np.uint64(size))


def sieve_of(shingles: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of shingles, and whether some shingle has these leading bits: ``2**SIEVE`` marks whatever the benchmark."""
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())
    marks = np.zeros(1 << SIEVE, bool)
    marks[shingles.select(F.shiftrightunsigned("key", 64 - SIEVE).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    return sizes, np.packbits(marks)


def scanned(docs: DataFrame, sieve: tuple[list[int], np.ndarray], hits: bool, name: str = "hits") -> DataFrame:
    """The rows that may hold a shingle of an item, with the shingles that say so under ``name``; or all other rows."""
    sizes, bits = sieve
    columns = docs.columns

    def run(batches):
        marks = np.unpackbits(bits).astype(bool)
        for batch in batches_of(batches):
            data, bounds = text_buffer(batch.column("text"))
            hashes, _, _, words = word_hashes(data, bounds, LOOSE_ENDS, LOOSE_FOLD)
            keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for size in sizes:
                shingles = keyed(grams(hashes, size), size)
                at = np.flatnonzero(marks[(shingles >> np.uint64(64 - SIEVE)).astype(np.int64)])
                row = np.searchsorted(words, at, side="right") - 1
                inside = at + size <= words[row + 1]
                keys.append(shingles[at[inside]])
                rows.append(row[inside])
            key, row = np.concatenate(keys), np.concatenate(rows)
            held = np.zeros(batch.num_rows, bool)
            held[row] = True
            if not hits:
                yield batch.filter(pa.array(~held))
            elif held.any():
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
                key, row = key[new], row[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, [*np.flatnonzero(held), batch.num_rows]), pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(held)).columns, lists], [*columns, name])

    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(LongType()))]) if hits else docs.schema
    return docs.mapInArrow(run, schema)


def matched(found: DataFrame, names: list[str], shingles: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, first_word, similarity) from rows that may hold shingles; ``names`` are their columns "hits" and "row"."""
    hits, row = names
    of = shingles.select("key", "item_group").distinct()
    pairs = found.select(F.col(row).alias("row"), F.explode(hits).alias("key")).join(of, "key").select("row", "item_group").distinct()
    texts = found.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = stored(pairs.join(texts, "row"), "dealt")
    # Documents of a group in parts of bounded bytes; items go to each part of their group.
    sizes = stored(dealt.groupBy("item_group").agg(F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64) / PART_BYTES).alias("parts")), "parts")
    left = dealt.join(sizes, "item_group").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    right = items.join(sizes.select("item_group", F.col("parts").alias("of")), "item_group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))

    def run(key, docs, items):
        index = Items(list(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist())))
        out = []
        for batch in docs.to_batches():
            data, bounds = text_buffer(batch.column("text"))
            hashes, _, _, words = word_hashes(data, bounds, LOOSE_ENDS, LOOSE_FOLD)
            for i, (row, doc_id) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist())):
                out += [(row, doc_id, *m) for m in index.matches(hashes[words[i] : words[i + 1]])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 5, kinds)], ["row", "doc_id", "item_id", "first_word", "similarity"])

    key = ["item_group", "part"]
    left, right = left.select(*key, "row", "doc_id", "text"), right.select(*[F.col(k).alias(k) for k in key], "item_id", F.col("text").alias("text"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "row long, doc_id long, item_id long, first_word long, similarity double")


def candidates_in(docs: DataFrame, benchmark: DataFrame):
    """Rows of ``docs`` that may hold an item, their column names "hits" and "row", and what ``matched`` needs."""
    items = grouped_items(benchmark)
    shingles = item_shingles(items)
    sieve = sieve_of(shingles)
    names = fresh(docs, "_hits", "_row")
    found = stored(scanned(docs, sieve, True, names[0]).withColumn(names[1], F.monotonically_increasing_id()), "hits")
    return found, names, shingles, items, sieve


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of each item in each document that has it.

    Of equally similar windows the first counts.  A document with fewer words
    than an item counts as one window.  Null, empty and wordless texts match
    nothing, a text of any length is searched whole, and an empty table on
    either side gives no rows.  Repeated documents give rows of their own, as do
    items that share an item_id, null or not, but not their text; items that
    repeat in both are one.  Other columns, whatever their names, are ignored.
    """
    found, names, shingles, items, _ = candidates_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return matched(found, names, shingles, items).drop("row")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns kept; null and empty texts stay."""
    found, names, shingles, items, sieve = candidates_in(docs, benchmark)
    bad = stored(matched(found, names, shingles, items).select(F.col("row").alias("_id")).distinct(), "leaks")
    clean = with_ids(found, names[1], bad, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return scanned(docs, sieve, False).unionAll(clean)


def op2(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
