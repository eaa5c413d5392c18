"""Removal of repeated byte strings by difference-cover sampling.

A string of ``SPAN`` bytes counts as repeated if it starts at two places.  The
suffixes that are sorted are those at a difference cover: places of a text whose
remainder modulo v is in a set D such that any two places i and j have some
d < v with i + d and j + d both sampled.  D is a Singer difference set over
GF(q), v = q*q + q + 1 with q + 1 members (q = 17: v = 307, 18 members), the
sparsest there is, rather than {1, 2} modulo 3.

1. Sampled suffixes are named by their first ``SPAN - v + 1`` bytes and the
   names are brought together (sorted within hash ranges).  Two equal strings
   of SPAN bytes hold two sampled suffixes at one distance d with equal names.
2. Names that occur twice are looked at further: the name of v - 1 bytes before
   to SPAN bytes after a sampled suffix.  Where that recurs, every string that
   the suffix stands for recurs.
3. Where names agree and the longer ones don't, the remaining suffixes (d = 0 to
   v - 1 before the sampled one) are named by all their SPAN bytes and compared.

Names are 64-bit hashes of the bytes, equal for equal bytes, rather than ranks
in lexicographic order; equality is all that comparing adjacent prefixes of SPAN
bytes needs, and it makes recursion on names a lookup of a longer name.
Everything is judged on the input.  Names travel as described in ``exchange``,
first by as many leading bits as keep chance meetings rare.

Beside bytes, words: a passage of ``PASSAGE`` words that several documents share
may have fewer than SPAN bytes.  Word places at a cover (q = 3: 4 of 13) are
named by the ``PASSAGE - v + 1`` words from there on, and a name that another
document has too marks its words; every shared passage holds such a name.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_values, distinct, documents, grams, mix64, owner, powers, within, word_hashes
from .exchange import CHUNK_BYTES, DIRECT, RUN, Deal, Leading, answers_of, chunked, sums, unpacked_rows

SPAN = 400
FIELD = 17
PASSAGE = 50
PASSAGE_FIELD = 3
_PIECE = 1 << 17


@functools.lru_cache(maxsize=4)
def difference_cover(q: int) -> tuple[np.ndarray, int]:
    """A Singer difference set for a prime q, and its modulus: powers of a generator of GF(q^3) in a plane."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, powers_of = (1, 0, 0), []
                for i in range(q**3 - 1):
                    powers_of.append(x)
                    x = ((c * x[2]) % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                    if x == (1, 0, 0):
                        break
                if len(powers_of) == q**3 - 1:
                    return np.array(sorted(i for i in range(v) if powers_of[i][2] == 0)), v
    raise ValueError(f"{q} is no prime")


def range_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``data[first:last]`` for sorted ``first`` and short ranges."""
    up, down = powers()
    values, out, at = byte_values(3), np.empty(len(first), np.uint64), 0
    while at < len(first):
        origin = int(first[at])
        to = int(np.searchsorted(first, origin + _PIECE))
        a, b = first[at:to] - origin, last[at:to] - origin
        sums_ = np.zeros(int(b.max()) + 1, np.uint64)
        np.cumsum(values[data[origin : origin + len(sums_) - 1]] * up[: len(sums_) - 1], out=sums_[1:])
        out[at:to] = (sums_[b] - sums_[a]) * down[a]
        at = to
    return mix64(out + (last - first).astype(np.uint64))


class Chunk:
    """The texts of a chunk and what the rounds know of them."""

    def __init__(self, table: pa.Table, span: int, q: int):
        cover, v = difference_cover(q)
        if not v < span:
            raise ValueError("the difference cover needs a smaller modulus than the span")
        self.ids, self.data, self.bounds = unpacked_rows(table)
        self.span, self.v, name = span, v, span - v + 1
        most = int(np.diff(self.bounds).max(initial=0))
        pattern = (np.arange(0, most + 1, v)[:, None] + cover).ravel()
        sizes = np.diff(self.bounds)
        takes = np.where(sizes >= span, np.searchsorted(pattern, sizes - name, side="right"), 0)
        text = np.repeat(np.arange(len(sizes)), takes)
        self.places = pattern[np.arange(len(text)) - np.repeat(np.cumsum(takes) - takes, takes)] + self.bounds[text] if len(text) else np.zeros(0, np.int64)
        self.low, self.high = self.bounds[text], self.bounds[text + 1] if len(text) else np.zeros(0, np.int64)
        self.names = range_hashes(self.data, self.places, self.places + name)
        self.known, self.counts = distinct(self.names)

    def narrowed(self, flags: np.ndarray, bits: Leading) -> None:
        """Keep the sampled suffixes whose names may occur twice, and name them by their surroundings."""
        again = flags[np.cumsum(bits.of(self.known)[1]) - 1] > 0 if len(self.known) else np.zeros(0, bool)
        keep = again[np.searchsorted(self.known, self.names)]
        self.places, self.names, self.low, self.high = (x[keep] for x in (self.places, self.names, self.low, self.high))
        self.start, self.stop = np.maximum(self.places - self.v + 1, self.low), np.minimum(self.places + self.span, self.high)
        # The part before the suffix tells surroundings apart that are cut at the ends of a text.
        order = np.argsort(self.start, kind="stable")
        wide = np.empty(len(order), np.uint64)
        wide[order] = range_hashes(self.data, self.start[order], self.stop[order])
        self.wide = mix64(wide + (self.places - self.start).astype(np.uint64))
        order = np.lexsort((self.wide, self.names))
        names, wide = self.names[order], self.wide[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (wide[1:] != wide[:-1])]) if len(order) else np.zeros(0, bool)
        self.first = order[new]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.kind_counts = np.bincount(self.kind, minlength=len(self.first))

    def windows(self, of: np.ndarray) -> np.ndarray:
        """Sorted places of all strings of ``span`` bytes that the suffixes ``of`` stand for."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        a, b = self.start[of], np.minimum(self.places[of], self.high[of] - self.span)
        some = a <= b
        np.add.at(marks, a[some], 1)
        np.add.at(marks, b[some] + 1, -1)
        return np.flatnonzero(np.cumsum(marks) > 0)

    def compared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places to compare byte by byte, and their names: one suffix of each kind stands for all of it."""
        places = self.windows(self.first[codes >= 2])
        return places, range_hashes(self.data, places, places + self.span)

    def removed(self, codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Which bytes a repeated string covers."""
        starts = [self.windows(np.flatnonzero((codes & 1 == 1)[self.kind]))]
        places, names = self.compared(codes)
        if len(places):
            starts.append(places[flags[np.searchsorted(distinct(names)[0], names)] > 0])
        marks = np.zeros(len(self.data) + 1, np.int32)
        for s in starts:
            np.add.at(marks, s, 1)
            np.add.at(marks, s + self.span, -1)
        return np.cumsum(marks[:-1]) > 0


class Passages:
    """Word places of a chunk at the cover, and the names of the ``most`` words less the modulus from there on."""

    def __init__(self, chunk: Chunk, most: int, q: int):
        cover, v = difference_cover(q)
        if not v < most:
            raise ValueError("the difference cover needs a smaller modulus than the passage")
        hashes, _, _, self.words = word_hashes(chunk.data, chunk.bounds)
        self.size = most - v + 1
        text = owner(self.words)
        sampled = np.zeros(v, bool)
        sampled[cover] = True
        whole = within(self.words, self.size, len(hashes))
        self.places = np.flatnonzero(whole & sampled[(np.arange(len(hashes)) - self.words[text])[: len(whole)] % v])
        self.names = grams(hashes, self.size)[self.places]
        order = np.lexsort((text[self.places], self.names))
        names, of = self.names[order], text[self.places][order]
        each = np.concatenate([[True], (names[1:] != names[:-1]) | (of[1:] != of[:-1])]) if len(names) else np.zeros(0, bool)
        #: How many documents of the chunk have a name.
        self.known, self.counts = distinct(names[each])

    def shared(self, flags: np.ndarray) -> np.ndarray:
        """How many words of each text are under a name that several documents have."""
        marks = np.zeros(int(self.words[-1]) + 1, np.int32)
        if len(self.places):
            places = self.places[flags[np.searchsorted(self.known, self.names)] > 0]
            np.add.at(marks, places, 1)
            np.add.at(marks, places + self.size, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        return np.diff(inside[self.words])


def twice(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return sums(names, counts) > 1


def codes_of(names: np.ndarray, wide: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 if the surroundings recur, and 2 more if the name has several surroundings of which some don't."""
    if not len(names):
        return np.zeros(0, np.uint8)
    order = np.lexsort((wide, names))
    a, b = names[order], wide[order]
    new_name = np.concatenate([[True], a[1:] != a[:-1]])
    new_kind = new_name | np.concatenate([[True], b[1:] != b[:-1]])
    kind, name = np.cumsum(new_kind) - 1, np.cumsum(new_name) - 1
    recurs = np.bincount(kind, counts[order]) > 1
    kinds_of_name = np.bincount(name[new_kind])
    lonely = np.bincount(name[new_kind], ~recurs)
    out = np.empty(len(order), np.uint8)
    out[order] = recurs[kind] + 2 * ((kinds_of_name > 1) & (lonely > 0))[name]
    return out


def without_repeats(
    docs: DataFrame, span: int = SPAN, q: int = FIELD, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = False, passage: int = PASSAGE, passage_q: int = PASSAGE_FIELD, direct: int = DIRECT
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words[, kept]) for each row of ``docs(doc_id, text)``.

    Every byte that a string of ``span`` bytes covers goes if that string also
    starts elsewhere, in the same text or another; a text of fewer bytes, or a
    null one (no bytes), keeps all.  ``n_shared_words`` counts the words
    ``[^\\x20\\x09-\\x0D]+`` under names that other rows have too: above 0 for
    every text that shares a passage of ``passage`` words with another, 0 for
    one that shares no ``passage - v + 1`` words (38).  Repeated rows are
    different texts and so lose everything from ``span`` bytes on.  A text of
    any length is taken whole, in the memory of one worker.  Other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    docs, chunks, _ = chunked(docs, chunk_bytes)
    deal, bits = Deal(chunks, direct), Leading(chunks * chunk_bytes, 4)

    def first(key, table):
        chunk = Chunk(table, span, q)
        short, new = bits.of(chunk.known)
        at = np.flatnonzero(new)
        counts = np.add.reduceat(chunk.counts, at) if len(at) else chunk.counts
        return deal.sent(key[0].as_py(), 1, short[at], counts.astype(np.uint32))

    def passages(key, table):
        own = Passages(Chunk(table, span, q), passage, passage_q)
        return deal.sent(key[0].as_py(), 4, own.known, own.counts.astype(np.uint32))

    def second(key, table, answers):
        chunk = Chunk(table, span, q)
        chunk.narrowed(answers_of(answers, 1, np.uint8), bits)
        return deal.sent(key[0].as_py(), 2, chunk.names[chunk.first], chunk.wide[chunk.first], chunk.kind_counts.astype(np.uint32))

    def third(key, table, answers):
        chunk = Chunk(table, span, q)
        chunk.narrowed(answers_of(answers, 1, np.uint8), bits)
        names, counts = distinct(chunk.compared(answers_of(answers, 2, np.uint8))[1])
        return deal.sent(key[0].as_py(), 3, names, counts.astype(np.uint32))

    def last(table, answers):
        chunk = Chunk(table, span, q)
        chunk.narrowed(answers_of(answers, 1, np.uint8), bits)
        gone = chunk.removed(answers_of(answers, 2, np.uint8), answers_of(answers, 3, np.uint8))
        shared = Passages(chunk, passage, passage_q).shared(answers_of(answers, 4, np.uint8))
        counts, spans, digests, texts = [], [], [], []
        for a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist()):
            part = gone[a:b]
            n = int(part.sum())
            kept = chunk.data[a:b][~part] if n else chunk.data[a:b]
            counts.append(n)
            spans.append(int((part[1:] & ~part[:-1]).sum()) + int(part[0]) if n else 0)
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            if keep_text:
                texts.append(kept.tobytes())
        columns = [chunk.ids, pa.array(np.diff(chunk.bounds)), pa.array(counts, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(shared.astype(np.int64))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"]
        return pa.table([*columns, pa.array(texts, pa.binary())], [*names, "kept"]) if keep_text else pa.table(columns, names)

    grouped = docs.groupBy("chunk")
    counted, paired = (np.uint64, np.uint32), (np.uint64, np.uint64, np.uint32)
    one = deal.answered(deal.relayed(grouped.applyInArrow(first, RUN), counted), counted, twice, np.uint8)
    two = deal.answered(deal.relayed(grouped.cogroup(one.groupBy("sender")).applyInArrow(second, RUN), paired), paired, codes_of, np.uint8)
    known = one.unionAll(two)
    three = deal.answered(deal.relayed(grouped.cogroup(known.groupBy("sender")).applyInArrow(third, RUN), counted), counted, twice, np.uint8)
    four = deal.answered(deal.relayed(grouped.applyInArrow(passages, RUN), counted), counted, twice, np.uint8)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + ", kept binary" * keep_text
    return grouped.cogroup(known.unionAll(three).unionAll(four).groupBy("sender")).applyInArrow(last, schema)


def op10(spark, sf_dir):
    return without_repeats(documents(spark, sf_dir))
