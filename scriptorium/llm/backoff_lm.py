"""Stupid-backoff language model scores of every document against the corpus.

Counts of all word n-grams up to ``ORDER`` are kept in tables partitioned by
hash, joined to the n-grams of the documents, and their scores are summed for
each document.  A document is scored by the counts of all others (its own
occurrences are taken off), so backing off has its meaning although the model
is the corpus itself.  The tables are the buckets of ``exchange``: a row carries
the sorted run of a chunk's distinct n-grams rather than one n-gram.

Most n-grams occur once in the corpus, and then nowhere else than in their
document.  A first round finds them by the leading bits of their hashes, as many
as keep chance meetings rare at the corpus's size; only n-grams that share those
bits with another occurrence are counted by their whole hashes in the second,
which sends the bits that the first left out.

For the word at place i with the longest context there is: if the n-gram occurs
elsewhere its score is its count over that of its context; else ``ALPHA`` times
the score with a shorter context; a word alone scores its count over the number
of words, and an unseen word 1 over that number plus 1.

N-grams are told apart by hashes of 64 bits: of n distinct ones about n / 2**64
share theirs with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, documents, grams, mix64, owner, within, word_hashes
from .exchange import CHUNK_BYTES, DIRECT, RUN, Deal, Leading, answers_of, chunked, sums, unpacked_rows

ORDER = 3
ALPHA = 0.4


def gram_keys(data: np.ndarray, bounds: np.ndarray, order: int):
    """Keys of the n-grams of each length by where they start, which starts are whole, and the words' bounds."""
    hashes, _, _, words = word_hashes(data, bounds)
    keys = [mix64(grams(hashes, n) + np.uint64(n)) for n in range(1, order + 1)]
    return keys, [within(words, n, len(hashes)) for n in range(1, order + 1)], words


def counts_elsewhere(keys: np.ndarray, texts: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each n-gram, its count in the corpus without that in its own text."""
    order = np.argsort(keys, kind="stable")
    ordered, text = keys[order], texts[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = counts[np.searchsorted(known, ordered[first])]
    each = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (text[1:] != text[:-1])])) if len(keys) else first
    own = np.diff(np.concatenate([each, [len(keys)]]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(total, np.diff(np.concatenate([first, [len(keys)]]))) - np.repeat(own, own)
    return out


def whole_counts(bits: Leading, rest, new, counts, shorts, many) -> np.ndarray:
    """Counts of n-grams by whole hashes, from the second round's columns and those of the first.

    A chunk's n-grams of the second round follow its recurring leading bits in
    order, ``new`` marking the first of each; a count of 0 means that of the bits.
    """
    again = sums(shorts, many) > 1
    of = np.cumsum(new, dtype=np.int64) - 1
    return sums(shorts[again][of] | rest, np.where(counts > 0, counts, many[again][of]))


def scores(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES, direct: int = DIRECT) -> DataFrame:
    """(doc_id, n_words, n_found_3, n_found_2, n_found_1, n_unseen, score) for each row of ``documents(doc_id, text)``.

    score is the mean base-10 logarithm over the words ``[^\\x20\\x09-\\x0D]+``,
    rounded to 6 places; a text without words, or a null one, has null.
    Repeated rows count as different documents and may land in different
    chunks.  A text of any length is scored whole, in the memory of one worker.
    Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    docs, chunks, (total,) = chunked(documents, chunk_bytes, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    deal, bits = Deal(chunks, direct), Leading(chunks * chunk_bytes)

    def known_grams(table):
        ids, data, bounds = unpacked_rows(table)
        keys, whole, words = gram_keys(data, bounds, order)
        known, counts = distinct(np.concatenate([k[ok] for k, ok in zip(keys, whole)]))
        return ids, keys, whole, words, known, counts

    def first(key, table):
        *_, known, counts = known_grams(table)
        short, new = bits.of(known)
        at = np.flatnonzero(new)
        many = np.add.reduceat(counts, at) if len(at) else counts
        return deal.sent(key[0].as_py(), 1, short[at], many.astype(np.uint32))

    def recurring(known, answers):
        return answers_of(answers, 1, np.uint8)[np.cumsum(bits.of(known)[1]) - 1] > 0

    def second(key, table, answers):
        *_, known, counts = known_grams(table)
        again = recurring(known, answers)
        known, counts = known[again], counts[again].astype(np.uint32)
        _, new = bits.of(known)
        alone = new & np.concatenate([new[1:], [True]]) if len(new) else new
        return deal.sent(key[0].as_py(), 2, known, bits.rest(known), new.astype(np.uint8), np.where(alone, 0, counts).astype(np.uint32), whole=False)

    def score(table, answers):
        names = ["doc_id", "n_words", *(f"n_found_{n}" for n in range(order, 0, -1)), "n_unseen", "score"]
        ids, keys, whole, words, known, _ = known_grams(table)
        counts = np.ones(len(known), np.int64)
        counts[recurring(known, answers)] = answers_of(answers, 2, np.uint64).astype(np.int64)
        text, n_words = owner(words), np.diff(words)
        size = len(text)
        elsewhere = [np.zeros(size, np.int64) for _ in range(order)]
        for n in range(order):
            starts = np.flatnonzero(whole[n])
            elsewhere[n][starts] = counts_elsewhere(keys[n][starts], text[starts], known, counts)
        rest = (total - n_words)[text].astype(float)
        level = np.where(elsewhere[0] > 0, 1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(level > 0, np.log10(elsewhere[0] / rest), -np.log10(rest + 1))
            for n in range(2, order + 1):
                there = np.zeros(size, bool)
                there[n - 1 :] = whole[n - 1]
                found, context = np.zeros(size, np.int64), np.ones(size, np.int64)
                found[n - 1 :] = elsewhere[n - 1][: size - n + 1]
                context[n - 1 :] = elsewhere[n - 2][: size - n + 1]
                log = np.where(there, np.where(found > 0, np.log10(found / context), np.log10(alpha) + log), log)
                level = np.where(there & (found > 0), n, level)

        def per_text(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(n_words), x.dtype)
            some = np.flatnonzero(n_words)
            if len(some):
                out[some] = np.add.reduceat(x, words[some])
            return out

        sums_ = per_text(log)
        mean = [round(float(s) / n, 6) if n else None for s, n in zip(sums_, n_words.tolist())]
        levels = [per_text((level == n).astype(np.int64)) for n in (*range(order, 0, -1), 0)]
        return pa.table([ids, pa.array(n_words), *map(pa.array, levels), pa.array(mean, pa.float64())], names)

    grouped = docs.groupBy("chunk")
    asked = deal.relayed(grouped.applyInArrow(first, RUN), (np.uint64, np.uint32))
    one = deal.answered(asked, (np.uint64, np.uint32), lambda keys, counts: sums(keys, counts) > 1, np.uint8)
    again = deal.relayed(grouped.cogroup(one.groupBy("sender")).applyInArrow(second, RUN), (np.uint64, np.uint8, np.uint32), whole=False)
    two = deal.answered(again, (np.uint64, np.uint8, np.uint32), lambda *columns: whole_counts(bits, *columns), np.uint64, whole=False, beside=(asked, (np.uint64, np.uint32)))
    schema = "doc_id long, n_words long, " + "".join(f"n_found_{n} long, " for n in range(order, 0, -1)) + "n_unseen long, score double"
    return grouped.cogroup(one.unionAll(two).groupBy("sender")).applyInArrow(score, schema)


def op1(spark, sf_dir):
    return scores(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM t),
g AS (SELECT doc_id, i, a,
        lag(a, 1) OVER d || ' ' || a AS b,
        lag(a, 2) OVER d || ' ' || lag(a, 1) OVER d || ' ' || a AS c,
        lag(a, 1) OVER d AS a1,
        lag(a, 2) OVER d || ' ' || lag(a, 1) OVER d AS b1
      FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ca AS (SELECT a, count(*) AS n FROM g GROUP BY a), da AS (SELECT doc_id, a, count(*) AS n FROM g GROUP BY ALL),
cb AS (SELECT b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b), db AS (SELECT doc_id, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
cc AS (SELECT c, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c), dc AS (SELECT doc_id, c, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM g) AS total),
x AS (SELECT g.doc_id, g.i, g.b, g.c,
        ca.n - da.n AS na, cb.n - db.n AS nb, cc.n - dc.n AS nc,
        ca1.n - da1.n AS na1, cb1.n - db1.n AS nb1,
        s.total - count(*) OVER (PARTITION BY g.doc_id) AS rest
      FROM g CROSS JOIN s
      JOIN ca ON ca.a = g.a JOIN da ON da.doc_id = g.doc_id AND da.a = g.a
      LEFT JOIN cb ON cb.b = g.b LEFT JOIN db ON db.doc_id = g.doc_id AND db.b = g.b
      LEFT JOIN cc ON cc.c = g.c LEFT JOIN dc ON dc.doc_id = g.doc_id AND dc.c = g.c
      LEFT JOIN ca ca1 ON ca1.a = g.a1 LEFT JOIN da da1 ON da1.doc_id = g.doc_id AND da1.a = g.a1
      LEFT JOIN cb cb1 ON cb1.b = g.b1 LEFT JOIN db db1 ON db1.doc_id = g.doc_id AND db1.b = g.b1),
y AS (SELECT doc_id,
        CASE WHEN nc > 0 THEN 3 WHEN nb > 0 THEN 2 WHEN na > 0 THEN 1 ELSE 0 END AS level,
        CASE WHEN nc > 0 THEN log10(nc / nb1)
             ELSE CASE WHEN c IS NULL THEN 0 ELSE log10(0.4) END +
             CASE WHEN nb > 0 THEN log10(nb / na1)
                  ELSE CASE WHEN b IS NULL THEN 0 ELSE log10(0.4) END +
                  CASE WHEN na > 0 THEN log10(na / rest) ELSE -log10(rest + 1) END END END AS score
      FROM x)
SELECT t.doc_id, count(y.level) AS n_words,
  count(*) FILTER (level = 3) AS n_found_3, count(*) FILTER (level = 2) AS n_found_2,
  count(*) FILTER (level = 1) AS n_found_1, count(*) FILTER (level = 0) AS n_unseen,
  round(sum(score) / count(y.level), 6) AS score
FROM t LEFT JOIN y ON y.doc_id = t.doc_id GROUP BY t.doc_id
"""
