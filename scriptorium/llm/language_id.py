"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``ORDER`` is estimated from character counts
of at most about ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_CHARS``
characters (``TRAIN_ALL`` documents over all languages), chosen by a hash of
doc_id against the language's number of documents.  The models share sorted
arrays of 64-bit n-gram hashes, one for each order, with a column of
log-probabilities and one of back-off weights for each language, looked up by
binary search.

A text's language is the one of lowest cross-entropy a character.  The score is
its probability in a softmax over languages whose sharpness is fitted on chosen
documents that the counts have left out, and a text is rejected if its
cross-entropy is beyond what nearly all of those documents have.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, mix64

ORDER = 4
TRAIN_DOCS = 300
TRAIN_CHARS = 20_000
TRAIN_ALL = 20_000
UNKNOWN = "und"
REJECT_SIGMAS = 6.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` characters that end at each position from the first of the text on."""
    at = ORDER - 1
    out = np.full(max(0, len(points) - at), n, np.uint64)
    for k in range(n - 1, -1, -1):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + points[at - k : len(points) - k])
    return out


def point_rows(grams: list[str], n: int) -> np.ndarray:
    """Code points of equally long strings, a row for each."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n) if n else np.zeros((len(grams), 0), np.uint64)


def row_hashes(points: np.ndarray) -> np.ndarray:
    """The same hashes as ``gram_hashes``, of rows of code points."""
    out = np.full(len(points), points.shape[1], np.uint64)
    for k in range(points.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + points[:, k])
    return out


class KneserNey:
    """Models of several languages.  ``grams[k]``: sorted hashes; ``logp[k]``, ``weight[k]``: a row for each."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        letters = {g[-1] for c in counts.values() for g in c}
        tables = [self._estimate(counts[lang], len(letters) + 1) for lang in self.languages]
        self.floor = np.array([t[2] for t in tables])
        self.grams, self.logp, self.weight = {}, {}, {}
        for k in range(1, ORDER + 1):
            names = sorted({g for t in tables for g in t[0][k]} | {h for t in tables for h in t[1][k]})
            logp = np.array([[t[0][k].get(g, np.nan) for t in tables] for g in names]).reshape(len(names), len(tables))
            weight = np.array([[t[1][k].get(g, 0.0) for t in tables] for g in names]).reshape(len(names), len(tables))
            hashes = row_hashes(point_rows(names, k))
            order = np.argsort(hashes)
            self.grams[k], self.logp[k], self.weight[k] = hashes[order], logp[order], weight[order]
        # Full values of all n-grams of the highest order, so that most characters need one search.
        points = point_rows(names, ORDER)[order]
        parts = {k: row_hashes(points[:, ORDER - k :]) for k in range(1, ORDER + 1)}
        contexts = {k: row_hashes(points[:, ORDER - 1 - k : ORDER - 1]) for k in range(1, ORDER)}
        self.full = self._levels(parts, contexts, ORDER).astype(np.float32)
        self.sharpness, self.most = 10.0, np.inf

    @staticmethod
    def _estimate(top: Counter, size: int):
        """Log-probabilities of seen n-grams and log back-off weights of contexts, by length; and an unseen character's."""
        counts = {ORDER: top}
        for k in range(ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        p, weights, below = {}, {k: {} for k in range(ORDER + 1)}, None
        for k in range(1, ORDER + 1):
            ones, twos = sum(c == 1 for c in counts[k].values()), sum(c == 2 for c in counts[k].values())
            off = ones / (ones + 2 * twos) if ones else 0.5
            total, kinds = Counter(), Counter()
            for g, c in counts[k].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            gamma = {h: off * kinds[h] / total[h] for h in total}
            weights[k - 1] = {h: float(np.log(x)) for h, x in gamma.items()}
            p[k] = {g: (c - off) / total[g[:-1]] + gamma[g[:-1]] * (below[g[1:]] if below else 1 / size) for g, c in counts[k].items()}
            below = p[k]
        floor = float(np.log(np.exp(weights[0].get("", 0.0)) / size))
        return {k: {g: float(np.log(x)) for g, x in v.items()} for k, v in p.items()}, weights, floor

    def _rows(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.grams[k]
        if not len(table):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return at, table[at] == hashes

    def _levels(self, hashes: dict[int, np.ndarray], contexts: dict[int, np.ndarray], most: int) -> np.ndarray:
        n = len(hashes[1])
        out = np.tile(self.floor, (n, 1))
        for k in range(1, most + 1):
            at, found = self._rows(k, hashes[k])
            own = np.where(found[:, None], self.logp[k][at], np.nan) if len(self.grams[k]) else np.full(out.shape, np.nan)
            if k > 1:
                at, found = self._rows(k - 1, contexts[k - 1])
                out = out + np.where(found[:, None], self.weight[k - 1][at], 0.0)
            out = np.where(np.isnan(own), out, own)
        return out

    def entropies(self, text: str) -> np.ndarray:
        """Cross-entropy a character (in nats) of the text under each language."""
        points = code_points(text)
        n = len(points) - ORDER + 1
        total = np.zeros(len(self.languages))
        step = 1 << 18
        for start in range(0, n, step):
            part = points[start : min(n, start + step) + ORDER - 1]
            top = gram_hashes(part, ORDER)
            at, found = self._rows(ORDER, top)
            total += self.full[at[found]].sum(0, dtype=np.float64)
            if not found.all():
                rest = np.flatnonzero(~found)
                before = np.concatenate([[0], part[:-1]]).astype(np.uint64)
                hashes = {k: gram_hashes(part, k)[rest] for k in range(1, ORDER)} | {ORDER: top[rest]}
                contexts = {k: gram_hashes(before, k)[rest] for k in range(1, ORDER)}
                total += self._levels(hashes, contexts, ORDER).sum(0)
        return -total / n

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """(language, score, rejected, cross-entropy); the unknown language only without letters or models."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True, 0.0
        loss = self.entropies(text)
        best = int(np.argmin(loss))
        p = 1.0 / np.exp(-self.sharpness * (loss - loss[best])).sum()
        return self.languages[best], float(p), bool(loss[best] > self.most), float(loss[best])

    def calibrate(self, rows: list[tuple[str, list[float]]]) -> None:
        """Fit sharpness and the rejection bound on (language, cross-entropies) of labelled documents."""
        rows = [(self.languages.index(lang), np.array(x)) for lang, x in rows if lang in self.languages]
        if not rows:
            return
        truth, loss = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])

        def likelihood(k: float) -> float:
            z = -k * loss
            z = z - z.max(1, keepdims=True)
            return float((z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())

        self.sharpness = max((1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0), key=likelihood)
        own = loss[np.arange(len(loss)), truth]
        self.most = float(own.mean() + REJECT_SIGMAS * own.std())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_parts(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[DataFrame, DataFrame] | None:
    """The documents that are counted, and a fourth as many others for calibration; None without any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    rows = rows.where(F.length("text") <= TRAIN_CHARS)
    counted = rows.groupBy("lang").count()
    kinds = counted.count()
    if not kinds:
        return None
    share = F.least(F.lit(1.0), F.lit(1.25 * min(most, TRAIN_ALL / kinds)) / F.col("count"))
    bounds = counted.select(F.col("lang").alias("_lang"), (share * (1 << 30)).cast("long").alias("_share"))
    bounds = F.broadcast(bounds) if kinds <= TRAIN_ALL else bounds
    chosen = rows.join(bounds, F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share")).select("doc_id", "text", "lang")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    return chosen.where(~apart), chosen.where(apart)


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> KneserNey:
    """Models from ``docs(doc_id, text, lang)`` outside the held-out part; rows with nulls are passed over.

    Repeated rows count as often as they are there.
    """
    parts = training_parts(docs, most)
    if parts is None:
        return KneserNey({})
    chosen, apart = parts

    def count(batches):
        counts: dict[str, Counter] = {}
        for batch in batches_of(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                padded = " " * (ORDER - 1) + text.lower()
                counts.setdefault(lang, Counter()).update(map("".join, zip(*(padded[k:] for k in range(ORDER)))))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["lang", "gram", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for lang, gram, n in counted.collect():
        counts.setdefault(lang, Counter())[gram] = n
    model = KneserNey(counts)

    def losses(batches):
        for batch in batches_of(batches):
            found = [model.entropies(t).tolist() if t else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.float64()))], ["lang", "loss"])

    model.calibrate([(r[0], r[1]) for r in apart.select("lang", "text").mapInArrow(losses, "lang string, loss array<double>").collect() if r[1]])
    return model


def identify(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy) for each row of ``docs(doc_id, text)``.

    A null or empty text or one without a letter is ``und`` with score 0.  The
    text alone decides, whole whatever its length; of equally good languages the
    first by name counts; repeated rows get equal rows; a null doc_id is not held
    out.  Nothing is shuffled; other columns, whatever their names, are ignored;
    an empty table gives no rows.
    """

    def run(batches):
        for batch in batches_of(batches):
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_()), pa.array([x[3] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
