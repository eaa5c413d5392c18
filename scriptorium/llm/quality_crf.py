"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

Each line gets binary features; Viterbi decoding finds the most likely labels
of a document's lines together; the share of its words in content lines decides
whether the document is kept, after plain rules on word and repetition counts.

The field is trained here, over at most ``TRAIN_DOCS`` labelled documents for
each quality, chosen by a hash of doc_id.  ``labels`` has the quality of whole
documents, while good ones have boilerplate lines and bad ones content.  A line
gets its label from both: the log-odds of its features between lines of good and
of bad documents, plus ``LEAN`` for its own document's quality.  So documents of
mixed lines exist, and the field learns from them, by gradient ascent on the
likelihood of these labels, when a document changes sides.  Training
rows give only feature masks to the driver, never texts, at most ``TRAIN_LINES``
for a document (those of more lines are not chosen).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches_of, documents, grams, mix64, owner, text_buffer, within, word_hashes

TRAIN_DOCS = 800
TRAIN_LINES = 2000
LEAN = 1.0
CONTENT_SHARE = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "shouting", "symbols", "exclaims", "digits", "repeats", "again", "table", "short", "sentence", "legal", "first", "previous short")
#: Words that mark notices rather than prose.
LEGAL = frozenset("license licensed copyright rights reserved terms cookies privacy subscribe login".split())


def line_features(text: str) -> tuple[list[int], list[int], int]:
    """A mask of ``FEATURES`` and the number of words for each line, and how many lines with a word repeat an earlier one."""
    masks, words, seen, again, short_before = [], [], set(), 0, False
    for line in text.split("\n"):
        parts = line.split()
        n, size = len(parts), len(line) or 1
        mask = 1
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                again += 1
                mask |= 64
            seen.add(line)
        if n:
            if line.upper() == line and line.lower() != line:
                mask |= 2
            if sum(map(line.count, SYMBOLS)) * 50 > size:
                mask |= 4
            if line.count("!") * 50 > size:
                mask |= 8
            if n > 4 and 2 * len(set(parts)) < n:
                mask |= 32
            if line.count("|") > 1:
                mask |= 128
            if n < 4:
                mask |= 256
            if line[-1] in ".!?…\"'»)":
                mask |= 512
            if sum(map(line.count, "0123456789")) * 5 > size:
                mask |= 16
            low = line.lower()
            if any(w in low for w in LEGAL) and not LEGAL.isdisjoint(w.strip(".,:;") for w in low.split()):
                mask |= 1024
        if not masks:
            mask |= 2048
        if short_before:
            mask |= 4096
        short_before = n < 4
        masks.append(mask)
        words.append(n)
    return masks, words, again


class LineField:
    """Weights of a two-label chain: ``emit`` favours content, ``step[a, b]`` goes from label a to b."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros(len(FEATURES)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step
        self.known: dict[int, float] = {}

    def score(self, mask: int) -> float:
        if (found := self.known.get(mask)) is None:
            found = self.known[mask] = float(sum(w for k, w in enumerate(self.emit) if mask >> k & 1))
        return found

    def viterbi(self, masks: list[int]) -> list[int]:
        """The most likely labels (1 content, 0 boilerplate); ties go to content."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for k, mask in enumerate(masks):
            e = self.score(mask)
            if k:
                from_a, from_b = a + s00 > b + s10, a + s01 > b + s11
                a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + e
            else:
                from_a = from_b = False
                b = e
            back.append((from_a, from_b))
        label, out = int(b >= a), []
        for from_a, from_b in reversed(back):
            out.append(label)
            label = 0 if (from_b if label else from_a) else 1
        return out[::-1]


def marginals(score: np.ndarray, step: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains side by side (line, chain): how likely each line is content, and the sums of each step's probability a chain."""
    most, n = score.shape
    ahead, behind = np.zeros((most, n, 2)), np.zeros((most, n, 2))
    ahead[0, :, 1] = score[0]
    for t in range(1, most):
        now = np.logaddexp(ahead[t - 1, :, :1] + step[0], ahead[t - 1, :, 1:] + step[1])
        now[:, 1] += score[t]
        ahead[t] = np.where(real[t][:, None], now, ahead[t - 1])
    for t in range(most - 2, -1, -1):
        after = behind[t + 1] + np.stack([np.zeros(n), score[t + 1]], 1)
        now = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
        behind[t] = np.where(real[t + 1][:, None], now, 0.0)
    logz = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - logz) * real
    pairs = np.zeros((2, 2, n))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = (np.exp(ahead[:-1, :, i] + step[i, j] + score[1:] * j + behind[1:, :, j] - logz) * real[1:]).sum(0)
    return content, pairs


def line_odds(rows: list[tuple[list[int], int]]) -> dict[int, float]:
    """For each mask, the log-odds of a line that has it between good and bad documents; every document counts alike."""
    share, docs = {0: {}, 1: {}}, {q: sum(r[1] == q for r in rows) for q in (0, 1)}
    for masks, quality in rows:
        for mask in masks:
            share[quality][mask] = share[quality].get(mask, 0.0) + 1 / len(masks) / docs[quality]
    few = 0.5 / min(docs.values())
    return {m: float(np.log((share[1].get(m, 0.0) + few) / (share[0].get(m, 0.0) + few))) for m in {*share[0], *share[1]}}


def line_labels(masks: list[int], quality: int, odds: dict[int, float], lean: float = LEAN) -> list[int]:
    """1 for content, 0 for boilerplate."""
    return [int(odds[m] + lean * (2 * quality - 1) > 0) for m in masks]


def train(rows: list[tuple[list[int], int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3, lean: float = LEAN) -> LineField:
    """``rows`` of (line masks, quality of the document); without both qualities all weights stay 0."""
    rows = sorted((r for r in rows if r[0]), key=lambda r: (len(r[0]), r[1], r[0]))
    if len({q for _, q in rows}) < 2:
        return LineField()
    groups, odds = [rows[at : at + 200] for at in range(0, len(rows), 200)], line_odds(rows)
    packed = []
    for group in groups:
        most = max(len(m) for m, _ in group)
        masks, real = np.zeros((most, len(group)), np.int64), np.zeros((most, len(group)), bool)
        for d, (m, _) in enumerate(group):
            masks[: len(m), d], real[: len(m), d] = m, True
        hot = ((masks[:, :, None] >> np.arange(len(FEATURES))) & 1).astype(np.float32)
        labels = np.zeros((most, len(group)))
        for d, (m, q) in enumerate(group):
            labels[: len(m), d] = line_labels(m, q, odds, lean)
        packed.append((hot, real, np.array([q for _, q in group], float), labels))
    share = {q: sum(r[1] == q for r in rows) for q in (0, 1)}
    emit, step, moved = np.zeros(len(FEATURES)), np.zeros((2, 2)), [0.0, 0.0]
    for _ in range(rounds):
        d_emit, d_step = -decay * emit * len(rows), -decay * step * len(rows)
        for hot, real, quality, labels in packed:
            weight = np.where(quality > 0, 0.5 / share[1], 0.5 / share[0]) * len(rows) / real.sum(0)
            content, steps = marginals(hot @ emit, step, real)
            d_emit += np.einsum("td,tdf->f", (labels - content) * weight, hot)
            for i in (0, 1):
                for j in (0, 1):
                    there = ((labels[:-1] == i) & (labels[1:] == j) & real[1:]).sum(0)
                    d_step[i, j] += ((there - steps[i, j]) * weight).sum()
        moved = [0.8 * moved[0] + d_emit / len(rows), 0.8 * moved[1] + d_step / len(rows)]
        emit, step = emit + rate * moved[0], step + rate * moved[1]
    return LineField(emit, step)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> LineField:
    """Train on at most ``most`` labelled documents of each quality.

    Rows with nulls are passed over, and so is a doc_id with both qualities; of
    several texts under a doc_id the least counts.
    """
    of = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality")).where("_id is not null and _quality in (0, 1)")
    of = of.groupBy("_id").agg(F.min("_quality").alias("_quality"), F.max("_quality").alias("_other")).where("_quality = _other").drop("_other")
    chosen = None
    for quality in (0, 1):
        part = of.where(F.col("_quality") == quality).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)

    def run(batches):
        for batch in batches_of(batches):
            masks = [line_features(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.list_(pa.int32())), batch.column("_quality")], ["masks", "quality"])

    # At most 2 * most rows of two numbers are broadcast, and as many come back.
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.col("text").isNotNull() & (lines <= TRAIN_LINES)).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("_quality").alias("_quality")).select("text", "_quality")
    return train([(list(r[0]), r[1]) for r in rows.mapInArrow(run, "masks array<int>, quality int").collect()])


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    data, bounds = text_buffer(column)
    hashes, _, _, words = word_hashes(data, bounds)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[bounds])

    marks = np.zeros(256, bool)
    marks[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": np.diff(words), "word_chars": per_text(((data & 0xC0) != 0x80) & ~SPACES[data]), "n_symbols": per_text(marks[data])}
    covered = np.zeros(len(hashes) + 1, np.int64)
    windows = np.flatnonzero(within(words, 5, len(hashes)))
    if len(windows):
        text = owner(words)
        keys = mix64(grams(hashes, 5)[windows] + text[windows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = np.concatenate([[False], keys[order][1:] == keys[order][:-1], [False]])
        twice = windows[order[same[1:] | same[:-1]]]
        np.add.at(covered, twice, 1)
        ends = twice + 5
        np.add.at(covered, ends, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[words])
    return out


def assess(docs: DataFrame, field: LineField) -> DataFrame:
    """Counts and the verdict for each row of ``docs(doc_id, text)``.

    A null or empty text has no words and fails the plain rules.  A text of any
    length is decoded whole; between equally likely labels content wins.
    Repeated rows get equal rows; other columns, whatever their names, are
    ignored; an empty table gives no rows; nothing is shuffled.
    """
    emit, step = field.emit, field.step

    def run(batches):
        field = LineField(emit, step)
        for batch in batches_of(batches):
            counts = base_counts(batch.column("text"))
            again, share = [], []
            for text in batch.column("text"):
                masks, words, n = line_features(text.as_py() or "")
                labels = field.viterbi(masks)
                total = sum(words)
                again.append(n)
                share.append(sum(w for w, x in zip(words, labels) if x) / total if total else 0.0)
            share = np.array(share)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k]) for k in ("n_words", "word_chars", "n_symbols")), pa.array(again, pa.int64()), pa.array(counts["n_repeat_words"]), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` without the rows that the rules and the field reject, all columns kept.

    The verdict depends on the text alone, so it is computed beside the rows
    and nothing is joined.  Null and empty texts go; repeated rows stay or go
    together.
    """
    emit, step = field.emit, field.step

    def run(batches):
        field = LineField(emit, step)
        for batch in batches_of(batches):
            counts = base_counts(batch.column("text"))
            keep = []
            for text, n, repeats in zip(batch.column("text"), counts["n_words"].tolist(), counts["n_repeat_words"].tolist()):
                if n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n:
                    keep.append(False)
                    continue
                masks, words, _ = line_features(text.as_py())
                total = sum(words)
                keep.append(bool(total) and sum(w for w, x in zip(words, field.viterbi(masks)) if x) >= CONTENT_SHARE * total)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
