"""The stages one after the other against a plain version of each."""

import re

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from scriptorium.llm import bpe_automaton, common, pii, quality_crf, similar_docs, token_files

from .fixtures import sha
from .test_operators import base_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = common.documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, FOLDER), name)
        out.append((docs.columns, {r["doc_id"]: r for r in docs.collect()}))
    return out


def test_stages_keep_columns():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, staged):
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    field = quality_crf.fit(common.documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = set()
    for r in rows:
        masks, words, _ = quality_crf.line_features(r["text"])
        content = sum(w for w, x in zip(words, field.viterbi(masks)) if x)
        if not base_of(r["text"])[-1] and 2 * content >= sum(words):
            want.add(r["doc_id"])
    assert set(staged[0][1]) == want and staged[0][0] == list(rows[0])


def test_copies_stage(staged):
    before = staged[0][1]
    least = {i: i for i in before}
    for i in sorted(before):
        for j in sorted(before):
            if j < i and least[i] != least[j] and similar_docs.similarity(before[i]["text"].encode(), before[j]["text"].encode()) >= 0.8:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if x == old else x for k, x in least.items()}
    want = {i for i, x in least.items() if i == x}
    assert set(staged[1][1]) == want and staged[1][0] == staged[0][0]


def test_leaks_stage(staged):
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").column("text").to_pylist()
    loose = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    lists = [loose(t) for t in items]

    def leaks(text):
        words = loose(text)
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item in lists:
            grams = [tuple(item[k : k + 5]) for k in range(len(item) - 4)]
            if sum(g in own for g in grams) >= 0.9 * len(grams):
                return True
        return False

    assert set(staged[2][1]) == {i for i, r in staged[1][1].items() if not leaks(r["text"])}


def test_personal_stage(spark, staged):
    """Each span that the detector reports is replaced, and nothing else."""
    before = staged[2][1]
    docs = spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string")
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.detect(docs).collect()}
    assert set(staged[3][1]) == set(before) and sum(map(len, spans.values())) > 10
    for i, r in staged[3][1].items():
        text, out, at = before[i]["text"], "", 0
        for kind, a, b in sorted(spans[i], key=lambda x: (x[1], x[2], x[0])):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r["text"] == out + text[at:]


def test_encoding_stage(staged):
    tokenizer = token_files._tokenizer(bpe_automaton.vocabulary_path())
    for i, r in staged[4][1].items():
        text = staged[3][1][i]["text"]
        assert list(r["ids"]) == tokenizer.encode(text, add_special_tokens=False).ids and r["decoded_sha256"] == sha(text)
    assert set(staged[4][1]) == set(staged[3][1])


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        pq.write_table(pq.read_table(f"{FOLDER}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages(spark, staged):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id: r.ids_sha256 for r in found.collect()} == {i: r["ids_sha256"] for i, r in staged[4][1].items()}
