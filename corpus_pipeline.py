"""From raw documents to token ids: quality rules, near duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of ``documents``, extra ones of any
name included.  An empty table stays empty through all stages.  Every text is
taken whole, whatever its length, in the memory of one worker.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe_automaton, decontaminate, pii, quality_crf, similar_docs
from scriptorium.llm.common import discard, documents, stored_alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules, or whose lines are mostly boilerplate, go.

    Null and empty texts have no words and go.  The text alone decides: rows with
    a null doc_id are judged like others, repeated rows stay or go together, and
    half of the words in content lines is enough to stay.
    """
    return quality_crf.keep_good(docs, quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays, the one of the least doc_id.

    Found by SimHash and Golay-code fuzzy hashing, compared exactly, and completed
    exactly.  A null doc_id counts as the greatest.  Repeated rows and equal texts are one
    document; different texts under one doc_id are documents of their own.  Texts
    without words, null ones too, are similar to each other.
    """
    return similar_docs.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (a window of its length with similarity 0.8 or more) go.

    Null and empty texts hold none and stay; repeated rows go together; an empty
    benchmark lets all stay, and items with null or empty texts count for nothing.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; every document stays.

    Null texts stay null; spans that touch are replaced as one, under the kind of
    the first; repeated rows get equal texts.
    """
    return pii.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document.

    Null and empty texts have no ids; repeated rows give repeated results.
    """
    return bpe_automaton.encode_documents(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Random fields, fuzzy hashes and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input; what stages store on the way is removed."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        after = stored_alone(functools.partial(stage, spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
