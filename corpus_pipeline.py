"""The training-data pipeline: five stages over documents, each one operator's decisions put into effect.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents; the last returns the token ids of each document that the mix takes, as often as it takes it.

Defined results: null and blank texts have no words, so the first stage rejects them. Repeated rows are near copies of
each other: of an id's rows one stays (that of the longest text). Rows of null id have no name to be dropped by, so the
second stage keeps them; the third cuts what they share with earlier rows. Null sources are one source, last in order;
null languages mean nothing. Very long texts pass whole. An empty table gives an empty result. Further columns reach
the fourth stage untouched, whatever their names, but n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, jaccard, mixing, quality, substrings
from quarrymill.llm.common import table
from quarrymill.scratch import forget, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.filter_clean(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked at 0.8 or more over five-word shingles: that of the smallest id."""
    return jaccard.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier elsewhere are cut out of texts; documents stay."""
    return substrings.dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.expand(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and digests of ids and of the decoded bytes."""
    return bpe.digest(docs, keep=("doc_id", "source", "lang"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Components, windows over all documents and byte-pair merges have no SQL here: tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settle(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
