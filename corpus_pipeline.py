"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Every stage reads whole texts and takes a missing text as an empty one. Rows without ``doc_id`` stay rows of their own and
extra columns of ``documents`` pass through all stages but the last; an empty table gives an empty result everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import bpe, exact, leaks, quality, simhash
from gridcast.llm.catalog import GOOD, WORD_BPE
from gridcast.llm.common import table
from gridcast.session import snapshot


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject stay.

    Every row is judged by its text alone, so repeated rows fare alike; empty and missing texts have a score like others. A
    score that equals the limit stays. Without labels of both kinds the score is their share, one half without any.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), GOOD)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group with the same bytes stays, that of the largest id.

    All empty and missing texts are one group. Of rows that repeat id and text one stays; rows without an id stay only
    where no row of their group has one.
    """
    return exact.drop_duplicates(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component stays, that of the smallest id.

    Texts without words have fingerprint zero and are linked like any other. A component without any id stays whole, and
    rows that repeat the id that stays leave one row.
    """
    return simhash.drop_near_duplicates(docs, shingle=3, bits=2)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage stay.

    Every row is judged by its text alone; empty and missing texts hold no passage, benchmark rows without id or text are
    no passages, and an empty benchmark removes nothing.
    """
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document: one row per row, no ids and digests of nothing for an empty text."""
    return bpe.digests(docs, WORD_BPE)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", without_leaks),
    ("BPE encoding and decoding", tokens),
]

#: A learned filter and fingerprints are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
