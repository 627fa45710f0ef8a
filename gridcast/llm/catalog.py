"""Named queries of this package with their DuckDB texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import alignment, bpe, exact, html, language, leaks, pages, quality, rollup, shingle_join, simhash, spelling, substrings, warc
from gridcast.llm.common import held_out, table
from gridcast.session import shared_dir, snapshot

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html.train(pages.labelled_pages()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Documents scored below this are rejected.
GOOD = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= GOOD).cast("int").alias("predicted")
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=200)


#: Batches that documents arrive in, dealt by hash of the id
BATCHES = 4
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through inserts, deletes and revisions.

    Documents are inserted in batches before their language is known, one batch is deleted again, and then every document
    is revised with its language, which brings the deleted ones back. The first batch arrives twice and counts once.
    """
    counted = snapshot(rollup.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, "byte_bpe_50k"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    nameless = counted.withColumn("lang", F.lit(None).cast("string"))
    kept = rollup.Rollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    for n in range(BATCHES):
        kept.commit(nameless.filter(part == n).withColumn("action", F.lit("insert")), f"documents-{n}")
    kept.commit(nameless.filter(part == 1).withColumn("action", F.lit("delete")), "withdrawn-1")
    for n in range(BATCHES):
        kept.commit(counted.filter(part == n).withColumn("action", F.lit("revise")), f"languages-{n}")
    kept.commit(nameless.filter(part == 0).withColumn("action", F.lit("insert")), "documents-0")
    return kept.totals()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least=0)


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), PIECES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least=6, times=5, drop_every=199, factor=5)


OP9_SQL = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, sha256(t) as text_sha256
      from (select doc_id, coalesce(text, '') as t from documents) window g as (partition by t))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_shingle_join": op11_shingle_join,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {"op9_exact_dedup": OP9_SQL}
