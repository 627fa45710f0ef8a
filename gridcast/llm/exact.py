"""Exact deduplication by a 128-bit content hash, with bytes compared inside every hash group.

Everything here is DataFrame functions. Grouping on (hash, text) compares bytes only where hashes agree, and it
combines before the shuffle, so a text that a third of the rows share arrives as one row per task. Rows are then mapped
to their group over narrow columns; that join is left to adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import fresh, whole
from gridcast.session import snapshot


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def duplicate_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a missing text is an empty one. Of equal texts the row with the smallest
    (or largest) key stays. Rows that repeat a key and its text are one document: all of them carry the same answer,
    and group_size counts rows. A row without a key stays only where its whole group has none; keep_id is then null.
    An empty table gives an empty result; other columns are ignored. Where different texts share a hash (``hashed``
    can be replaced to test this), their rows are told apart by the text itself.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t")).select("id", "t", hashed(F.col("t")).alias("h"))

    def by_bytes(of: DataFrame) -> DataFrame:
        return of.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    groups = snapshot(
        by_bytes(rows).select("h", "keep_id", "group_size", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
    )
    clashes = snapshot(groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h"))
    if clashes.isEmpty():
        found = rows.select("id", "h").join(groups, "h")
    else:
        clear = groups.join(clashes, "h", "left_anti")
        mixed = rows.join(clashes, "h", "left_semi")
        texts = by_bytes(mixed).withColumn("text_sha256", F.sha2(F.col("t").cast("binary"), 256))
        told = mixed.join(texts, ["h", "t"]).select("id", "keep_id", "group_size", "text_sha256")
        found = rows.select("id", "h").join(clear, "h").select("id", "keep_id", "group_size", "text_sha256").unionByName(told)
    return found.select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row per distinct text, all columns kept; the row that stays is that of ``duplicate_groups``.

    Texts travel by key, not by content, so a hot text does not meet in one task.
    """
    digest, = fresh(docs, "digest")
    stay = duplicate_groups(docs, key, text, keep).filter("kept").select(F.col(key).alias("id_"), F.col("text_sha256").alias("sha_"))
    marked = docs.withColumn(digest, F.sha2(whole(text).cast("binary"), 256))
    same = marked[key].eqNullSafe(stay["id_"]) & (marked[digest] == stay["sha_"])
    return marked.join(stay.distinct(), same, "left_semi").dropDuplicates([key, digest]).select(*docs.columns)
