"""Tables, feature snapshots, reports and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("year",)) -> None:
    """Replace the table at ``path``. Partition columns the table lacks are ignored; CSV gets a header.

    Partitioned tables are rebalanced by partition value first: each value gets files of the advisory size, one
    task per file, so a year with a third of the rows is split and tasks do not each write a file per year.
    """
    present = [c for c in partition_by if c in df.columns] if fmt != "csv" else []
    if present:
        df = df.hint("rebalance", *[F.col(c) for c in present])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if present:
        writer = writer.partitionBy(*present)
    writer.save(path)


def write_snapshot(df: DataFrame, path: str, partition: str = "week") -> None:
    """Replace only the partitions that ``df`` holds (one write per run, other weeks stay untouched).

    ``df`` must not read from ``path`` itself: merge into a stored table first, then write.
    """
    (
        df.hint("rebalance", F.col(partition))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Replace the table ``name``, stored at ``path`` in ``buckets`` parts by hash of ``keys`` and sorted by them.

    Joins on these keys read the parts as they lie: only the other side is exchanged.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def report_row(**sections: DataFrame) -> DataFrame:
    """One-row sections and small tables as one nested JSON document.

    Sections are reports (a row, or a row per model or feature); tables of observations do not belong here.
    """
    names = list(sections)
    spark = sections[names[0]].sparkSession
    fields = []
    for name in names:
        table = sections[name]
        as_list = table.agg(F.to_json(F.collect_list(F.struct(*table.columns))).alias("j"))
        fields.append(F.concat(F.lit(f'"{name}": '), as_list.scalar()))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return spark.range(1).select(body.alias("value"))


def write_report(path: str, **sections: DataFrame) -> None:
    report_row(**sections).coalesce(1).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
