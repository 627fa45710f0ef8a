"""Point detections and validated events."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.calendar import event_instant
from gridcast.functions.coerce import to_day, to_number
from gridcast.functions.grid import cell_index
from gridcast.operators.cells import bbox_filter, drop_incomplete, locate
from gridcast.operators.checks import require_columns
from gridcast.schemas import DETECTION_OPTIONAL, DETECTION_REQUIRED


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text: one line is read for the names, none for inference.

    Files of a folder must agree in the order of their columns; a file that does not fails instead of being misread.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def file_headers(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Column names of every CSV file at ``path`` (a file, folder or pattern), from its first line alone.

    The files are listed by Spark's own reader and opened through its file systems one after the other, plain or packed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for row in spark.read.format("binaryFile").load(path).filter("length > 0").select("path").collect():
        at = jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            line = (lines.readLine() or "").removeprefix("\ufeff")
        finally:
            stream.close()
        out[row["path"]] = tuple(n.strip() for n in next(csv.reader([line]), []))
    return out


def read_mixed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose headers differ in order or content, every column as text; a column that a file lacks is NULL there.

    Files are grouped by header and every group is read with its own, so as many scans as there are headers. Columns keep
    the order in which the headers, sorted, name them first.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in sorted(file_headers(spark, path).items()):
        groups.setdefault(names, []).append(file)
    parts = [
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).option("enforceSchema", False).csv(files)
        for names, files in sorted(groups.items())
    ]
    if not parts:
        raise ValueError(f"no CSV file with a header at {path}")
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)


def parse_detections(raw: DataFrame) -> DataFrame:
    """Text columns to typed, located detections inside the study area. Absent optional columns are tolerated."""
    require_columns(raw, DETECTION_REQUIRED)
    carried = [c for c in raw.columns if c not in DETECTION_REQUIRED]
    typed = raw.select(
        *carried,
        *[to_number(F.col(c)).alias(c) for c in ("latitude", "longitude", "acq_time", "frp")],
        to_day(F.col("acq_date")).alias("acq_date"),
        "confidence",
    )
    return locate(bbox_filter(drop_incomplete(typed, ["latitude", "longitude", "acq_date", "acq_time"])))


def scan_detections(spark: SparkSession, path: str) -> DataFrame:
    """CSV export to located detections; only the known columns are kept, so the reader parses no others.

    The files of a folder may differ in the order of their columns, and in which optional ones they have.
    """
    raw = read_mixed_csv(spark, path)
    known = [c for c in raw.columns if c in DETECTION_REQUIRED + DETECTION_OPTIONAL]
    return parse_detections(raw.select(*known))


def validate_events(raw: DataFrame) -> DataFrame:
    """Required columns checked, four coercions, incomplete rows dropped, event time derived."""
    required = ("grid_lat", "grid_lon", "acq_date", "hour")
    require_columns(raw, required)
    carried = [c for c in raw.columns if c not in required]
    typed = raw.select(
        *carried,
        *[to_number(F.col(c)).alias(c) for c in ("grid_lat", "grid_lon", "hour")],
        to_day(F.col("acq_date")).alias("acq_date"),
    )
    whole = drop_incomplete(typed, required).withColumn("hour", F.col("hour").cast("int"))
    return whole.select(
        "*",
        cell_index(F.col("grid_lat")).alias("cell_y"),
        cell_index(F.col("grid_lon")).alias("cell_x"),
        event_instant(F.col("acq_date"), F.col("hour")).alias("event_time"),
    )


def head_events(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` events of an explicit order (top-n per partition, merged)."""
    return events.orderBy(*order).limit(n)


def scan_events_validated(spark: SparkSession, path: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    events = validate_events(read_text_csv(spark, path))
    return events if n is None else head_events(events, n, order or ["event_time", "cell_y", "cell_x"])
