"""Hourly weather payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.weather import explode_hourly
from gridcast.sources.json_ranges import RANGE, array_elements


def scan_hourly(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Files of one JSON document each (an object or a list of objects); ``source`` is the file name.

    Large lists are read by several tasks, by byte ranges, and their objects parsed one by one: an object that is
    unreadable gives no rows by itself. Packed files cannot be read in parts; each is one task.
    """
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|snappy|lz4|deflate)$")
    names = spark.read.format("binaryFile").load(path).select("path").filter(packed)
    elements = array_elements(spark, path, range_bytes).filter(~packed)
    plain = explode_hourly(elements.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.col("place").alias("_at"), "element"), ["source", "_at"], "element")
    out = plain.drop("place").withColumnRenamed("_at", "place")
    out = out.select("source", "place", *[c for c in out.columns if c not in ("source", "place")])
    if names.isEmpty():
        return out
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )
    return out.unionByName(explode_hourly(documents.filter(packed), ["source"]))
