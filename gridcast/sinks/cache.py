"""A feature cache in versioned partitions with a manifest.

Rows live in one folder per batch and week; a manifest names, for every week, the batch whose folder holds it. A batch reads
and rewrites the weeks it has rows for and no others. A new manifest becomes the current one when Spark writes its
``_SUCCESS`` file, which is the last thing a write does: until then readers see the version before, whatever was lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators.assembly import upsert_features

WEEK = "_week"


class FeatureCache:
    """Latest row per key below ``folder``, which every executor reaches. One writer at a time, any number of readers.

    ``at`` is a key column with the date or instant that decides a row's week; rows without one form a part of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, keys: Sequence[str], at: str, version: Sequence[str] = ()):
        self.spark, self.folder, self.keys, self.at, self.version = spark, folder.rstrip("/"), list(keys), at, list(version)
        self.schema = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Batch of every week, of the current version unless told otherwise. As many entries as the calendar has weeks."""
        known = self.versions()
        if not known:
            return {}
        path = f"{self.folder}/manifests/{known[-1] if version is None else version}"
        return {r["week"]: r["batch"] for r in self.spark.read.schema("week string, batch string").parquet(path).collect()}

    def _weeks(self, manifest: dict[str, str]) -> DataFrame:
        """The rows of the weeks in ``manifest``; only their partitions are read."""
        by_batch: dict[str, list[str]] = {}
        for week, batch in manifest.items():
            by_batch.setdefault(batch, []).append(week)
        stored = T.StructType([*self.schema.fields, T.StructField(WEEK, T.StringType())])
        out = self.spark.createDataFrame([], stored)
        for batch, weeks in by_batch.items():
            out = out.unionByName(self.spark.read.schema(stored).parquet(f"{self.folder}/data/{batch}").filter(F.col(WEEK).isin(weeks)))
        return out.drop(WEEK)

    def read(self, version: int | None = None) -> DataFrame:
        return self._weeks(self.manifest(version))

    def touched(self, weeks: Sequence[str]) -> DataFrame:
        """What the cache holds for the named weeks."""
        return self._weeks({w: b for w, b in self.manifest().items() if w in set(weeks)})

    def week_of(self) -> Column:
        return F.coalesce(F.date_format(F.date_trunc("week", F.col(self.at)), "yyyy-MM-dd"), F.lit("none"))

    def upsert(self, new: DataFrame) -> int:
        """Merge a batch: its rows replace those of their keys, later versions win inside it. Returns the new version.

        An empty batch makes a version with the same content.
        """
        known, before = self.versions(), self.manifest()
        rows = new.select(*self.schema.names)
        # One name per week of the batch.
        weeks = [r["w"] for r in rows.select(self.week_of().alias("w")).distinct().collect()]
        batch = f"{len(known)}-{uuid.uuid4().hex}"
        if weeks:
            merged = upsert_features(self.touched(weeks), rows, self.keys, self.version).withColumn(WEEK, self.week_of())
            merged.hint("rebalance", F.col(WEEK)).write.partitionBy(WEEK).parquet(f"{self.folder}/data/{batch}")
        after = before | dict.fromkeys(weeks, batch)
        version = (known[-1] if known else 0) + 1
        table = self.spark.createDataFrame(sorted(after.items()), "week string, batch string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{version}")
        return version
