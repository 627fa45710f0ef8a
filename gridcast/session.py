"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the tables behind a balanced snapshot for which it gets a part more than the session shuffles into
PART_BYTES = 16 << 20
#: Setting that deletes the shuffle files of a statement at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "gridcast", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the submitter's own settings are used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRIDCAST_DRIVER_MEMORY", "8g"))
    )
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """The one setting results depend on: instants without a zone are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, where all executors share one disk, may fall back to a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridcast-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """Name of a folder below the shared one that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/gridcast-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for what one function stores, deleted when it ends: nothing that is read later may lie there."""
    folder = new_folder(spark)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_behind(df: DataFrame) -> int:
    """Size of the files and generated rows ``df`` is made from, as the optimizer knows it without a job; 0 if it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Rows sent from the driver have the largest number there is for a size.
    return sum(size for size in sizes if size < (1 << 63) - 1)


def balanced_parts(df: DataFrame) -> int:
    """Parts of a balanced snapshot: as many as the session shuffles into, more where the tables behind ``df`` are large."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-_bytes_behind(df) // PART_BYTES))


def _read_parts(spark: SparkSession, path: str, schema, parts: int) -> DataFrame:
    """The snapshot in ``path``. Where it has more parts than one scan would make tasks of, several scans share them.

    Well compressed parts are small files, of which a scan packs many into one task, however many rows they unfold to.
    A scan makes about as many tasks as there are cores, so each gets that many files.
    """
    # The schema is known: reading it back starts no job to infer it.
    table = spark.read.schema(schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if parts <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores):
        return table
    files = sorted(table.inputFiles())
    scans = [spark.read.schema(schema).parquet(*files[at : at + cores]) for at in range(0, len(files), cores)]
    return reduce(DataFrame.unionAll, scans) if scans else table


def snapshot(df: DataFrame, balanced: bool = False, parts: int = 0, path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder (or in ``path``) and read it back.

    Jobs that scan the same prepared table many times (one fit per model and feature set) then read only the
    columns they need, and a lost executor costs a re-read instead of the whole upstream plan. ``balanced`` deals
    the rows out evenly first, which pays off for tables that iterative fits scan again and again; the number of its
    parts, and of the tasks that read them, follows the size of the tables behind it. ``parts`` says that ``df`` was
    dealt out into so many.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    if balanced:
        parts = balanced_parts(df)
        df = df.repartition(parts)
    # What the write shuffled is deleted when it has ended, not when the driver happens to collect its plan.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return _read_parts(spark, path, df.schema, parts)
