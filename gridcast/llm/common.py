"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the documents no model may learn from: crc32 of the id as text divides by ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def map_keyed(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], kinds: str) -> DataFrame:
    """``fn`` over batches of ``rows`` without their first column, the key, which never leaves Arrow.

    pandas would make floats of a batch of integer keys with a gap, and so change large ones. ``fn`` takes a frame and
    returns one with the columns of ``kinds``; its index tells by number which rows of the batch its rows belong to.
    """
    key = rows.schema.fields[0]
    kind = T.StructType([key, *T.DataType.fromDDL(kinds).fields])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_arrays(batch.columns[1:], batch.schema.names[1:])
            out = fn(rest.to_pandas())
            keys = batch.column(0).take(pa.array(out.index.to_numpy(np.int64, copy=True)))
            found = pa.Table.from_arrays(
                [keys.cast(target.field(0).type), *[pa.Array.from_pandas(out[f.name], type=f.type) for f in list(target)[1:]]], schema=target
            )
            yield from found.combine_chunks().to_batches()

    return rows.mapInArrow(run, kind)
