"""Grid keys. Cells are integers (tenths of a degree), so equal cells always compare equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS_PER_DEGREE = 10
BLOCK_DEGREES = 2


def cell_index(degrees: Column) -> Column:
    """Nearest 0.1 degree, ties to the even index. Divides by 0.1: 0.35 / 0.1 and 0.35 * 10 round differently."""
    return F.rint(degrees / F.lit(0.1)).cast("int")


def cell_degrees(index: Column) -> Column:
    return F.round(index / F.lit(float(CELLS_PER_DEGREE)), 1)


def hour_of(hhmm: Column) -> Column:
    """Hour of an HHMM number, held inside 0..23."""
    return F.least(F.greatest(F.floor(hhmm / 100), F.lit(0)), F.lit(23)).cast("int")


def block_key(cell_y: Column, cell_x: Column, degrees: int = BLOCK_DEGREES) -> Column:
    span = degrees * CELLS_PER_DEGREE
    return F.concat_ws(
        "_", F.floor(cell_y / span).cast("int").cast("string"), F.floor(cell_x / span).cast("int").cast("string")
    )


def point_label(latitude: Column, longitude: Column, instant: Column) -> Column:
    """Signed, zero-padded coordinates plus the UTC hour: the name of one point extract."""
    return F.concat_ws(
        "_",
        F.format_string("%+07.2f", latitude),
        F.format_string("%+08.2f", longitude),
        F.date_format(instant, "yyyyMMddHH"),
    )
