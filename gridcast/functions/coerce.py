"""Text to typed value; whatever cannot be read becomes NULL (never NaN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, removed from both ends (a plain ``trim`` would leave tabs and line ends).
WHITE_SPACE = " \t\n\x0b\f\r"
#: A plain cast would take '1d' as 1.0 and 'nan' as NaN; only text made of these characters is tried.
NUMBER_CHARACTERS = "0123456789+-.eE"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_lower(text: Column) -> Column:
    return F.lower(strip(text))


def to_number(text: Column) -> Column:
    bare = strip(text.cast("string"))
    foreign = F.translate(bare, NUMBER_CHARACTERS, "")
    return F.when(foreign == "", bare.try_cast("double"))


#: A plain cast would take a year alone, or a date followed by anything, as a date.
DAY = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def to_day(text: Column) -> Column:
    """The day of a date or of a date with a time; any other text is NULL."""
    bare = strip(text.cast("string"))
    return F.when(bare.rlike(DAY), F.substring_index(F.substring_index(bare, " ", 1), "T", 1).try_cast("date"))


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(value) < float("inf"), value)


def missing(df: DataFrame, name: str) -> Column:
    """NULL or, in a floating-point column, NaN: tables written by other libraries mark gaps either way."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def to_utc(text: Column) -> Column:
    """Instant from text: a zone suffix is converted, text without one is UTC already (session zone is UTC)."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def confidence_score(text: Column) -> Column:
    # fixed values: low / nominal / high
    level = strip_lower(text)
    return F.when(level == "l", 0.25).when(level == "n", 0.5).when(level == "h", 1.0)
