"""Putting the labelled weather dataset together: cache lookups, request planning, joins and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.calendar import days_in_month, event_instant, week_start
from gridcast.functions.grid import cell_degrees, point_label
from gridcast.operators.cells import drop_incomplete
from gridcast.operators.dedupe import dedupe_last
from gridcast.schemas import CELL_HOUR, WEATHER_FEATURES
from gridcast.sinks.tables import write_bucketed

REQUEST_SIZE = 5


def missing_keys(wanted: DataFrame, cache: DataFrame, keys: Sequence[str] = CELL_HOUR) -> DataFrame:
    """Distinct wanted keys the cache does not hold."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), list(keys), "left_anti")


def week_coordinates(keys: DataFrame) -> DataFrame:
    """Distinct (week, cell) of the keys."""
    return keys.select(week_start(F.col("acq_date")).alias("week"), "cell_y", "cell_x").distinct()


def request_batches(keys: DataFrame, size: int = REQUEST_SIZE) -> DataFrame:
    """Each week's coordinates with request number and place in the request.

    A week holds every grid cell at most once, so a rank per week is bounded by the grid, not by the rows.
    """
    rank = F.row_number().over(W.partitionBy("week").orderBy("cell_y", "cell_x")) - 1
    return week_coordinates(keys).select(
        "week", F.floor(rank / size).cast("int").alias("batch"), (rank % size).alias("place"), "cell_y", "cell_x"
    )


def fetch_manifest(keys: DataFrame, size: int = REQUEST_SIZE) -> DataFrame:
    """One row per request: at most ``size`` coordinates and the dates they need (week before to week end)."""
    label = F.format_string("%.1f:%.1f", cell_degrees(F.col("cell_y")), cell_degrees(F.col("cell_x")))
    listed = F.sort_array(F.collect_list(F.struct("place", label.alias("label"))))
    return (
        request_batches(keys, size)
        .groupBy("week", "batch")
        .agg(F.count(F.lit(1)).alias("n"), listed.alias("_list"))
        .select(
            "week",
            "batch",
            "n",
            F.concat_ws(",", F.transform("_list", lambda e: e["label"])).alias("coordinates"),
            F.date_sub("week", 7).alias("start_date"),
            F.date_add("week", 6).alias("end_date"),
        )
    )


def zip_request_payload(requests: DataFrame, payloads: DataFrame, request: Sequence[str] = ("week", "batch")) -> DataFrame:
    """Pair the i-th coordinate of a request with the i-th payload of its answer.

    Both arrays are bounded by the request size; a request without an answer gives no rows.
    """
    asked = requests.select(*request, F.posexplode("coordinates").alias("place", "coordinate"))
    answered = payloads.select(*request, F.posexplode("payloads").alias("place", "payload"))
    return asked.join(answered, [*request, "place"])


def match_block_keys(fetched: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys served by a fetched (week, cell): an equi join, so no coordinate is compared with every key."""
    return keys.withColumn("week", week_start(F.col("acq_date"))).join(fetched, ["week", "cell_y", "cell_x"])


def block_range_join(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys dated from 7 days before to 6 days after a block's week start, same cell.

    A date lies in exactly two such ranges (its own week and the next), so each key states both candidate weeks
    and the range test becomes an equi join on (cell, week): no scan of a whole cell, at most two rows per key.
    """
    own = week_start(F.col("acq_date"))
    candidates = keys.withColumn("week", F.explode(F.array(own, F.date_add(own, 7))))
    return candidates.join(blocks, ["week", "cell_y", "cell_x"])


def attach_weather(
    observations: DataFrame,
    features: DataFrame,
    keys: Sequence[str] = CELL_HOUR,
    columns: Sequence[str] = WEATHER_FEATURES,
    version: Sequence[str] = (),
) -> DataFrame:
    """Observations with the weather of their key; unmatched rows drop out, repeated observations stay.

    A key that ``features`` repeats counts once, with the row highest in ``version`` (without one, in the values), so
    no observation is multiplied. The one row per key is exchanged anew for the join: only so can adaptive skew-join
    handling split a key that many observations share.
    """
    wanted = features.select(*keys, *columns, *[v for v in version if v not in (*keys, *columns)])
    single = dedupe_last(wanted, keys, version or columns)
    return observations.join(single.select(*keys, *columns).hint("rebalance"), list(keys))


def store_weather(
    features: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = CELL_HOUR, columns: Sequence[str] = WEATHER_FEATURES, version: Sequence[str] = ()
) -> None:
    """Store one row per key, bucketed and sorted by key, for joins that come again and again.

    All parts of the key decide the bucket, so a cell or an hour with many rows is spread over all of them.
    """
    wanted = features.select(*keys, *columns, *[v for v in version if v not in (*keys, *columns)])
    write_bucketed(dedupe_last(wanted, keys, version or columns).select(*keys, *columns), name, path, keys, buckets)


def attach_stored(observations: DataFrame, name: str, keys: Sequence[str] = CELL_HOUR) -> DataFrame:
    """As ``attach_weather`` (and, keyed by cell and hour, ``weather_at``) with a series from ``store_weather``.

    Only the observations are exchanged. A single key that very many of them share stays one task here, because stored
    buckets cannot be dealt anew; for such tables ``attach_weather`` is the way.
    """
    stored = observations.sparkSession.table(name)
    return observations.join(stored.hint("merge"), list(keys))


def labelled_dataset(observations: DataFrame, features: DataFrame, keys: Sequence[str] = CELL_HOUR) -> DataFrame:
    """Complete cases with calendar columns."""
    joined = drop_incomplete(attach_weather(observations, features, keys), [*WEATHER_FEATURES, "fire"])
    return joined.withColumns({"year": F.year("acq_date"), "month": F.month("acq_date")})


def upsert_features(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Cache content after a batch: a new row replaces the old one of its key, later rows win within a batch."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return dedupe_last(both, keys, ["_batch", *version]).drop("_batch")


def event_windows(events: DataFrame, days: int = 7) -> DataFrame:
    """Extract list for point series: name, coordinates and the dates from ``days`` before the event to its day."""
    lat, lon = cell_degrees(F.col("cell_y")), cell_degrees(F.col("cell_x"))
    at = event_instant(F.col("acq_date"), F.col("hour"))
    return events.select(
        point_label(lat, lon, at).alias("extract"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        at.alias("event_time"),
        F.to_date(at - F.make_dt_interval(F.lit(days))).alias("start_date"),
        F.to_date(at).alias("end_date"),
    )


def period_gaps(
    present: DataFrame, first_year: int, last_year: int, first_month: int = 1, limit: int | None = None
) -> DataFrame:
    """Calendar months without data, in order, with their number of days.

    The calendar has twelve rows per year; ``present`` is reduced to its distinct months first.
    """
    spark = present.sparkSession
    months = F.sequence(F.make_date(F.lit(first_year), F.lit(first_month), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(1)), F.expr("interval 1 month"))
    expected = spark.range(1).select(F.explode(months).alias("_m")).select(
        F.year("_m").alias("year"), F.month("_m").alias("month"), days_in_month(F.col("_m")).alias("days")
    )
    gaps = expected.join(present.select("year", "month").distinct(), ["year", "month"], "left_anti")
    if limit is None:
        return gaps
    return gaps.orderBy("year", "month").limit(limit)
