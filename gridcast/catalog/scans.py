"""Sources, scalar functions, filters and checks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from gridcast.catalog.views import OBSERVATION_KEYS, Query, Views, oracle
from gridcast.functions import calendar, coerce, grid, rates
from gridcast.operators import cells, checks, holdout, profiles, weather
from gridcast.schemas import INSTANT
from gridcast.session import shared_dir
from gridcast.sources.dataset import normalise_cache, parse_dataset
from gridcast.sources.detections import head_events, parse_detections, read_mixed_csv, validate_events

NUMBER = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"

TYPED_RAW = f"""
select det_id,
       case when regexp_matches(latitude, {NUMBER}) then latitude::double end as latitude,
       longitude::double as longitude, try_cast(acq_date as date) as acq_date,
       case when regexp_matches(acq_time, {NUMBER}) then acq_time::int end as acq_time, confidence, frp::double as frp
from detections_raw
"""


_LOCATED = ("latitude", "longitude", "acq_date", "hour", "frp", "cell_y", "cell_x", "confidence_score")

LOCATED = """
select *, cast(round_even(latitude / 0.1::double, 0) as int) as cell_y,
       cast(round_even(longitude / 0.1::double, 0) as int) as cell_x,
       cast(least(greatest(acq_time // 100, 0), 23) as int) as hour,
       case lower(trim(confidence)) when 'l' then 0.25::double when 'n' then 0.5::double when 'h' then 1.0::double end
         as confidence_score
from typed where latitude between 6 and 37 and longitude between 68 and 98 and acq_date is not null and acq_time is not null
"""


def _scan_detections(v: Views):
    return parse_detections(v.detections_raw()).select("det_id", *_LOCATED)


def _scan_files(v: Views):
    """The raw detections as CSV files of three headers: other orders, and one without an optional column."""
    raw = v.detections_raw()
    folder = f"{shared_dir(v.spark).rstrip('/')}/detections-{uuid.uuid4().hex}"
    orders = [raw.columns, [*reversed(raw.columns)], ["frp", *[c for c in raw.columns if c != "frp"], "satellite"]]
    for n, names in enumerate(orders):
        part = raw.filter(F.pmod("det_id", F.lit(3)) == n).withColumn("satellite", F.lit("N")).select(*names)
        part.write.option("header", True).mode("append").csv(folder)
    found = parse_detections(read_mixed_csv(v.spark, folder))
    return found.select(F.col("det_id").cast("long").alias("det_id"), *_LOCATED, F.col("satellite").isNotNull().alias("has_satellite"))


def _dataset_text(v: Views):
    o = v.observations()
    text = [F.col(c).cast("string").alias(c) for c in ("hour", "fire", "temp_1d", "rh_1d", "acq_date")]
    year = F.when(F.col("l_orderkey") % 31 == 0, "n/a").otherwise(F.col("year").cast("string")).alias("year")
    return o.select(*[k for k in OBSERVATION_KEYS if k != "acq_date"], *text, year)


def _events_text(v: Views):
    d = v.detections()
    return d.select(
        "det_id",
        F.when(F.col("det_id") % 47 == 0, "north").otherwise(F.col("latitude").cast("string")).alias("grid_lat"),
        F.col("longitude").cast("string").alias("grid_lon"),
        F.when(F.col("det_id") % 43 == 0, "2024-13-01").otherwise(F.col("acq_date").cast("string")).alias("acq_date"),
        grid.hour_of(F.col("acq_time")).cast("string").alias("hour"),
    )


VALID_EVENTS = """
select det_id, latitude as grid_lat, longitude as grid_lon, acq_date,
       cast(least(greatest(acq_time // 100, 0), 23) as int) as hour
from detections where det_id % 47 <> 0 and det_id % 43 <> 0
"""


def _scan_events(v: Views):
    return validate_events(_events_text(v)).drop("cell_y", "cell_x")


def _head_events(v: Views):
    return head_events(_scan_events(v), 500, ["event_time", "det_id"])


def _payloads(v: Views):
    """Payload text per request (five coordinates of a week), in odd weeks one object per coordinate, else a list.

    Some coordinates are replaced by an error, and some temperatures by text that is no number.
    """
    week = F.date_trunc("week", "hour_ts").cast("date")
    reading = F.struct("hour_ts", *INSTANT)
    docs = v.hourly().groupBy("cell", week.alias("week")).agg(F.sort_array(F.collect_list(reading)).alias("r"))
    stamp = F.transform("r", lambda r: F.date_format(r["hour_ts"], "yyyy-MM-dd'T'HH:mm"))
    broken = F.col("cell") % 7 == 3
    warm = F.transform("r", lambda r: F.when(broken & (F.hour(r["hour_ts"]) == 5), "x").otherwise(r["temperature_2m"].cast("string")))
    rest = [F.col(f"r.{c}").alias(c) for c in INSTANT if c != "temperature_2m"]
    hourly = F.struct(stamp.alias("time"), warm.alias("temperature_2m"), *rest)
    body = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    failed = ((F.col("cell") + F.weekofyear("week")) % 11) == 0
    text = F.when(failed, F.lit(json.dumps({"error": True}))).otherwise(body)
    odd = (F.weekofyear("week") % 2) == 1
    one = docs.select("week", F.floor(F.col("cell") / 5).cast("int").alias("batch"), "cell", text.alias("body"))
    listed = one.filter(~odd).groupBy("week", "batch").agg(F.sort_array(F.collect_list(F.struct("cell", "body"))).alias("l"))
    joined = F.concat(F.lit("["), F.concat_ws(",", F.col("l.body")), F.lit("]"))
    lists = listed.select("week", "batch", F.lit(-1).alias("single"), joined.alias("payload"))
    return lists.unionByName(one.filter(odd).select("week", "batch", F.col("cell").alias("single"), F.col("body").alias("payload")))


def _cache_rows(v: Views):
    d = v.detections()
    lat, lon = grid.cell_index(F.col("latitude")), grid.cell_index(F.col("longitude"))
    return d.select(
        (lat * F.lit(0.1)).alias("grid_lat"),
        grid.cell_degrees(lon).alias("grid_lon"),
        F.col("acq_date").cast("string").alias("acq_date"),
        grid.hour_of(F.col("acq_time")).cast("long").alias("hour"),
        F.col("det_id").alias("version"),
        "frp",
    )


def _scalar_kit(v: Views):
    raw = v.detections_raw()
    padded = F.concat(F.lit(" \t"), F.coalesce("confidence", F.lit("")), F.lit("\n"))
    stamp = F.concat(F.coalesce("acq_date", F.lit("")), F.lit("T03:15:00+05:30"))
    naive = F.concat(F.coalesce("acq_date", F.lit("")), F.lit(" 03:15:00"))
    day = coerce.to_day(F.col("acq_date"))
    number = coerce.to_number(F.col("latitude"))
    return raw.select(
        "det_id",
        number.alias("number"),
        coerce.to_number(F.concat("acq_time", F.lit("d"))).alias("suffixed"),
        coerce.to_number(F.when(F.col("det_id") % 3 == 0, "nan").otherwise(F.concat(F.lit(" "), "longitude"))).alias("not_nan"),
        day.alias("day"),
        coerce.strip_lower(padded).alias("level"),
        coerce.to_utc(stamp).alias("zoned"),
        coerce.to_utc(naive).alias("naive"),
        calendar.day_label(day).alias("label"),
        F.date_trunc("month", day).cast("date").alias("month_start"),
        calendar.week_start(day).alias("week"),
        calendar.days_in_month(day).alias("month_days"),
        F.round(rates.ratio(number, (F.col("det_id") % 4).cast("double")), 6).alias("ratio"),
    )


SCALAR_KIT = f"""
select det_id,
  case when regexp_matches(latitude, {NUMBER}) then latitude::double end as number, null::double as suffixed,
  case when det_id % 3 <> 0 then longitude::double end as not_nan, try_cast(acq_date as date) as day,
  lower(trim(coalesce(confidence, ''))) as level,
  try_cast(acq_date as date)::timestamp - interval '2 hours 15 minutes' as zoned,
  try_cast(acq_date as date)::timestamp + interval '3 hours 15 minutes' as naive,
  try_cast(acq_date as date)::varchar as label, date_trunc('month', try_cast(acq_date as date))::date as month_start,
  date_trunc('week', try_cast(acq_date as date))::date as week,
  day(last_day(try_cast(acq_date as date)))::int as month_days,
  round(case when det_id % 4 = 0 or not regexp_matches(latitude, {NUMBER}) then 0
             else try_cast(latitude as double) / (det_id % 4)::double end, 6) as ratio
from detections_raw
"""


def _event_time(v: Views):
    hour = grid.hour_of(F.col("acq_time"))
    return v.detections().select("det_id", calendar.event_instant(F.col("acq_date"), hour).alias("event_time"))


def _bbox(v: Views):
    return cells.bbox_filter(v.detections()).select("det_id", "latitude", "longitude")


def _drop_incomplete(v: Views):
    return cells.drop_incomplete(v.detections(), ["confidence", "frp"]).select("det_id", "confidence", "frp")


def _temporal_split(v: Views):
    return holdout.temporal_split(v.observations()).select(*OBSERVATION_KEYS, "year", "split")


def _require_checks(v: Views):
    o = holdout.temporal_split(v.observations())
    return checks.violations(
        o,
        columns=["fire", "temp_1d", "soil_1d"],
        complete=["temp_1d", "rh_1d", "wind_1d"],
        years=[2018, 2023, 2024, 2025],
        splits=["train", "validation", "test"],
    )


def _violations(**wanted):
    return lambda v: checks.violations(holdout.temporal_split(v.observations()), **wanted)


def _exclude_leakage(v: Views):
    table = cells.fire_cells(cells.locate(cells.bbox_filter(v.detections())))
    return checks.exclude_leakage(table, ["hour", "month", "cell_y", "cell_x"])


def _spatial_blocks(v: Views):
    return holdout.with_block(v.observations()).select(*OBSERVATION_KEYS, "block")


def _distinct(source: str, *columns: str):
    def build(v: Views):
        if source == "detections":
            return profiles.distinct_rows(cells.locate(cells.bbox_filter(v.detections())), columns)
        return profiles.distinct_rows(holdout.with_block(v.observations()), columns)

    return build


KEYS = ", ".join(OBSERVATION_KEYS)

QUERIES = {
    "scan_detections": Query(
        _scan_detections,
        oracle(f"select det_id, {', '.join(_LOCATED)} from located", "detections_raw", typed=TYPED_RAW, located=LOCATED),
    ),
    "scan_detection_files": Query(
        _scan_files,
        oracle(
            f"select det_id, {', '.join(_LOCATED)}, det_id % 3 = 2 as has_satellite from located",
            "detections_raw",
            typed=TYPED_RAW,
            located=LOCATED,
        ),
    ),
    "scan_dataset": Query(
        lambda v: parse_dataset(_dataset_text(v), ["temp_1d", "rh_1d"]),
        oracle(
            """select l_orderkey, l_linenumber, l_partkey, l_suppkey, hour, fire, temp_1d, rh_1d, acq_date,
                      case when l_orderkey % 31 <> 0 then year end as year from observations""",
            "observations",
        ),
    ),
    "scan_events_validated": Query(
        _scan_events,
        oracle(
            "select *, acq_date::timestamp + to_hours(hour) as event_time from valid", "detections", valid=VALID_EVENTS
        ),
    ),
    "head_events": Query(
        _head_events,
        oracle(
            "select *, acq_date::timestamp + to_hours(hour) as event_time from valid order by event_time, det_id limit 500",
            "detections",
            valid=VALID_EVENTS,
        ),
    ),
    "explode_hourly": Query(
        lambda v: weather.explode_hourly(_payloads(v), ["week", "batch", "single"]),
        oracle(
            """select * exclude (cell) replace (case when cell % 7 = 3 and hour(hour_ts) = 5 then null else temperature_2m end as temperature_2m)
               from (select *, date_trunc('week', hour_ts)::date as week, cell // 5 as batch,
                            case when weekofyear(hour_ts) % 2 = 1 then cell else -1 end as single,
                            case when weekofyear(hour_ts) % 2 = 1 then 0
                                 else dense_rank() over (partition by date_trunc('week', hour_ts), cell // 5 order by cell) - 1 end::int as place
                     from hourly)
               where (cell + weekofyear(hour_ts)) % 11 <> 0""",
            "hourly",
        ),
    ),
    "read_feature_cache": Query(
        lambda v: normalise_cache(_cache_rows(v), ["version"]),
        oracle(
            """select cell_y, cell_x, acq_date, hour, max(version) as version, arg_max_null(frp, version) as frp from (
               select cast(round_even(latitude / 0.1::double, 0) as int) as cell_y,
                      cast(round_even(longitude / 0.1::double, 0) as int) as cell_x, acq_date,
                      cast(least(greatest(acq_time // 100, 0), 23) as int) as hour, det_id as version, frp
               from detections) group by all""",
            "detections",
        ),
    ),
    "scalar_kit": Query(_scalar_kit, oracle(SCALAR_KIT, "detections_raw")),
    "event_time": Query(
        _event_time,
        oracle(
            """select det_id, acq_date::timestamp + to_hours(least(greatest(acq_time // 100, 0), 23)::int) as event_time
               from detections""",
            "detections",
        ),
    ),
    "bbox_filter": Query(
        _bbox,
        oracle(
            """select det_id, latitude, longitude from detections
               where latitude >= 6 and latitude <= 37 and longitude >= 68 and longitude <= 98""",
            "detections",
        ),
    ),
    "drop_incomplete": Query(
        _drop_incomplete,
        oracle(
            "select det_id, confidence, frp from detections where confidence is not null and frp is not null", "detections"
        ),
    ),
    "temporal_split": Query(
        _temporal_split,
        oracle(
            f"""select {KEYS}, year, case when year <= 2023 then 'train' when year <= 2024 then 'validation'
                     when year <= 2025 then 'test' end as split from observations""",
            "observations",
        ),
    ),
    "require_checks": Query(
        _require_checks,
        oracle(
            """select 'column' as "check", 'fire' as subject, 0::bigint as violations
               union all select 'column', 'temp_1d', 0 union all select 'column', 'soil_1d', 1
               union all select 'complete', 'temp_1d', count(*) filter (temp_1d is null) from observations
               union all select 'complete', 'rh_1d', count(*) filter (rh_1d is null) from observations
               union all select 'complete', 'wind_1d', count(*) filter (wind_1d is null) from observations
               union all select 'year', y::varchar, (select (count(*) = 0)::bigint from observations where year = y)
                         from unnest([2018, 2023, 2024, 2025]) t(y)
               union all select 'nonempty', 'train', (count(*) = 0)::bigint from observations where year <= 2023
               union all select 'nonempty', 'validation', (count(*) = 0)::bigint from observations where year = 2024
               union all select 'nonempty', 'test', (count(*) = 0)::bigint from observations where year = 2025""",
            "observations",
        ),
    ),
    "require_columns": Query(
        _violations(columns=["fire", "temp_1d", "soil_1d"]),
        oracle(
            """select 'column' as "check", c as subject,
                      (select count(*) = 0 from (describe observations) where column_name = c)::bigint as violations
               from unnest(['fire', 'temp_1d', 'soil_1d']) t(c)""",
            "observations",
        ),
    ),
    "require_complete": Query(
        _violations(complete=["temp_1d", "rh_1d"]),
        oracle(
            """select 'complete' as "check", 'temp_1d' as subject, count(*) filter (temp_1d is null) as violations from observations
               union all select 'complete', 'rh_1d', count(*) filter (rh_1d is null) from observations""",
            "observations",
        ),
    ),
    "require_years": Query(
        _violations(years=[2018, 2023, 2024, 2025]),
        oracle(
            """select 'year' as "check", y::varchar as subject,
                      (select (count(*) = 0)::bigint from observations where year = y) as violations
               from unnest([2018, 2023, 2024, 2025]) t(y)""",
            "observations",
        ),
    ),
    "require_nonempty": Query(
        _violations(splits=["train", "validation", "test"]),
        oracle(
            """select 'nonempty' as "check", s as subject, (select (count(*) = 0)::bigint from observations
                 where s = case when year <= 2023 then 'train' when year = 2024 then 'validation'
                                when year = 2025 then 'test' end) as violations
               from unnest(['train', 'validation', 'test']) t(s)""",
            "observations",
        ),
    ),
    "exclude_leakage": Query(
        _exclude_leakage, oracle("select cell_y, cell_x, acq_date, hour, fire, year, month from cells", "cells")
    ),
    "spatial_blocks": Query(_spatial_blocks, oracle(f"select {KEYS}, block from blocked", "blocked")),
    "distinct_cells": Query(
        _distinct("detections", "cell_y", "cell_x"), oracle("select distinct cell_y, cell_x from boxed", "boxed")
    ),
    "distinct_dates": Query(
        _distinct("detections", "acq_date"), oracle("select distinct acq_date from boxed", "boxed")
    ),
    "distinct_years": Query(
        _distinct("observations", "year"), oracle("select distinct year from observations", "observations")
    ),
    "distinct_blocks": Query(
        _distinct("observations", "block"), oracle("select distinct block from blocked", "blocked")
    ),
}
