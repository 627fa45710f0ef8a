"""Cells, profiles, deduplication, cache merges and dataset assembly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridcast.catalog.views import OBSERVATION_KEYS, Query, Views, oracle, rounded, rounds
from gridcast.functions import grid
from gridcast.operators import assembly, cells, dedupe, holdout, negatives, profiles, stats, weather
from gridcast.schemas import CELL_HOUR, WEATHER_FEATURES
from gridcast.session import shared_dir
from gridcast.sinks.cache import FeatureCache

#: Weather station of a grid cell: stands in for one series per cell.
STATION = "cast((cell_y * 31 + cell_x) % 50 as int)"


def boxed(v: Views):
    return cells.locate(cells.bbox_filter(v.detections()))


def fire_cells(v: Views):
    return cells.fire_cells(boxed(v))


def _dedupe_rows(v: Views):
    return boxed(v).select(*CELL_HOUR, "det_id", "frp", "confidence_score")


def _cache_batches(v: Views):
    """Cached hours from all readings, and a later batch recomputed for the second half of the month."""
    old = v.hourly().select("cell", "hour_ts", "temperature_2m", "precipitation")
    fresh = (
        v.hourly()
        .filter(F.col("hour_ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
        .select(
            "cell",
            (F.col("hour_ts") + F.expr("interval 6 hours")).alias("hour_ts"),
            F.col("dew_point_2m").alias("temperature_2m"),
            "precipitation",
        )
    )
    return old, fresh


def _upsert(v: Views):
    old, fresh = _cache_batches(v)
    return assembly.upsert_features(old, fresh, ["cell", "hour_ts"])


def _upsert_versions(v: Views):
    """The same two batches through the versioned cache; the second rewrites the weeks it has rows for."""
    old, fresh = _cache_batches(v)
    folder = f"{shared_dir(v.spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    cache = FeatureCache(v.spark, folder, old.schema, ["cell", "hour_ts"], "hour_ts")
    cache.upsert(old)
    cache.upsert(fresh)
    return cache.read()


def _half_cache(v: Views):
    """Keys already cached: cells seen in the first half of the month."""
    return fire_cells(v).filter(F.col("acq_date") < F.lit("2024-01-16").cast("date")).select(*CELL_HOUR)


def _missing(v: Views):
    return assembly.missing_keys(boxed(v), _half_cache(v))


def _manifest(v: Views):
    return assembly.fetch_manifest(_missing(v))


def _answers(v: Views):
    """Answers to the requests: the i-th payload counts the detections at the i-th coordinate in that week."""
    batches = assembly.request_batches(_missing(v))
    found = (
        boxed(v)
        .withColumn("week", F.date_trunc("week", "acq_date").cast("date"))
        .groupBy("week", "cell_y", "cell_x")
        .agg(F.count(F.lit(1)).alias("detections"))
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "cell_y", "cell_x", "detections")))
    rows = batches.join(found, ["week", "cell_y", "cell_x"]).groupBy("week", "batch").agg(listed.alias("l"))
    requests = rows.select("week", "batch", F.transform("l", lambda e: F.struct(e["cell_y"].alias("cell_y"), e["cell_x"].alias("cell_x"))).alias("coordinates"))
    payloads = rows.select("week", "batch", F.transform("l", lambda e: e["detections"]).alias("payloads"))
    return requests, payloads


def _zip(v: Views):
    zipped = assembly.zip_request_payload(*_answers(v))
    return zipped.select("week", "batch", "place", "coordinate.cell_y", "coordinate.cell_x", F.col("payload").alias("detections"))


def _match(v: Views):
    keys = _missing(v)
    fetched = assembly.request_batches(keys)
    return assembly.match_block_keys(fetched, keys).select("week", "batch", *CELL_HOUR)


def _range_join(v: Views):
    keys = fire_cells(v).select(*CELL_HOUR)
    return assembly.block_range_join(assembly.week_coordinates(keys), keys)


def _features_by_key(v: Views):
    features = weather.weather_features(weather.densify_hours(v.hourly()))
    return features.select(
        F.col("cell").alias("station"),
        F.to_date("hour_ts").alias("acq_date"),
        F.hour("hour_ts").alias("hour"),
        *WEATHER_FEATURES,
    )


def _requested(v: Views):
    """Detections as observations (keys repeat), with their station and a label."""
    d = boxed(v).select("det_id", *CELL_HOUR, F.expr(STATION).alias("station"))
    return d.withColumn("fire", (F.col("det_id") % 2).cast("int"))


def _attach(v: Views):
    joined = assembly.attach_weather(_requested(v), _features_by_key(v), ["station", "acq_date", "hour"])
    return rounded(joined, *WEATHER_FEATURES)


def _attach_stored(v: Views):
    name = f"weather_{uuid.uuid4().hex}"
    keys = ["station", "acq_date", "hour"]
    assembly.store_weather(_features_by_key(v), name, f"{shared_dir(v.spark).rstrip('/')}/{name}", 8, keys)
    joined = assembly.attach_stored(_requested(v), name, keys)
    return rounded(joined, *WEATHER_FEATURES)


def _labelled(v: Views):
    dataset = assembly.labelled_dataset(_requested(v), _features_by_key(v), ["station", "acq_date", "hour"])
    return rounded(dataset, *WEATHER_FEATURES)


def _coverage(v: Views):
    requested = _requested(v)
    matched = assembly.labelled_dataset(requested, _features_by_key(v), ["station", "acq_date", "hour"])
    return profiles.coverage_report(requested, matched, CELL_HOUR)


def _union(v: Views):
    """Fire cells with the quiet cell-hours twelve hours later."""
    fires = fire_cells(v)
    shifted = fires.select("cell_y", "cell_x", "acq_date", ((F.col("hour") + 12) % 24).alias("hour"), F.lit(0).alias("fire"))
    return rounded(negatives.case_control_union(fires, negatives.reject_positives(shifted, fires)), "mean_confidence")


def _class_weights(v: Views):
    return stats.class_weights(v.observations())


STAT_COLUMNS = ["temp_1d", "rh_1d", "wind_1d", "score"]


def _feature_stats(v: Views):
    return rounded(stats.feature_stats(v.observations(), STAT_COLUMNS), "median", "mean", "std")


def _gaps(v: Views):
    return assembly.period_gaps(v.observations(), 2018, 2025, limit=10)


KEYS = ", ".join(OBSERVATION_KEYS)
KEY4 = ", ".join(CELL_HOUR)
LABEL = "format('{:.1f}:{:.1f}', cell_y / 10.0::double, cell_x / 10.0::double)"

MISSING = f"""select distinct {KEY4} from boxed
  where ({KEY4}) not in (select ({KEY4}) from cells where acq_date < date '2024-01-16')"""
BATCHES = """
select week, ((r - 1) // 5)::int as batch, ((r - 1) % 5)::int as place, cell_y, cell_x from (
  select *, row_number() over (partition by week order by cell_y, cell_x) as r from (
    select distinct date_trunc('week', acq_date)::date as week, cell_y, cell_x from missing))
"""
REQUESTED = f"select det_id, {KEY4}, {STATION} as station, (det_id % 2)::int as fire from boxed"
ATTACHED = f"""
select r.*, {", ".join(WEATHER_FEATURES)} from requested r
join features f on f.cell = r.station and f.hour_ts = r.acq_date::timestamp + to_hours(r.hour)
"""
COMPLETE = f"select * from attached where {' and '.join(f'{c} is not null' for c in WEATHER_FEATURES)}"
ROUND_WEATHER = rounds(*WEATHER_FEATURES)

QUERIES = {
    "fire_cells": Query(
        lambda v: rounded(fire_cells(v), "mean_confidence"),
        oracle(f"select * replace ({rounds('mean_confidence')}) from cells", "cells"),
    ),
    "dataset_profile": Query(
        lambda v: profiles.dataset_profile(v.observations()),
        oracle(
            """select count(*) as rows, 15::bigint as columns, min(acq_date) as date_min, max(acq_date) as date_max,
                      count(*) filter (fire = 1) as fire_rows, count(*) filter (fire = 0) as nonfire_rows,
                      (select string_agg(year::varchar, ',' order by year) from (select distinct year from observations)) as years
               from observations""",
            "observations",
        ),
    ),
    "split_profile": Query(
        lambda v: profiles.split_profile(holdout.temporal_split(holdout.with_block(v.observations())), "block"),
        oracle(
            """select case when year <= 2023 then 'train' when year <= 2024 then 'validation' when year <= 2025 then 'test' end
                        as split, count(*) as rows, count(distinct block) as groups,
                      round(count(*) / (select count(*) from blocked)::double, 5) as fraction
               from blocked group by all""",
            "blocked",
        ),
    ),
    "missing_profile": Query(
        lambda v: profiles.missing_profile(v.observations(), ["acq_date", "temp_1d", "rh_1d", "wind_1d", "score", "fire"]),
        oracle(
            " union all ".join(
                f"select '{c}' as \"column\", count(*) filter ({c} is null) as missing from observations"
                for c in ("acq_date", "temp_1d", "rh_1d", "wind_1d", "score", "fire")
            ),
            "observations",
        ),
    ),
    "dedupe_first": Query(
        lambda v: dedupe.dedupe_first(_dedupe_rows(v), CELL_HOUR, ["det_id"]),
        oracle(
            f"""select {KEY4}, det_id, frp, confidence_score from boxed
                qualify row_number() over (partition by {KEY4} order by det_id) = 1""",
            "boxed",
        ),
    ),
    "dedupe_last": Query(
        lambda v: dedupe.dedupe_last(_dedupe_rows(v), CELL_HOUR, ["det_id"]),
        oracle(
            f"""select {KEY4}, det_id, frp, confidence_score from boxed
                qualify row_number() over (partition by {KEY4} order by det_id desc) = 1""",
            "boxed",
        ),
    ),
    "upsert_features": Query(
        _upsert,
        oracle(
            """select coalesce(n.cell, o.cell) as cell, coalesce(n.hour_ts, o.hour_ts) as hour_ts,
                      case when n.cell is null then o.temperature_2m else n.temperature_2m end as temperature_2m,
                      case when n.cell is null then o.precipitation else n.precipitation end as precipitation
               from hourly o full join fresh n on o.cell = n.cell and o.hour_ts = n.hour_ts""",
            "hourly",
            fresh="""select cell, hour_ts + interval 6 hours as hour_ts, dew_point_2m as temperature_2m, precipitation
                     from hourly where hour_ts >= timestamp '2024-01-16'""",
        ),
    ),
    "upsert_cache": Query(
        _upsert_versions,
        oracle(
            """select coalesce(n.cell, o.cell) as cell, coalesce(n.hour_ts, o.hour_ts) as hour_ts,
                      case when n.cell is null then o.temperature_2m else n.temperature_2m end as temperature_2m,
                      case when n.cell is null then o.precipitation else n.precipitation end as precipitation
               from hourly o full join fresh n on o.cell = n.cell and o.hour_ts = n.hour_ts""",
            "hourly",
            fresh="""select cell, hour_ts + interval 6 hours as hour_ts, dew_point_2m as temperature_2m, precipitation
                     from hourly where hour_ts >= timestamp '2024-01-16'""",
        ),
    ),
    "missing_keys": Query(_missing, oracle("select * from missing", "cells", missing=MISSING)),
    "fetch_manifest": Query(
        _manifest,
        oracle(
            f"""select week, batch, count(*) as n, string_agg({LABEL}, ',' order by place) as coordinates,
                       (week - 7)::date as start_date, (week + 6)::date as end_date
                from batches group by week, batch""",
            "cells",
            missing=MISSING,
            batches=BATCHES,
        ),
    ),
    "zip_request_payload": Query(
        _zip,
        oracle(
            """select week, batch, place, cell_y, cell_x, count(*) as detections
               from batches join boxed using (cell_y, cell_x)
               where date_trunc('week', acq_date)::date = week group by all""",
            "cells",
            missing=MISSING,
            batches=BATCHES,
        ),
    ),
    "match_block_keys": Query(
        _match,
        oracle(
            f"""select week, batch, {KEY4} from missing join batches using (cell_y, cell_x)
                where date_trunc('week', acq_date)::date = week""",
            "cells",
            missing=MISSING,
            batches=BATCHES,
        ),
    ),
    "block_range_join": Query(
        _range_join,
        oracle(
            f"""select b.week, k.* from (select {KEY4} from cells) k
                join (select distinct date_trunc('week', acq_date)::date as week, cell_y, cell_x from cells) b
                  on k.cell_y = b.cell_y and k.cell_x = b.cell_x and k.acq_date between b.week - 7 and b.week + 6""",
            "cells",
        ),
    ),
    "attach_weather": Query(
        _attach,
        oracle(f"select * replace ({ROUND_WEATHER}) from attached", "boxed", "features", requested=REQUESTED, attached=ATTACHED),
    ),
    "attach_weather_stored": Query(
        _attach_stored,
        oracle(f"select * replace ({ROUND_WEATHER}) from attached", "boxed", "features", requested=REQUESTED, attached=ATTACHED),
    ),
    "labelled_dataset": Query(
        _labelled,
        oracle(
            f"""select * replace ({ROUND_WEATHER}), year(acq_date)::int as year, month(acq_date)::int as month
                from ({COMPLETE})""",
            "boxed",
            "features",
            requested=REQUESTED,
            attached=ATTACHED,
        ),
    ),
    "coverage_report": Query(
        _coverage,
        oracle(
            f"""select (select count(*) from requested) as requested, count(*) as matched,
                       round(count(*) / (select count(*) from requested)::double, 6) as coverage,
                       count(*) filter (fire = 1) as fire_rows, count(*) filter (fire = 0) as nonfire_rows,
                       (select count(*) from (select distinct {KEY4} from requested)) as unique_keys
                from ({COMPLETE})""",
            "boxed",
            "features",
            requested=REQUESTED,
            attached=ATTACHED,
        ),
    ),
    "case_control_union": Query(
        _union,
        oracle(
            f"""select * replace ({rounds('mean_confidence')}) from cells
                union all by name
                (select cell_y, cell_x, acq_date, hour, 0 as fire from (
                   select cell_y, cell_x, acq_date, ((hour + 12) % 24)::int as hour from cells)
                 where ({KEY4}) not in (select ({KEY4}) from cells))""",
            "cells",
        ),
    ),
    "feature_stats": Query(
        _feature_stats,
        oracle(
            f"select feature, n, {rounds('median', 'mean', 'std')} from stats",
            "observations",
            stats=" union all ".join(
                f"""select '{c}' as feature, count({c}) as n, median({c}) as median, avg({c}) as mean,
                           stddev_pop({c}) as std from observations"""
                for c in STAT_COLUMNS
            ),
        ),
    ),
    "class_weights": Query(
        _class_weights,
        oracle(
            """select fire, count(*) as rows, (select count(*) from observations) / (2 * count(*))::double as weight
               from observations group by fire""",
            "observations",
        ),
    ),
    "period_gaps": Query(
        _gaps,
        oracle(
            """select year(m)::int as year, month(m)::int as month, day(last_day(m))::int as days
               from (select unnest(generate_series(date '2018-01-01', date '2025-12-01', interval 1 month))::date as m)
               where (year(m)::int, month(m)::int) not in (select (year, month) from observations)
               order by 1, 2 limit 10""",
            "observations",
        ),
    ),
    "event_windows": Query(
        lambda v: assembly.event_windows(fire_cells(v)),
        oracle(
            """select format('{:+07.2f}_{:+08.2f}_', cell_y / 10.0::double, cell_x / 10.0::double)
                        || strftime(acq_date::timestamp + to_hours(hour), '%Y%m%d%H') as extract,
                      cell_y / 10.0::double as latitude, cell_x / 10.0::double as longitude,
                      acq_date::timestamp + to_hours(hour) as event_time,
                      (acq_date - 7)::date as start_date, acq_date as end_date from cells""",
            "cells",
        ),
    ),
}
