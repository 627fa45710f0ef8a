"""Operators against brute force on small tables, and invariants."""

import datetime as dt
import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridcast.catalog.views import OBSERVATION_KEYS, Views
from gridcast.operators import (
    assembly,
    cells,
    checks,
    dedupe,
    holdout,
    importance,
    metrics,
    negatives,
    profiles,
    ranking,
    sampling,
    stats,
    weather,
)
from gridcast.schemas import CELL_HOUR, FINAL_FEATURES, INSTANT, LEAKAGE, WEATHER_FEATURES

DAY = dt.date(2024, 1, 1)


def scored(spark, pairs, extra=()):
    return spark.createDataFrame([(*extra, y, float(p)) for y, p in pairs], "fire int, score double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, out, last = sum(y for y, _ in pairs), 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        above = [y for y, p in pairs if p >= t]
        recall = sum(above) / total
        out += (recall - last) * sum(above) / len(above)
        last = recall
    return out


def test_ties_in_ranking_metrics(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.7), (0, 0.2)]
    row = metrics.ranking_metrics(scored(spark, pairs)).first()
    assert row["pr_auc"] == pytest.approx(0.733333, abs=1e-6)
    assert row["roc_auc"] == pytest.approx(0.666667, abs=1e-6)


def test_ranking_metrics_against_brute_force(spark):
    rng = random.Random(3)
    # A third of the rows share one score, the rest are nearly all distinct.
    pairs = [(rng.random() < 0.4, 0.31 if i % 3 == 0 else round(rng.random() ** 4, 5)) for i in range(600)]
    pairs = [(int(y), p) for y, p in pairs]
    row = metrics.ranking_metrics(scored(spark, pairs)).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)
    assert row["pr_auc"] == pytest.approx(brute_ap(pairs), abs=1e-12)


def test_one_class_has_no_auc(spark):
    row = metrics.ranking_metrics(scored(spark, [(0, 0.1), (0, 0.9)])).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    row = metrics.ranking_metrics(scored(spark, [(1, 0.1), (1, 0.9)])).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 1.0


def test_published_confusion_counts_give_published_rates(spark):
    # fixed values: published test confusion counts and the rates that follow
    counts = spark.createDataFrame([(10373, 5388, 4066, 11698)], "tn long, fp long, fn long, tp long")
    row = metrics.rates_of(counts).first()
    assert (row["accuracy"], row["precision"]) == (pytest.approx(0.700111, abs=1e-6), pytest.approx(0.684654, abs=1e-6))
    assert (row["recall"], row["f1"]) == (pytest.approx(0.742071, abs=1e-6), pytest.approx(0.712207, abs=1e-6))


def test_zero_division_is_zero(spark):
    row = metrics.binary_metrics(scored(spark, [(0, 0.1), (0, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_evaluate_agrees_with_single_metrics(spark):
    rng = random.Random(5)
    pairs = [(int(rng.random() < 0.5), round(rng.random(), 2)) for _ in range(300)]
    df = scored(spark, pairs)
    row = metrics.evaluate(df, digits=None).first()
    single = metrics.binary_metrics(df).first()
    for name in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1"):
        assert row[name] == pytest.approx(single[name])
    assert row["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs))
    assert row["positive_rate"] == pytest.approx(sum(y for y, _ in pairs) / len(pairs))


def test_exact_medians_with_hot_value_and_gaps(spark):
    rng = random.Random(7)
    rows = []
    for i in range(501):
        rows.append((5.0 if i % 3 else rng.random() * 10, rng.gauss(0, 1) if i % 4 else None, None))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {r["feature"]: (r["n"], r["median"]) for r in stats.exact_medians(df, ["a", "b", "c"]).collect()}
    assert found["a"] == (501, statistics.median(a for a, _, _ in rows))
    present = [b for _, b, _ in rows if b is not None]
    assert found["b"] == (len(present), pytest.approx(statistics.median(present)))
    assert "c" not in found


def test_standardize_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    out = stats.standardize(df, stats.fetch_stats(stats.moments(df, ["a", "b"]))).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("n", [0, 1, 37, 199, 200, 500])
def test_sample_n_is_exact_and_nested(spark, n):
    df = spark.range(200).withColumnRenamed("id", "k")
    got = [r["k"] for r in sampling.sample_n(df, n, ["k"]).collect()]
    assert len(got) == len(set(got)) == min(n, 200)
    larger = {r["k"] for r in sampling.sample_n(df, n + 5, ["k"]).collect()}
    assert set(got) <= larger


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = [r["k"] for r in sampling.shuffle_rows(df, ["k"]).orderBy("position").collect()]
    assert sorted(got) == list(range(500)) and got != sorted(got)


@pytest.mark.parametrize("n", [3, 10, 50, 95, 109, 110, 200])
def test_stratified_sample_against_brute_force(spark, n):
    # One year holds most rows, one holds two.
    rows = [(k, 2019 if k < 68 else 2020 if k < 108 else 2021) for k in range(110)]
    df = spark.createDataFrame(rows, "k long, year int")
    got = sampling.stratified_sample(df, n, ["k"]).collect()
    hashes = {r["k"]: r["h"] for r in df.select("k", sampling.key_hash(["k"], 42).alias("h")).collect()}
    quota = {y: n // 3 + (i < n % 3) for i, y in enumerate((2019, 2020, 2021))}
    ranked = {y: sorted((k for k, year in rows if year == y), key=hashes.get) for y in quota}
    want = [k for y, ks in ranked.items() for k in ks[: quota[y]]]
    rest = sorted((k for k, _ in rows if k not in set(want)), key=hashes.get)
    want += rest[: max(0, n - len(want))]
    assert sorted(r["k"] for r in got) == sorted(want)


def _positives(spark):
    rows = [(60 + y, 680 + x, DAY + dt.timedelta(d), (7 * y + 3 * x + d) % 24) for y in range(6) for x in range(4) for d in range(3)]
    return spark.createDataFrame(rows, "cell_y int, cell_x int, acq_date date, hour int")


@pytest.mark.parametrize("unique", [False, True])
def test_negatives_invariants(spark, unique):
    positives = _positives(spark)
    got = negatives.sample_negatives(positives, seed=1, unique=unique)
    rows = [tuple(r[c] for c in CELL_HOUR) for r in got.collect()]
    taken = {tuple(r) for r in positives.collect()}
    assert len(rows) == len(taken)
    assert not taken & set(rows)
    assert {r[:2] for r in rows} <= {r[:2] for r in taken} and {r[2] for r in rows} <= {r[2] for r in taken}
    if unique:
        assert len(set(rows)) == len(rows)
    again = [tuple(r[c] for c in CELL_HOUR) for r in negatives.sample_negatives(positives, seed=1, unique=unique).collect()]
    assert sorted(again) == sorted(rows)


def test_full_universe_has_no_negatives(spark):
    full = spark.range(24).select(F.lit(1).alias("cell_y"), F.lit(2).alias("cell_x"), F.lit(DAY).alias("acq_date"), F.col("id").cast("int").alias("hour"))
    with pytest.raises(ValueError):
        negatives.sample_negatives(full)


def test_short_draw_fails(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    short = ranking.take_first(df, 6, ["k"], F.col("k"), short_message="not enough")
    with pytest.raises(Exception, match="not enough"):
        short.collect()


def test_spatial_holdout_keeps_blocks_whole(spark, sf_dir):
    parts = holdout.spatial_holdout(Views(spark, sf_dir).observations())
    per_block = parts.groupBy("block").agg(F.count_distinct("split").alias("n"))
    assert per_block.filter("n <> 1").count() == 0
    test_blocks = parts.filter("split = 'test'").select("block").distinct().count()
    assert test_blocks == max(1, round(0.2 * per_block.count()))


def test_dedupe_keeps_whole_rows(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (2, 3, 1.0)], "k int, v int, x double")
    assert sorted(map(tuple, dedupe.dedupe_first(df, ["k"], ["v"]).collect())) == [(1, 1, None), (2, 3, 1.0)]
    assert sorted(map(tuple, dedupe.dedupe_last(df, ["k"], ["v"]).collect())) == [(1, 2, 5.0), (2, 3, 1.0)]


def test_checks_raise(spark):
    df = spark.createDataFrame([(2018, None), (2019, 1.0)], "year int, a double")
    checks.require_years(df, [2018, 2019])
    with pytest.raises(ValueError, match="2025"):
        checks.require_years(df, [2018, 2025])
    with pytest.raises(ValueError, match="'a'"):
        checks.require_complete(df, ["year", "a"])
    with pytest.raises(ValueError, match="'b'"):
        checks.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="test"):
        checks.require_nonempty(holdout.temporal_split(df), ["train", "test"])
    with pytest.raises(ValueError, match="max_frp"):
        checks.exclude_leakage(df, ["a", "max_frp"])


def test_rows_without_a_year_are_in_no_split(spark):
    df = spark.createDataFrame([(2022,), (2023,), (2024,), (2025,), (2026,), (None,)], "year int")
    final = {r["year"]: r["split"] for r in holdout.temporal_split(df, holdout.FINAL).collect()}
    assert final == {2022: "train", 2023: "validation", 2024: "test", 2025: "test", 2026: "test", None: None}
    experiment = {r["year"]: r["split"] for r in holdout.temporal_split(df).collect()}
    assert experiment == {2022: "train", 2023: "train", 2024: "validation", 2025: "test", 2026: None, None: None}


def test_feature_lists_are_clean():
    assert len(FINAL_FEATURES) == 31 and len(WEATHER_FEATURES) == 15
    assert not set(LEAKAGE) & set(FINAL_FEATURES + WEATHER_FEATURES)


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], "cell_y int, cell_x int, acq_date date, hour int, fire int")
    row = profiles.coverage_report(empty, empty, CELL_HOUR).first()
    assert (row["requested"], row["matched"], row["coverage"]) == (0, 0, 0.0)


def _hourly(spark, values):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(hours=h), *([v] * len(INSTANT))) for h, v in values]
    fields = ", ".join(f"{c} double" for c in INSTANT)
    return spark.createDataFrame(rows, f"cell int, hour_ts timestamp_ntz, {fields}")


def test_trailing_features_against_brute_force(spark):
    rng = random.Random(11)
    values = {h: (None if rng.random() < 0.2 else round(rng.random() * 9, 2)) for h in range(400) if rng.random() < 0.7}
    values[0], values[399] = 1.0, 2.0
    got = weather.weather_features(weather.densify_hours(_hourly(spark, sorted(values.items())))).orderBy("hour_ts").collect()
    assert len(got) == 400

    def last(h, n):
        return [values[i] for i in range(max(0, h - n + 1), h + 1) if values.get(i) is not None]

    for h, row in enumerate(got):
        assert row["temperature_2m"] == values.get(h)
        for n in (24, 72, 168):
            want = sum(last(h, n)) if last(h, n) else None
            assert row[f"rain_{n}h"] == (None if want is None else pytest.approx(want, abs=1e-9))
        window = last(h, 24)
        assert row["avg_temp_24h"] == (pytest.approx(sum(window) / len(window), abs=1e-9) if window else None)
        assert row["max_wind_24h"] == (max(window) if window else None)


def test_all_missing_window_is_null_and_one_value_is_kept(spark):
    hourly = _hourly(spark, [(0, 3.0)] + [(h, None) for h in range(1, 30)])
    got = weather.trailing_rain(hourly).orderBy("hour_ts").collect()
    assert got[23]["rain_24h"] == 3.0 and got[24]["rain_24h"] is None and got[29]["rain_72h"] == 3.0


def _long_series(spark, cells=3, hours=1500, gap=()):
    """Hourly rain and temperature of a few cells, without the hours in ``gap`` for the first cell."""
    rows = spark.range(cells * hours).selectExpr(f"cast(id div {hours} as int) as cell", f"cast(id % {hours} as int) as h")
    if gap:
        rows = rows.filter(~((F.col("cell") == 0) & F.col("h").between(*gap)))
    at = F.lit("2023-12-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))
    value = lambda m: (F.col("h") * 7 + F.col("cell")) % m
    return rows.select(
        "cell", at.alias("hour_ts"), *[F.when(value(11) > 0, value(5 + i).cast("double")).alias(v) for i, v in enumerate(INSTANT)]
    )


def test_a_value_leaves_no_trace_once_it_is_out_of_the_frame(spark):
    """Rain of 1.0 an hour with one fill value at the third hour: later frames hold exactly their own hours."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
    rain = F.when(F.col("id") == 3, F.lit(9.96921e36)).otherwise(F.lit(1.0))
    hourly = spark.range(400).select(F.lit(1).alias("cell"), at.alias("hour_ts"), rain.alias("precipitation"))
    got = weather.trailing_rain(hourly, (24, 72, 168, 50, 5)).orderBy("hour_ts").collect()
    assert got[399]["rain_168h"] == 168.0 and got[27]["rain_24h"] == 24.0 and got[26]["rain_24h"] > 1e36
    for n in (24, 72, 168, 50, 5):
        assert [r[f"rain_{n}h"] for r in got[n + 3 :]] == [float(n)] * (397 - n)
        assert [r[f"rain_{n}h"] for r in got[:3]] == [1.0, 2.0, 3.0]


def test_chunks_with_a_halo_give_the_same_rows(spark):
    """Gaps longer than a chunk and its halo, chunks shorter than a frame, chunks longer than the series."""
    series = _long_series(spark, gap=(300, 1100))
    whole = sorted(map(tuple, weather.weather_features(weather.densify_hours(series)).collect()))
    assert len(whole) == 4500
    for chunk in (50, 168, 672, 5000):
        got = weather.weather_features(weather.densify_hours(series, chunk=chunk), chunk=chunk)
        assert sorted(map(tuple, got.collect())) == whole


def test_a_cell_with_a_third_of_all_rows_is_several_tasks(spark):
    series = _long_series(spark, cells=1, hours=2000).unionByName(_long_series(spark, cells=5, hours=800).filter("cell > 0"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = weather.weather_features(weather.densify_hours(series, chunk=weather.CHUNK), chunk=weather.CHUNK)
        spread = got.filter("cell = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1 and got.count() == 2000 + 4 * 800


def test_weather_features_use_one_exchange(spark):
    hourly = _hourly(spark, [(0, 1.0), (5, 2.0)])
    plan = weather.weather_features(weather.densify_hours(hourly))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_payload_shapes(spark):
    docs = [
        ("a", '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, null]}}'),
        ("b", '[{"hourly": {"time": ["2024-01-01T00:00"], "precipitation": [0.2]}}, {"error": true}]'),
        ("c", '{"error": true}'),
        ("d", "not json"),
        ("e", '{"hourly": {}}'),
    ]
    rows = weather.explode_hourly(spark.createDataFrame(docs, "k string, payload string"), ["k"]).orderBy("k", "hour_ts").collect()
    assert [(r["k"], r["hour_ts"].hour, r["temperature_2m"], r["precipitation"]) for r in rows] == [
        ("a", 0, 1.5, None),
        ("a", 1, None, None),
        ("b", 0, None, 0.2),
    ]


def test_block_range_join_against_range_predicate(spark):
    keys = [(1, 1, DAY + dt.timedelta(d), 0) for d in range(40)]
    df = spark.createDataFrame(keys, "cell_y int, cell_x int, acq_date date, hour int")
    weeks = [dt.date(2024, 1, 8), dt.date(2024, 1, 22)]
    blocks = spark.createDataFrame([(w, 1, 1) for w in weeks], "week date, cell_y int, cell_x int")
    got = {(r["week"], r["acq_date"]) for r in assembly.block_range_join(blocks, df).collect()}
    want = {(w, k[2]) for w in weeks for k in keys if w - dt.timedelta(7) <= k[2] <= w + dt.timedelta(6)}
    assert got == want


def test_upsert_prefers_new_rows(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, None), (3, 9.0)], "k int, v double")
    assert sorted(map(tuple, assembly.upsert_features(old, new, ["k"]).collect())) == [(1, 1.0), (2, None), (3, 9.0)]


def test_attach_keeps_duplicates_and_drops_unmatched(spark):
    obs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, o string")
    feats = spark.createDataFrame([(1, 0.5), (3, 0.7)], "k int, f double")
    got = assembly.attach_weather(obs, feats, ["k"], ["f"]).orderBy("o").collect()
    assert [(r["o"], r["f"]) for r in got] == [("a", 0.5), ("b", 0.5)]


def test_permutation_uses_every_value_once(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("x"))
    got = importance.permute_rows(df, ["k"], ["x"], repeats=2, seed=1, rows=300).collect()
    for repeat in (0, 1):
        rows = [r for r in got if r["repeat"] == repeat]
        assert sorted(r["_with"]["x"] for r in rows) == [k * 2.0 for k in range(300)]
        assert sum(r["_with"]["x"] == r["x"] for r in rows) == 0


def test_rings_of_many_buckets_sort_no_rows_to_find_the_first(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 2.0).alias("x"), F.lit(1).alias("y"))
    ring = importance.permute_rows(df, ["k"], ["x", "y"], repeats=2, seed=1, rows=10**6)
    assert "SortAggregate" not in ring._jdf.queryExecution().executedPlan().toString()
    few = importance.permute_rows(df, ["k"], ["x", "y"], repeats=2, seed=1, rows=10)
    got, want = ({(r["repeat"], r["k"]): r["_with"] for r in d.collect()} for d in (ring, few))
    assert got == want and len(got) == 6000
    order = sorted(range(3000), key=lambda k: hashlib.md5(f"{k}|1|1".encode()).hexdigest())
    assert [got[1, k]["x"] for k in order] == [2.0 * k if k % 7 else None for k in [*order[1:], order[0]]]


def test_bucket_digits_follow_the_row_count():
    assert [ranking.digits_for(n) for n in (0, 65_536, 65_537, 2**20, 2**20 + 1, 10**12)] == [0, 0, 1, 1, 2, 6]


def test_dropping_incomplete_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert cells.drop_incomplete(df, ["x"]).count() == 1


def test_random_split_is_row_level(spark, sf_dir):
    o = Views(spark, sf_dir).observations()
    parts = sampling.random_split(o, list(OBSERVATION_KEYS)).groupBy("split").count().collect()
    share = {r["split"]: r["count"] for r in parts}
    assert 0.15 < share["test"] / sum(share.values()) < 0.25


def test_hot_key_is_split_by_the_join(spark):
    """A third of the observations share one weather key: the join splits that key over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("int")
        obs = spark.range(0, 300_000, 1, 8).select(hot.alias("k"), F.md5(F.col("id").cast("string")).alias("o"))
        feats = spark.range(5000).select(F.col("id").cast("int").alias("k"), F.col("id").cast("double").alias("f"))
        joined = assembly.attach_weather(obs, feats, ["k"], ["f"])
        assert len(joined.collect()) == 300_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_box_and_columns_reach_the_scan(spark, sf_dir, tmp_path):
    Views(spark, sf_dir).detections().write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # the plan text shows all filters
    boxed = cells.bbox_filter(spark.read.parquet(str(tmp_path / "d"))).select("det_id")
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude,6.0)" in plan and "LessThanOrEqual(longitude,98.0)" in plan
    assert "ReadSchema: struct<det_id:bigint,latitude:double,longitude:double>" in plan


def test_bootstrap_draws_are_not_dealt_out_by_tree_and_class(spark):
    """The weights, one row per tree and class, go to the draws: the few keys of the join never share out the rows."""
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("fire"))
    out = sampling.bootstrap_weights(df, ["k"], "fire", trees=3)
    final = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin [tree" not in final
    rows = out.collect()
    for tree in range(3):
        weights = {y: sum(r["weight"] for r in rows if r["tree"] == tree and r["fire"] == y) for y in (0, 1)}
        assert weights[0] == pytest.approx(weights[1])


def test_bootstrap_times_follow_the_limits(spark):
    limits = sampling.bootstrap_limits()
    for draw in (0, limits[0] - 1, limits[0], limits[1], limits[4] - 1, 16**12 - 1):
        got = spark.range(1).select(F.lit(f"{draw:012x}").alias("d")).select(sampling.bootstrap_times("d")).first()[0]
        assert got == sum(draw >= limit for limit in limits)


def test_exact_medians_count_digits_without_a_sort(spark, monkeypatch):
    """Middle ranks in different digits, numbers that differ in the last bit only, infinities, both zeros; equal values settle early."""
    import numpy as np

    passes, one = [], stats._digits
    monkeypatch.setattr(stats, "_digits", lambda *given: passes.append(1) or one(*given))
    rng = np.random.default_rng(3)
    ends = [1e300, -1e300, float("inf"), float("-inf"), 1e-310, -0.0, 0.0]
    rows = [(float(rng.normal()), 1.0 + 2.0**-52 * (i % 7), float(rng.choice(ends)), -5.0 if i % 2 else 7.0, float("nan") if i % 3 else -3.5, None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    found = {r["feature"]: (r["n"], r["median"]) for r in stats.exact_medians(df, df.columns).collect()}
    known = {c: [r[i] for r in rows if r[i] is not None and r[i] == r[i]] for i, c in enumerate("abcdef")}
    assert found == {c: (len(v), float(np.median(v))) for c, v in known.items() if v} and len(passes) <= 4
    passes.clear()
    assert [r["median"] for r in stats.exact_medians(df, ["d", "e"]).orderBy("feature").collect()] == [1.0, -3.5] and len(passes) == 2
    assert stats.exact_medians(df.filter("false"), ["a"]).count() == 0


def test_shuffles_store_one_repeat_after_the_other(spark, monkeypatch):
    """No statement makes the ring of more than one repeat, and the metrics are those of all repeats at once."""
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 3 == 0).cast("int").alias("fire"))
    scorer = lambda rows: rows.withColumn("score", (F.col("a") + F.col("b")) / 20)
    own = importance.stored(df, ["id"], ["a", "b"])
    seen, one = [], importance.snapshot

    def snapshot(table, **options):
        out = one(table, **options)
        seen.append({r["repeat"] for r in out.select("repeat").distinct().collect()})
        return out

    monkeypatch.setattr(importance, "snapshot", snapshot)
    got = importance.shuffled_metrics(own, ["id"], ["a", "b"], scorer, "fire", 3, 42, 10**6)
    assert seen == [{0}, {1}, {2}, {0, 1, 2}]
    whole = metrics.ranking_metrics(importance.permuted_scores(own, ["id"], ["a", "b"], scorer, "fire", 3, 42, 500), ["feature", "repeat"])
    key = lambda r: (r["feature"], r["repeat"])
    assert sorted(got.collect(), key=key) == sorted(whole.collect(), key=key)
