"""Feature cache versions, CSV files of several headers, JSON arrays read in ranges, bucketed series, streams."""

import datetime as dt
import glob
import gzip
import time

import pytest
from pyspark.sql import functions as F

from gridcast import session
from gridcast.sinks.cache import FeatureCache
from gridcast.sources import detections

ROW = "cell int, hour_ts timestamp_ntz, v double, turn int"


def _cache(spark, path):
    return FeatureCache(spark, str(path), ROW, ["cell", "hour_ts"], "hour_ts", ["turn"])


def _rows(spark, rows):
    return spark.createDataFrame([(c, t and dt.datetime.fromisoformat(t), v, n) for c, t, v, n in rows], ROW)


def _found(table):
    return sorted(((r["cell"], str(r["hour_ts"]), r["v"]) for r in table.collect()), key=str)


def test_cache_merges_only_the_weeks_of_a_batch(spark, tmp_path):
    cache = _cache(spark, tmp_path)
    assert _found(cache.read()) == [] and cache.versions() == []
    cache.upsert(_rows(spark, [(1, "2024-01-01T05:00", 1.0, 0), (1, "2024-01-09T05:00", 2.0, 0), (2, None, 3.0, 0)]))
    first = cache.manifest()
    assert sorted(first) == ["2024-01-01", "2024-01-08", "none"]
    cache.upsert(_rows(spark, [(1, "2024-01-09T05:00", 5.0, 1), (1, "2024-01-09T05:00", 6.0, 2), (1, "2024-01-14T23:00", 7.0, 0)]))
    want = [(1, "2024-01-01 05:00:00", 1.0), (1, "2024-01-09 05:00:00", 6.0), (1, "2024-01-14 23:00:00", 7.0), (2, "None", 3.0)]
    assert _found(cache.read()) == want
    # Untouched weeks stay where they were; the old version can still be read.
    now = cache.manifest()
    assert now["2024-01-01"] == first["2024-01-01"] and now["none"] == first["none"] and now["2024-01-08"] != first["2024-01-08"]
    assert _found(cache.read(1)) == [(1, "2024-01-01 05:00:00", 1.0), (1, "2024-01-09 05:00:00", 2.0), (2, "None", 3.0)]
    plan = cache.touched(["2024-01-08"])._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-08" in plan and "PartitionFilters: [isnotnull(_week" in plan.replace("#", "").replace("(_week", "(_week")
    assert _found(cache.touched(["2024-01-08"])) == want[1:3]
    assert cache.upsert(_rows(spark, [])) == 3 and _found(cache.read()) == want


def test_a_lost_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    cache = _cache(spark, tmp_path)
    cache.upsert(_rows(spark, [(1, "2024-01-01T05:00", 1.0, 0)]))
    want = _found(cache.read())
    made = spark.createDataFrame

    def lost(data, schema=None, **more):
        if schema == "week string, batch string":
            raise RuntimeError("lost")
        return made(data, schema, **more)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **more: lost(data, schema, **more))
        with pytest.raises(RuntimeError):
            cache.upsert(made([(1, dt.datetime(2024, 1, 1, 5), 9.0, 1)], ROW))
    made([("2024-01-01", "nowhere")], "week string, batch string").write.parquet(f"{tmp_path}/manifests/2")
    (tmp_path / "manifests" / "2" / "_SUCCESS").unlink()
    assert cache.versions() == [1] and _found(cache.read()) == want
    assert cache.upsert(made([(1, dt.datetime(2024, 1, 1, 5), 9.0, 1)], ROW)) == 2
    assert _found(cache.read()) == [(1, "2024-01-01 05:00:00", 9.0)]


def test_files_of_three_headers(spark, tmp_path):
    """Orders differ, optional columns come and go, one file is packed, one has a mark of byte order, one is empty."""
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp,satellite\n20.2,77.0,2024-01-05,130,h,3.5,N\n")
    (tmp_path / "b.csv").write_text("﻿frp,confidence,acq_time,acq_date,longitude,latitude\n1.5,n,2300,2024-01-06,78.0,21.0\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as file:
        file.write('acq_date,"latitude",longitude,extra,acq_time,confidence,frp,daynight\n2024-01-07,22.0,79.0,zzz,0,l,2.5,D\n')
    (tmp_path / "d.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp,satellite\n23.0,80.0,2024-01-08,5,h,,T\n")
    (tmp_path / "e.csv").write_text("")
    rows = detections.scan_detections(spark, str(tmp_path)).orderBy("acq_date").collect()
    assert [(r["cell_y"], r["cell_x"], r["hour"], r["frp"], r["satellite"], r["daynight"]) for r in rows] == [
        (202, 770, 1, 3.5, "N", None), (210, 780, 23, 1.5, None, None), (220, 790, 0, 2.5, None, "D"), (230, 800, 0, None, "T", None),
    ]
    assert "extra" not in rows[0].asDict()
    assert len(set(detections.file_headers(spark, str(tmp_path)).values())) == 3


def test_stored_series_is_joined_without_an_exchange(spark, tmp_path):
    """The plan exchanges the observations and not the stored weather; rows equal those of the plain join."""
    from pyspark.sql import functions as F

    from gridcast.operators import assembly

    features = spark.range(500).selectExpr("cast(id % 50 as int) as cell", "cast(id div 50 as int) as hour", "id * 1.0D as f", "cast(id as int) as turn")
    features = features.unionByName(features.filter("cell = 3").withColumn("f", F.lit(-1.0)).withColumn("turn", F.lit(999)))
    obs = spark.range(2000).selectExpr("id as o", "cast(id % 60 as int) as cell", "cast(id % 7 as int) as hour")
    assembly.store_weather(features, "stored_series", str(tmp_path / "s"), 4, ["cell", "hour"], ["f"], ["turn"])
    joined = assembly.attach_stored(obs, "stored_series", ["cell", "hour"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    want = assembly.attach_weather(obs, features, ["cell", "hour"], ["f"], ["turn"])
    rows = lambda df: sorted((r["o"], r["f"]) for r in df.collect())
    assert rows(joined) == rows(want) and len(rows(joined)) > 1000
    spark.sql("drop table stored_series")


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    """Files scored in two runs, one micro-batch repeated after a lost commit: each row once, as in a batch."""
    from gridcast.plans.scoring import linear_scorer, score_rows
    from gridcast.streaming.scoring import score_arrivals, scored_arrivals

    schema = "id int, a string, b string"
    rows = [(i, None if i % 7 == 0 else str(i / 9), "x" if i % 11 == 0 else str(i)) for i in range(60)]
    files, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    scorer = linear_scorer({"a": 0.7, "b": -0.02})

    def run():
        score_arrivals(spark, files, schema, ["a", "b"], scorer, out, at, files_at_once=1)

    def got():
        return sorted(tuple(r.asDict()[c] for c in want_columns) for r in scored_arrivals(spark, out).collect())

    for part in (rows[:20], rows[20:40]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(files)
    want = score_rows(spark.createDataFrame(rows, schema), ["a", "b"], scorer)
    want_columns = want.columns
    run()
    run()  # nothing new
    assert len(got()) == 40
    commits = sorted((tmp_path / "at" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver had been lost after the write
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    spark.createDataFrame(rows[40:], schema).coalesce(1).write.mode("append").parquet(files)
    run()
    assert got() == sorted(map(tuple, want.collect()))


def test_a_rerun_fits_only_what_the_ledger_lacks(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridcast.plans import experiments, models
    from gridcast.plans.ledger import Ledger

    rows = spark.range(600).select(
        (F.col("id") % 6 + 2020).cast("int").alias("year"), *[(F.xxhash64("id", F.lit(i)) % 100 / 50.0).alias(f) for i, f in enumerate("abc")]
    ).withColumn("fire", (F.col("a") + F.col("b") * F.col("c") + (F.xxhash64("a", "c") % 10) / 20 > 0).cast("int"))
    seen = []

    def counted(name):
        def fit(train, features, **more):
            seen.append((name, tuple(features)))
            return models.fit_logistic(train, features, max_iter=20, **more)

        return fit

    family = models.Family({n: counted(n) for n in ("one", "two")})
    sets = {"ab": ["a", "b"], "all of it": ["a", "b", "c"]}
    ledger = Ledger(spark, str(tmp_path / "fits"))
    key = lambda df: sorted(tuple(r.asDict().items()) for r in df.select(*sorted(df.columns)).collect())
    want = key(experiments.ablation(rows, family, sets))
    seen.clear()
    assert key(experiments.ablation(rows, family, sets, ledger=ledger)) == want and len(seen) == 4
    assert len(ledger.done()) == 4
    seen.clear()
    lost = next(p for p in (tmp_path / "fits").rglob("_SUCCESS") if "two" in str(p) and "ab" in str(p))
    lost.unlink()
    assert key(experiments.ablation(rows, family, sets, ledger=ledger)) == want and seen == [("two", ("a", "b"))]
    again = experiments.temporal_experiment(rows, ["a", "b", "c"], family, ledger=Ledger(spark, str(tmp_path / "t")))
    assert key(again) == key(experiments.temporal_experiment(rows, ["a", "b", "c"], family))


def _documents(folder):
    """Arrays with strings that hold brackets, quotes and backslashes, an object, an empty and a broken file."""
    import json
    import random

    rng = random.Random(1)
    nasty = ['a "quoted" [x]', "back\\slash\\", '\\"', "}{][,", "é😀", ""]
    hours = [f"2024-01-01T{h:02}:00" for h in range(24)]
    for n in range(3):
        items = []
        for _ in range(rng.randint(5, 30)):
            pick = rng.random()
            if pick < 0.1:
                items.append({"error": True, "reason": rng.choice(nasty)})
            else:
                items.append({"note": rng.choice(nasty), "deep": [{"x": [rng.choice(nasty)]}], "hourly": {"time": hours, "temperature_2m": [rng.choice([1.5, None, "x"]) for _ in hours]}})
        (folder / f"a{n}.json").write_text(json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=n == 0), encoding="utf-8")
    (folder / "one.json").write_text(' {"hourly": {"time": ["2024-01-01T00:00"],\n "temperature_2m": [2.5]}, "b": [1, 2]} ')
    (folder / "empty.json").write_text("")
    (folder / "none.json").write_text("[]")
    with gzip.open(folder / "packed.json.gz", "wt") as file:
        file.write('[{"error": true}, {"hourly": {"time": ["2024-01-01T05:00"], "temperature_2m": [7]}}]')


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_json_arrays_give_the_same_rows_for_every_range_size(spark, tmp_path, size):
    from pyspark.sql import functions as F

    from gridcast.operators.weather import explode_hourly
    from gridcast.sources import json_ranges, payloads

    _documents(tmp_path)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("payload"))
    key = lambda df: sorted(map(tuple, df.select("source", "place", "hour_ts", "temperature_2m").collect()), key=str)
    if size == 7:  # ranges much shorter than an element: look at the summaries, and at one file only
        (tmp_path / "small").mkdir()
        (tmp_path / "small" / "s.json").write_text('[{"a": "\\\\\\"]"}, 5, {"b": [1, 2, "}"]}, null, {"c": {}}]')
        found = json_ranges.array_elements(spark, str(tmp_path / "small"), size).collect()
        assert sorted((r["place"], r["element"]) for r in found) == [(0, '{"a": "\\\\\\"]"}'), (2, '{"b": [1, 2, "}"]}'), (4, '{"c": {}}')]
        return
    got = payloads.scan_hourly(spark, str(tmp_path), size)
    assert key(got) == key(explode_hourly(whole, ["source"])) and ("packed.json.gz", 1) in {r[:2] for r in key(got)}
    if size == 1000:
        tasks = json_ranges.array_elements(spark, str(tmp_path / "a1.json"), size).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1  # one file, several tasks


def test_models_are_fitted_anew_for_every_draw_of_negatives(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridcast.operators.negatives import sample_negatives, universe_of
    from gridcast.plans import experiments, models
    from gridcast.plans.ledger import Ledger

    positives = spark.range(300).selectExpr(
        "cast(200 + id % 9 as int) as cell_y", "cast(700 + id % 7 as int) as cell_x", "date_add(date'2022-06-01', cast(id * 4 as int)) as acq_date", "cast(id % 24 as int) as hour", "1 as fire"
    )
    path = str(tmp_path / "p")
    positives.write.parquet(path)
    positives = spark.read.parquet(path)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(sample_negatives(positives, 7, universe=universe_of(positives))) == key(sample_negatives(positives, 7))

    def prepare(rows):
        noise = F.pmod(F.xxhash64("cell_y", "cell_x", "acq_date", "hour"), F.lit(100)) / 100.0
        return rows.withColumn("a", F.col("fire") * 0.5 + noise).withColumn("b", noise).withColumn("year", F.year("acq_date"))

    seen = []

    def fit(train, features, **more):
        seen.append(train.count())
        return models.fit_logistic(train, features, max_iter=10, **more)

    family = models.Family({"one": fit})
    got = experiments.refit_sensitivity(positives, prepare, ["a", "b"], family, seeds=(1, 2))
    rows = {r["metric"]: r for r in got.collect()}
    assert len(seen) == 2 and set(rows) == {"roc_auc", "pr_auc"} and all(r["repeats"] == 2 and 0.5 < r["value_mean"] <= 1 for r in rows.values())
    ledger = Ledger(spark, str(tmp_path / "l"))
    for _ in range(2):
        again = experiments.refit_sensitivity(positives, prepare, ["a", "b"], family, seeds=(1, 2), ledger=ledger)
        assert key(again.select("model", "metric", F.round("value_mean", 9))) == key(got.select("model", "metric", F.round("value_mean", 9)))
    assert len(seen) == 4


def test_snapshot_leaves_no_shuffle_files(spark):
    """What a write shuffled goes when it ends; the session's own setting stays as it was."""
    disks = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in disks for f in glob.glob(f"{d}/*/shuffle_*.data")}
    setting = spark.conf.get(session.CLEANUP)
    grouped = spark.range(10_000).select((F.col("id") % 1000).alias("k")).groupBy("k").count()
    before = files()
    table = session.snapshot(grouped, balanced=True)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(session.CLEANUP) == setting
    assert table.count() == 1000
