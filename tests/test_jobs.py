"""Sources, sinks, models and whole runs on small files."""

import datetime as dt
import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from gridcast.catalog import learning
from gridcast.catalog.views import OBSERVATION_KEYS, Views
from gridcast.operators.cells import with_degrees
from gridcast.plans import experiments, jobs, models, scoring
from gridcast.schemas import INSTANT, WEATHER_FEATURES
from gridcast.sinks import tables
from gridcast.sources import dataset, detections, payloads
from gridcast.sources.models import load_model


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    from gridcast.session import snapshot

    return snapshot(learning.experiment_rows(Views(spark, sf_dir)))


def test_detection_csv_to_cells(spark, tmp_path):
    text = [
        "latitude,longitude,acq_date,acq_time,confidence,frp,brightness,daynight",
        "20.25,77.0,2018-01-05,130, N ,3.5,300,D",
        "20.25,77.0,2018-01-05,159,h,,300,D",
        "20.35,77.0,2019-02-06,2400,x,1.0,300,N",
        "5.9,77.0,2019-02-06,0,l,1.0,300,N",
        "bad,77.0,2019-02-06,0,l,1.0,300,N",
        "20.35,77.0,2019-02-30,0,l,1.0,300,N",
    ]
    source = tmp_path / "d.csv"
    source.write_text("\n".join(text))
    located = detections.scan_detections(spark, str(source))
    assert "brightness" not in located.columns and "daynight" in located.columns
    out = jobs.run_cells(spark, str(source), str(tmp_path / "cells"), max_cells=10).orderBy("acq_date").collect()
    first, second = out
    assert (first["cell_y"], first["cell_x"], first["hour"], first["fire_detections"]) == (202, 770, 1, 2)
    assert (first["mean_confidence"], first["max_frp"], first["fire"], first["year"]) == (0.75, 3.5, 1, 2018)
    assert (second["cell_y"], second["hour"], second["mean_confidence"], second["month"]) == (204, 23, None, 2)
    with pytest.raises(ValueError, match="frp"):
        detections.parse_detections(located.drop("frp"))


def test_events_and_dataset_csv(spark, tmp_path):
    source = tmp_path / "e.csv"
    source.write_text("grid_lat,grid_lon,acq_date,hour,year\n20.3,77.0,2024-01-05,6,2024\n20.3,77.0,2024-01-04,6,x\nx,77.0,2024-01-03,6,2024\n")
    events = detections.scan_events_validated(spark, str(source), n=1).collect()
    assert [e["event_time"] for e in events] == [dt.datetime(2024, 1, 4, 6)]
    table = dataset.scan_dataset(spark, str(source), ["grid_lat", "grid_lon"]).orderBy("acq_date").collect()
    assert [(r["grid_lat"], r["year"]) for r in table] == [(None, 2024), (20.3, None), (20.3, 2024)]


def test_cache_roundtrip(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame(
        [(20.200000000000003, 77.0, "2024-01-05", 6, 1, 0.1), (20.2, 77.0, "2024-01-05", 6, 2, 0.2)],
        "grid_lat double, grid_lon double, acq_date string, hour long, version int, rain_24h double",
    )
    rows.write.parquet(path)
    got = dataset.read_feature_cache(spark, path, ["version"]).collect()
    assert [(r["cell_y"], r["cell_x"], r["rain_24h"]) for r in got] == [(202, 770, 0.2)]


def test_snapshot_replaces_only_its_weeks(spark, tmp_path):
    path = str(tmp_path / "snap")
    tables.write_snapshot(spark.createDataFrame([("w1", 1), ("w2", 2)], "week string, v int"), path)
    tables.write_snapshot(spark.createDataFrame([("w2", 3)], "week string, v int"), path)
    assert sorted((r["week"], r["v"]) for r in spark.read.parquet(path).collect()) == [("w1", 1), ("w2", 3)]


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"hourly": {"time": ["2024-01-01T00:00"],\n "temperature_2m": [1.5]}}')
    (tmp_path / "b.json").write_text('{"error": true}')
    got = payloads.scan_hourly(spark, str(tmp_path)).collect()
    assert [(r["source"], r["temperature_2m"], r["precipitation"]) for r in got] == [("a.json", 1.5, None)]


def test_table_and_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2018, 1.5), (2019, None)], "year int, v double")
    tables.write_table(df, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("year", "v").collect())) == [(2018, 1.5), (2019, None)]
    tables.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "c")).columns) == ["v", "year"]
    tables.write_report(str(tmp_path / "r"), table=df, best=df.agg(F.max("v").alias("top")))
    text = spark.read.text(str(tmp_path / "r")).first()["value"]
    assert json.loads(text) == {"table": [{"year": 2018, "v": 1.5}, {"year": 2019}], "best": [{"top": 1.5}]}


def test_model_roundtrip_and_errors(spark, sf_dir, tmp_path):
    o = Views(spark, sf_dir).observations().drop("score")
    model = models.fit_logistic(o, ["temp_1d", "rh_1d"], max_iter=20)
    path = str(tmp_path / "m")
    tables.save_model(model, path)
    test = o.limit(50)
    before = sorted(r["score"] for r in models.score_with(model, test).collect())
    after = sorted(r["score"] for r in models.score_with(load_model(spark, path), test).collect())
    assert before == after and all(0 <= p <= 1 for p in before)
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "absent"))


def test_logistic_matches_newton(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2)) * [1.0, 5.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1] - 1)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, fire int")
    model = models.fit_logistic(df, ["a", "b"]).stages[-1]
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(400)]
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    beta = np.zeros(3)
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-4)


def test_temporal_experiment_selects_and_refits(rows):
    got = experiments.temporal_experiment(rows, WEATHER_FEATURES, learning.FAMILY).collect()
    validation = [r for r in got if r["split"] == "validation"]
    (test,) = [r for r in got if r["split"] == "test"]
    assert len(validation) == 3 and test["selected"]
    best = max(validation, key=lambda r: r["pr_auc"])
    assert test["model"] == best["model"] and best["roc_auc"] > 0.6
    for r in got:
        assert 0 <= r["brier"] <= 1 and r["tn"] + r["fp"] + r["fn"] + r["tp"] > 0
    with pytest.raises(ValueError, match="2017"):
        experiments.temporal_experiment(rows, WEATHER_FEATURES, learning.FAMILY, required_years=(2017,))


def test_same_seed_same_forest(rows):
    from gridcast.operators.holdout import split_parts, temporal_split

    parts = split_parts(temporal_split(rows))
    family = models.only(learning.FAMILY, "random_forest")
    runs = [experiments.fit_score(parts["train"], parts["test"], WEATHER_FEATURES, family).collect() for _ in range(2)]
    assert runs[0] == runs[1]


def test_dataset_run(spark, sf_dir, tmp_path):
    from gridcast.catalog.tables import fire_cells

    v = Views(spark, sf_dir)
    cells = fire_cells(v)
    # A regular hourly series for every cell, a week longer than the detections at the start.
    hours = F.sequence(F.lit("2023-12-24 00:00:00").cast("timestamp_ntz"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.expr("interval 1 hour"))
    series = cells.select("cell_y", "cell_x").distinct().withColumn("hour_ts", F.explode(hours))
    hourly = series.select("*", *[(F.hour("hour_ts") + F.col("cell_y") % 7).cast("double").alias(c) for c in INSTANT])
    report = jobs.run_dataset(cells, hourly, str(tmp_path / "set"), max_cells=60).first()
    assert (report["requested"], report["matched"], report["coverage"]) == (120, 120, 1.0)
    assert (report["fire_rows"], report["nonfire_rows"]) == (60, 60)
    table = spark.read.parquet(str(tmp_path / "set"))
    assert set(WEATHER_FEATURES) <= set(table.columns)
    day = table.filter("hour = 23").first()
    if day is not None:
        assert day["rain_24h"] == pytest.approx(sum(h + day["cell_y"] % 7 for h in range(24)))


def test_final_run(spark, sf_dir, tmp_path):
    rows = learning.final_rows(Views(spark, sf_dir)).drop("cell_y", "cell_x")
    features = ["grid_lat", "grid_lon", "temp_1d", "rh_1d", "rain_7d_total"]
    fit = partial(models.fit_final, rounds=2)
    result = jobs.run_final(rows, str(tmp_path), features=features, keys=OBSERVATION_KEYS, fit=fit, repeats=2)
    metrics = {r["split"]: r for r in result.metrics.collect()}
    assert set(metrics) == {"validation", "test"} and metrics["test"]["roc_auc"] > 0.6
    ranked = spark.read.option("header", True).csv(str(tmp_path / "feature_importance")).collect()
    assert {r["feature"] for r in ranked} == set(features)
    top = max(ranked, key=lambda r: float(r["importance_mean"]))
    assert top["feature"] in ("temp_1d", "rh_1d")
    predictions = spark.read.option("header", True).csv(str(tmp_path / "test_predictions"))
    assert predictions.count() == sum(metrics["test"][c] for c in ("tn", "fp", "fn", "tp"))
    report = json.loads(spark.read.text(str(tmp_path / "metrics")).first()["value"])
    assert len(report["report"]) == 5 and {s["split"] for s in report["split"]} == {"train", "validation", "test"}
    assert load_model(spark, str(tmp_path / "model")) is not None


def test_experiment_run(spark, rows, tmp_path):
    family = models.only(models.model_family(trees=2, tree_depth=2, rounds=1, max_iter=5), "logistic_regression")
    jobs.run_experiments(rows.withColumn("acq_date", F.col("acq_date")), str(tmp_path), family, required_years=(2023, 2024, 2025))
    report = json.loads(spark.read.text(str(tmp_path / "metrics")).first()["value"])
    assert set(report) == {"dataset", "temporal", "spatial", "ablation"} and len(report["ablation"]) == 4
    assert report["spatial"][0]["train_groups"] > report["spatial"][0]["test_groups"] > 0


def test_temporal_run_without_refit(spark, rows, tmp_path):
    family = models.Family(models.model_family(max_iter=5).fits, impute=False)
    results = jobs.run_temporal(rows, str(tmp_path), models.only(family, "logistic_regression")).collect()
    assert [(r["split"], r["selected"]) for r in sorted(results, key=lambda r: r["split"])] == [("test", True), ("validation", True)]
    summary = json.loads(spark.read.text(str(tmp_path / "experiment_summary")).first()["value"])
    assert summary["final_test"][0]["model"] == "logistic_regression"
    assert load_model(spark, str(tmp_path / "model")) is not None


def test_scoring_works_on_a_stream(spark, sf_dir, tmp_path):
    features = ("temp_1d", "rh_1d")
    raw = Views(spark, sf_dir).observations().select("l_orderkey", *[F.col(f).cast("string").alias(f) for f in features])
    raw.write.parquet(str(tmp_path / "in"))
    scorer = scoring.linear_scorer({"temp_1d": 0.1, "rh_1d": -0.05})
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    query = (
        scoring.score_rows(stream, features, scorer)
        .writeStream.format("memory")
        .queryName("scored_stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    want = scoring.score_rows(spark.read.parquet(str(tmp_path / "in")), features, scorer)
    assert spark.table("scored_stream").exceptAll(want).count() == 0 and spark.table("scored_stream").count() == want.count()


def test_display_coordinates(spark):
    df = with_degrees(spark.createDataFrame([(202, -3)], "cell_y int, cell_x int")).first()
    assert (df["grid_lat"], df["grid_lon"]) == (20.2, -0.3)
