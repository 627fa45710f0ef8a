"""End-to-end runs: detections to cells, cells to a labelled dataset, dataset to reports and a model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.assembly import labelled_dataset
from gridcast.operators.cells import drop_incomplete, fire_cells, with_indices
from gridcast.operators.checks import require_complete
from gridcast.operators.holdout import EXPERIMENT, FINAL, Years, split_parts, temporal_split
from gridcast.operators.importance import permutation_importance
from gridcast.operators.metrics import classification_report, evaluate
from gridcast.operators.negatives import case_control_union, sample_negatives
from gridcast.operators.profiles import coverage_report, dataset_profile, split_profile
from gridcast.operators.sampling import sample_n, stratified_sample
from gridcast.operators.weather import densify_hours, restrict_hourly, weather_features
from gridcast.plans.experiments import ablation, run_temporal_protocol, spatial_experiment, temporal_experiment
from gridcast.plans.models import Family, Fit, fit_final, score_with
from gridcast.plans.scoring import prediction_table
from gridcast.schemas import CELL_HOUR, FINAL_FEATURES, WEATHER_FEATURES
from gridcast.session import snapshot
from gridcast.sinks.tables import save_model, write_report, write_table
from gridcast.sources.detections import scan_detections


def run_cells(spark: SparkSession, detections: str, output: str, max_cells: int = 100_000, seed: int = 42) -> DataFrame:
    """Detection CSV to a year-stratified table of fire cells."""
    cells = snapshot(fire_cells(scan_detections(spark, detections)))
    write_table(stratified_sample(cells, max_cells, list(CELL_HOUR), seed), output)
    return spark.read.parquet(output)


def cell_weather(hourly: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features per cell-hour from an hourly series keyed by (cell_y, cell_x), for the wanted cells and days only."""
    cell = F.struct("cell_y", "cell_x")
    series = hourly.withColumn("cell", cell).drop("cell_y", "cell_x")
    needed = wanted.select(cell.alias("cell"), "acq_date").distinct()
    features = weather_features(densify_hours(restrict_hourly(series, needed)))
    return features.select(
        F.col("cell.cell_y").alias("cell_y"),
        F.col("cell.cell_x").alias("cell_x"),
        F.to_date("hour_ts").alias("acq_date"),
        F.hour("hour_ts").alias("hour"),
        *WEATHER_FEATURES,
    )


def run_dataset(
    cells: DataFrame, hourly: DataFrame, output: str, max_cells: int | None = None, seed: int = 42
) -> DataFrame:
    """Fire cells and hourly weather to the labelled dataset; returns its coverage report."""
    chosen = snapshot(cells if max_cells is None else sample_n(cells, max_cells, list(CELL_HOUR), seed))
    observations = snapshot(case_control_union(chosen, sample_negatives(chosen, seed).drop("draw")))
    write_table(labelled_dataset(observations, cell_weather(hourly, observations)), output)
    matched = cells.sparkSession.read.parquet(output)
    return coverage_report(observations, matched, CELL_HOUR)


def run_experiments(
    df: DataFrame,
    output: str,
    family: Family,
    features: Sequence[str] = WEATHER_FEATURES,
    # fixed values: years the published protocol insists on
    required_years: Sequence[int] = (2018, 2023, 2024, 2025),
) -> None:
    """Temporal, spatial and ablation experiments into one report and one table."""
    table = snapshot(with_indices(df), balanced=True)
    sets = snapshot(ablation(table, family))
    write_table(sets, f"{output}/ablation", fmt="csv")
    write_report(
        f"{output}/metrics",
        dataset=dataset_profile(table),
        temporal=temporal_experiment(table, features, family, required_years=required_years),
        spatial=spatial_experiment(table, features, family),
        ablation=sets,
    )


def run_temporal(
    df: DataFrame, output: str, family: Family, features: Sequence[str] = WEATHER_FEATURES, years: Years = EXPERIMENT
) -> DataFrame:
    """Complete cases, no refit: the validated winner is tested as it is. Writes result rows, a summary, the model."""
    rows = drop_incomplete(df, [*features, "fire", "acq_date"]).withColumn("year", F.year("acq_date"))
    run = run_temporal_protocol(rows, features, family, years=years, refit=False)
    results = snapshot(run.rows)
    write_table(results, f"{output}/temporal_results", fmt="csv")
    write_report(f"{output}/experiment_summary", final_test=results.filter("split = 'test'"))
    save_model(run.model, f"{output}/model")
    return results


@dataclass
class FinalModel:
    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    splits: DataFrame
    report: DataFrame
    importance: DataFrame
    predictions: DataFrame


def train_final(
    df: DataFrame,
    features: Sequence[str] = FINAL_FEATURES,
    years: Years = FINAL,
    keys: Sequence[str] = CELL_HOUR,
    fit: Fit = fit_final,
    repeats: int = 5,
    seed: int = 42,
) -> FinalModel:
    """Fit on the training years, score validation and test, permute features on the test rows."""
    require_complete(df, [*features, "fire"])
    df = with_indices(df)
    table = snapshot(temporal_split(df, years), balanced=True)
    parts = split_parts(table)
    model = fit(parts["train"], features)
    scored = snapshot(score_with(model, table.filter("split in ('validation', 'test')")))
    test = scored.filter("split = 'test'")
    return FinalModel(
        model=model,
        scored=scored,
        metrics=evaluate(scored, ["split"], digits=None),
        splits=split_profile(table.withColumn("cell", F.concat_ws("_", "cell_y", "cell_x")), "cell"),
        report=classification_report(test),
        importance=permutation_importance(
            parts["test"], keys, features, lambda rows: score_with(model, rows), repeats=repeats, seed=seed
        ),
        predictions=prediction_table(test),
    )


def run_final(df: DataFrame, output: str, **options) -> FinalModel:
    result = train_final(df, **options)
    importance = snapshot(result.importance)
    write_table(importance, f"{output}/feature_importance", fmt="csv")
    write_table(result.predictions, f"{output}/test_predictions", fmt="csv")
    write_report(
        f"{output}/metrics", dataset=dataset_profile(df), split=result.splits, scores=result.metrics, report=result.report
    )
    save_model(result.model, f"{output}/model")
    return result
