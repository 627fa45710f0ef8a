"""Model fitting and experiments at the published settings. Fitted models have no SQL form, so these queries carry no oracle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from gridcast.catalog.scores import FEATURES as SMALL_FEATURES
from gridcast.catalog.series import dense
from gridcast.catalog.tables import STATION
from gridcast.catalog.views import OBSERVATION_KEYS, Query, Views
from gridcast.operators import importance, weather
from gridcast.operators.cells import drop_incomplete, with_degrees
from gridcast.operators.holdout import EXPERIMENT, FINAL, split_parts, temporal_split
from gridcast.operators.metrics import evaluate
from gridcast.plans import experiments, models
from gridcast.plans.scoring import prediction_table
from gridcast.schemas import DAILY_FEATURES, FINAL_FEATURES, INSTANT, WEATHER_FEATURES
from gridcast.session import snapshot

#: Columns that a fit on the experiment rows reads
NEEDED = (*WEATHER_FEATURES, "fire", "split")
FAMILY = models.model_family()
COMPLETE_FAMILY = models.complete_case_family()


def _on_january(o):
    """The weather series covers 30 days: each observation looks up its day of the month."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.day("acq_date") - 1) % 30)
    return o.withColumn("cell", F.expr(STATION)).withColumn("_day", day)


def experiment_rows(v: Views):
    """Observations with the 15 features: own temperature, humidity and wind, the rest from the weather series."""
    own = {"temperature_2m": "temp_1d", "relative_humidity_2m": "rh_1d", "wind_speed_10m": "wind_1d"}
    o = _on_january(v.observations())
    o = o.withColumn("hour_ts", F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour")))
    features = weather.weather_features(dense(v)).drop(*own)
    joined = o.join(features, ["cell", "hour_ts"])
    return joined.select(
        *OBSERVATION_KEYS, "cell_y", "cell_x", "year", "hour", "fire", *[F.col(c).alias(f) for f, c in own.items()],
        *[c for c in WEATHER_FEATURES if c not in own],
    )


def final_rows(v: Views):
    """Complete rows with the 31 daily features."""
    own = ("temp_1d", "rh_1d", "wind_1d")
    daily = weather.daily_features(weather.densify_days(weather.daily_rollup(v.hourly()))).drop(*own)
    joined = _on_january(v.observations()).join(daily.withColumnRenamed("day", "_day"), ["cell", "_day"])
    return drop_incomplete(with_degrees(joined), FINAL_FEATURES).select(
        *OBSERVATION_KEYS, "cell_y", "cell_x", *FINAL_FEATURES, "fire"
    )


def _parts(v: Views, columns: Sequence[str] = ()):
    """The split rows, all their columns or some. The candidate limits that trees draw depend on how rows of all columns are dealt."""
    rows = temporal_split(experiment_rows(v), EXPERIMENT)
    return split_parts(snapshot(rows.select(*columns) if columns else rows, balanced=True))


def _fit_one(name: str):
    def build(v: Views):
        parts = _parts(v, NEEDED if name == "logistic_regression" else ())
        return experiments.fit_score(parts["train"], parts["test"], WEATHER_FEATURES, models.only(FAMILY, name))

    return build


def _fit_score(v: Views):
    parts = _parts(v)
    return experiments.fit_score(parts["train"], parts["validation"], WEATHER_FEATURES, FAMILY)


def _fit_final(v: Views):
    parts = snapshot(temporal_split(final_rows(v), FINAL), balanced=True)
    model = models.fit_final(parts.filter("split = 'train'"), FINAL_FEATURES)
    scored = models.score_with(model, parts.filter("split <> 'train'"))
    return evaluate(scored, ["split"])


def _small_model(v: Views):
    o = v.observations().drop("score")
    parts = split_parts(snapshot(temporal_split(o, FINAL), balanced=True))
    return models.fit_logistic(parts["train"], SMALL_FEATURES, max_iter=50), parts["test"]


def _model_predictions(v: Views):
    model, test = _small_model(v)
    return prediction_table(models.score_with(model, test))


def _model_importance(v: Views):
    model, test = _small_model(v)
    return importance.permutation_importance(
        test, OBSERVATION_KEYS, SMALL_FEATURES, lambda rows: models.score_with(model, rows), repeats=2
    )


def _no_refit(v: Views):
    rows = drop_incomplete(experiment_rows(v), WEATHER_FEATURES)
    return experiments.temporal_experiment(rows, WEATHER_FEATURES, COMPLETE_FAMILY, refit=False)


QUERIES = {
    "fit_logistic": Query(_fit_one("logistic_regression")),
    "fit_forest": Query(_fit_one("random_forest")),
    "fit_boosting": Query(_fit_one("gradient_boosting")),
    "fit_final": Query(_fit_final),
    "fit_score": Query(_fit_score),
    "score_model": Query(_model_predictions),
    "temporal_experiment": Query(
        lambda v: experiments.temporal_experiment(
            experiment_rows(v), WEATHER_FEATURES, FAMILY, required_years=(2019, 2023, 2024, 2025)
        )
    ),
    "temporal_no_refit": Query(_no_refit),
    "spatial_experiment": Query(lambda v: experiments.spatial_experiment(experiment_rows(v), WEATHER_FEATURES, FAMILY)),
    "ablation": Query(lambda v: experiments.ablation(experiment_rows(v), FAMILY)),
    "permutation_importance_model": Query(_model_importance),
}
