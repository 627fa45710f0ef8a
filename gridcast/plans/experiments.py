"""Model comparison under temporal, spatial and feature-set protocols."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache, partial, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.checks import exclude_leakage, require_columns, require_nonempty, require_years
from gridcast.operators.holdout import EXPERIMENT, Years, spatial_holdout, split_parts, temporal_split
from gridcast.operators.metrics import evaluate
from gridcast.operators.negatives import sample_negatives, universe_of
from gridcast.operators.profiles import split_profile
from gridcast.operators.stats import repeat_summary
from gridcast.plans.ledger import Ledger, fit_missing
from gridcast.plans.models import Family, fit_all, only, score_with, training_stats
from gridcast.schemas import ABLATION_SETS
from gridcast.session import snapshot


def _needed(df: DataFrame, features: Sequence[str], label: str, others: Sequence[str]) -> DataFrame:
    """Only the columns a fit reads, leakage refused, stored once."""
    require_columns(df, [*features, label, *others])
    exclude_leakage(df, features)
    return df.select(*others, *[f for f in features if f not in others], F.col(label).cast("int").alias(label))


def score_all(models: Mapping[str, PipelineModel], test: DataFrame, label: str = "fire") -> DataFrame:
    """model, model_order, label, score: every model on the same rows."""
    scored = [
        score_with(model, test).select(F.lit(name).alias("model"), F.lit(i).alias("model_order"), label, "score")
        for i, (name, model) in enumerate(models.items())
    ]
    return reduce(DataFrame.unionByName, scored)


def compare(models: Mapping[str, PipelineModel], test: DataFrame, label: str = "fire") -> DataFrame:
    """One row of metrics per model, all models scored in one pass."""
    return evaluate(score_all(models, test, label), ["model", "model_order"], label=label)


def fit_score(
    train: DataFrame, test: DataFrame, features: Sequence[str], family: Family, label: str = "fire", ledger: Ledger | None = None, split: str = "test", parallel: int = 3
) -> DataFrame:
    """Metrics of every model. With a ``ledger``, fits run side by side and a rerun does only those it lacks."""
    if ledger is None:
        return compare(fit_all(train, features, family, label), test, label)
    return fit_missing(_work(train, test, {"all": list(features)}, family, label, split), ledger, parallel).drop("split", "feature_set")


def _work(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], family: Family, label: str, split: str) -> dict:
    """One fit and its metrics per feature set and model; the statistics they share are computed once, when first needed."""
    features = list(dict.fromkeys(f for names in sets.values() for f in names))
    stats = cache(lambda: training_stats(train, features, family.impute))

    def one(names: Sequence[str], model: str, order: int) -> DataFrame:
        fitted = fit_all(train, list(names), only(family, model), label, stats())
        return compare(fitted, test, label).withColumn("model_order", F.lit(order))

    return {(split, name, model): partial(one, names, model, i) for name, names in sets.items() for i, model in enumerate(family.fits)}


def select_model(scores: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """The best row; the model listed first wins ties."""
    return scores.orderBy(F.desc(metric), "model_order").limit(1)


@dataclass
class TemporalRun:
    """Metric rows (validation of every model, test of the winner), the winner's name and its tested model."""

    rows: DataFrame
    selected: str
    model: PipelineModel


def run_temporal_protocol(
    df: DataFrame,
    features: Sequence[str],
    family: Family,
    years: Years = EXPERIMENT,
    required_years: Sequence[int] = (),
    refit: bool = True,
    label: str = "fire",
    ledger: Ledger | None = None,
) -> TemporalRun:
    """Validate every model, pick the best by PR-AUC, score it once on the test years.

    With ``refit`` the winner is fitted again on train and validation; without, the validated model is scored. With a
    ``ledger`` the validation fits run side by side and a rerun does only those it lacks; the winner is fitted in any case.
    """
    table = snapshot(temporal_split(_needed(df, features, label, ["year"]), years), balanced=True)
    if required_years:
        require_years(table, required_years)
    require_nonempty(table, ["train", "validation", "test"])
    parts = split_parts(table)
    if ledger is None:
        models = fit_all(parts["train"], features, family, label)
        # One row per model: small enough to keep, so the choice and the report read the same numbers.
        validation = snapshot(compare(models, parts["validation"], label))
    else:
        models = {}
        validation = fit_score(parts["train"], parts["validation"], features, family, label, ledger, "validation")
    best = select_model(validation).first()["model"]
    winner = models.get(best)
    if winner is None and not refit:
        winner = fit_all(parts["train"], features, only(family, best), label)[best]
    if refit:
        earlier = parts["train"].unionByName(parts["validation"])
        winner = fit_all(earlier, features, only(family, best), label)[best]
    test = compare({best: winner}, parts["test"], label)
    rows = validation.withColumn("split", F.lit("validation")).unionByName(test.withColumn("split", F.lit("test")))
    return TemporalRun(rows.withColumn("selected", F.col("model") == best).drop("model_order"), best, winner)


def temporal_experiment(df: DataFrame, features: Sequence[str], family: Family, **options) -> DataFrame:
    """The metric rows of the temporal protocol (see ``run_temporal_protocol`` for the options)."""
    return run_temporal_protocol(df, features, family, **options).rows


def spatial_experiment(
    df: DataFrame, features: Sequence[str], family: Family, seed: int = 42, label: str = "fire"
) -> DataFrame:
    """Whole 2-degree blocks held out; metrics per model next to the group profile."""
    table = snapshot(spatial_holdout(_needed(df, features, label, ["cell_y", "cell_x"]), seed=seed), balanced=True)
    profile = split_profile(table, "block")
    scores = fit_score(table.filter("split = 'train'"), table.filter("split = 'test'"), features, family, label)
    return scores.drop("model_order").select(
        "*",
        profile.filter("split = 'train'").select("groups").scalar().alias("train_groups"),
        profile.filter("split = 'test'").select("groups").scalar().alias("test_groups"),
        profile.filter("split = 'test'").select("fraction").scalar().alias("test_fraction"),
    )


def ablation(
    df: DataFrame,
    family: Family,
    sets: Mapping[str, Sequence[str]] = ABLATION_SETS,
    years: Years = EXPERIMENT,
    label: str = "fire",
    ledger: Ledger | None = None,
    parallel: int = 3,
) -> DataFrame:
    """Every model on every feature set: train on the training years, score the test years.

    With a ``ledger``, fits run side by side and a rerun does only those it lacks.
    """
    features = list(dict.fromkeys(f for names in sets.values() for f in names))
    parts = split_parts(snapshot(temporal_split(_needed(df, features, label, ["year"]), years), balanced=True))
    if ledger is not None:
        return fit_missing(_work(parts["train"], parts["test"], sets, family, label, "test"), ledger, parallel).drop("split", "model_order")
    stats = training_stats(parts["train"], features, family.impute)
    scored = []
    for name, chosen in sets.items():
        models = fit_all(parts["train"], list(chosen), family, label, stats)
        scored.append(score_all(models, parts["test"], label).withColumn("feature_set", F.lit(name)))
    table = reduce(DataFrame.unionByName, scored)
    return evaluate(table, ["feature_set", "model", "model_order"], label=label).drop("model_order")


def seed_sensitivity(
    positives: DataFrame, score, seeds: Sequence[int] = (41, 42, 43), metrics: Sequence[str] = ("roc_auc", "pr_auc")
) -> DataFrame:
    """Repeat the negative draw per seed, evaluate ``score`` (a table function) on each, summarise over seeds.

    ``positives`` is a stored table.
    """
    universe = universe_of(positives)
    repeats = [
        positives.unionByName(sample_negatives(positives, seed, universe=universe).drop("draw"), allowMissingColumns=True).withColumn(
            "seed", F.lit(seed)
        )
        for seed in seeds
    ]
    per_seed = evaluate(score(reduce(DataFrame.unionByName, repeats)), ["seed"], digits=None)
    long = per_seed.unpivot(["seed"], list(metrics), "metric", "value")
    return repeat_summary(long, ["metric"], "value")


def refit_sensitivity(
    positives: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    family: Family,
    seeds: Sequence[int] = (41, 42, 43),
    years: Years = EXPERIMENT,
    metrics: Sequence[str] = ("roc_auc", "pr_auc"),
    label: str = "fire",
    ledger: Ledger | None = None,
    parallel: int = 3,
) -> DataFrame:
    """Mean and deviation of every model's test metrics over draws of negatives, with the models fitted anew for each draw.

    ``positives`` is a stored table; ``prepare`` turns positives and negatives into rows with features, label and year.
    Models train on the training years and are scored on the test years. With a ledger a rerun fits only what it lacks.
    """
    universe = universe_of(positives)
    rows = []
    for seed in seeds:
        drawn = positives.unionByName(sample_negatives(positives, seed, universe=universe).drop("draw"), allowMissingColumns=True)
        parts = split_parts(snapshot(temporal_split(_needed(prepare(drawn), features, label, ["year"]), years), balanced=True))
        if ledger is None:
            found = compare(fit_all(parts["train"], features, family, label), parts["test"], label)
        else:
            found = fit_missing(_work(parts["train"], parts["test"], {f"seed {seed}": list(features)}, family, label, "test"), ledger, parallel)
        rows.append(snapshot(found.select("model", *metrics)))
    long = reduce(DataFrame.unionByName, rows).unpivot(["model"], list(metrics), "metric", "value")
    return repeat_summary(long, ["model", "metric"], "value")
