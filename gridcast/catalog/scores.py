"""Metrics, curves and reports on a deterministic score, batch scoring, prediction table, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.catalog.samples import hashed
from gridcast.catalog.views import OBSERVATION_KEYS, Query, Views, oracle, rounded, rounds
from gridcast.functions import rates
from gridcast.operators import importance, metrics, stats
from gridcast.plans.experiments import select_model
from gridcast.plans.scoring import linear_scorer, prediction_table, score_rows

KEYS = ", ".join(OBSERVATION_KEYS)
FEATURES = ("temp_1d", "rh_1d", "wind_1d", "month", "hour")
# Fixed linear form standing in for a fitted model.
WEIGHTS = {"temp_1d": 0.16, "rh_1d": -0.05, "wind_1d": 0.02, "month": 0.01, "hour": -0.005}
INTERCEPT = -0.5
SCORER = linear_scorer(WEIGHTS, INTERCEPT, digits=4)
TEST_FROM = 2024
SEED = 42
REPEATS = 5


def _test(v: Views):
    """All rows with the score rounded to two places, so that many rows tie."""
    return v.observations().withColumn("score", F.round("score", 2))


def _complete(v: Views):
    """All rows, a missing humidity replaced by the median."""
    o = v.observations().drop("score")
    return stats.impute_median(o, {"rh_1d": stats.fetch_stats(stats.exact_medians(o, ["rh_1d"]))["rh_1d"]["median"]})


def _complete_test(v: Views):
    return _complete(v).filter(F.col("year") >= TEST_FROM)


def _brier(v: Views):
    return rounded(metrics.brier_score(_test(v), ["year"]), "brier", "positive_rate")


def _binary(v: Views):
    table = metrics.binary_metrics(_test(v), ["year"])
    return table.select(*[F.round(c, 5).alias(c) if c in ("accuracy", "precision", "recall", "f1") else c for c in table.columns])


def _impute(v: Views):
    o = v.observations().select(*OBSERVATION_KEYS, "temp_1d", "rh_1d")
    medians = {f: s["median"] for f, s in stats.fetch_stats(stats.exact_medians(o, ["temp_1d", "rh_1d"])).items()}
    return stats.impute_median(o, medians)


def _standardize(v: Views):
    columns = ["temp_1d", "rh_1d", "wind_1d"]
    o = v.observations().select(*OBSERVATION_KEYS, *columns)
    return rounded(stats.standardize(o, stats.fetch_stats(stats.moments(o, columns))), *columns)


def _raw_rows(v: Views):
    """Feature rows as text, some of them malformed or incomplete."""
    o = v.observations()
    bad = F.when(F.col("l_orderkey") % 53 == 0, "hot").otherwise(F.col("temp_1d").cast("string")).alias("temp_1d")
    gone = F.when(F.col("l_orderkey") % 59 != 0, F.col("wind_1d").cast("string")).alias("wind_1d")
    rest = [F.col(c).cast("string").alias(c) for c in ("rh_1d", "month", "hour")]
    return o.select(*OBSERVATION_KEYS, bad, gone, *rest)


def _score_rows(v: Views):
    scored = score_rows(_raw_rows(v), FEATURES, linear_scorer(WEIGHTS, INTERCEPT))
    return rounded(scored, "probability", "percent")


def _predictions(v: Views):
    table = prediction_table(SCORER(_complete_test(v)))
    return table


def _candidate_scores(v: Views, rows="true"):
    """Three candidate scores per row."""
    o = v.observations().filter(rows)
    named = [
        ("heat", (F.col("temp_1d") - 10.0) / 25.0),
        ("combined", F.col("score")),
        ("calendar", F.col("month") / 12.0),
    ]
    entries = [F.struct(F.lit(n).alias("model"), F.lit(i).alias("model_order"), F.round(e, 4).alias("score")) for i, (n, e) in enumerate(named)]
    return o.select("fire", F.inline(F.array(*entries)))


def _select(v: Views):
    """The best of three candidates on the validation year."""
    return select_model(metrics.evaluate(_candidate_scores(v, f"year = {TEST_FROM}"), ["model", "model_order"]))


def _evaluate(v: Views):
    return metrics.evaluate(_candidate_scores(v), ["model", "model_order"])


def _importance(v: Views):
    return importance.permutation_importance(_complete(v), OBSERVATION_KEYS, FEATURES, SCORER, repeats=REPEATS, seed=SEED)


def _repeats(v: Views):
    """ROC-AUC with each feature shuffled, summarised over repeats."""
    table = importance.stored(_complete(v), OBSERVATION_KEYS, FEATURES)
    shuffled = importance.shuffled_metrics(table, OBSERVATION_KEYS, FEATURES, SCORER, "fire", REPEATS, SEED, table.count())
    return stats.repeat_summary(shuffled, ["feature"], "roc_auc")


TEST = "select * replace (round(score, 2) as score) from observations"
COMPLETE = "select * replace (coalesce(rh_1d, (select median(rh_1d) from observations)) as rh_1d) from observations"
CURVE = """
select score, n, tp, sum(n) over w as cn, sum(tp) over w as ctp, sum(tp) over () as p, sum(n) over () as total
from (select score, count(*) as n, sum(fire) as tp from test group by score) window w as (order by score desc)
"""
AP = "(sum(tp::double * ctp / cn) / max(p)::double)"
ROC = "(sum((n - tp) * ((ctp - tp)::double + tp / 2.0::double)) / (max(p)::double * max(total - p)))"


def linear(columns: dict[str, str] | None = None) -> str:
    names = columns or {}
    terms = " + ".join(f"{w}::double * {names.get(f, f)}::double" for f, w in WEIGHTS.items())
    return f"1.0::double / (1.0::double + exp(-({INTERCEPT}::double + {terms})))"


def grouped_curve(source: str, by: str) -> str:
    return f"""
    select {by}, score, n, tp, sum(n) over w as cn, sum(tp) over w as ctp, sum(tp) over g as p, sum(n) over g as total
    from (select {by}, score, count(*) as n, sum(fire) as tp from {source} group by {by}, score)
    window w as (partition by {by} order by score desc), g as (partition by {by})"""


def confusion(p: str = "score", by: str = "") -> str:
    return f"""
    count(*) filter (fire = 0 and {p} < 0.5) as tn, count(*) filter (fire = 0 and {p} >= 0.5) as fp,
    count(*) filter (fire = 1 and {p} < 0.5) as fn, count(*) filter (fire = 1 and {p} >= 0.5) as tp"""


RATES = """
select *, (tp + tn) / (tp + tn + fp + fn)::double as accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision,
       coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1
from counts
"""

REPORT = """
select unnest([
  {'class': '0', 'precision': p0, 'recall': r0, 'f1': f0, 'support': s0},
  {'class': '1', 'precision': p1, 'recall': r1, 'f1': f1, 'support': s1},
  {'class': 'accuracy', 'precision': acc, 'recall': acc, 'f1': acc, 'support': s0 + s1},
  {'class': 'macro avg', 'precision': (p0 + p1) / 2, 'recall': (r0 + r1) / 2, 'f1': (f0 + f1) / 2, 'support': s0 + s1},
  {'class': 'weighted avg', 'precision': (p0 * s0 + p1 * s1) / (s0 + s1), 'recall': (r0 * s0 + r1 * s1) / (s0 + s1),
   'f1': (f0 * s0 + f1 * s1) / (s0 + s1), 'support': s0 + s1}]) as e
from (select tn / (tn + fn)::double as p0, tn / (tn + fp)::double as r0, 2 * tn / (2 * tn + fn + fp)::double as f0, tn + fp as s0,
             tp / (tp + fp)::double as p1, tp / (tp + fn)::double as r1, 2 * tp / (2 * tp + fp + fn)::double as f1, fn + tp as s1,
             (tp + tn) / (tp + tn + fp + fn)::double as acc from counts)
"""

CANDIDATES = """
select fire, unnest([{'model': 'heat', 'model_order': 0, 'score': round((temp_1d - 10.0::double) / 25.0::double, 4)},
                     {'model': 'combined', 'model_order': 1, 'score': round(score::double, 4)},
                     {'model': 'calendar', 'model_order': 2, 'score': round(month / 12.0::double, 4)}], recursive := true)
from observations
"""
EVALUATED = f"""
select model, model_order, tn, fp, fn, tp, round(accuracy, 5) as accuracy, round(precision, 5) as precision,
       round(recall, 5) as recall, round(f1, 5) as f1, round(roc_auc, 5) as roc_auc, round(pr_auc, 5) as pr_auc,
       round(brier, 5) as brier, round(positive_rate, 5) as positive_rate
from rates join (select model, {ROC} as roc_auc, {AP} as pr_auc from curve group by model) using (model)
"""


def evaluated(rows: str) -> str:
    return oracle(
        EVALUATED,
        "observations",
        candidates=CANDIDATES + rows,
        counts=f"""select model, model_order, {confusion()}, avg((score - fire) * (score - fire)) as brier, avg(fire) as positive_rate
                   from candidates group by model, model_order""",
        rates=RATES,
        curve=grouped_curve("candidates", "model"),
    )


# Each repeat: one random ring of all rows; a row takes the value of the next row in the ring.


def ring(columns: tuple[str, ...]) -> str:
    nexts = ", ".join(f"coalesce(lead({c}) over w, first_value({c}) over w) as next_{c}" for c in columns)
    return f"""
    select *, {nexts} from (
      select c.*, repeat::int as repeat, {hashed(*OBSERVATION_KEYS, 'repeat', seed=SEED)} as h
      from complete c, range({REPEATS}) t(repeat))
    window w as (partition by repeat order by h, {KEYS})"""


PERMUTED = " union all ".join(
    f"select '{f}' as feature, repeat, fire, round({linear({f: f'next_{f}'})}, 4) as score from ring" for f in FEATURES
)
IMPORTANCE = f"""
select feature, avg(importance) as importance_mean, stddev_pop(importance) as importance_std, count(*) as repeats from (
  select feature, (select {ROC} from base_curve) - {ROC} as importance from curve group by feature, repeat) group by feature
"""
IMPORTANCE_VIEWS = dict(
    complete=COMPLETE,
    ring=ring(FEATURES),
    permuted=PERMUTED,
    curve=grouped_curve("permuted", "feature, repeat"),
    base=f"select 1 as one, fire, round({linear()}, 4) as score from complete",
    base_curve=grouped_curve("base", "one"),
    summary=IMPORTANCE,
)

QUERIES = {
    "confusion_matrix": Query(
        lambda v: metrics.confusion_matrix(_test(v)),
        oracle(f"select {confusion()} from test", "observations", test=TEST),
    ),
    "binary_metrics": Query(
        _binary,
        oracle(
            """select year, tn, fp, fn, tp, round(accuracy, 5) as accuracy, round(precision, 5) as precision,
                      round(recall, 5) as recall, round(f1, 5) as f1 from rates""",
            "observations",
            test=TEST,
            counts=f"select year, {confusion()} from test group by year",
            rates=RATES,
        ),
    ),
    "brier_score": Query(
        _brier,
        oracle(
            f"select year, {rounds('brier', 'positive_rate')} from b",
            "observations",
            test=TEST,
            b="select year, avg((score - fire) * (score - fire)) as brier, avg(fire) as positive_rate from test group by year",
        ),
    ),
    "roc_auc": Query(
        lambda v: rounded(metrics.ranking_metrics(_test(v)).select("roc_auc", "positives", "rows"), "roc_auc"),
        oracle(
            f"select {rounds('roc_auc')}, positives, rows from r",
            "observations",
            test=TEST,
            curve=CURVE,
            r=f"select {ROC} as roc_auc, max(p)::bigint as positives, max(total)::bigint as rows from curve",
        ),
    ),
    "pr_auc": Query(
        lambda v: rounded(metrics.ranking_metrics(_test(v)).select("pr_auc", "positives", "rows"), "pr_auc"),
        oracle(
            f"select {rounds('pr_auc')}, positives, rows from r",
            "observations",
            test=TEST,
            curve=CURVE,
            r=f"select {AP} as pr_auc, max(p)::bigint as positives, max(total)::bigint as rows from curve",
        ),
    ),
    "pr_curve": Query(
        lambda v: rounded(metrics.pr_curve(_test(v)), "precision", "recall"),
        oracle(
            f"select threshold, {rounds('precision', 'recall')} from c",
            "observations",
            test=TEST,
            curve=CURVE,
            c="select score as threshold, ctp / cn::double as precision, ctp / p::double as recall from curve",
        ),
    ),
    "roc_curve": Query(
        lambda v: rounded(metrics.roc_curve(_test(v)), "fpr", "tpr"),
        oracle(
            f"select threshold, {rounds('fpr', 'tpr')} from c",
            "observations",
            test=TEST,
            curve=CURVE,
            c="select score as threshold, (cn - ctp) / (total - p)::double as fpr, ctp / p::double as tpr from curve",
        ),
    ),
    "classification_report": Query(
        lambda v: metrics.classification_report(_test(v)),
        oracle(
            """select e.class as "class", round(e.precision, 4) as precision, round(e.recall, 4) as recall,
                      round(e.f1, 4) as f1, e.support as support from lines""",
            "observations",
            test=TEST,
            counts=f"select {confusion()} from test",
            lines=REPORT,
        ),
    ),
    "calibration_bins": Query(
        lambda v: rounded(metrics.calibration_bins(_test(v)), "mean_score", "observed_rate"),
        oracle(
            f"select bin, rows, {rounds('mean_score', 'observed_rate')} from b",
            "observations",
            test=TEST,
            b="""select least(floor(score * 10.0::double), 9)::int as bin, count(*) as rows, avg(score) as mean_score,
                        avg(fire) as observed_rate from test group by 1""",
        ),
    ),
    "evaluate_models": Query(_evaluate, evaluated("")),
    "select_model": Query(_select, f"{evaluated(f'where year = {TEST_FROM}')} order by round(pr_auc, 5) desc, model_order limit 1"),
    "impute_median": Query(
        _impute,
        oracle(
            f"""select {KEYS}, coalesce(temp_1d, (select median(temp_1d) from observations)) as temp_1d,
                       coalesce(rh_1d, (select median(rh_1d) from observations)) as rh_1d from observations""",
            "observations",
        ),
    ),
    "standardize": Query(
        _standardize,
        oracle(
            f"select {KEYS}, {rounds('temp_1d', 'rh_1d', 'wind_1d')} from z",
            "observations",
            z=f"""select {KEYS}, """
            + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}" for c in ("temp_1d", "rh_1d", "wind_1d"))
            + " from observations",
        ),
    ),
    "score_rows": Query(
        _score_rows,
        oracle(
            f"""select {KEYS}, {rounds('probability', 'percent')}, prediction,
                       case prediction when 1 then '{rates.LABEL_POSITIVE}' when 0 then '{rates.LABEL_NEGATIVE}' end as label, error
                from (select *, probability * 100 as percent, (probability >= 0.5)::int as prediction from (
                  select *, case when error is null then {linear()} end as probability from raw))""",
            "observations",
            raw="""select *, case when l_orderkey % 53 = 0 then 'Invalid input: ''temp_1d'' is not a number: hot'
                                  when rh_1d is null then 'Invalid input: ''rh_1d'' is missing'
                                  when l_orderkey % 59 = 0 then 'Invalid input: ''wind_1d'' is missing' end as error
                   from observations""",
        ),
    ),
    "prediction_table": Query(
        _predictions,
        oracle(
            f"""select cell_y / 10.0::double as grid_lat, cell_x / 10.0::double as grid_lon, acq_date::varchar as acq_date, hour,
                       fire as actual_fire, score as fire_probability, (score >= 0.5)::int as predicted_fire
                from (select *  exclude (score), round({linear()}, 4) as score from complete)""",
            "observations",
            complete=f"{COMPLETE} where year >= {TEST_FROM}",
        ),
    ),
    "permutation_importance": Query(
        lambda v: rounded(_importance(v), "importance_mean", "importance_std"),
        oracle(
            f"select feature, {rounds('importance_mean', 'importance_std')}, repeats from summary",
            "observations",
            **IMPORTANCE_VIEWS,
        ),
    ),
    "importance_topk": Query(
        lambda v: rounded(importance.importance_topk(_importance(v), 3), "importance_mean", "importance_std"),
        oracle(
            f"select feature, {rounds('importance_mean', 'importance_std')}, repeats from summary order by summary.importance_mean desc limit 3",
            "observations",
            **IMPORTANCE_VIEWS,
        ),
    ),
    "repeat_summary": Query(
        lambda v: rounded(_repeats(v), "roc_auc_mean", "roc_auc_std"),
        oracle(
            f"select feature, {rounds('roc_auc_mean', 'roc_auc_std')}, repeats from summary",
            "observations",
            complete=COMPLETE,
            ring=ring(FEATURES),
            permuted=PERMUTED,
            curve=grouped_curve("permuted", "feature, repeat"),
            summary=f"""select feature, avg(a) as roc_auc_mean, stddev_pop(a) as roc_auc_std, count(*) as repeats from (
                          select feature, {ROC} as a from curve group by feature, repeat) group by feature""",
        ),
    ),
}
