"""Leaf-wise boosting against a small plain version on the same bins."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.plans import histogram, models
from gridcast.sinks.tables import save_model
from gridcast.sources.models import load_model


def plain_boosting(bins, y, rounds, rate, leaves, l2, min_leaf):
    """Raw scores after every round: the best leaf is split first, all splits tried by hand."""
    share = y.mean()
    raw = np.full(len(y), math.log(share / (1 - share)))

    def best(rows, g, h):
        found = None
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[1:]:
                left, right = rows & (bins[:, f] < b), rows & (bins[:, f] >= b)
                if min(left.sum(), right.sum()) < min_leaf or min(h[left].sum(), h[right].sum()) < histogram.LEAST_CURVATURE:
                    continue
                gain = part(left) + part(right) - part(rows)
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                    found = gain, left, right
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        done, heap, turn = [], [], 0

        def add(rows):
            nonlocal turn
            found = best(rows, g, h)  # noqa: B023
            if found is None:
                done.append(rows)  # noqa: B023
            else:
                heapq.heappush(heap, (-found[0], turn, rows, *found[1:]))  # noqa: B023
                turn += 1

        add(np.ones(len(y), bool))
        while heap and len(done) + len(heap) < leaves:
            _, _, _, left, right = heapq.heappop(heap)
            add(left)
            add(right)
        step = np.zeros(len(y))
        for rows in done + [entry[2] for entry in heap]:
            step[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        raw = raw + step
    return 1 / (1 + np.exp(-raw))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.1) ^ (rng.random(400) < 0.1)).astype(int)
    rows = [(i, *map(float, r), int(l)) for i, (r, l) in enumerate(zip(x, y))]
    rows[5] = (5, None, *rows[5][2:])
    rows[6] = (6, float("nan"), *rows[6][2:])
    return spark.createDataFrame(rows, "id int, a double, b double, c double, fire int")


def test_equal_to_a_plain_version(spark, table):
    features = ["a", "b", "c"]
    limits = histogram.bin_limits(table, features, 12)
    assert all(1 < len(x) < 12 and x == sorted(set(x)) for x in limits)
    rows = histogram.binned(table, features, limits, ["id", F.col("fire").alias("y")]).orderBy("id").collect()
    bins = np.array([r["bins"] for r in rows])
    assert bins[5, 0] == bins[6, 0] == len(limits[0]) + 1  # missing: above all others
    y = np.array([r["y"] for r in rows])
    for rounds, leaves, l2, min_leaf in ((9, 6, 1.0, 20), (2, 31, 0.0, 5), (3, 2, 5.0, 30)):
        model = histogram.fit(table, features, "fire", rounds, 0.3, leaves, l2, 12, min_leaf)
        got = [r["score"] for r in models.score_with(model, table).orderBy("id").collect()]
        assert np.allclose(got, plain_boosting(bins, y, rounds, 0.3, leaves, l2, min_leaf), atol=1e-9)


def test_edges(spark, table):
    features = ["a", "b", "c"]
    one = models.fit_final(table.withColumn("fire", F.lit(1)), features, rounds=2)
    assert min(r["score"] for r in models.score_with(one, table).collect()) > 0.999
    none = models.fit_final(table.filter("false"), features, rounds=2)
    assert models.score_with(none, table).count() == 400
    flat = models.fit_final(table.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(3)), features, rounds=2)
    assert len({r["score"] for r in models.score_with(flat, table).collect()}) > 1


def test_rounds_end_when_the_held_out_loss_stops_falling(spark, table, tmp_path):
    noise = table.withColumn("fire", (F.xxhash64("id") % 2 == 0).cast("int"))
    model = models.fit_final(noise, ["a", "b", "c"], rounds=40, rate=0.5, patience=2, patient_rows=100)
    assert len(model.stages) < 2 + 40 // histogram.TREES_AT_ONCE
    before = sorted(r["score"] for r in models.score_with(model, table).collect())
    save_model(model, f"{tmp_path}/m")
    assert sorted(r["score"] for r in models.score_with(load_model(spark, f"{tmp_path}/m"), table).collect()) == before


def test_forest_balances_classes_inside_each_bootstrap(spark, table):
    """Every tree is fitted on its own draws; the forest is the mean of its trees and can be saved."""
    rows = table.dropna().filter("fire = 1 or id % 5 = 0 and not isnan(a)")
    model = models.fit_forest(rows, ["a", "b", "c"], trees=6, depth=4, subsample=True, impute=False)
    forest = model.stages[-1]
    assert forest.getNumTrees == 6 and len({t.toDebugString for t in forest.trees}) > 1
    scored = models.score_with(model, rows).collect()
    each = []
    for tree in forest.trees:
        part = model.stages[0].transform(rows)
        part = model.stages[1].transform(part)
        each.append([r["probability"][1] for r in tree.setProbabilityCol("probability").transform(part).orderBy("id").collect()])
    want = np.mean(each, axis=0)
    assert np.allclose([r["score"] for r in sorted(scored, key=lambda r: r["id"])], want)
    again = models.fit_forest(rows, ["a", "b", "c"], trees=6, depth=4, subsample=True, impute=False)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in forest.trees]


def test_draws_of_a_forest_are_stored(spark, table, monkeypatch):
    """Draws are hashed once, in groups of trees, and the number of classes is known without reading the rows."""
    seen, one = [], models.snapshot

    def snapshot(df, **options):
        seen.append(df.columns)
        return one(df, **options)

    rows = table.dropna().filter("not isnan(a)")
    whole = models.fit_forest(rows, ["a", "b", "c"], trees=5, depth=3, subsample=True, impute=False)
    monkeypatch.setattr(models, "snapshot", snapshot)
    monkeypatch.setattr(models, "DRAWN_AT_ONCE", 2)
    parts = models.fit_forest(rows, ["a", "b", "c"], trees=5, depth=3, subsample=True, impute=False)
    assert [len([c for c in names if c.startswith("_times")]) for names in seen] == [2, 2, 1]
    assert [t.toDebugString.split("\n", 1)[1] for t in parts.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.stages[-1].trees]


def test_parts_of_a_balanced_table_follow_its_size(spark, tmp_path, monkeypatch):
    """Rows that compress well are dealt out, and read, by more tasks than cores where the table behind them is large."""
    from gridcast import session

    spark.range(100_000).select("id", F.lit(1).alias("same")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    small = session.snapshot(df, balanced=True)
    assert len(small.inputFiles()) == 4
    monkeypatch.setattr(session, "PART_BYTES", session._bytes_behind(df) // 19)
    large = session.snapshot(df, balanced=True)
    assert len(large.inputFiles()) >= 19 and large.rdd.getNumPartitions() >= 19
    assert large.agg(F.count("*"), F.sum("id"), F.sum("same")).first() == small.agg(F.count("*"), F.sum("id"), F.sum("same")).first()
    assert session.snapshot(df.filter("false"), balanced=True).count() == 0


def test_a_pass_sums_in_arrays_in_as_many_tasks_as_cores_take(spark, table):
    """Sums of numbered nodes equal plain ones; rows in many parts are summed by few tasks, whose sums alone are shuffled."""
    features, tree = ["a", "b", "c"], histogram.Node(3.0, 2.0, grown=True)
    tree.split, tree.children = histogram.Split(1, 4, 1.0), [histogram.Node(-1.0, 2.0), histogram.Node(4.0, 3.0)]
    root = histogram.Node(0.0, 0.0, split=histogram.Split(0, 5, 1.0))
    root.children = [histogram.Node(0.0, 0.0, place=0), histogram.Node(0.0, 0.0, split=histogram.Split(2, 3, 1.0))]
    root.children[1].children = [histogram.Node(0.0, 0.0), histogram.Node(0.0, 0.0, place=1)]
    limits = histogram.bin_limits(table, features, 12)
    plain = histogram.binned(table, features, limits, ["id", F.col("fire").alias("y")]).orderBy("id").collect()
    packed = histogram.binned(table.repartition(50), features, limits, ["id", F.col("fire").alias("y")], packed=True)
    sums = histogram.histogram_sums(packed.withColumn(histogram.RAW, F.lit(0.5)), [tree], root, 2, 16, 0.1, 1.0)
    assert f"Coalesce {histogram.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}" in sums._jdf.queryExecution().toString()
    want = {}
    for r in plain:
        p = 1 / (1 + math.exp(-(0.5 - 0.1 * (-1.0 / 3.0 if r["bins"][1] < 4 else 4.0 / 4.0))))
        node = 0 if r["bins"][0] < 5 else 1 if r["bins"][2] >= 3 else None
        for f, b in enumerate(r["bins"]) if node is not None else ():
            g, h, n = want.get((node, f, b), (0, 0, 0))
            want[node, f, b] = g + p - r["y"], h + p * (1 - p), n + 1
    got = {(r["node"], r["feature"], r["bin"]): (r["g"], r["h"], r["n"]) for r in sums.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("patience", [None, 2])
def test_rows_kept_by_one_task_give_the_trees_of_passes(spark, table, monkeypatch, patience):
    features = ["a", "b", "c"]
    scores = []
    for kept in (histogram.KEPT_BYTES, 0):
        monkeypatch.setattr(histogram, "KEPT_BYTES", kept)
        model = histogram.fit(table, features, "fire", 5, 0.4, 5, 1.0, 12, 20, patience)
        scores.append([r["score"] for r in models.score_with(model, table).orderBy("id").collect()])
    assert np.allclose(*scores, atol=1e-9) and len(set(scores[0])) > 5


def test_the_final_query_fits_all_published_rounds(monkeypatch):
    from gridcast.catalog import learning

    seen = []
    monkeypatch.setattr(learning.models, "fit_final", lambda train, features, **settings: seen.append(settings))
    monkeypatch.setattr(learning, "final_rows", lambda v: None)
    for name in ("temporal_split", "snapshot", "evaluate"):
        monkeypatch.setattr(learning, name, lambda *_, **__: type("Rows", (), {"filter": lambda self, _: self})())
    monkeypatch.setattr(learning.models, "score_with", lambda *_: None)
    learning._fit_final(None)
    assert seen == [{}]
