"""Block-wise boosting against plain Python: the trace, the patience stop, resuming, gain and compiled scoring."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekcast.operators import boosting as bo
from weekcast.operators import model as mo

PARAMS = {"maxIter": 40, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 2, "seed": 1}


def _rows(spark, n=240, seed=3):
    """Noisy training rows and validation rows that they fit less and less."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rnd.randrange(12), rnd.randrange(5)
        out.append((float(x), float(z), 100.0 * (x > 5) + 10 * z + rnd.gauss(0, 40), i % 4 == 0, i % 7 == 0))
    return out, spark.createDataFrame(out, "x double, z double, label double, is_validation boolean, is_holiday boolean")


def _walk(nodes, x):
    at = 0
    while nodes[at].left >= 0:
        n = nodes[at]
        at = n.left if x[n.feature] <= n.threshold else n.right
    return nodes[at].value


def _plain_trace(model, rows):
    """wmae, mae and rmse of the validation rows after every round, walked node by node."""
    by = {}
    for r in model.nodes.collect():
        by.setdefault(r["round"], {})[r.node] = r
    val = [r for r in rows if r[3]]
    made, out = [model.base] * len(val), []
    for turn in sorted(by):
        made = [p + model.step * _walk(by[turn], r[:2]) for p, r in zip(made, val)]
        errors = [abs(p - r[2]) for p, r in zip(made, val)]
        weights = [5 if r[4] else 1 for r in val]
        out.append((sum(e * w for e, w in zip(errors, weights)) / sum(weights), sum(errors) / len(val), (sum(e * e for e in errors) / len(val)) ** 0.5))
    return out


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rows, df = _rows(spark)
    return rows, df, bo.fit(df, ["x", "z"], str(tmp_path_factory.mktemp("boost")), PARAMS, patience=5, block=4)


def test_trace_equals_plain_python_and_patience_stops_it(fitted):
    rows, _, model = fitted
    want = _plain_trace(model, rows)
    assert model.base == pytest.approx(np.mean([r[2] for r in rows if not r[3]]))
    assert len(model.trace) == len(want) < PARAMS["maxIter"]
    for got, expected in zip(model.trace, want):
        assert got[1:4] == pytest.approx(expected) and got[4] == got[1]
    errors = [w for w, _, _ in want]
    best = errors.index(min(errors)) + 1
    assert model.best_round == best and len(errors) == best + 5


def test_every_round_fits_the_residuals_of_those_before(fitted):
    rows, _, model = fitted
    train = [r for r in rows if not r[3]]
    by = {}
    for r in model.nodes.collect():
        by.setdefault(r["round"], {})[r.node] = r
    left = [r[2] - model.base for r in train]
    for turn in sorted(by)[:6]:
        groups = {}
        for r, e in zip(train, left):
            groups.setdefault(_walk(by[turn], r[:2]), []).append(e)
        assert all(np.mean(g) == pytest.approx(value, abs=1e-6) for value, g in groups.items())
        left = [e - model.step * _walk(by[turn], r[:2]) for r, e in zip(train, left)]


def test_total_gain_is_the_sum_over_nodes_and_the_drop_of_squared_error(spark, fitted):
    rows, _, model = fitted
    kept = [r for r in model.nodes.collect() if r["round"] <= model.best_round]
    want = {f: sum(r.gain * r.rows for r in kept if r.feature == i) for i, f in enumerate(model.features)}
    got = {r.feature: r.importance for r in bo.total_gain(model).collect()}
    assert got == pytest.approx(want) and list(got) == sorted(got, key=lambda f: -got[f])
    # the first tree: what its leaves' means take away from the squared error
    train = [r for r in rows if not r[3]]
    first = {r.node: r for r in kept if r["round"] == 1}
    before = sum((r[2] - model.base) ** 2 for r in train)
    after = sum((r[2] - model.base - _walk(first, r[:2])) ** 2 for r in train)
    assert sum(r.gain * r.rows for r in first.values()) == pytest.approx(before - after)


def test_a_killed_fit_goes_on_after_its_last_block(spark, fitted, tmp_path, monkeypatch):
    _, df, whole = fitted
    runs = []
    real = bo.Trainer.run_block

    def failing(self, n, trace, validation):
        if n == 1 and "killed" not in runs:
            runs.append("killed")
            raise RuntimeError("killed")
        runs.append(n)
        return real(self, n, trace, validation)

    monkeypatch.setattr(bo.Trainer, "run_block", failing)
    with pytest.raises(RuntimeError):
        bo.fit(df, ["x", "z"], str(tmp_path), PARAMS, patience=5, block=4)
    model = bo.fit(df, ["x", "z"], str(tmp_path), PARAMS, patience=5, block=4)
    assert runs[:3] == [0, "killed", 1]  # the first block is not run again
    assert [t[0] for t in model.trace] == [t[0] for t in whole.trace] and model.best_round == whole.best_round
    assert [t[1] for t in model.trace] == pytest.approx([t[1] for t in whole.trace])
    again = bo.fit(df, ["x", "z"], str(tmp_path), PARAMS, patience=5, block=4)
    assert again.trace == model.trace and again.best_round == model.best_round


def test_other_metrics_and_metrics_of_ones_own(spark, tmp_path):
    _, df = _rows(spark, 80)
    few = PARAMS | {"maxIter": 3}
    by_rmse = bo.fit(df, ["x", "z"], str(tmp_path / "a"), few, metric="rmse", patience=2)
    assert all(t[4] == t[3] for t in by_rmse.trace)
    worst = F.max(F.abs(F.col("prediction") - F.col("label")))
    own = bo.fit(df, ["x", "z"], str(tmp_path / "b"), few, metric=worst, patience=2)
    assert all(t[4] >= t[2] for t in own.trace)
    none = bo.fit(df.withColumn("is_validation", F.lit(False)), ["x", "z"], str(tmp_path / "c"), few, patience=3, validation=False)
    assert [t[1] for t in none.trace] == sorted((t[1] for t in none.trace), reverse=True)


def test_compiled_trees_equal_the_node_walk_on_any_values(spark, fitted):
    _, _, model = fitted
    trees = model.compiled()
    by = {}
    for r in model.kept().collect():
        by.setdefault(r["round"], {})[r.node] = r
    rng = np.random.default_rng(0)
    x = np.column_stack((rng.uniform(-5, 20, 500), rng.choice([-np.inf, np.inf, 0.0, 2.0, 3.5], 500)))
    want = [model.base + model.step * sum(_walk(t, r) for t in by.values()) for r in x]
    assert trees.predict(x[:, trees.used]) == pytest.approx(want)
    assert trees.predict(np.empty((0, len(trees.used)))).tolist() == []


def test_trees_of_unequal_depth_and_single_leaves():
    nodes = pa.table({
        "round": pa.array([1, 1, 1, 1, 1, 2], pa.int32()), "node": pa.array([0, 1, 2, 3, 4, 0], pa.int32()),
        "feature": pa.array([3, -1, 5, -1, -1, -1], pa.int32()), "threshold": pa.array([1.0, None, 2.0, None, None, None]),
        "left": pa.array([1, -1, 3, -1, -1, -1], pa.int32()), "right": pa.array([2, -1, 4, -1, -1, -1], pa.int32()),
        "value": pa.array([0.0, 10.0, 0.0, 20.0, 30.0, 1.0])})
    trees = bo.compile_trees(nodes, 100.0, 1.0)
    assert trees.used.tolist() == [3, 5] and trees.depth.tolist() == [2, 0]
    assert trees.predict(np.array([[1.0, 9.0], [1.5, 2.0], [1.5, 2.1]])).tolist() == [111.0, 121.0, 131.0]


def test_saved_models_and_odd_rows_score_alike(spark, fitted, tmp_path):
    rows, df, model = fitted
    again = bo.load(spark, bo.save(model, str(tmp_path)))
    assert (again.features, again.base, again.step, again.best_round, again.trace) == (model.features, model.base, model.step, model.best_round, model.trace)
    odd = spark.createDataFrame([(1, None, "a"), (2, float("nan"), "b"), (3, 7.0, "c")], "x int, z double, prediction string")
    got = mo.score(again, odd)
    assert got.columns == ["x", "z", "prediction"]
    trees = model.compiled()
    want = trees.predict(np.array([[1.0, 0], [2.0, 0], [3.0, 7.0]])[:, trees.used])
    assert sorted(r.prediction for r in got.collect()) == pytest.approx(sorted(want))
    assert mo.score(again, df.drop("x")).where("prediction IS NULL").count() == 0
    assert mo.score(model, odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mo.score(model, odd, ["x"])


def test_a_model_without_splits_predicts_the_mean(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0, False, False), (1.0, 7.0, False, False), (1.0, 6.0, True, True)], "x double, label double, is_validation boolean, is_holiday boolean")
    model = bo.fit(df, ["x"], str(tmp_path), PARAMS | {"maxIter": 2}, patience=2)
    assert [r.prediction for r in mo.score(model, df).collect()] == [6.0] * 3
    assert bo.total_gain(model).collect()[0].importance == 0.0


def test_training_on_the_feature_table_keeps_holidays_as_input_and_weight(spark):
    rnd = random.Random(4)
    rows = [(s, 1, dt.date(2020, 1, 3) + dt.timedelta(weeks=w), rnd.uniform(10, 20) + (30 if w % 5 == 0 else 0), 1.0, w % 5 == 0, float(w))
            for s in (1, 2) for w in range(40)]
    df = spark.createDataFrame(rows, "store_id int, dept_id int, feature_date date, weekly_sales double, sales_lag_1 double, is_holiday boolean, week double")
    model, feats, metrics = mo.train_forecaster(df, params={"maxIter": 4, "maxDepth": 2, "minInstancesPerNode": 1, "stepSize": 0.9, "subsamplingRate": 1.0})
    assert feats == ["sales_lag_1", "is_holiday", "week"] == mo.model_features(model)
    assert mo.feature_importance(spark, model).first().feature == "is_holiday"
    trace = mo.training_trace(model).orderBy("round").collect()
    kept = next(r for r in trace if r.is_best)
    assert metrics.first().wmae == pytest.approx(kept.wmae) and sum(r.is_best for r in trace) == 1
