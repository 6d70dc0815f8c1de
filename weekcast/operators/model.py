"""Training data preparation, boosted-tree training, scoring and model metadata.

* ``clean_training``     drop rows without target; drop rows whose lag/rolling columns are
                         all NULL; booleans -> 0/1; numeric NULL/NaN -> 0 (trees here take
                         no missing values, so this always runs before training)
* ``feature_columns``    every numeric column except the exclusion set (``is_holiday`` stays)
* ``time_split``         validation = rows within ``val_weeks`` weeks of the last date (inclusive)
* ``random_split``       deterministic hash split on the row keys
* ``train_forecaster``   boosted trees (``operators/boosting.py``) that stop ``patience`` rounds
                         after the best validation error; returns the model, the feature list
                         and the metrics of the best round (validation if any, else training)
* ``feature_importance`` total gain per feature, descending
* ``score``              batch scoring by compiled trees, one prediction per input row
* ``model_metadata``     one metadata row: metrics as DECIMAL(10,2), parameters and
                         importances as JSON text
* ``importance_share`` / ``importance_by_category`` the dashboard's views of that JSON
* ``save_model`` / ``load_model`` the model as tables; using a model before
  training raises ``ValueError``

Training parameters map the original's booster settings where Spark's trees have an
equivalent (rounds -> maxIter, learning rate -> stepSize, subsample ->
subsamplingRate, column sample -> featureSubsetStrategy, min child samples ->
minInstancesPerNode, early stopping rounds -> patience, seed); 127 leaves need a tree
of depth 7; L1/L2 terms have no counterpart. The original's booster watches the root
mean squared error; here ``metric`` chooses between it and the weighted error that
the project is judged by (the default).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions import text as tx
from weekcast.operators import boosting
from weekcast.operators import metrics as me
from weekcast.operators.boosting import BoostedTrees
from weekcast.plans.joins import with_scalars
from weekcast.schema import MODEL_METADATA
from weekcast.session import scratch_path
from weekcast.sources.sinks import append, conform_to_schema

# Columns that are no features, and the booster settings.
EXCLUDE = ("id", "store_id", "dept_id", "feature_date", "weekly_sales", "created_at")
ROUNDS = 2000
DEFAULT_PARAMS = {
    "maxIter": ROUNDS,
    "maxDepth": 7,
    "stepSize": 0.03,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 20,
    "seed": 42,
    "patience": 100,
    "metric": "wmae",
}
VALIDATION_WEEKS = 8


def clean_training(df: DataFrame, target: str = "weekly_sales") -> DataFrame:
    out = df.dropna(subset=[target])
    lagroll = [c for c in out.columns if "lag" in c or "rolling" in c]
    if lagroll:
        out = out.dropna(how="all", subset=lagroll)
    bools = [f.name for f in out.schema.fields if isinstance(f.dataType, T.BooleanType)]
    if bools:
        out = out.withColumns({c: F.col(c).cast("int") for c in bools})
    numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, T.NumericType)]
    return out.fillna(0, subset=numeric)


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDE) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name not in exclude and f.name != "is_validation"
            and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def time_split(df: DataFrame, date_col: str = "feature_date", val_weeks: int = VALIDATION_WEEKS) -> DataFrame:
    """Adds ``is_validation``: date >= (last date - val_weeks weeks)."""
    last = df.agg(F.max(date_col).alias("_last"))
    s = with_scalars(df, last)
    return s.withColumn("is_validation", F.col(date_col) >= F.date_sub(F.col("_last"), 7 * val_weeks)).drop("_last")


def random_split(df: DataFrame, keys: Sequence[str], train_pct: int = 80, seed: int = 42):
    """(train, test) by the md5 of seed and keys: stable under repartitioning, retries and engines."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100
    return df.where(h < train_pct), df.where(h >= train_pct)


class NotTrained(ValueError):
    pass


def train_forecaster(df: DataFrame, target: str = "weekly_sales", params: dict | None = None,
                     val_weeks: int | None = VALIDATION_WEEKS, exclude: Sequence[str] = EXCLUDE,
                     folder: str | None = None, block: int = boosting.BLOCK):
    """Fit on the cleaned rows; returns (BoostedTrees, features, metrics DataFrame).

    ``folder`` keeps the blocks of rounds; a fit that was killed goes on after the last complete one
    when it is called again with the same folder. Without one a scratch folder of the application is used.
    """
    p = dict(DEFAULT_PARAMS, **(params or {}))
    data = clean_training(df, target).withColumn("label", F.col(target).cast("double"))
    data = time_split(data, val_weeks=val_weeks) if val_weeks else data.withColumn("is_validation", F.lit(False))
    feats = feature_columns(data.drop("label"), exclude)
    # is_holiday is 0/1 after cleaning; the metric weights need it as a boolean,
    # and without the column every week counts as a regular week
    flag = F.col("is_holiday").cast("boolean") if "is_holiday" in data.columns else F.lit(False)
    rows = data.withColumn("_flag", flag).select(*[F.col(c).cast("double").alias(c) for c in feats if c != "is_holiday"],
                                                 *[F.col("is_holiday").cast("double").alias("_holiday")] * ("is_holiday" in feats),
                                                 "label", "is_validation", F.col("_flag").alias("is_holiday"))
    inputs = ["_holiday" if c == "is_holiday" else c for c in feats]
    folder = folder or scratch_path(df.sparkSession, f"boosting-{uuid.uuid4().hex}")
    model = boosting.fit(rows, inputs, folder, p, p["metric"], p["patience"], block, bool(val_weeks))
    model.features = feats
    scored = score(model, data)
    if val_weeks:
        scored = scored.where(F.col("is_validation"))
    flagged = scored.withColumn("_h", F.col("is_holiday").cast("boolean") if "is_holiday" in scored.columns else F.lit(False))
    return model, feats, me.evaluate_model(flagged, y="label", p="prediction", holiday="_h")


def training_trace(model: BoostedTrees | None) -> DataFrame:
    """``round``, its validation metrics, the metric that is watched, and whether it is the round that is kept."""
    if model is None:
        raise NotTrained("Model not trained yet")
    return model.trace_rows().withColumn("is_best", F.col("round") == model.best_round)


def feature_importance(spark, model: BoostedTrees | None, feats: Sequence[str] | None = None) -> DataFrame:
    """Total gain per feature, descending; ``feats`` only restricts the rows."""
    if model is None:
        raise NotTrained("Model not trained yet")
    gains = boosting.total_gain(model)
    return gains if feats is None else gains.where(F.col("feature").isin(list(feats))).orderBy(F.desc("importance"), "feature")


def model_features(model: BoostedTrees | None) -> list[str]:
    """The feature contract of a fitted or loaded model: its inputs, in order."""
    if model is None:
        raise NotTrained("Model not trained yet")
    return list(model.features)


def score(model: BoostedTrees | None, df: DataFrame, feats: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``prediction``: every row is predicted, with or without a target.

    Only the model's inputs are prepared: cast to double, NULL and NaN as 0, a
    feature missing from ``df`` as 0; the columns of ``df`` come through unchanged.
    ``feats``, if given, are the model's features (in any order).
    """
    if model is None:
        raise NotTrained("Model not trained yet")
    if feats is not None and set(feats) != set(model.features):
        raise ValueError(f"the model was trained on {model.features}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "prediction"], boosting.predicted(model, df).alias("prediction"))


def model_predictor(model: BoostedTrees, feats: Sequence[str] | None = None):
    """A ``generate_forecasts`` predictor backed by the fitted model."""
    return lambda df: score(model, df, feats)


def model_metadata(spark, metrics: DataFrame, importance: DataFrame, params: dict | None = None,
                   model_name: str = "gbt_forecaster", model_version: str = "v1.0",
                   run_id: str | None = None, training_date: dt.datetime | None = None) -> DataFrame:
    p = dict(DEFAULT_PARAMS, **(params or {}))
    head = spark.createDataFrame(
        [(run_id or uuid.uuid4().hex, model_name, model_version, training_date or dt.datetime.now(),
          json.dumps({k: str(v) for k, v in p.items()}, sort_keys=True))],
        "run_id string, model_name string, model_version string, training_date timestamp, parameters string")
    m = metrics.select(*[F.col(c).cast("decimal(10,2)").alias(c) for c in ("wmae", "mae", "rmse")])
    imp = tx.importance_json(importance)
    return with_scalars(with_scalars(head, m), imp).select(
        "run_id", "model_name", "model_version", "wmae", "mae", "rmse", "training_date", "parameters",
        "feature_importance")


def latest_model(metadata: DataFrame) -> DataFrame:
    return metadata.orderBy(F.col("training_date").desc(), "run_id").limit(1)


def importance_rows(metadata: DataFrame) -> DataFrame:
    """(position, feature, importance) from the stored JSON, in stored order."""
    arr = tx.parse_importance(F.col("feature_importance"))
    return metadata.select(F.posexplode(arr).alias("position", "item")).select(
        "position", F.col("item.feature").alias("feature"), F.col("item.importance").alias("importance"))


def append_metadata(metadata: DataFrame, path: str) -> None:
    """Append the row to the stored ``model_metadata`` table; ``latest_model`` reads the table."""
    append(conform_to_schema(metadata, MODEL_METADATA), path)


def importance_share(metadata: DataFrame, top: int | None = None) -> DataFrame:
    """Importance as percent of the total, in stored order; only the first ``top`` features if given."""
    rows = importance_rows(metadata)
    total = rows.agg(F.sum("importance").alias("_t"))
    s = with_scalars(rows, total).withColumn("importance_pct", F.try_divide(F.col("importance") * 100, F.col("_t")))
    out = s.select("position", "feature", "importance_pct").orderBy("position")
    return out.limit(top) if top else out


def importance_by_category(metadata: DataFrame) -> DataFrame:
    rows = importance_rows(metadata)
    total = rows.agg(F.sum("importance").alias("_t"))
    s = with_scalars(rows, total).withColumn("importance_pct", F.try_divide(F.col("importance") * 100, F.col("_t")))
    return (s.withColumn("category", tx.categorize_feature(F.col("feature")))
            .groupBy("category").agg(F.sum("importance_pct").alias("importance_pct"))
            .orderBy(F.col("importance_pct").desc(), "category"))


def save_model(model: BoostedTrees | None, path: str) -> str:
    if model is None:
        raise NotTrained("Model not trained yet")
    return boosting.save(model, path)


def load_model(path: str, spark: SparkSession | None = None) -> BoostedTrees:
    return boosting.load(spark or SparkSession.active(), path)
