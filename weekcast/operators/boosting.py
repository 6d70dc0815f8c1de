"""Boosted regression trees in resumable blocks, with a patience stop on a metric of one's own.

Spark ML's boosting stops at the first round that gains less than a tolerance. Here every round fits
one Spark ML tree to the residuals, then measures the validation rows with the library's metrics, so
training can go on through rounds without gain and stop only after ``patience`` of them; the best
round is the one kept.

* **Blocks.** Every ``block`` rounds the rows with their current prediction are written, then the
  block's trees, then the trace of metrics, whose file marks the block as done. A fit that is started again
  on the same folder goes on after the last block that was done, and lineage never spans more than
  a block. Within a block only the latest predictions are kept by the executors; lost parts are made
  again from the block's rows.
* **One table of nodes.** The ensemble is a table (round, node, feature, threshold, children, value, gain,
  rows). Total gain per feature is an aggregate over it: a node's gain times its rows is the drop of
  the sum of squared errors.
* **Compiled scoring.** The nodes of the kept rounds become flat arrays that whole Arrow batches walk
  level by level: one comparison per row and level instead of an object per node. Only columns that
  some split uses leave the JVM. The arrays grow with rounds x 2**(depth + 1), never with data.

Prediction = mean of the training labels + step size x the sum of the kept trees' values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.operators import metrics as me

#: What a round's tree takes from the parameters; the others steer the boosting.
TREE_PARAMS = ("maxDepth", "maxBins", "minInstancesPerNode", "subsamplingRate", "featureSubsetStrategy")
BLOCK = 25
NODES = "round int, node int, feature int, threshold double, left int, right int, value double, gain double, rows double"
TRACE = "round int, wmae double, mae double, rmse double, metric double"


@dataclass
class BoostedTrees:
    """A fitted ensemble: inputs in order, start value, step size, kept rounds, the trace, and the table of nodes."""

    features: list[str]
    base: float
    step: float
    best_round: int
    trace: list[tuple]
    nodes: DataFrame
    _compiled: "CompiledTrees | None" = field(default=None, repr=False)

    def kept(self) -> DataFrame:
        return self.nodes.where(F.col("round") <= self.best_round)

    def compiled(self) -> "CompiledTrees":
        if self._compiled is None:
            self._compiled = compile_trees(self.kept().toArrow(), self.base, self.step)
        return self._compiled

    def trace_rows(self) -> DataFrame:
        """The metrics after every round, the last one ``patience`` rounds after the best unless rounds ran out."""
        return self.nodes.sparkSession.createDataFrame(self.trace, TRACE)


# ------------------------------------------------------------------ compiled scoring


@dataclass
class CompiledTrees:
    """All trees as flat arrays. A split's right child comes right after its left one; a leaf is its own left
    child and sends every row there, so all rows walk ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: np.ndarray
    used: np.ndarray
    base: float
    step: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The predictions of rows of the used features (in the order of ``used``)."""
        flat, rows = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for root, depth in zip(self.roots.tolist(), self.depth.tolist()):
            at = np.full(len(x), root)
            for _ in range(depth):
                at = self.left[at] + (flat[rows + self.feature[at]] > self.threshold[at])
            total += self.value[at]
        return self.base + self.step * total


def compile_trees(nodes: pa.Table, base: float, step: float) -> CompiledTrees:
    """Flat arrays from the table of nodes (children of a node are node numbers of its round, -1 for leaves)."""
    nodes = nodes.sort_by([("round", "ascending"), ("node", "ascending")])
    col = {c: nodes.column(c).to_numpy() for c in nodes.column_names}
    roots, depths = [], []
    feature, threshold, left, value = [], [], [], []
    starts = np.flatnonzero(np.diff(col["round"], prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], nodes.num_rows)):
        of = {int(n): start + i for i, n in enumerate(col["node"][start:end])}
        roots.append(len(left))
        level, depth = [of[0]], 0
        sizes = len(left) + 1
        while level:  # breadth first: places are given out in the order in which nodes are met
            following = []
            for row in level:
                split = col["left"][row] >= 0
                feature.append(int(col["feature"][row]) if split else 0)
                threshold.append(float(col["threshold"][row]) if split else np.inf)
                left.append(sizes if split else len(left))
                value.append(float(col["value"][row]))
                if split:
                    following += [of[int(col["left"][row])], of[int(col["right"][row])]]
                    sizes += 2
            level = following
            depth += bool(level)
        depths.append(depth)
    splits = np.isfinite(threshold) if threshold else np.empty(0, bool)
    used = np.unique(np.array(feature, np.int64)[splits])
    place = np.searchsorted(used, feature) if len(used) else np.zeros(len(feature), np.int64)
    place = np.where(splits, place, 0).astype(np.int64)
    return CompiledTrees(np.array(roots, np.int64), place, np.array(threshold, float), np.array(left, np.int64),
                         np.array(value, float), np.array(depths, np.int64), used, base, step)


def inputs(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """The features as doubles: NULL and NaN as 0, one that ``df`` lacks as 0."""
    def ready(c: str) -> Column:
        return F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))

    return {c: ready(c) if c in df.columns else F.lit(0.0) for c in features}


def predicted(model: BoostedTrees, df: DataFrame) -> Column:
    """The model's prediction for the rows of ``df``."""
    trees = model.compiled()
    if not len(trees.used):
        return F.lit(model.base + model.step * float(trees.value[trees.roots].sum()))
    known = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def walk(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:  # of one column: the arrays themselves
        trees = known.value
        for batch in columns:
            batch = batch if isinstance(batch, tuple) else (batch,)
            x = np.empty((len(batch[0]), len(batch)))
            for j, column in enumerate(batch):
                x[:, j] = column.to_numpy(zero_copy_only=False)
            yield pa.array(trees.predict(x))

    ready = inputs(df, model.features)
    return walk(*[ready[model.features[i]] for i in trees.used])


# ------------------------------------------------------------------ training


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def _nodes_of(spark: SparkSession, path: str, turn: int) -> DataFrame:
    """The nodes of one saved tree as rows of the ensemble's table."""
    data = spark.read.parquet(f"{path}/data")
    node = data.select("nodeData.*")
    threshold = F.col("split.leftCategoriesOrThreshold").getItem(0)
    leaf = F.col("leftChild") < 0
    return node.select(
        F.lit(turn).alias("round"), F.col("id").alias("node"), F.when(~leaf, F.col("split.featureIndex")).otherwise(-1).alias("feature"),
        F.when(~leaf, threshold).alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"), F.when(~leaf, F.col("gain")).otherwise(0.0).alias("gain"),
        F.col("impurityStats").getItem(0).alias("rows"))


class Trainer:
    """The block-wise fit of one ensemble in one folder (see :func:`fit`)."""

    def __init__(self, spark: SparkSession, folder: str, params: dict, metric: str | Column, patience: int, block: int):
        self.spark, self.folder, self.params = spark, folder, params
        self.metric, self.patience, self.block = metric, patience, block

    def at(self, n: int, what: str) -> str:
        return f"{self.folder}/block-{n:05d}/{what}"

    def done(self) -> int:
        """The last block that is complete; -1 before the first rows are written."""
        n = -1
        while _exists(self.spark, f"{self.at(n + 1, 'trace')}/_SUCCESS"):
            n += 1
        return n

    def begin(self, rows: DataFrame) -> None:
        """Block 0: the rows with the mean of the training labels as their first prediction."""
        mean = rows.where(~F.col("is_validation")).agg(F.avg("label")).first()[0]
        start = rows.withColumn("prediction", F.lit(float(mean or 0.0)))
        start.write.mode("overwrite").parquet(self.at(0, "rows"))
        self._commit(0, [])

    def _commit(self, n: int, trace: list[tuple]) -> None:
        self.spark.createDataFrame(trace, TRACE).coalesce(1).write.mode("overwrite").parquet(self.at(n, "trace"))

    def trace(self, n: int) -> list[tuple]:
        return sorted(tuple(r) for k in range(n + 1) for r in self.spark.read.schema(TRACE).parquet(self.at(k, "trace")).collect())

    def best(self, trace: list[tuple]) -> int:
        """The first round of the least metric; 0 without rounds."""
        return min(trace, key=lambda r: (r[4], r[0]))[0] if trace else 0

    def over(self, trace: list[tuple]) -> bool:
        """Whether the rounds have run out, or the metric has had no gain for ``patience`` rounds."""
        last = trace[-1][0] if trace else 0
        return last >= self.params["maxIter"] or last - self.best(trace) >= self.patience

    def measured(self, rows: DataFrame, turn: int, validation: bool) -> tuple:
        """The metrics after a round over the validation rows (all rows where there are none).

        The aggregate goes over all rows, so that their predictions are made and kept by it."""
        asked = F.col("is_validation") if validation else F.lit(True)
        rows = rows.select(*[F.when(asked, F.col(c)).alias(c) for c in ("label", "prediction", "is_holiday")])
        found = dict(zip(("wmae", "mae", "rmse"), me.metric_columns("label", "prediction", "is_holiday")))
        # rows outside have no error, so they count in no mean; in the weights' sum they must not either
        weight = F.when(F.col("label").isNotNull(), me.holiday_weight(F.col("is_holiday")))
        found["wmae"] = F.try_divide(F.sum(weight * F.abs(F.col("prediction") - F.col("label"))), F.sum(weight))
        chosen = found[self.metric] if isinstance(self.metric, str) else self.metric
        r = rows.agg(*[x.alias(c) for c, x in found.items()], chosen.cast("double").alias("metric")).first()
        return (turn, *[float(r[c]) if r[c] is not None else float("inf") for c in ("wmae", "mae", "rmse", "metric")])

    def run_block(self, n: int, trace: list[tuple], validation: bool) -> list[tuple]:
        """Rounds until the block is full or training is over; returns the trace with them."""
        rows = self.spark.read.parquet(self.at(n, "rows"))
        begun, current, trace = len(trace), rows, list(trace)
        step, turns = self.params["stepSize"], []
        while not self.over(trace) and len(trace) - begun < self.block:
            turn = (trace[-1][0] if trace else 0) + 1
            learner = RandomForestRegressor(
                numTrees=1, bootstrap=False, featuresCol="features", labelCol="residual", predictionCol="fitted", impurity="variance",
                seed=self.params["seed"] + turn, **{k: self.params[k] for k in TREE_PARAMS if k in self.params})
            left = current.where(~F.col("is_validation")).select("features", (F.col("label") - F.col("prediction")).alias("residual"))
            tree = learner.fit(left)
            tree.write().overwrite().save(self.at(n + 1, f"trees/{turn:06d}"))
            after = tree.transform(current).withColumn("prediction", F.col("prediction") + step * F.col("fitted")).drop("fitted")
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
            trace.append(self.measured(after, turn, validation))
            if current is not rows:
                current.unpersist()
            current = after
            turns.append(turn)
        current.write.mode("overwrite").parquet(self.at(n + 1, "rows"))
        nodes = None
        for turn in turns:
            one = _nodes_of(self.spark, self.at(n + 1, f"trees/{turn:06d}"), turn)
            nodes = one if nodes is None else nodes.unionByName(one)
        nodes.coalesce(1).write.mode("overwrite").parquet(self.at(n + 1, "nodes"))
        self._commit(n + 1, trace[begun:])
        if current is not rows:
            current.unpersist()
        for old in (self.at(n, "rows"), self.at(n + 1, "trees")):
            _delete(self.spark, old)
        return trace


def fit(rows: DataFrame, features: Sequence[str], folder: str, params: dict, metric: str | Column = "wmae",
        patience: int = 100, block: int = BLOCK, validation: bool = True) -> BoostedTrees:
    """Fit on ``rows``: the features (numeric, without NULLs), ``label``, ``is_validation`` and ``is_holiday`` (booleans).

    ``metric`` is ``wmae``, ``mae``, ``rmse`` or any aggregate of label, prediction and is_holiday (NULL outside the
    validation rows); less is better. Ends after ``params['maxIter']`` rounds, or ``patience`` rounds after the best.
    ``folder`` (shared by all executors) holds the blocks: a second call goes on after the last complete one.
    """
    spark = rows.sparkSession
    features = list(features)
    work = Trainer(spark, folder, params, metric, patience, block)
    if work.done() < 0:
        assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
        work.begin(assembled.select("features", F.col("label").cast("double").alias("label"), "is_validation", "is_holiday"))
    n = work.done()
    base = _start(spark, work)
    trace = work.trace(n)
    while not work.over(trace):
        trace = work.run_block(n, trace, validation)
        n += 1
    nodes = [work.at(k, "nodes") for k in range(1, n + 1)]
    table = spark.read.schema(NODES).parquet(*nodes) if nodes else spark.createDataFrame([], NODES)
    return BoostedTrees(features, base, float(params["stepSize"]), work.best(trace), trace, table)


def _start(spark: SparkSession, work: Trainer) -> float:
    """The ensemble's start value, kept beside the blocks when they begin."""
    path = f"{work.folder}/start"
    if not _exists(spark, f"{path}/_SUCCESS"):
        spark.read.parquet(work.at(0, "rows")).select("prediction").limit(1).write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path).first()
    return float(found[0]) if found else 0.0


# ------------------------------------------------------------------ views and persistence


def total_gain(model: BoostedTrees) -> DataFrame:
    """``feature`` and ``importance``: the squared error that its splits in the kept rounds took away, falling; 0 without splits."""
    spark = model.nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(model.features)), "feature int, name string")
    gains = model.kept().where("feature >= 0").groupBy("feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    found = names.join(gains, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("importance"))
    return found.orderBy(F.desc("importance"), "feature")


def save(model: BoostedTrees, path: str) -> str:
    spark = model.nodes.sparkSession
    model.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    head = {"features": model.features, "base": model.base, "step": model.step, "best_round": model.best_round, "trace": model.trace}
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return path


def load(spark: SparkSession, path: str) -> BoostedTrees:
    head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
    trace = [tuple(r) for r in head["trace"]]
    return BoostedTrees(head["features"], head["base"], head["step"], head["best_round"], trace, spark.read.schema(NODES).parquet(f"{path}/nodes"))
