"""Classifiers: population scaling, a squared-hinge linear machine fitted by distributed Newton steps, a random forest."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.operators import forest, metrics
from vocalis.schemas import feature_set

#: Groups of a forest's trees that grow at the same time, and bytes of features in a partition for them.
FOREST_GROUPS, FOREST_PARTITION_BYTES = 8, 32 << 20
#: Nodes that the driver holds; a forest that may get more of them grows in tasks.
FOREST_DRIVER_NODES = 20_000


@dataclass(frozen=True)
class Scaler:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> Scaler:
        """Means and population deviations in one aggregate; a deviation of 0 divides by 1."""
        row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
        n = len(columns)
        return Scaler(tuple(columns), tuple(float(row[i] or 0) for i in range(n)), tuple(float(row[n + i] or 0) or 1.0 for i in range(n)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})


@dataclass(frozen=True)
class LinearModel:
    scaler: Scaler
    weights: tuple[float, ...]
    intercept: float
    #: Whether the gradient was within the tolerance when training ended.
    converged: bool = True

    def score(self, df: DataFrame) -> DataFrame:
        """df with score and pred, as one expression over the unscaled columns."""
        s = self.scaler
        total = F.lit(self.intercept)
        for c, m, d, w in zip(s.columns, s.mean, s.std, self.weights, strict=True):
            total = total + (F.col(c) - m) * (w / d)
        return df.withColumn("score", total).withColumn("pred", (F.col("score") > 0).cast("int"))


def class_sizes(df: DataFrame, label: str) -> dict[int, int]:
    sizes = {int(r[0]): r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if set(sizes) != {0, 1}:
        raise ValueError(f"both classes are needed, found {sorted(sizes)}")
    return sizes


def _balanced(sizes: dict[int, int]) -> dict[int, float]:
    n = sum(sizes.values())
    return {k: n / (2 * v) for k, v in sizes.items()}


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    return _balanced(class_sizes(df, label))


def linear_svm(df: DataFrame, columns: list[str], label: str = "label_id", c: float = 1.0, steps: int = 100, tolerance: float = 1e-6) -> LinearModel:
    """Minimise |w|^2/2 + c * sum of weighted squared hinges, the intercept being regularised like a weight.

    Each Newton step is one pass: partitions send their gradient and Hessian (columns squared), never rows.
    The input is kept in memory and on disk between passes. Ending without convergence is warned of.
    """
    scaler, weight = Scaler.fit(df, columns), class_weights(df, label)
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *(F.col(x).cast("double") for x in columns))
    mean, std = np.array(scaler.mean), np.array(scaler.std)
    d = len(columns) + 1

    def one_pass(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, hess = np.zeros(1), np.zeros(d), np.zeros((d, d))
            for b in batches:
                x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)], 1)
                y, x = 2 * x[:, 0] - 1, np.nan_to_num((x[:, 1:] - mean) / std)
                x = np.hstack([x, np.ones((len(x), 1))])
                u = np.where(y > 0, weight[1], weight[0])
                gap = 1 - y * (x @ w)
                act = gap > 0
                loss += (u[act] * gap[act] ** 2).sum()
                grad += -2 * c * (x[act].T @ (u[act] * y[act] * gap[act]))
                hess += 2 * c * (x[act].T * u[act]) @ x[act]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([c * loss, grad, hess.ravel()]).tobytes()], pa.binary())], ["sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
            return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

        # Two levels of sums, so that no task meets all partitions.
        partial = rows.mapInArrow(part, "sums binary").withColumn("k", F.spark_partition_id() % 64).groupBy("k").applyInArrow(lambda t: add(t.select(["sums"])), "sums binary")
        total = sum(np.frombuffer(bytes(r[0]), np.float64) for r in partial.collect())
        return float(total[0] + w @ w / 2), total[1 : 1 + d] + w, total[1 + d :].reshape(d, d) + np.eye(d)

    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w = np.zeros(d)
        loss, grad, hess = one_pass(w)
        size, converged = 1.0, False
        for _ in range(steps):
            converged = bool(np.abs(grad).max() < tolerance * max(1, np.abs(w).max()))
            if converged:
                break
            # The next point's own pass tells whether the step before it was too long.
            step = np.linalg.solve(hess, -grad)
            there = one_pass(w + size * step)
            if there[0] <= loss + 1e-4 * size * (grad @ step) + 1e-12 * abs(loss):
                w, (loss, grad, hess), size = w + size * step, there, 1.0
            elif size < 1e-6:
                break
            else:
                size /= 2
    finally:
        rows.unpersist()
    if not converged:
        warnings.warn(f"the linear machine ended with a gradient of {np.abs(grad).max():.3g}", stacklevel=2)
    return LinearModel(scaler, tuple(map(float, w[:-1])), float(w[-1]), converged)


def random_forest(df: DataFrame, columns: list[str], label: str = "label_id", trees: int = 200, depth: int = 30, seed: int = 1337):
    """A fitted forest with balanced weights; score is the probability of class 1.

    A forest whose nodes, by its rows and depth, may be more than the driver holds is a forest.DealtForest. Others are a
    pyspark.ml pipeline, which has all nodes on the driver. There, groups of trees grow at the same time, each with a seed of its own, over few partitions: each partition
    makes and sends a histogram of all bins for every node, however few rows the node has.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sizes = class_sizes(df, label)
    weight = _balanced(sizes)
    if trees * min(2 ** (depth + 1), 2 * sum(sizes.values())) > FOREST_DRIVER_NODES:
        return forest.fit(df, columns, label, weight, trees, depth, seed)
    weighed = df.withColumn("_weight", F.when(F.col(label) == 1, weight[1]).otherwise(weight[0]))
    assembler = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip")
    rows = assembler.transform(weighed).select(label, "_weight", "_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = rows.coalesce(-(-rows.count() * len(columns) * 8 // FOREST_PARTITION_BYTES) or 1)
        groups = min(FOREST_GROUPS, max(1, trees // 2))

        def grow(k: int):
            size = trees // groups + (k < trees % groups)
            return RandomForestClassifier(labelCol=label, weightCol="_weight", featuresCol="_features", numTrees=size, maxDepth=depth, maxBins=256, featureSubsetStrategy="sqrt", seed=seed + k, cacheNodeIds=True).fit(rows)

        with ThreadPoolExecutor(groups) as pool:
            parts = list(pool.map(inheritable_thread_target(df.sparkSession)(grow), range(groups)))
    finally:
        rows.unpersist()
    jvm, gateway = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._gateway
    grown = [t for p in parts for t in p._java_obj.trees()]
    own = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(grown))
    for i, t in enumerate(grown):
        own[i] = t
    first = parts[0]
    whole = RandomForestClassificationModel(jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(first.uid, own, first.numFeatures, first.numClasses))
    first._copyValues(whole)._set(numTrees=trees)
    whole._transfer_params_to_java()
    return PipelineModel([assembler, whole])


def forest_score(model, df: DataFrame) -> DataFrame:
    if isinstance(model, forest.DealtForest):
        return forest.score(model, df)
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int")).drop("_features", "rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame, model: str, features: str, label: str = "label_id") -> DataFrame:
    """One result row, computed here: all metrics read labels, scores and predictions that are kept meanwhile, so the model scores once."""
    # Cut from the plan before, which each of some fifty scans of kept rows would carry.
    got = forest.kept(scored.select(F.col(label).alias("y"), "score", "pred"))
    row = metrics.binary_metrics(metrics.confusion(got)).select("accuracy", "precision", "recall", "f1")
    out = row.join(metrics.roc_auc(got)).join(metrics.equal_error_rate(got)).select(F.lit(model).alias("model"), F.lit(features).alias("features"), "*")
    return scored.sparkSession.createDataFrame(out.collect(), out.schema)


def experiment_grid(train: DataFrame, test: DataFrame, sets: tuple[str, ...] = ("MFCC", "LFCC", "MFCC+Spectral", "Combined"), trees: int = 200, depth: int = 30) -> DataFrame:
    """Both models on every feature family, in canonical order; a row each."""
    out = None
    for name in sets:
        columns = feature_set(name)
        for model in ("SVM", "Random Forest"):
            scored = linear_svm(train, columns).score(test) if model == "SVM" else forest_score(random_forest(train, columns, trees=trees, depth=depth), test)
            row = evaluate(scored, model, name)
            out = row if out is None else out.unionByName(row)
    return out
