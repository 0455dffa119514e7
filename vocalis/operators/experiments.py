"""Training and evaluation drivers over feature tables, their result tables and saved models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions import kernels
from vocalis.operators import metrics, models
from vocalis.operators.forest import DealtForest
from vocalis.schemas import FEATURE_META, FEATURES, LABEL_IDS, feature_set

FAMILIES = ("MFCC", "LFCC", "MFCC+Spectral", "Combined")
SVM, FOREST = "SVM", "Random Forest"
RESULT_COLUMNS = ("model", "features", "training_samples", "evaluation_samples", "accuracy", "precision", "recall", "f1", "roc_auc", "eer", "eer_threshold")


def feature_columns(df: DataFrame, expected: int | None = len(FEATURES)) -> list[str]:
    """All columns that are not metadata, in order; another number than expected is an error."""
    out = [c for c in df.columns if c not in FEATURE_META]
    if expected is not None and len(out) != expected:
        raise ValueError(f"{expected} feature columns are due, {len(out)} are there")
    return out


def label_name(predicted: Column) -> Column:
    names = {n: name for name, n in LABEL_IDS.items()}
    return F.when(predicted == 1, names[1]).otherwise(names[0])


def fit(train: DataFrame, columns: list[str], model: str = SVM, label: str = "label_id", **options):
    if model not in (SVM, FOREST):
        raise ValueError(f"unknown model {model!r}")
    return models.linear_svm(train, columns, label, **options) if model == SVM else models.random_forest(train, columns, label, **options)


def score(fitted, df: DataFrame) -> DataFrame:
    """df with score and pred: the margin of a linear model, the probability of class 1 of a forest."""
    return fitted.score(df) if isinstance(fitted, models.LinearModel) else models.forest_score(fitted, df)


def predictions(scored: DataFrame) -> DataFrame:
    """The table of single predictions."""
    return scored.select("utt_id", F.col("label").alias("true_label"), F.col("label_id").cast("long").alias("true_label_id"), F.col("pred").cast("long").alias("predicted_label_id"), label_name(F.col("pred")).alias("predicted_label"), F.col("score").alias("svm_score"))


def final_evaluation(train: DataFrame, validation: DataFrame, evaluation: DataFrame, model: str = SVM, family: str = "Combined", **options) -> tuple[DataFrame, DataFrame, object]:
    """The chosen model refitted on train and validation together and applied to the evaluation rows: result row, predictions, model."""
    development = train.unionByName(validation)
    columns = feature_columns(development) if family == "Combined" else feature_set(family)
    fitted = fit(development, columns, model, **options)
    scored = score(fitted, evaluation)
    row = models.evaluate(scored, model, family).withColumns({"training_samples": F.lit(development.count()), "evaluation_samples": F.lit(evaluation.count())})
    return row.select(*RESULT_COLUMNS), predictions(scored), fitted


def evaluate_all(train: DataFrame, evaluation: DataFrame, path: str, families: tuple[str, ...] = FAMILIES, kinds: tuple[str, ...] = (SVM, FOREST), **forest) -> DataFrame:
    """Every model on every family; each result row is appended to the table at path as soon as it is known, and rows that are there already are not computed again."""
    spark = train.sparkSession
    for family in families:
        for kind in kinds:
            done = read_results(spark, path)
            if done is not None and not done.where((F.col("model") == kind) & (F.col("features") == family)).isEmpty():
                continue
            fitted = fit(train, feature_set(family), kind, **(forest if kind == FOREST else {}))
            models.evaluate(score(fitted, evaluation), kind, family).coalesce(1).write.mode("append").parquet(path)
    order = F.array_position(F.array(*map(F.lit, families)), F.col("features")), F.array_position(F.array(*map(F.lit, kinds)), F.col("model"))
    return read_results(spark, path).orderBy(*order)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cross_corpus(train: DataFrame, validation: DataFrame, other: DataFrame, path: str, seed: int = 1337, **options) -> DataFrame:
    """All models refitted on train and validation, tested on as many spoof as bonafide rows of another corpus."""
    from vocalis.operators.sampling import balanced

    return evaluate_all(train.unionByName(validation), balanced(other, seed, shuffled=False), path, **options)


def validation_against_evaluation(validation: DataFrame, evaluation: DataFrame) -> DataFrame:
    """roc_auc_drop = validation - evaluation, eer_increase = evaluation - validation."""
    columns = ("model", "features", "accuracy", "precision", "recall", "f1", "roc_auc", "eer")
    return metrics.changes(validation.select(*columns), evaluation.select(*columns), "val", "eval", drop=True)


def corpus_against_corpus(first: DataFrame, second: DataFrame) -> DataFrame:
    """auc_change and eer_change, both second - first."""
    columns = ("model", "features", "accuracy", "f1", "roc_auc", "eer")
    return metrics.changes(first.select(*columns), second.select(*columns), "la", "df")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A feature, result, prediction or comparison table; with a header as CSV."""
    out = df.write.mode("overwrite")
    (out.option("header", True).csv if fmt == "csv" else out.parquet)(path)


def read_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A feature table with its own types; missing columns are an error."""
    from vocalis.operators.features import SCHEMA
    from vocalis.schemas import require_columns

    got = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    names = [*FEATURE_META, *FEATURES]
    return require_columns(got, names).select(*(F.col(c).cast(SCHEMA[c].dataType) for c in names))


def save_model(fitted, path: str, spark: SparkSession, columns: list[str] | None = None) -> None:
    """A linear model as one JSON row, a forest with pyspark.ml or as tables beside a row of its columns."""
    if isinstance(fitted, models.LinearModel):
        s = fitted.scaler
        value = {"kind": SVM, "columns": s.columns, "mean": s.mean, "std": s.std, "weights": fitted.weights, "intercept": fitted.intercept}
    elif isinstance(fitted, DealtForest):
        value = {"kind": FOREST, "columns": columns or fitted.columns, "dealt": True}
        fitted.save(f"{path.rstrip('/')}/trees")
    else:
        value = {"kind": FOREST, "columns": columns or fitted.stages[0].getInputCols()}
        fitted.write().overwrite().save(f"{path.rstrip('/')}/stages")
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/model")


def load_model(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    """The model and its columns in training order."""
    value = json.loads(spark.read.text(f"{path.rstrip('/')}/model").first()[0])
    if value["kind"] == SVM:
        scaler = models.Scaler(tuple(value["columns"]), tuple(value["mean"]), tuple(value["std"]))
        return models.LinearModel(scaler, tuple(value["weights"]), value["intercept"]), list(value["columns"])
    if value.get("dealt"):
        return DealtForest.load(spark, f"{path.rstrip('/')}/trees"), list(value["columns"])
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path.rstrip('/')}/stages"), list(value["columns"])


def predict_file(spark: SparkSession, audio_path: str, fitted, columns: list[str], length: int = 64000) -> dict:
    """One file through the front end of training: label, score, and the side its sign leans to."""
    from vocalis.sources.audio import load

    found = spark.read.format("binaryFile").load(audio_path).select("content").first()
    signal = kernels.preprocess(load(bytes(found[0]), audio_path), length)
    vector = dict(zip(FEATURES, np.asarray(kernels.feature_vector(signal)).tolist(), strict=True))
    row = spark.createDataFrame([[vector[c] for c in columns]], ", ".join(f"{c} double" for c in columns))
    got = score(fitted, row).select("score", "pred", label_name(F.col("pred")).alias("label")).first()
    return {"label": got.label, "prediction": int(got.pred), "score": float(got.score), "leans_to": "spoof" if got.score >= 0 else "bonafide"}
