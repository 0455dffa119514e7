"""Detection metrics. Scores are summed up by value first, so the curve's global order is over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str = "y", predicted: str = "pred", by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*(by or [])).agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, tn, fn; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def by_score(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _running(counts: DataFrame, columns: dict[str, str], ranges: int = 256) -> DataFrame:
    """Running sums from the highest score down, without one task for all: sums of score ranges, then within ranges."""
    cuts = counts.stat.approxQuantile("score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    placed = counts.withColumn("_range", -F.size(F.filter(edges, lambda e: e <= F.col("score"))))
    sums = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_range").orderBy(F.desc("score"))
    joined = placed.join(F.broadcast(sums), "_range")
    return joined.select("_range", "score", *counts.columns[1:], *((F.sum(c).over(inside) + F.col(f"_{c}")).alias(n) for c, n in columns.items()))


def roc_auc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Exact: pairs in order, ties half. Null without both classes."""
    run = _running(by_score(df, label, score), {"pos": "tps"})
    won = F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2))
    return run.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "y", score: str = "score", thinned: bool = True) -> DataFrame:
    """(threshold, tps, fps, tpr, fpr); thinned drops interior points at which neither curve turns."""
    run = _running(by_score(df, label, score), {"pos": "tps", "neg": "fps"})
    totals = run.agg(F.max("tps").alias("_p"), F.max("fps").alias("_n"))
    points = run.select("_range", F.col("score").alias("threshold"), "tps", "fps", F.col("pos").alias("_dp"), F.col("neg").alias("_dn"))
    if thinned:
        # The next lower score's steps; a point stays if its own steps differ from those, or it ends the curve. Next in the
        # same range, or the first of the next range: of the ranges, a few hundred, alone there is one order.
        inside, over = Window.partitionBy("_range").orderBy(F.desc("threshold")), Window.orderBy("_range")
        firsts = points.groupBy("_range").agg(F.max_by(F.struct("_dp", "_dn"), "threshold").alias("_head"), F.max("threshold").alias("_top"))
        firsts = firsts.select("_range", F.lead("_head").over(over).alias("_after"), (F.row_number().over(over) == 1).alias("_leads"), "_top")
        points = points.withColumn("_next", F.lead(F.struct("_dp", "_dn")).over(inside)).join(F.broadcast(firsts), "_range")
        following = F.coalesce("_next", "_after")
        points = points.where(following.isNull() | (F.col("_leads") & (F.col("threshold") == F.col("_top"))) | (following != F.struct("_dp", "_dn")))
    points = points.select("threshold", "tps", "fps").unionByName(df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tps long, fps long"))
    return points.join(F.broadcast(totals)).select("threshold", "tps", "fps", ratio(F.col("tps"), F.col("_p")).alias("tpr"), ratio(F.col("fps"), F.col("_n")).alias("fpr"))


def equal_error_rate(df: DataFrame, label: str = "y", score: str = "score", thinned: bool = True) -> DataFrame:
    """(eer, threshold) at the first point of least |FPR - FNR|, without interpolation."""
    p = roc_points(df, label, score, thinned).withColumn("_gap", F.abs(F.col("fpr") - (1 - F.col("tpr"))))
    return p.orderBy("_gap", F.desc("threshold")).limit(1).select(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer"), F.col("threshold").alias("eer_threshold"))


def changes(a: DataFrame, b: DataFrame, first: str, second: str, keys: tuple[str, ...] = ("model", "features"), drop: bool = False) -> DataFrame:
    """Results side by side as published: with drop the fall of AUC (first - second) and the rise of EER, else both as second - first."""
    left = a.withColumnsRenamed({c: f"{first}_{c}" for c in a.columns if c not in keys})
    right = b.withColumnsRenamed({c: f"{second}_{c}" for c in b.columns if c not in keys})
    auc, eer = F.col(f"{second}_roc_auc") - F.col(f"{first}_roc_auc"), F.col(f"{second}_eer") - F.col(f"{first}_eer")
    return left.join(right, list(keys)).withColumns({"roc_auc_drop": -auc, "eer_increase": eer} if drop else {"auc_change": auc, "eer_change": eer})


def compare(a: DataFrame, b: DataFrame, first: str, second: str, keys: tuple[str, ...] = ("model", "features")) -> DataFrame:
    """Results of two conditions side by side, with the changes of AUC and EER from the first to the second."""
    return changes(a, b, first, second, keys)
