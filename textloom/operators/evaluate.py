"""Scores against truth: ROC curve, AUC, cut, reports, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.running import running_total


def roc(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down, with a first point (null, 0, 0). Rows are counted a score before they are ordered, in ranges."""
    at = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).alias("tp"), F.sum(1 - F.col(truth)).alias("fp"))
    down = [F.col("threshold").desc()]
    total = at.agg(F.sum("tp").alias("all_pos"), F.sum("fp").alias("all_neg"))
    curve = running_total(running_total(at, down, "tp", "tps"), down, "fp", "fps").join(F.broadcast(total))
    curve = curve.select(F.col("threshold").cast("double").alias("threshold"), (F.col("fps") / F.col("all_neg")).alias("fpr"), (F.col("tps") / F.col("all_pos")).alias("tpr"))
    return curve.unionByName(scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"))


def auc(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """The area under the curve: over thresholds, the negatives there times the mean of positives above and down to there."""
    at = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).alias("tp"), F.sum(1 - F.col(truth)).alias("fp"))
    area = F.sum(F.col("fp") * (F.col("tps") - F.col("tp") / 2)) / (F.sum("fp") * F.sum("tp"))
    return running_total(at, [F.col("threshold").desc()], "tp", "tps").agg(F.round(area, 6).alias("auc"))


def cut(curve: DataFrame) -> DataFrame:
    """The first best threshold: of equal gains the highest score."""
    best = F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 9), F.coalesce("threshold", F.lit(float("inf"))))).alias("b")
    return curve.agg(best).select(F.col("b.threshold").alias("threshold"), F.round(F.col("b.tpr") - F.col("b.fpr"), 6).alias("gain"))


def report(predicted: DataFrame) -> DataFrame:
    """Per class of (truth, predicted): precision, recall, f1 (0 where undefined) and support."""
    tally = predicted.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), (F.col("truth") == F.col("predicted")).cast("long").alias("tp"), F.lit(0).cast("long").alias("said"), F.lit(1).cast("long").alias("support")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("said"), F.lit(0).cast("long").alias("support")),
    )).alias("t")).select("t.*")
    sums = tally.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "said", "support")))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", *(F.round(c, 6).alias(n) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1))), "support")


def averages(by_class: DataFrame) -> DataFrame:
    """Macro and weighted averages of a report."""
    n = F.sum("support")
    macro = by_class.agg(F.lit("macro").alias("average"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))
    weighted = by_class.agg(F.lit("weighted").alias("average"), *(F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(c) for c in ("precision", "recall", "f1")))
    return macro.unionByName(weighted)


def decoded(scores: Column, names: tuple[str, ...]) -> Column:
    """The name of the greatest of an array of scores; of equal ones the first."""
    return F.get(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def routed(rows: DataFrame, predicted: DataFrame, key: str, none: str = "None") -> tuple[DataFrame, DataFrame]:
    """The rows whose prediction (key, predicted) is a relation, and those whose is none; rows without a prediction are in neither."""
    of = lambda c: predicted.where(c).select(key).distinct()
    return rows.join(of(F.col("predicted") != none), key, "left_semi"), rows.join(of(F.col("predicted") == none), key, "left_semi")


def cascade(score: Column, predicted: Column, threshold: float = 0.2) -> Column:
    """The classifier's label above the detector's threshold (strictly), else "None"."""
    return F.when(score > threshold, predicted).otherwise("None")
