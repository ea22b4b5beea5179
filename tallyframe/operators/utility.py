"""Prediction metrics, retention and ratios over tables of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expressions import ratio
from tallyframe.operators.stats import running_sums


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) over the union of seen classes; 0 where undefined."""
    cells = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    g = long.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])
    g = g.withColumns({"precision": F.coalesce(ratio(F.col("hit"), F.col("claimed")), F.lit(0.0)), "recall": F.coalesce(ratio(F.col("hit"), F.col("support")), F.lit(0.0))})
    return g.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("class", "support", "hit", "precision", "recall", "f1")


def classification_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(n, accuracy, macro_f1, balanced_accuracy, weighted_f1): the last weighs classes against their frequency."""
    m = class_metrics(df, label, predicted)
    total = F.sum("support").over(Window.partitionBy(F.lit(1)))
    m = m.withColumn("w", 1 - ratio(F.col("support"), total))
    return m.agg(F.sum("support").alias("n"), ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), ratio(F.sum(F.col("f1") * F.col("w")), F.count(F.lit(1)) - 1).alias("weighted_f1"))


def ranking_scores(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(roc_auc, average_precision) of a binary label, ties shared; undefined with one class only.

    Scores are counted first, so the running sums pass over distinct scores only.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    c = running_sums(counts, [], "s", ["p", "q"], descending=True)
    tp, fp = F.col("upto_p"), F.col("upto_q")
    total = c.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.col("q") * (tp - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * ratio(tp, tp + fp)).alias("ap"))
    return total.select(ratio(F.col("area"), F.col("np") * F.col("nq")).alias("roc_auc"), F.when(F.col("nq") > 0, ratio(F.col("ap"), F.col("np"))).alias("average_precision"))


def regression_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(n, rmse, mae, r2, explained_variance); the last two are undefined for a constant or a single row."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(predicted).cast("double")
    both = F.col(label).isNotNull() & F.col(predicted).isNotNull()
    g = df.where(both).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"))
    defined = F.col("n") >= 2
    return g.select("n", F.sqrt("mse").alias("rmse"), "mae", F.when(defined, 1 - ratio(F.col("mse"), F.col("vy"))).alias("r2"), F.when(defined, 1 - ratio(F.col("ve"), F.col("vy"))).alias("explained_variance"))


def local_retention(dummy: Column, trtr: Column, tstr: Column, higher_is_better: Column) -> Column:
    """Unclipped; null where the real model does not beat the dummy by more than 1e-12."""
    gap = F.when(higher_is_better, trtr - dummy).otherwise(dummy - trtr)
    return F.when(gap > 1e-12, F.when(higher_is_better, tstr - dummy).otherwise(dummy - tstr) / gap)


def target_ratio(reference: Column, synthetic: Column, classification: Column) -> Column:
    return F.when(classification, ratio(synthetic, reference)).otherwise(ratio(reference, synthetic))


def complete_mean(value: Column, expected: int) -> Column:
    """The mean only if all expected values are there."""
    return F.when(F.count(value) == expected, F.avg(value))


def class_support(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(class, state) of classes on one side only."""
    a, b = (x.where(F.col(column).isNotNull()).select(F.col(column).alias("class")).distinct() for x in (train, test))
    return b.join(a, "class", "left_anti").withColumn("state", F.lit("test_only")).unionByName(a.join(b, "class", "left_anti").withColumn("state", F.lit("train_only")))
