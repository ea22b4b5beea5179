"""Boosted trees over ordered target statistics: categories become numbers without a row ever seeing its own target."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.contracts import GateError
from tallyframe.functions.expressions import present
from tallyframe.operators.estimators import codes_of, report_metrics
from tallyframe.operators.stats import by_value, running_sums
from tallyframe.sources.working import working


def ordered_statistics(df: DataFrame, column: str, target: Column, order: Column, *, weight: float = 1.0, name: str | None = None) -> DataFrame:
    """``df`` with, per row, the mean target of the rows of its category that come before it in ``order`` (a whole number, never
    null), drawn to the overall mean by ``weight`` rows of that.

    Rows of one category at the same place see the same earlier rows. A missing category is one of its own; rows without a
    target add nothing. Sums run in buckets of a category, so a frequent one is never sorted in one task.
    """
    held = df.withColumns({"_c": F.col(column).cast("string"), "_o": order.cast("long"), "_y": present(target)})
    prior = held.agg(F.avg("_y").alias("_prior"))
    sums = running_sums(held.groupBy("_c", "_o").agg(F.count("_y").alias("_n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("_s"), F.count(F.lit(1)).alias("_rows")), ["_c"], "_o", ["_n", "_s"])
    before = sums.select(F.col("_c").alias("_k__c"), F.col("_o").alias("_k__o"), "_rows", (F.col("upto__n") - F.col("_n")).alias("_bn"), (F.col("upto__s") - F.col("_s")).alias("_bs"))
    told = by_value(held, before, ["_c", "_o"], "_rows").join(F.broadcast(prior))  # one row
    stat = (F.col("_bs") + F.lit(weight) * F.col("_prior")) / (F.col("_bn") + F.lit(weight))
    return told.withColumn(name or f"{column}_stat", stat).drop("_c", "_o", "_y", "_prior", "_rows", "_bn", "_bs")


class Statistics:
    """Whole-table statistics of categories, fitted on one table, for rows that took no part; an unknown category gets the mean."""

    def __init__(self, train: DataFrame, column: str, target: Column, weight: float = 1.0):
        y = present(target)
        self.column, self.prior = column, float(train.agg(F.avg(y)).first()[0] or 0.0)
        each = train.groupBy(F.col(column).cast("string").alias("_k__c")).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.count(y).alias("n"), F.count(F.lit(1)).alias("_rows"))
        self.table = working(each.select("_k__c", "_rows", ((F.col("s") + F.lit(weight * self.prior)) / (F.col("n") + F.lit(weight))).alias("_stat")), "statistics")

    def apply(self, df: DataFrame, name: str | None = None) -> DataFrame:
        told = by_value(df.withColumn("_c", F.col(self.column).cast("string")), self.table, ["_c"], "_rows")
        return told.withColumn(name or f"{self.column}_stat", F.coalesce("_stat", F.lit(self.prior))).drop("_c", "_stat", "_rows")


def evaluate(arms: dict[str, DataFrame], target: str, task: str, numeric: list[str], categorical: list[str], *, kind: str, order: Column, rounds: int = 50, depth: int = 5, rate: float = 0.1, weight: float = 1.0, seed: int = 0) -> DataFrame:
    """(split, metric, value, score) of boosted trees fitted on the ``real``, the ``synthetic`` or the ``merged`` rows of ``arms``
    (train, val, test, synthetic), told for the rows fitted on, val and test.

    Categories become ordered statistics on the rows fitted on, in the given order, and whole statistics elsewhere; for
    classes there is one statistic and one model per class. Rounds stop when the validation rows gain no more.
    """
    if kind not in ("real", "synthetic", "merged"):
        raise GateError("invalid_evaluation", kind)
    fitted_on = {"real": lambda: arms["train"], "synthetic": lambda: arms["synthetic"], "merged": lambda: arms["train"].unionByName(arms["synthetic"])}[kind]()
    columns = [*numeric, *categorical, target]
    plain = {"train": fitted_on, "val": arms["val"], "test": arms["test"]}
    plain = {k: df.withColumn("_order", order).select(*columns, "_order").where(F.col(target).isNotNull()) for k, df in plain.items()}
    labels = codes_of(reduce(DataFrame.unionByName, [df.drop("_order") for df in plain.values()]), plain["test"], target) if task == "classification" else [None]
    models = labels[1:] if len(labels) == 2 else labels  # of two classes, one model tells both

    def scored(label: str | None) -> dict[str, DataFrame]:
        y = F.col(target).cast("double") if label is None else (F.col(target).cast("string") == label).cast("double")
        made = {k: df.withColumns({"_id": F.monotonically_increasing_id()}) for k, df in held.items()}
        for c in categorical:
            made["train"] = ordered_statistics(made["train"], c, y, F.col("_order"), weight=weight)
            whole = Statistics(held["train"], c, y, weight)
            made |= {k: whole.apply(made[k]) for k in ("val", "test")}
        features = VectorAssembler(inputCols=[*numeric, *[f"{c}_stat" for c in categorical]], outputCol="features", handleInvalid="keep")
        flat = {k: features.transform(df.withColumns({n: present(F.col(n)) for n in numeric}).withColumn("label", y)).select("_id", "label", "features") for k, df in made.items()}
        both = flat["train"].withColumn("_held", F.lit(False)).unionByName(flat["val"].withColumn("_held", F.lit(True)))
        trees = GBTRegressor if label is None else GBTClassifier
        model = trees(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="_held").fit(both)
        s = F.col("prediction") if label is None else F.get(vector_to_array("probability"), F.lit(1))
        return {k: model.transform(df).select("_id", s.alias("s")) for k, df in flat.items()}

    held = {k: working(df, f"boosted-{k}") for k, df in plain.items()}
    found = [scored(label) for label in models]
    out = None
    for k, df in held.items():
        told = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.col(target).alias("label"))
        for i, one in enumerate(found):
            told = told.join(one[k].withColumnRenamed("s", f"s{i}"), "_id")
        if task == "regression":
            told = told.select(F.col("label").cast("double").alias("label"), F.col("s0").alias("prediction"))
        else:
            shares = F.array(1 - F.col("s0"), F.col("s0")) if len(labels) == 2 else F.array(*[F.col(f"s{i}") for i in range(len(labels))])
            known = F.array(*[F.lit(v) for v in labels])
            told = told.select(F.col("label").cast("string").alias("label"), shares.alias("scores")).withColumn("prediction", F.get(known, (F.array_position("scores", F.array_max("scores")) - 1).cast("int")))
        here = report_metrics(working(told, "told"), task, labels=labels if task == "classification" else None).select(F.lit(k).alias("split"), "metric", "value", "score")
        out = here if out is None else out.unionByName(here)
    return out
