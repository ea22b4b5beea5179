"""Reports over metric rows: by seed, run, dataset and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expressions import nested
from tallyframe.operators.stats import quantiles
from tallyframe.operators.utility import complete_mean, local_retention, ranking_scores, target_ratio


def moments(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(by..., n, mean, std_pop, std_samp, low, high)."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std_pop"), F.stddev_samp(column).alias("std_samp"), F.min(column).alias("low"), F.max(column).alias("high"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct) of each column, missing counted as a value."""
    made = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias("n_distinct")) for c in columns])
    return df.agg(made.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def seeds_report(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, std) over seeds, with the population deviation."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def run_report(df: DataFrame, value: str, by: str, *, complement: bool = True, digits: int = 3) -> DataFrame:
    """(by, mean_percent, std_percent) over repeated runs, with the sample deviation; ``complement`` tells 1 - value."""
    mean = F.avg(value)
    return df.groupBy(by).agg(F.round(((1 - mean) if complement else mean) * 100, digits).alias("mean_percent"), F.round(F.stddev_samp(value) * 100, digits).alias("std_percent"))


def state_counts(df: DataFrame, state: str, warnings: str) -> DataFrame:
    """(state, n, warnings): rows in each state, and the sorted set of their warning codes (an array column), comma-joined."""
    flat = df.select(F.col(state).alias("state"), F.explode_outer(warnings).alias("w")).where("w is not null").distinct().groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("warnings"))
    counts = df.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(flat, "state", "left").select("state", "n", F.coalesce("warnings", F.lit("")).alias("warnings"))


def resource_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, most, middle, p95, total)."""
    found = quantiles(df, value, {"middle": 0.5, "p95": 0.95}, [by])
    return df.groupBy(by).agg(F.max(value).alias("most"), F.sum(value).alias("total")).join(found, by)


def best_parameters(df: DataFrame, by: str, parameters: str, value: str, *, greatest: bool = True) -> DataFrame:
    """(by, best, best_value): the parameters of the best value, the least of those as good."""
    score = -F.col(value) if greatest else F.col(value)
    return df.groupBy(by).agg(F.min_by(parameters, F.struct(score, F.col(parameters))).alias("best"), (F.max(value) if greatest else F.min(value)).alias("best_value"))


def stability(df: DataFrame, value: str, by: str, limit: float = 0.05) -> DataFrame:
    """(by, n, mean, std, spread, max_deviation, stable): ratios that should be 1, and whether none strays from it beyond the limit."""
    off = F.max(F.abs(F.col(value) - 1))
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("spread"), off.alias("max_deviation"), (off <= limit).alias("stable"))


def leaderboard(df: DataFrame, method: str, dataset: str, value: str) -> DataFrame:
    """(method, n_datasets, macro_mean): means over seeds within a dataset first, then over datasets."""
    return df.groupBy(method, dataset).agg(F.avg(value).alias("v")).groupBy(method).agg(F.count(F.lit(1)).alias("n_datasets"), F.avg("v").alias("macro_mean"))


def results_matrix(df: DataFrame, method: str, dataset: str, value: str, datasets: list[str], digits: int = 4, absent: str = "--") -> DataFrame:
    """A row per method and a text column per dataset; ``absent`` where there is no result."""
    wide = df.groupBy(method).pivot(dataset, datasets).agg(F.avg(value))
    return wide.select(method, *[F.when(F.col(f"`{c}`").isNull(), absent).otherwise(F.format_string(f"%.{digits}f", F.col(f"`{c}`"))).alias(c) for c in datasets])


def votes(df: DataFrame, row: str, label: str, weight: Column | None = None) -> DataFrame:
    """(row, voted, votes): each row's label with the most votes over trials, the least of those with as many."""
    counted = df.groupBy(row, label).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("k"))
    return counted.groupBy(row).agg(F.min_by(label, F.struct(-F.col("k"), F.col(label))).alias("voted"), F.sum("k").alias("votes"))


def vote_scores(voted: DataFrame, truth: DataFrame, row: str, label: str) -> DataFrame:
    """(micro_f1, micro_auc, n) of votes over trials, given as (row, label, k): for a label each, micro F1 is the share of rows whose
    most voted label is the true one, and micro AUC ranks the shares of all rows and labels together against what is true.

    Labels are those that are true of a row; a row without votes has share 0 for all.
    """
    shares = voted.groupBy(row).agg(F.sum("k").alias("_all"), F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string"), F.col("k")))).alias("_of"), F.min_by(label, F.struct(-F.col("k"), F.col(label))).cast("string").alias("_best"))  # labels of a declared column
    known = truth.select(F.col(label).cast("string").alias("_l")).distinct()
    held = truth.select(row, F.col(label).cast("string").alias("_true")).join(shares, row, "left")
    micro = held.agg(F.avg(F.coalesce(F.col("_best") == F.col("_true"), F.lit(False)).cast("double")).alias("micro_f1"), F.count(F.lit(1)).alias("n"))
    cells = held.join(F.broadcast(known)).select((F.col("_l") == F.col("_true")).alias("y"), F.coalesce(F.try_divide(F.try_element_at("_of", F.col("_l")).cast("double"), F.col("_all").cast("double")), F.lit(0.0)).alias("s"))
    return micro.join(ranking_scores(cells, F.col("y"), "s").select(F.col("roc_auc").alias("micro_auc")))  # single rows


def imputed_error(imputed: DataFrame, truth: DataFrame, row: str, value: str, low: float = 1.0, high: float = 20000.0) -> DataFrame:
    """(rmse, n) of ``imputed_mean`` against the logarithm of the clipped true value."""
    y = F.ln(F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)))
    return truth.select(row, y.alias("_y")).join(imputed, row).agg(F.sqrt(F.avg(F.pow(F.col("imputed") - F.col("_y"), F.lit(2.0)))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def imputed_mean(df: DataFrame, row: str, value: str, low: float = 1.0, high: float = 20000.0) -> DataFrame:
    """(row, imputed): the mean over trials of the logarithm of the clipped value."""
    return df.groupBy(row).agg(F.avg(F.ln(F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)))).alias("imputed"))


def merge_specs(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Records of two roots by key: fields of the preferred one where it has them, else the other's."""
    fields = [c for c in dict.fromkeys([*preferred.columns, *other.columns]) if c != key]
    a = preferred.select(key, *[F.col(c).alias(f"_a_{c}") for c in fields if c in preferred.columns])
    b = other.select(key, *[F.col(c).alias(f"_b_{c}") for c in fields if c in other.columns])
    pick = lambda c: F.coalesce(*[F.col(f"_{s}_{c}") for s, df in (("a", preferred), ("b", other)) if c in df.columns])
    return a.join(b, key, "full_outer").select(key, *[pick(c).alias(c) for c in fields])


def aligned_arms(df: DataFrame, by: list[str], value: str, *, higher_is_better: Column) -> DataFrame:
    """(by..., dummy, trtr, tstr, retention, ratio) from rows with an ``arm`` of these names."""
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.col(value))).alias(name)
    wide = df.groupBy(*by).agg(arm("dummy"), arm("trtr"), arm("tstr"))
    return wide.select(*by, "dummy", "trtr", "tstr", local_retention(F.col("dummy"), F.col("trtr"), F.col("tstr"), higher_is_better).alias("retention"), target_ratio(F.col("trtr"), F.col("tstr"), higher_is_better).alias("ratio"))


def local_summary(aligned: DataFrame, by: list[str], expected: int) -> DataFrame:
    """(by..., n_defined, retention): the mean retention, null unless all ``expected`` ones are defined."""
    return aligned.groupBy(*by).agg(F.count("retention").alias("n_defined"), complete_mean(F.col("retention"), expected).alias("retention"))


def global_summary(ratios: DataFrame, target: str, seed: str, predictor: str, value: str, expected: int) -> DataFrame:
    """(n, n_targets, global_utility): mean over predictors, then seeds, then targets; null unless all ``expected`` ratios are defined."""
    runs = ratios.groupBy(target, seed).agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    targets = runs.groupBy(target).agg(F.avg("v").alias("v"), F.sum("n").alias("n"))
    return targets.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_targets"), F.when(F.sum("n") == expected, F.avg("v")).alias("global_utility"))


def legacy_ratios(df: DataFrame, column: str) -> DataFrame:
    """(column, kind, ratio) from rows (column, task, reference, synthetic): a constant synthetic column scores 1; zero or missing references give no row."""
    syn = F.when(F.col("constant"), F.lit(1.0)).otherwise(F.col("synthetic"))
    classes = (F.col("task") == "classification") | F.col("constant")
    out = df.select(column, F.when(classes, "classification").otherwise("regression").alias("kind"), target_ratio(F.col("reference"), syn, classes).alias("ratio"), F.col("reference").alias("_r"), syn.alias("_s"))
    usable = (F.col("_r") != 0) & (F.col("kind").eqNullSafe("classification") | (F.col("_s") != 0))
    return out.where(usable & F.col("ratio").isNotNull()).drop("_r", "_s")


def summary_rows(df: DataFrame, column: str, fields: dict[str, tuple[str, ...]], order: list[str]) -> DataFrame:
    """One row per summary text (JSON): the named nested fields, sorted."""
    return df.select(*[nested(F.col(column), *path).alias(name) for name, path in fields.items()]).orderBy(*order)


def inventory(df: DataFrame, order: str, **wanted: str) -> DataFrame:
    """The entries of an inventory that have all wanted values, sorted by name."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == value)
    return df.orderBy(order)
