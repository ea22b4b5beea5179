"""Distribution and association similarity of a reference and a candidate arm, told apart by a boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expressions import present, ratio
from tallyframe.operators.stats import co_moments, rho, running_sums

ARM = "is_candidate"


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column_name, value, arm) rows without nulls: all columns pass through one shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("v")) for c in columns]))
    return df.select(F.col(ARM), cells.alias("x")).select(ARM, "x.column_name", "x.v").where("v is not null")


def ks_complement(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, score): 1 - the largest gap of the two distribution functions; null without values in an arm.

    Values are counted first, each column by itself; running sums pass over buckets of distinct values.
    """
    arm = lambda c: df.where(present(F.col(c)).isNotNull()).groupBy(present(F.col(c)).alias("v")).agg(F.count_if(~F.col(ARM)).alias("r"), F.count_if(F.col(ARM)).alias("s")).select(F.lit(c).alias("column_name"), "v", "r", "s")
    placed = running_sums(reduce(DataFrame.unionByName, [arm(c) for c in columns]), ["column_name"], "v", ["r", "s"])
    gap = F.abs(ratio(F.col("upto_r"), F.col("all_r")) - ratio(F.col("upto_s"), F.col("all_s")))
    return placed.groupBy("column_name").agg((1 - F.max(gap)).alias("score"))


def tv_complement(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, score): 1 - half the sum of differences of category shares."""
    counts = _long(df, columns, "string").groupBy("column_name", "v").agg(F.count_if(~F.col(ARM)).alias("r"), F.count_if(F.col(ARM)).alias("s"))
    return _tv(counts, "column_name")


def _tv(counts: DataFrame, key: str) -> DataFrame:
    totals = counts.groupBy(key).agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    joined = counts.join(totals, key)
    gap = F.abs(F.try_divide(F.col("r").cast("double"), F.col("nr").cast("double")) - F.try_divide(F.col("s").cast("double"), F.col("ns").cast("double")))
    return joined.groupBy(key).agg((1 - F.sum(gap) / 2).alias("score"))


def column_shapes(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Every column's score with its weight and contribution to the property's mean."""
    scores = ks_complement(df, numeric).withColumn("metric_id", F.lit("ks_complement")).unionByName(tv_complement(df, categorical).withColumn("metric_id", F.lit("tv_complement")))
    n = F.count("score").over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("weight", F.when(F.col("score").isNotNull(), 1.0 / n).otherwise(0.0)).withColumn("contribution", F.col("score") * F.col("weight"))


def correlation_similarity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left_column, right_column, real_rho, candidate_rho, score) of all pairs.

    Each task sums co-moments of all columns at once, so a table of many columns needs no expression per pair. Null where a
    column is constant.
    """
    names = F.array(*[F.lit(c) for c in columns])
    long = co_moments(df, columns, ARM).select(F.get(names, "i").alias("left_column"), F.get(names, "j").alias("right_column"), "by", rho().alias("rho"))
    out = long.groupBy("left_column", "right_column").agg(F.max(F.when(F.col("by") == "false", F.col("rho"))).alias("real_rho"), F.max(F.when(F.col("by") == "true", F.col("rho"))).alias("candidate_rho"))
    return out.withColumn("score", 1 - F.abs(F.col("real_rho") - F.col("candidate_rho")) / 2)


def contingency_similarity(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair_name, score) over the union of joint cells."""
    cells = F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair_name"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs]))
    long = df.select(ARM, cells.alias("x")).select(ARM, "x.*").where("a is not null and b is not null")
    return _tv(long.groupBy("pair_name", "a", "b").agg(F.count_if(~F.col(ARM)).alias("r"), F.count_if(F.col(ARM)).alias("s")), "pair_name")


def binned(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Each numeric column replaced by its bin of equal width, edges fitted per arm."""
    bounds = df.groupBy(ARM).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(bounds), ARM)  # two rows
    cut = lambda c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), 1).otherwise(F.floor(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * bins) + 1).cast("int")
    return out.withColumns({c: cut(c) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pair_name, chi2, n, v): association of two categorical columns, without bias correction."""
    return cramers_vs(df, [(a, b)])


def cramers_vs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair_name, chi2, n, v) of all pairs; sums run over joint cells, whose number is that of the categories."""
    cells = F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair_name"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs]))
    o = df.select(cells.alias("x")).select("x.*").where("a is not null and b is not null").groupBy("pair_name", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"))
    side = lambda c: o.groupBy("pair_name", c).agg(F.sum("o").alias(f"r{c}"))
    e = o.join(side("a"), ["pair_name", "a"]).join(side("b"), ["pair_name", "b"])
    g = e.groupBy("pair_name").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("q"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    chi2 = F.col("n") * F.col("q") - F.col("n")
    v = F.sqrt(F.greatest(ratio(chi2, F.col("n") * (F.least("ka", "kb") - 1)), F.lit(0.0)))
    return g.select("pair_name", chi2.alias("chi2"), F.col("n").cast("long").alias("n"), v.alias("v"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(arm, bin, n) over edges shared by both arms."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    cut = F.least(F.floor(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(column).isNotNull()).join(F.broadcast(bounds)).groupBy(ARM, cut.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def union_arms(real: DataFrame, candidate: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [real.withColumn(ARM, F.lit(False)), candidate.withColumn(ARM, F.lit(True))])
