"""Writes evaluation results as an atomic relation and verifies such a bundle by computing its aggregates again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.contracts import ATOMIC, SCOPES, STATES
from tallyframe.operators.utility import local_retention


def atomic(df: DataFrame, **constant: object) -> DataFrame:
    """``df`` in the shape of the result relation; what it lacks comes from ``constant`` or is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(constant.get(f.name))).cast(f.dataType).alias(f.name) for f in ATOMIC.fields])


def problems(rows: DataFrame) -> DataFrame:
    """(problem, n): row invariants and the key of the relation; no rows if all hold."""
    values = [F.col(c) for c in ("raw_value", "normalized_value", "aggregate_contribution", "reference_value")]
    finite = [c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf"))) for c in [*values, F.col("weight")]]
    computed = F.col("state") == "computed"
    checks = {
        "unknown_state": ~F.col("state").isin(*STATES),
        "unknown_scope": ~F.col("scope_type").isin(*SCOPES),
        "not_finite": ~(finite[0] & finite[1] & finite[2] & finite[3] & finite[4]),
        "negative_weight": F.col("weight") < 0,
        "too_many_rows": F.col("n_valid") + F.col("n_excluded") > F.col("n_reference") + F.col("n_synthetic"),
        "computed_with_reason": computed & F.col("reason_code").isNotNull(),
        "value_without_state": ~computed & F.coalesce(*values).isNotNull(),
        "state_without_reason": ~computed & F.col("reason_code").isNull(),
        "contribution_without_value": F.col("aggregate_contribution").isNotNull() & F.col("normalized_value").isNull(),
    }
    counted = rows.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in checks.items()])
    found = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("n")) for k in checks])).alias("x")).select("x.*").where("n > 0")
    repeated = rows.groupBy("metric_id", "scope_type", "scope_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("duplicate_key").alias("problem"), "n")
    wrong = F.abs(F.col("aggregate_contribution") - F.col("normalized_value") * F.col("weight")) > 1e-12 * F.greatest(F.abs(F.col("aggregate_contribution")), F.lit(1.0))
    shares = rows.agg(F.count_if(wrong).alias("n")).where("n > 0").select(F.lit("wrong_contribution").alias("problem"), "n")
    return found.unionByName(repeated).unionByName(shares)


def property_scores(rows: DataFrame) -> DataFrame:
    """(dimension, score, n_rows, n_computed, complete) from the atomic rows alone."""
    return rows.groupBy("dimension").agg(F.sum("aggregate_contribution").alias("score"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("state") == "computed").alias("n_computed"), F.bool_and(F.col("state").isin("computed", "not_applicable")).alias("complete"))


def recomputed(rows: DataFrame) -> DataFrame:
    """(metric_id, scope_id, field, stored, expected): weights, contributions and retentions that do not follow from the rows they rest on.

    Rows of a metric that have a weight share it equally; a contribution is value times weight; a retention is that of its
    three raw arms. Differences within 1e-12 are none.
    """
    off = lambda a, b: F.coalesce(F.abs(a - b) > 1e-12 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), a.isNull() != b.isNull())
    shares = rows.where(F.col("weight") > 0).groupBy("metric_id").agg(F.count(F.lit(1)).alias("_n"))
    weighed = rows.where(F.col("weight") > 0).join(shares, "metric_id").withColumn("_partial", F.col("metric_id") == "std-local-utility-retention")
    told = lambda df, field, stored, expected: df.where(off(stored, expected)).select("metric_id", "scope_id", F.lit(field).alias("field"), stored.alias("stored"), expected.alias("expected"))
    weights = told(weighed.where(~F.col("_partial")), "weight", F.col("weight"), 1.0 / F.col("_n"))
    contributions = told(rows.where(F.col("normalized_value").isNotNull()), "aggregate_contribution", F.col("aggregate_contribution"), F.col("normalized_value") * F.col("weight"))
    raw = rows.where(F.col("metric_id").isin("std-local-utility-macro-f1", "std-local-utility-rmse") & F.col("raw_value").isNotNull())
    split = raw.select(F.regexp_replace("scope_id", "--(dummy|trtr|tstr)$", "").alias("scope_id"), F.regexp_extract("scope_id", "--(dummy|trtr|tstr)$", 1).alias("arm"), "raw_value", F.col("metric_id").endswith("macro-f1").alias("up"))
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.col("raw_value"))).alias(name)
    wide = split.groupBy("scope_id", "up").agg(arm("dummy"), arm("trtr"), arm("tstr")).withColumn("expected", local_retention(F.col("dummy"), F.col("trtr"), F.col("tstr"), F.col("up")))
    kept = rows.where(F.col("metric_id") == "std-local-utility-retention").select("metric_id", "scope_id", "raw_value").join(wide.select("scope_id", "expected"), "scope_id")
    retentions = told(kept, "raw_value", F.col("raw_value"), F.col("expected"))
    return weights.unionByName(contributions).unionByName(retentions)


def verify(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(problem, n): broken row invariants, values that do not follow from the rows, and stored scores (metric_id, score) other than the sums of contributions."""
    sums = rows.groupBy("metric_id").agg(F.sum("aggregate_contribution").alias("_sum"))
    wrong = scores.join(sums, "metric_id", "left").where(F.col("score").isNotNull() & F.coalesce(F.abs(F.col("score") - F.col("_sum")) > 1e-12, F.lit(True)))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("problem"), "n")
    return problems(rows).unionByName(count(recomputed(rows), "not_reproducible")).unionByName(count(wrong, "wrong_score"))


def write_bundle(rows: DataFrame, path: str, scores: DataFrame | None = None) -> None:
    """The result relation, and the stored scores beside it, as Parquet."""
    rows.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    if scores is not None:
        scores.write.option("compression", "zstd").mode("errorifexists").parquet(path.rstrip("/") + "-scores")


def validate_bundle(spark: SparkSession, path: str, *, scored: bool = False) -> DataFrame:
    rows = spark.read.schema(ATOMIC).parquet(path)
    return verify(rows, spark.read.parquet(path.rstrip("/") + "-scores")) if scored else problems(rows)
