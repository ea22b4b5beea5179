"""Registered queries of the evaluation: result relations, arms of fitted models, privacy, encodings and reports, with their SQL.

The train arm of ``lineitem`` holds the order keys that 3 divides, the synthetic arm those that leave 1, the test arm the
rest; models are fitted to one number, where SQL can state the fit as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.contracts import ColumnSpec, Profile
from tallyframe.functions import expressions as X
from tallyframe.operators import audit, boosted, distance, estimators, generate, preprocess, reports, rules, stats, tuning
from tallyframe.plans import bundle, evaluate
from tallyframe.plans.registry import _KS_BODY, _TV_BODY, CONSTRAINTS, _contingency_sql, r6, registered, table
from tallyframe.sources import tables
from tallyframe.sources.working import working

COLUMNS = (ColumnSpec("l_quantity", "continuous"), ColumnSpec("l_extendedprice", "continuous"), ColumnSpec("l_returnflag", "categorical"), ColumnSpec("l_linestatus", "categorical"), ColumnSpec("l_partkey", "string"))
PROFILE = Profile("lineitem", COLUMNS)


def _related(df: DataFrame) -> DataFrame:
    """The columns of ``lineitem`` are independent: the price is made to depend on the quantity, the status on the flag."""
    return df.withColumns({"l_extendedprice": F.col("l_extendedprice") + 2000 * F.col("l_quantity"), "l_linestatus": F.when(F.col("l_returnflag") == "R", "F").otherwise(F.col("l_linestatus"))})


_RELATED = "SELECT * REPLACE (l_extendedprice + 2000 * l_quantity AS l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'F' ELSE l_linestatus END AS l_linestatus), l_orderkey % 2 = 1 AS s FROM lineitem"


def _two_arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _related(table(spark, d, "lineitem"))
    pick = lambda df: df.select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("l_partkey"))
    return pick(t.where("l_orderkey % 2 = 0")), pick(t.where("l_orderkey % 2 = 1"))


def _v_sql(a: str, b: str, source: str) -> str:
    return f"(SELECT sqrt(greatest((sum(o * o / (ra * rb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1), 0)) FROM (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {source} WHERE NOT s GROUP BY ALL)))"


def _pair_sql(a: str, b: str, source: str) -> str:
    score = _contingency_sql(a, b, source).replace(f"'{a}|{b}' AS pair_name, round(", "").replace(", 6) AS score", " AS score")
    return f"SELECT '{a}--{b}' AS scope_id, ({score}) AS score, {_v_sql(a, b, source)} AS strength, 0.3 AS least"


_CUT = "cut AS (SELECT t.s, l_returnflag, l_linestatus, floor((l_extendedprice - lo) / (hi - lo) * 10)::INT + 1 AS l_extendedprice, floor((l_quantity - ql) / (qh - ql) * 10)::INT + 1 AS l_quantity FROM t JOIN (SELECT s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_quantity) AS ql, max(l_quantity) AS qh FROM t GROUP BY s) e ON t.s = e.s)"
_MIXED = [("l_quantity", "l_returnflag"), ("l_quantity", "l_linestatus"), ("l_extendedprice", "l_returnflag"), ("l_extendedprice", "l_linestatus"), ("l_returnflag", "l_linestatus")]
_UNSUPPORTED = [("l_quantity", "l_partkey"), ("l_extendedprice", "l_partkey"), ("l_returnflag", "l_partkey"), ("l_linestatus", "l_partkey")]
_FIDELITY = (
    f"WITH t AS ({_RELATED}), {_KS_BODY}, {_TV_BODY}, {_CUT}, shapes AS (SELECT column_name AS scope_id, score, NULL::DOUBLE AS strength, NULL::DOUBLE AS least FROM ks WHERE column_name IN ('l_quantity', 'l_extendedprice') UNION ALL SELECT column_name, score, NULL, NULL FROM tv UNION ALL SELECT 'l_partkey', NULL, NULL, NULL), "
    "rho AS (SELECT 'l_quantity--l_extendedprice' AS scope_id, 1 - abs(corr(l_quantity, l_extendedprice) FILTER (NOT s) - corr(l_quantity, l_extendedprice) FILTER (s)) / 2 AS score, abs(corr(l_quantity, l_extendedprice) FILTER (NOT s)) AS strength, 0.5 AS least FROM t), "
    f"trends AS (SELECT * FROM rho UNION ALL {' UNION ALL '.join(_pair_sql(a, b, 'cut') for a, b in _MIXED)} UNION ALL {' UNION ALL '.join(f"SELECT '{a}--{b}', NULL, NULL, NULL" for a, b in _UNSUPPORTED)}), "
    "u AS (SELECT 'sdmetrics-column-shapes' AS metric_id, 'column' AS scope_type, * FROM shapes UNION ALL SELECT 'sdmetrics-column-pair-trends', 'pair', * FROM trends), "
    "z AS (SELECT *, CASE WHEN score IS NULL THEN 'unsupported_semantic_type' WHEN strength <= least THEN 'below_source_threshold' END AS reason_code FROM u), "
    "w AS (SELECT *, CASE WHEN reason_code IS NULL THEN 'computed' ELSE 'not_applicable' END AS state, CASE WHEN reason_code IS NULL THEN score END AS raw_value, CASE WHEN reason_code IS NULL THEN 1.0 / count(*) FILTER (reason_code IS NULL) OVER (PARTITION BY metric_id) ELSE 0 END AS weight FROM z), "
    "n AS (SELECT count(*) FILTER (NOT s) AS n_reference, count(*) FILTER (s) AS n_synthetic FROM t)"
)


@registered(_FIDELITY + " SELECT metric_id, scope_type, scope_id, state, reason_code, round(raw_value, 6) AS raw_value, round(weight, 6) AS weight, round(raw_value * weight, 6) AS aggregate_contribution, n_reference, n_synthetic, n_reference + n_synthetic AS n_valid, 0::BIGINT AS n_excluded FROM w, n")
def evaluate_table_atoms(spark, d):
    atoms = evaluate.evaluate_table(*_two_arms(spark, d), PROFILE, expected_rows=None).atoms
    return atoms.select("metric_id", "scope_type", "scope_id", "state", "reason_code", *[r6(c, c) for c in ("raw_value", "weight", "aggregate_contribution")], "n_reference", "n_synthetic", "n_valid", "n_excluded")


@registered(_FIDELITY + " SELECT metric_id, round(sum(raw_value * weight), 6) AS score, count(*) AS n_rows, count(*) FILTER (state = 'computed') AS n_computed, 'success' AS status FROM w GROUP BY ALL")
def evaluate_table_scores(spark, d):
    out = evaluate.evaluate_table(*_two_arms(spark, d), PROFILE)
    return out.scores.select("metric_id", r6("score", "score"), "n_rows", "n_computed", F.lit(out.status).alias("status"))


@registered(_FIDELITY + " SELECT round((max(p) FILTER (metric_id LIKE '%shapes') + max(p) FILTER (metric_id LIKE '%trends')) / 2, 6) AS overall FROM (SELECT metric_id, sum(raw_value * weight) AS p FROM w GROUP BY ALL)")
def c11_overall(spark, d):
    return evaluate.overall(evaluate.evaluate_table(*_two_arms(spark, d), PROFILE).scores).select(r6("overall", "overall"))


@registered(_FIDELITY + " SELECT name, n FROM (SELECT count(*) FILTER (scope_type = 'column') AS requested_columns, count(*) FILTER (scope_type = 'column' AND score IS NOT NULL) AS source_evaluated_columns, count(*) FILTER (scope_type = 'column' AND weight > 0) AS shape_contributing_columns, count(*) FILTER (scope_type = 'pair') AS requested_column_pairs, count(*) FILTER (scope_type = 'pair' AND score IS NOT NULL) AS source_evaluated_column_pairs, count(*) FILTER (scope_type = 'pair' AND weight > 0) AS trend_contributing_column_pairs FROM w) UNPIVOT (n FOR name IN (requested_columns, source_evaluated_columns, shape_contributing_columns, requested_column_pairs, source_evaluated_column_pairs, trend_contributing_column_pairs))")
def c09_denominators(spark, d):
    return evaluate.evaluate_table(*_two_arms(spark, d), PROFILE).denominators


@registered(_FIDELITY + " SELECT scope_id, round(strength, 6) AS strength, strength > least AS contributes FROM trends WHERE score IS NOT NULL")
def c07_thresholds(spark, d):
    both = evaluate._arms(*_two_arms(spark, d), PROFILE)
    return evaluate.trend_scores(both, PROFILE).where("evaluated").select("scope_id", r6("strength", "strength"), (F.col("strength") > F.col("least")).alias("contributes"))


@registered("WITH t AS (SELECT *, l_orderkey % 2 = 1 AS s, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END AS x, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS g FROM lineitem) SELECT * FROM (SELECT 'x' AS scope_id, count(x) AS n_valid, count(*) - count(x) AS n_excluded FROM t UNION ALL SELECT 'g', count(g), count(*) - count(g) FROM t UNION ALL SELECT 'x--g', count(*) FILTER (x IS NOT NULL AND g IS NOT NULL), count(*) FILTER (x IS NULL OR g IS NULL) FROM t)")
def c10_valid_counts(spark, d):
    holes = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("x"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")).alias("g"))
    profile = Profile("holes", (ColumnSpec("x", "continuous"), ColumnSpec("g", "categorical")))
    both = evaluate._arms(holes.where("l_orderkey % 2 = 0"), holes.where("l_orderkey % 2 = 1"), profile)
    return evaluate._counts(both, profile, [profile.columns]).select("scope_id", "n_valid", "n_excluded")


DEFINITIONS = [
    {"selector": {"semantic_types": ["continuous"]}, "rules": [{"type": "not_null"}, {"type": "finite"}, {"type": "bounds"}]},
    {"selector": {"valid_domain_keys": ["values"]}, "rules": [{"type": "allowed_values"}]},
    {"selector": {"roles_any": ["identifier"]}, "rules": [{"type": "regex", "pattern": "[0-9]+"}]},
]
JUDGED = Profile("lineitem", (ColumnSpec("l_quantity", "continuous", valid_domain={"min": 1, "max": 45}), ColumnSpec("l_extendedprice", "continuous", valid_domain={"min": 2000}), ColumnSpec("l_returnflag", "categorical", valid_domain={"values": ["A", "N"]}), ColumnSpec("l_linestatus", "categorical", valid_domain={"values": ["O", "F"]}), ColumnSpec("l_partkey", "string", roles=("identifier",))))
_P3 = f"WITH t AS (SELECT * FROM ({_RELATED}) WHERE s), v AS (SELECT 'column' AS scope_type, 'l_quantity' AS scope_id, count(*) FILTER (l_quantity BETWEEN 1 AND 45) AS g, count(*) AS m FROM t UNION ALL SELECT 'column', 'l_extendedprice', count(*) FILTER (l_extendedprice >= 2000), count(*) FROM t UNION ALL SELECT 'column', 'l_returnflag', count(*) FILTER (l_returnflag IN ('A', 'N')), count(*) FROM t UNION ALL SELECT 'column', 'l_linestatus', count(*) FILTER (l_linestatus IN ('O', 'F')), count(*) FROM t UNION ALL SELECT 'column', 'l_partkey', count(*), count(*) FROM t UNION ALL SELECT 'group', 'combinations', count(*) FILTER ((l_returnflag, l_linestatus) IN (('N', 'O'), ('R', 'F'), ('A', 'F'))), count(*) FROM t UNION ALL SELECT 'group', 'never', 0, 0)"


@registered(_P3 + ", w AS (SELECT *, g / nullif(m, 0)::DOUBLE AS raw_value, CASE WHEN m = 0 THEN 0 ELSE 1.0 / count(*) FILTER (m > 0) OVER (PARTITION BY scope_type) END AS weight FROM v) SELECT CASE scope_type WHEN 'column' THEN 'std-tabular-column-validity' ELSE 'std-tabular-constraint-validity' END AS metric_id, scope_id, CASE WHEN m = 0 THEN 'not_applicable' ELSE 'computed' END AS state, CASE WHEN m = 0 THEN 'no_applicable_rows' END AS reason_code, round(raw_value, 6) AS raw_value, round(weight, 6) AS weight, round(raw_value * weight, 6) AS aggregate_contribution FROM w")
def evaluate_table_validity(spark, d):
    held = {"combinations": CONSTRAINTS["combinations"], "never": {"type": "comparison", "left": "l_quantity", "right": "l_extendedprice", "op": "lt", "applies": {"type": "column_equals", "column": "l_returnflag", "value": "absent"}}}
    atoms = evaluate.evaluate_table(*_two_arms(spark, d), JUDGED, protocol="p3", definitions=DEFINITIONS, constraints=held).atoms
    return atoms.select("metric_id", "scope_id", "state", "reason_code", *[r6(c, c) for c in ("raw_value", "weight", "aggregate_contribution")])


def _three_arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = _related(table(spark, d, "lineitem")).select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag", "l_linestatus")
    return {name: t.where(F.col("l_orderkey") % 3 == k).drop("l_orderkey") for k, name in enumerate(("train", "synthetic", "test"))}


_FIT = "WITH t AS (SELECT l_orderkey % 3 AS arm, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE + 2000 * l_quantity AS y FROM lineitem), f AS (SELECT regr_slope(y, x) FILTER (arm = 0) AS b0, regr_intercept(y, x) FILTER (arm = 0) AS a0, regr_slope(y, x) FILTER (arm = 1) AS b1, regr_intercept(y, x) FILTER (arm = 1) AS a1, avg(y) FILTER (arm = 0) AS m FROM t), p AS (SELECT y, m AS dummy, a0 + b0 * x AS trtr, a1 + b1 * x AS tstr FROM t, f WHERE arm = 2), s AS (SELECT sqrt(avg((y - dummy) * (y - dummy))) AS dummy, sqrt(avg((y - trtr) * (y - trtr))) AS trtr, sqrt(avg((y - tstr) * (y - tstr))) AS tstr FROM p)"


@registered(_FIT + ", l AS (SELECT 'dummy' AS arm, dummy AS v FROM p UNION ALL SELECT 'trtr', trtr FROM p UNION ALL SELECT 'tstr', tstr FROM p) SELECT arm, round(sqrt(avg((y - v) * (y - v))), 3) AS rmse, round(avg(abs(y - v)), 3) AS mae, round(1 - avg((y - v) * (y - v)) / var_pop(y), 5) AS r2 FROM (SELECT 'dummy' AS arm, dummy AS v, y FROM p UNION ALL SELECT 'trtr', trtr, y FROM p UNION ALL SELECT 'tstr', tstr, y FROM p) GROUP BY arm")
def e03_fitted_arms(spark, d):
    runs = estimators.local_evaluation(_three_arms(spark, d), "l_extendedprice", "regression", ["l_quantity"], [], evaluators=["linear-regression"], seeds=[0])
    pick = lambda m, k: F.round(F.max(F.when(F.col("metric") == m, F.col("value"))), k).alias(m)
    return runs.groupBy("arm").agg(pick("rmse", 3), pick("mae", 3), pick("r2", 5))


@registered(_FIT + " SELECT 'linear-regression' AS evaluator, 1::BIGINT AS n_defined, round((dummy - tstr) / (dummy - trtr), 6) AS retention FROM s")
def e08_local_evaluation(spark, d):
    runs = estimators.local_evaluation(_three_arms(spark, d), "l_extendedprice", "regression", ["l_quantity"], [], evaluators=["linear-regression"], seeds=[0])
    aligned = reports.aligned_arms(runs.where("metric = 'rmse'"), ["evaluator", "seed"], "value", higher_is_better=F.lit(False))
    return reports.local_summary(aligned, ["evaluator"], 1).select("evaluator", "n_defined", r6("retention", "retention"))


@registered(_FIT + ", g AS (SELECT regr_slope(x, y) FILTER (arm = 0) AS b0, regr_intercept(x, y) FILTER (arm = 0) AS a0, regr_slope(x, y) FILTER (arm = 1) AS b1, regr_intercept(x, y) FILTER (arm = 1) AS a1 FROM t), q AS (SELECT sqrt(avg(pow(x - a0 - b0 * y, 2))) AS r, sqrt(avg(pow(x - a1 - b1 * y, 2))) AS s FROM t, g WHERE arm = 2) SELECT 2::BIGINT AS n, 2::BIGINT AS n_targets, round((trtr / tstr + r / q.s) / 2, 6) AS global_utility FROM s, q")
def e10_global_utility(spark, d):
    a = _three_arms(spark, d)
    runs = estimators.global_evaluation(a["train"], a["synthetic"], a["test"], ["l_quantity", "l_extendedprice"], [], evaluators={"regression": ["linear-regression"]}, seeds=[0])
    return reports.global_summary(estimators.global_ratios(runs), "target", "seed", "evaluator", "value", 2).select("n", "n_targets", r6("global_utility", "global_utility"))


@registered("WITH t AS (SELECT l_orderkey % 3 AS arm, l_returnflag AS y FROM lineitem), m AS (SELECT y FROM t WHERE arm = 0 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1), k AS (SELECT count(*) FILTER (t.y = m.y) AS hit, count(*) AS n, count(DISTINCT t.y) AS c FROM t, m WHERE arm = 2) SELECT 'dummy' AS arm, round(2 * (hit / n::DOUBLE) / (hit / n::DOUBLE + 1) / c, 6) AS macro_f1, round(1.0 / c, 6) AS balanced_accuracy FROM k")
def e02_dummy_arm(spark, d):
    a = _three_arms(spark, d)
    labels = estimators.codes_of(a["train"], a["test"], "l_returnflag")
    s = estimators.scores_of(estimators.dummy_predictions(a["train"], a["test"], "l_returnflag", "classification"), "classification", labels)
    return spark.createDataFrame([("dummy", round(s["macro-f1"], 6), round(s["balanced-accuracy"], 6))], "arm string, macro_f1 double, balanced_accuracy double")


@registered("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / s, 6) AS quantity, (l_returnflag = 'A')::INT AS a, (l_returnflag = 'N')::INT AS n, (l_returnflag = 'R')::INT AS r FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 3 = 0)")
def e01_feature_frame(spark, d):
    from pyspark.ml.functions import vector_to_array

    t = table(spark, d, "lineitem")
    features = estimators.Features(t.where("l_orderkey % 3 = 0"), ["l_quantity"], ["l_returnflag"])
    out = features.apply(t, F.lit(0.0), "l_orderkey", "l_linenumber", "l_partkey").withColumn("x", vector_to_array("features"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6(F.get("x", F.lit(0)), "quantity"), *[F.get("x", F.lit(i + 1)).cast("int").alias(c) for i, c in enumerate("anr")])


@registered("WITH f AS (SELECT min(p_retailprice) AS pl, max(p_retailprice) AS ph, min(p_size) AS sl, max(p_size) AS sh FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, round(CASE WHEN pl >= 0 AND ph >= 1000 THEN ln(greatest(p_retailprice, 0.01)) ELSE (p_retailprice - pl) / (ph - pl) * 5 END, 6) AS price, round(CASE WHEN sl >= 0 AND sh >= 1000 THEN ln(greatest(p_size, 0.01)) ELSE (p_size - sl) / (sh - sl)::DOUBLE * 5 END, 6) AS size, round(ln(least(greatest(p_retailprice, 1), 20000)), 6) AS target FROM part, f")
def e13_features(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), estimators.regression_target(F.col("p_retailprice")).alias("target"))
    return estimators.mle_features(p, p.where("p_partkey % 2 = 0"), ["price", "size"]).select("p_partkey", *[r6(c, c) for c in ("price", "size", "target")])


@registered("SELECT 'val' AS split, floor(count(*) / 9)::BIGINT AS n FROM orders UNION ALL SELECT 'train', count(*) - floor(count(*) / 9)::BIGINT FROM orders")
def e14_validation_split(spark, d):
    return preprocess.validation_rows(table(spark, d, "orders"), "o_orderkey", 7).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@registered("WITH r AS (SELECT s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END AS reference, s_acctbal + 1 AS synthetic, s_suppkey % 5 = 0 AS constant FROM supplier), k AS (SELECT name, CASE WHEN constant OR task = 'classification' THEN 'classification' ELSE 'regression' END AS kind, reference, CASE WHEN constant THEN 1 ELSE synthetic END AS synthetic FROM r WHERE reference <> 0) SELECT name, kind, round(CASE kind WHEN 'classification' THEN synthetic / reference ELSE reference / nullif(synthetic, 0) END, 6) AS ratio FROM k WHERE kind = 'classification' OR synthetic <> 0")
def e12_legacy_ratios(spark, d):
    s = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("name"), F.when(s % 2 == 0, "classification").otherwise("regression").alias("task"), F.when(s % 7 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("reference"), (F.col("s_acctbal") + 1).alias("synthetic"), (s % 5 == 0).alias("constant"))
    return reports.legacy_ratios(r, "name").select("name", "kind", r6("ratio", "ratio"))


@registered("WITH t AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem) SELECT metric, round(v, 4) AS value, round(s, 4) AS score FROM (SELECT 'rmse' AS metric, 2 * sqrt(avg((y - p) * (y - p))) AS v, -2 * sqrt(avg((y - p) * (y - p))) AS s FROM t UNION ALL SELECT 'r2', 1 - avg((y - p) * (y - p)) / var_pop(y), 1 - avg((y - p) * (y - p)) / var_pop(y) FROM t)")
def e18_report_metrics(spark, d):
    told = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return estimators.report_metrics(told, "regression", target_std=2.0).select("metric", F.round("value", 4).alias("value"), F.round("score", 4).alias("score"))


@registered(_FIT + ", b AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE arm < 2) SELECT 'linear-regression' AS evaluator, round(sqrt(avg(pow(y - a - b * x, 2))), 3) AS rmse FROM t, b WHERE arm = 2")
def e19_merged_model(spark, d):
    a = _three_arms(spark, d)
    out = estimators.simple_models(a["train"], a["synthetic"], a["test"], "l_extendedprice", "regression", ["l_quantity"], [], kind="merged", evaluators=["linear-regression"])
    return out.where("metric = 'rmse'").select("evaluator", F.round("value", 3).alias("rmse"))


@registered(_FIT + ", k AS (SELECT 1.0 AS k) SELECT 'linear-regression' AS evaluator, round(sqrt(avg(pow(y - a0 - b0 * x, 2))), 3) AS rmse FROM t, f WHERE arm = 2")
def e16_grid_search(spark, d):
    """The grid holds an unpenalised fit and two with a penalty that only harms; the best one's test score is that of the plain fit on both parts."""
    from pyspark.ml.regression import LinearRegression

    train = _related(table(spark, d, "lineitem")).where("l_orderkey % 3 = 0").select("l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    out = estimators.grid_search(train.where("l_partkey % 4 > 0"), train.where("l_partkey % 4 = 0"), _three_arms(spark, d)["test"].select("l_quantity", "l_extendedprice"), "l_extendedprice", "regression", ["l_quantity"], [], lambda p: LinearRegression(solver="normal", **p), {"regParam": [1e7, 0.0, 1e6]}, "rmse")
    return out.where("test is not null").select(F.lit("linear-regression").alias("evaluator"), F.round("test", 3).alias("rmse"))


_PLACE = "(l_orderkey * 7919 + l_linenumber * 104729) % 1000003"


@registered(f"WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, {_PLACE} AS o, l_extendedprice::DOUBLE AS y FROM lineitem), w AS (SELECT *, (SELECT avg(y) FROM t) AS p, coalesce(sum(y) OVER a, 0) AS sa, count(*) OVER a AS na, coalesce(sum(y) OVER b, 0) AS sb, count(*) OVER b AS nb FROM t WINDOW a AS (PARTITION BY l_returnflag ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY l_linestatus ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT l_orderkey, l_linenumber, round((sa + 2 * p) / (na + 2), 4) AS flag_stat, round((sb + 2 * p) / (nb + 2), 4) AS status_stat FROM w")
def e24_ordered_statistics(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    order, y = F.expr(_PLACE), F.col("l_extendedprice")
    out = boosted.ordered_statistics(boosted.ordered_statistics(t, "l_returnflag", y, order, weight=2.0, name="f"), "l_linestatus", y, order, weight=2.0, name="s")
    return out.select("l_orderkey", "l_linenumber", F.round("f", 4).alias("flag_stat"), F.round("s", 4).alias("status_stat"))


@registered()
def e24_boosted_trees(spark, d):
    """Categories that decide the target, by ordered statistics and boosted trees; the scores of each split."""
    t = _related(table(spark, d, "lineitem")).withColumn("l_linestatus", F.when(F.col("l_quantity") > 25, "O").otherwise(F.col("l_linestatus")))
    arm = {k: t.where(F.col("l_orderkey") % 5 == i) for i, k in enumerate(("train", "val", "test", "synthetic"))}
    out = boosted.evaluate(arm, "l_linestatus", "classification", ["l_quantity"], ["l_returnflag"], kind="merged", order=F.expr(_PLACE), rounds=5, depth=3)
    return out.select("split", "metric", r6("value", "value"))


@registered()
def e25_search(spark, d):
    """How much a category's statistic is drawn to the mean, searched on held-out rows."""
    t = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("kind"), F.col("p_retailprice").alias("y"))
    train, val = t.where("p_partkey % 4 > 0"), t.where("p_partkey % 4 = 0")

    def objective(point: dict) -> float:
        told = boosted.Statistics(train, "kind", F.col("y"), point["weight"]).apply(val)
        return told.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("kind_stat"), F.lit(2.0))))).first()[0]

    return tuning.search(spark, objective, {"weight": tuning.Choice("log", 0.01, 1000.0)}, 8, seed=1, maximize=False, startup=4).select("trial", "state", r6("value", "value"), "parameters")


@registered()
def c12_detection(spark, d):
    t = table(spark, d, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return estimators.detection_score(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), ["l_quantity", "l_tax"], ["l_returnflag"], key="row_key")


@registered()
def c13_alpha_beta(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return estimators.alpha_beta(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "c_custkey", ["c_acctbal", "c_nationkey"])


_BALLS = "c AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), g AS (SELECT max(v) - min(v) AS w FROM c WHERE id % 2 = 0), h AS (SELECT max(v) - min(v) AS w FROM c WHERE id % 2 = 1), a AS (SELECT id, v / (SELECT w FROM g) AS v FROM c WHERE id % 2 = 0), b AS (SELECT id, v / (SELECT w FROM g) AS v FROM c WHERE id % 2 = 1), e AS (SELECT id, v / (SELECT w FROM h) AS v FROM c WHERE id % 2 = 0), f AS (SELECT id, v / (SELECT w FROM h) AS v FROM c WHERE id % 2 = 1)"
_KTH = "SELECT id, max(d) AS r FROM (SELECT x.id, abs(x.v - y.v) AS d, row_number() OVER (PARTITION BY x.id ORDER BY abs(x.v - y.v)) AS k FROM {t} x JOIN {t} y ON y.id <> x.id) WHERE k <= 5 GROUP BY id"


@registered(f"WITH {_BALLS}, ra AS ({_KTH.format(t='a')}), rf AS ({_KTH.format(t='f')}), i AS (SELECT a.id AS centre, b.id AS point FROM a JOIN ra ON a.id = ra.id JOIN b ON abs(a.v - b.v) <= ra.r), j AS (SELECT f.id AS centre, e.id AS point FROM f JOIN rf ON f.id = rf.id JOIN e ON abs(f.v - e.v) <= rf.r) SELECT round((SELECT count(DISTINCT point) FROM i) / (SELECT count(*) FROM b)::DOUBLE, 6) AS precision, round((SELECT count(DISTINCT point) FROM j) / (SELECT count(*) FROM a)::DOUBLE, 6) AS recall, round((SELECT count(*) FROM i) / (5.0 * (SELECT count(*) FROM b))::DOUBLE, 3) AS density, round((SELECT count(DISTINCT centre) FROM i) / (SELECT count(*) FROM a)::DOUBLE, 6) AS coverage")
def c14_prdc(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    out = distance.prdc(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "c_custkey", ["c_acctbal"])
    return out.select(r6("precision", "precision"), r6("recall", "recall"), F.round("density", 3).alias("density"), r6("coverage", "coverage"))


@registered("WITH c AS (SELECT *, c_custkey % 3 AS arm FROM customer), x AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM c WHERE arm = 0), p AS (SELECT s.c_custkey, sqrt(pow(abs(s.c_acctbal - t.c_acctbal) / r, 2) + CASE WHEN s.c_mktsegment <> t.c_mktsegment THEN 1 ELSE 0 END) AS d FROM c s, c t, x WHERE s.arm = 2 AND t.arm = 0), n AS (SELECT c_custkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d) AS k FROM p), w AS (SELECT c_custkey, max(d) FILTER (k = 1) AS a, max(d) FILTER (k = 2) AS b FROM n WHERE k <= 2 GROUP BY ALL) SELECT round(quantile_cont(a, 0.05), 6) AS dcr, round(quantile_cont(a / nullif(b, 0), 0.05), 6) AS nndr FROM w")
def f05_fifth_percentiles(spark, d):
    c = table(spark, d, "customer")
    out = distance.nearest(c.where("c_custkey % 3 = 2"), c.where("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal"], ["c_mktsegment"], kind="l2", mismatch=1.0, neighbours=2)
    return distance.fifth_percentiles(out).select(r6("dcr", "dcr"), r6("nndr", "nndr"))


_PARTS = "WITH p AS (SELECT p_partkey AS id, p_size AS a, p_retailprice AS b, p_brand AS g, p_partkey % 3 AS arm FROM part)"


def _prdc_sql(fake: int) -> str:
    near = lambda x, y, w: f"sqrt(pow(abs({x}.a - {y}.a) / {w}.wa, 2) + pow(abs({x}.b - {y}.b) / {w}.wb, 2) + ({x}.g <> {y}.g)::INT)"
    side = lambda arm: f"(SELECT * FROM p WHERE arm = {arm})"
    width = lambda arm: f"(SELECT max(a) - min(a) AS wa, max(b) - min(b) AS wb FROM p WHERE arm = {arm})"
    kth = lambda arm: f"(SELECT id, max(d) AS r FROM (SELECT x.id, {near('x', 'y', 'w')} AS d, row_number() OVER (PARTITION BY x.id ORDER BY {near('x', 'y', 'w')}) AS k FROM {side(arm)} x JOIN {side(arm)} y ON x.id <> y.id, {width(arm)} w) WHERE k <= 5 GROUP BY id)"
    balls = lambda centre, point: f"(SELECT x.id AS centre, y.id AS point FROM {side(centre)} x JOIN {kth(centre)} k ON x.id = k.id, {side(point)} y, {width(centre)} w WHERE {near('x', 'y', 'w')} <= k.r)"
    n = lambda arm: f"(SELECT count(*) FROM p WHERE arm = {arm})::DOUBLE"
    return f"(SELECT (SELECT count(DISTINCT point) FROM {balls(0, fake)}) / {n(fake)} AS precision, (SELECT count(DISTINCT point) FROM {balls(fake, 0)}) / {n(0)} AS recall, (SELECT count(*) FROM {balls(0, fake)}) / (5 * {n(fake)}) AS density, (SELECT count(DISTINCT centre) FROM {balls(0, fake)}) / {n(0)} AS coverage)"


@registered(_PARTS + f", u AS (SELECT * FROM {_prdc_sql(1)} UNION ALL SELECT * FROM {_prdc_sql(2)}) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM u" for c in ("precision", "recall", "density", "coverage")))
def c14_diversity(spark, d):
    """Two numbers and a category; mean and deviation over two candidate tables."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    arm = lambda k: p.where(F.col("p_partkey") % 3 == k)
    return distance.diversity(arm(0), [arm(1), arm(2)], "p_partkey", ["p_size", "p_retailprice"], ["p_brand"]).select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@registered(_PARTS + ", q AS (SELECT p_partkey AS id, p_brand AS a, p_type AS b, p_size::VARCHAR AS c FROM part) SELECT x.id AS p_partkey, min(2 * ((x.a <> y.a)::INT + (x.b <> y.b)::INT + (x.c <> y.c)::INT))::DOUBLE AS d, arg_min(y.id, (2 * ((x.a <> y.a)::INT + (x.b <> y.b)::INT + (x.c <> y.c)::INT), y.id)) AS nearest FROM q x, q y WHERE x.id % 2 = 1 AND y.id % 2 = 0 GROUP BY x.id")
def j02_nearest_categories(spark, d):
    """No number at all: the nearest row by categories, the least key among those as near."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    out = distance.nearest(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0"), "p_partkey", [], ["p_brand", "p_type", "p_size"])
    return out.select("p_partkey", distance.least().alias("d"), F.get("neighbours", F.lit(0)).alias("nearest"))


_EIGHT = ("c_acctbal", "n", "total", "least", "most", "mean", "first", "last")
_PROFILES = "SELECT c_custkey AS id, any_value(c_acctbal)::DOUBLE AS c_acctbal, count(*)::DOUBLE AS n, sum(o_totalprice)::DOUBLE AS total, min(o_totalprice)::DOUBLE AS least, max(o_totalprice)::DOUBLE AS most, avg(o_totalprice)::DOUBLE AS mean, min(o_orderkey)::DOUBLE AS first, max(o_orderkey)::DOUBLE AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"


@registered(f"WITH c AS ({_PROFILES}), w AS (SELECT {', '.join(f'max({c}) - min({c}) AS {c}' for c in _EIGHT)} FROM c WHERE id % 3 = 0) SELECT x.id AS c_custkey, round(min({' + '.join(f'abs(x.{c} - y.{c}) / w.{c}' for c in _EIGHT)}), 6) AS d FROM c x, c y, w WHERE x.id % 3 = 1 AND y.id % 3 = 0 GROUP BY x.id")
def j02_nearest_eight_numbers(spark, d):
    held = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey")
    price = F.col("o_totalprice")
    c = working(held.agg(F.first("c_acctbal").alias("c_acctbal"), F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.min(price).alias("least"), F.max(price).alias("most"), F.avg(price).alias("mean"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")), "profiles")
    return distance.nearest(c.where("c_custkey % 3 = 1"), c.where("c_custkey % 3 = 0"), "c_custkey", list(_EIGHT), []).select("c_custkey", r6(distance.least(), "d"))


_AUTH = "WITH c AS (SELECT c_custkey AS id, c_acctbal AS v, c_mktsegment AS g FROM customer), w AS (SELECT max(v) - min(v) AS w FROM c WHERE id % 2 = 0), p AS (SELECT s.id, r.id AS r, abs(s.v - r.v) / w + CASE WHEN s.g <> r.g THEN 2 ELSE 0 END AS d FROM c s, c r, w WHERE s.id % 2 = 1 AND r.id % 2 = 0), n AS (SELECT id, arg_min(r, (d, r)) AS r, min(d) AS d FROM p GROUP BY id), o AS (SELECT x.id, min(abs(x.v - y.v) / w + CASE WHEN x.g <> y.g THEN 2 ELSE 0 END) AS d FROM c x, c y, w WHERE x.id % 2 = 0 AND y.id % 2 = 0 AND x.id <> y.id GROUP BY x.id)"


@registered(_AUTH + " SELECT n.id AS c_custkey, round(n.d, 6) AS d_real, round(o.d, 6) AS d_other, n.d > o.d AS authentic FROM n JOIN o ON n.r = o.id")
def f09_authenticity(spark, d):
    c = table(spark, d, "customer")
    out = distance.authenticity(c.where("c_custkey % 2 = 1"), c.where("c_custkey % 2 = 0"), "c_custkey", ["c_acctbal"], ["c_mktsegment"])
    return out.select("c_custkey", r6("d_real", "d_real"), r6("d_other", "d_other"), "authentic")


@registered()
def f10_delta_presence(spark, d):
    c = table(spark, d, "customer")
    return estimators.delta_presence(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["c_acctbal", "c_nationkey"])


@registered("WITH c AS (SELECT *, c_custkey % 3 AS arm FROM customer), x AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM c WHERE arm = 0) SELECT s.c_custkey, round(min(least(abs(s.c_acctbal - t.c_acctbal) / r, 1) + (s.c_mktsegment <> t.c_mktsegment)::INT) / 2, 6) AS d FROM c s, c t, x WHERE s.arm = 2 AND t.arm = 0 GROUP BY ALL")
def f03_protocol_dcr(spark, d):
    c = table(spark, d, "customer")
    return distance.nearest(c.where("c_custkey % 3 = 2"), c.where("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal"], ["c_mktsegment"], kind="mean").select("c_custkey", r6(distance.least(), "d"))


_D1 = "WITH c AS (SELECT *, c_custkey % 3 AS arm FROM customer), x AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM c WHERE arm = 0), n AS (SELECT s.arm, s.c_custkey, min(abs(s.c_acctbal - t.c_acctbal) / r) AS d FROM c s, c t, x WHERE s.arm > 0 AND t.arm = 0 GROUP BY ALL), q AS (SELECT quantile_cont(d, 0.2) AS l FROM n WHERE arm = 2)"


@registered(_D1 + " SELECT c_custkey, round(d, 6) AS d FROM n, q WHERE d >= l QUALIFY row_number() OVER (ORDER BY 2 - arm, c_custkey) <= (SELECT count(*) FROM n WHERE arm = 2)")
def f06_resample(spark, d):
    c = table(spark, d, "customer")
    far = lambda k: distance.nearest(c.where(F.col("c_custkey") % 3 == k), c.where("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal"], []).select("c_custkey", distance.least().alias("d"))
    return distance.resample([far(2), far(1)], "d", "c_custkey", 0.2, c.where("c_custkey % 3 = 2").count()).select("c_custkey", r6("d", "d"))


@registered("SELECT count(*) AS n, count(*) FILTER (k > 1) AS n_duplicated FROM (SELECT count(*) OVER (PARTITION BY l_quantity, l_extendedprice) AS k FROM lineitem)")
def w02_duplicated(spark, d):
    return stats.duplicated(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).agg(F.count(F.lit(1)).alias("n"), F.count_if("duplicated").alias("n_duplicated"))


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def w07_head(spark, d):
    return stats.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


@registered("SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name")
def w10_inventory(spark, d):
    return reports.inventory(table(spark, d, "nation"), "n_name", n_regionkey=1).select("n_name", "n_nationkey")


@registered("SELECT 1000::BIGINT AS n, 1000::BIGINT AS n_distinct")
def c08_seeded_sample(spark, d):
    t = table(spark, d, "orders")
    a, b = stats.seeded_sample(t, "o_orderkey", 1000, 3), stats.seeded_sample(t.repartition(5), "o_orderkey", 1000, 3)
    return a.select("o_orderkey").union(b.select("o_orderkey")).agg((F.count(F.lit(1)) / 2).cast("long").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


@registered("SELECT 'rows' AS kind, 'all' AS name, count(*) AS n FROM customer UNION ALL SELECT 'missing', 'c_name', count(*) FILTER (c_custkey % 9 = 0) FROM customer UNION ALL SELECT 'missing', 'c_acctbal', count(*) FILTER (c_custkey % 4 = 0) FROM customer UNION ALL SELECT 'class', c_mktsegment, count(*) FROM customer GROUP BY ALL")
def a29_summaries(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 9 == 0, "?").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    return audit.summaries(c, ["c_name", "c_acctbal"], "c_mktsegment")


@registered("SELECT l_linestatus AS by, column_name, n, n_not_integer, n_outside FROM (SELECT l_linestatus, 'l_quantity' AS column_name, count(*) AS n, count(*)::BIGINT AS n_not_integer, count(*) FILTER (l_quantity > 45) AS n_outside FROM (SELECT l_linestatus, l_quantity FROM lineitem) GROUP BY ALL UNION ALL SELECT l_linestatus, 'l_linenumber', count(*), 0, count(*) FILTER (l_linenumber > 5) FROM lineitem GROUP BY ALL UNION ALL SELECT l_linestatus, 'l_returnflag', count(*), 0, count(*) FILTER (l_returnflag = 'R') FROM lineitem GROUP BY ALL)")
def a28_domain_checks(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double").cast("string"))
    return audit.domain_checks(t, {"l_quantity": {"integer": True, "min": 1, "max": 45}, "l_linenumber": {"integer": True, "max": 5}, "l_returnflag": {"values": ["A"], "marker": "N"}}, by="l_linestatus")


@registered("WITH a AS (SELECT l_orderkey % 3 AS k, l_quantity, CASE WHEN l_orderkey % 3 = 1 AND l_linenumber = 2 THEN NULL ELSE l_linenumber END AS line FROM lineitem) SELECT CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'synthetic' ELSE 'test' END AS arm, column_name, n_rows, n_missing, 0::BIGINT AS n_type_mismatch, 0::BIGINT AS n_nonfinite, CASE WHEN n_missing > 0 THEN 'missing_values_prohibited' END AS reason_code FROM (SELECT k, 'l_quantity' AS column_name, count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL) AS n_missing FROM a GROUP BY ALL UNION ALL SELECT k, 'line', count(*), count(*) FILTER (line IS NULL) FROM a GROUP BY ALL)")
def a27_arm_gate(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.when(~((F.col("l_orderkey") % 3 == 1) & (F.col("l_linenumber") == 2)), F.col("l_linenumber")).alias("line"))
    made = {name: t.where(F.col("l_orderkey") % 3 == k).drop("l_orderkey") for k, name in enumerate(("train", "synthetic", "test"))}
    return audit.gate_report(made, Profile("three", (ColumnSpec("l_quantity", "continuous"), ColumnSpec("line", "integer"))))


@registered("SELECT n_nationkey, k::BIGINT AS whole FROM (SELECT n_nationkey, n_nationkey * 9007199254740993 AS k FROM nation)")
def a25_canonical_types(spark, d):
    """Texts such as ``5.0`` and whole numbers above 2**53 become the exact integer."""
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.concat((F.col("n_nationkey").cast("decimal(20,0)") * F.lit(9007199254740993)).cast("decimal(20,0)").cast("string"), F.lit(".0")).alias("whole"))
    return audit.gate(t, Profile("types", (ColumnSpec("n_nationkey", "integer"), ColumnSpec("whole", "integer"))))


@registered("SELECT c_nationkey, c_acctbal FROM customer")
def a24_model_view(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    profile = Profile("customer", (ColumnSpec("c_custkey", "integer", roles=("audit_only",)), ColumnSpec("c_acctbal", "continuous"), ColumnSpec("c_nationkey", "integer")))
    return audit.model_view(c, profile, ["c_nationkey", "c_acctbal"])


@registered("SELECT split, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM customer) GROUP BY ALL")
def a06_union_splits(spark, d):
    c = table(spark, d, "customer")
    return tables.union_splits({"train": c.where("c_custkey % 2 = 0"), "test": c.where("c_custkey % 2 = 1")}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@registered("WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 3 > 0), o AS (SELECT s_suppkey AS k, 'other' AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey % 3 < 2) SELECT coalesce(p.k, o.k) AS k, coalesce(p.name, o.name) AS name, nation, balance FROM p FULL JOIN o ON p.k = o.k")
def j07_merge_specs(spark, d):
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"))
    b = s.where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("k"), F.lit("other").alias("name"), F.col("s_acctbal").alias("balance"))
    return reports.merge_specs(a, b, "k")


@registered("SELECT a.c_custkey, a.c_name, 10001 - b.c_custkey AS c_acctbal FROM customer a JOIN (SELECT c_custkey FROM customer) b ON a.c_custkey = b.c_custkey")
def j06_zip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("c_acctbal"))
    return preprocess.zipped(c, c.select("c_custkey", (10001 - F.col("c_custkey")).alias("c_acctbal")), "c_custkey", ["c_acctbal"])


@registered("WITH p AS (SELECT o_custkey, o_orderstatus AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT o_custkey, max(v) FILTER (arm = 'P') AS dummy, max(v) FILTER (arm = 'F') AS trtr, max(v) FILTER (arm = 'O') AS tstr FROM p GROUP BY ALL) SELECT o_custkey, round(CASE WHEN dummy - trtr > 1e-12 THEN (dummy - tstr) / (dummy - trtr) END, 6) AS retention, round(trtr / nullif(tstr, 0), 6) AS ratio FROM w")
def j08_aligned_arms(spark, d):
    named = F.when(F.col("o_orderstatus") == "P", "dummy").when(F.col("o_orderstatus") == "F", "trtr").otherwise("tstr")
    p = table(spark, d, "orders").groupBy("o_custkey", named.alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    out = reports.aligned_arms(p, ["o_custkey"], "v", higher_is_better=F.lit(False))
    return out.select("o_custkey", r6("retention", "retention"), r6("ratio", "ratio"))


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scores in [0, 1] by customer segment (method), order status (dataset) and a seed."""
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("dataset"), (F.col("o_orderkey") % 5).alias("seed"), (F.col("o_totalprice") / 600000).alias("value"))


_ROWS = "WITH m AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, o_orderkey % 5 AS seed, o_totalprice / 600000 AS value FROM orders)"


@registered(_ROWS + " SELECT method, round((1 - avg(value)) * 100, 3) AS mean_percent, round(stddev_samp(value) * 100, 3) AS std_percent FROM m GROUP BY ALL")
def g12_run_report(spark, d):
    return reports.run_report(_metric_rows(spark, d), "value", "method")


@registered(_ROWS + " SELECT method, dataset, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM m GROUP BY ALL")
def g11_seeds_report(spark, d):
    return reports.seeds_report(_metric_rows(spark, d), "value", ["method", "dataset"]).select("method", "dataset", "n", r6("mean", "mean"), r6("std", "std"))


@registered(_ROWS + ", s AS (SELECT method, dataset, seed, avg(value) AS value FROM m GROUP BY ALL) SELECT dataset, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY ALL")
def e20_seeds_by_dataset(spark, d):
    one = _metric_rows(spark, d).groupBy("method", "dataset", "seed").agg(F.avg("value").alias("value"))
    return reports.seeds_report(one, "value", ["dataset"]).select("dataset", "n", r6("mean", "mean"), r6("std", "std"))


@registered("SELECT o_orderstatus AS state, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 0)), ',') AS warnings FROM orders GROUP BY ALL")
def g13_state_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return reports.state_counts(rows, "o_orderstatus", "warnings")


@registered("SELECT event_type, round(max(value), 6) AS most, round(sum(value), 3) AS total, round(median(value), 6) AS middle, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def g15_resources(spark, d):
    return reports.resource_summary(table(spark, d, "events"), "value", "event_type").select("event_type", r6("most", "most"), F.round("total", 3).alias("total"), r6("middle", "middle"), r6("p95", "p95"))


@registered(_ROWS + ", s AS (SELECT method, dataset, seed, avg(value) AS value FROM m GROUP BY ALL) SELECT dataset, method AS best, round(value, 6) AS best_value FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY value DESC, method) = 1")
def g14_best_parameters(spark, d):
    one = _metric_rows(spark, d).groupBy("method", "dataset", "seed").agg(F.avg("value").alias("value"))
    return reports.best_parameters(one, "dataset", "method", "value").select("dataset", "best", r6("best_value", "best_value"))


@registered("SELECT l_linenumber AS target, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS spread, round(max(abs(v - 1)), 6) AS max_deviation, max(abs(v - 1)) <= 0.5 AS stable FROM (SELECT l_linenumber, avg(l_quantity) / 25.5 AS v FROM lineitem GROUP BY l_linenumber, l_suppkey) GROUP BY ALL")
def g16_stability(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("target"), "l_suppkey").agg((F.avg("l_quantity") / 25.5).alias("v"))
    return reports.stability(v, "v", "target", 0.5).select("target", "n", *[r6(c, c) for c in ("mean", "std", "spread", "max_deviation")], "stable")


@registered(_ROWS + ", s AS (SELECT method, dataset, seed, avg(value) AS value FROM m GROUP BY ALL), w AS (SELECT method, dataset, avg(value) AS v FROM s GROUP BY ALL) SELECT method, count(*) AS n_datasets, round(avg(v), 6) AS macro_mean FROM w GROUP BY ALL")
def g17_leaderboard(spark, d):
    one = _metric_rows(spark, d).groupBy("method", "dataset", "seed").agg(F.avg("value").alias("value"))
    return reports.leaderboard(one, "method", "dataset", "value").select("method", "n_datasets", r6("macro_mean", "macro_mean"))


@registered(_ROWS + ", w AS (SELECT method, dataset, printf('%.4f', round(avg(value), 4)) AS v FROM m WHERE NOT (method = '1-URGENT' AND dataset = 'P') GROUP BY ALL) SELECT method, coalesce(max(v) FILTER (dataset = 'F'), '--') AS F, coalesce(max(v) FILTER (dataset = 'O'), '--') AS O, coalesce(max(v) FILTER (dataset = 'P'), '--') AS P FROM w GROUP BY ALL")
def e21_results_matrix(spark, d):
    return reports.results_matrix(_metric_rows(spark, d).where("not (method = '1-URGENT' and dataset = 'P')"), "method", "dataset", "value", ["F", "O", "P"])


@registered("WITH v AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS k FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(l_returnflag, (-k, l_returnflag)) AS voted, round(sum(k), 4) AS votes FROM v GROUP BY ALL")
def e22_votes(spark, d):
    return reports.votes(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_quantity")).select("l_orderkey", "voted", F.round("votes", 4).alias("votes"))


@registered("WITH v AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS k FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, arg_min(l_returnflag, (-k, l_returnflag)) AS best, sum(k) AS whole FROM v GROUP BY ALL), t AS (SELECT l_orderkey, min(l_returnflag) AS told FROM lineitem GROUP BY ALL), c AS (SELECT l.l = t.told AS y, coalesce(k / whole, 0) AS s FROM t JOIN b USING (l_orderkey) CROSS JOIN (SELECT DISTINCT told AS l FROM t) l LEFT JOIN v ON v.l_orderkey = t.l_orderkey AND v.l_returnflag = l.l), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM c) SELECT round((SELECT avg((best = told)::INT) FROM b JOIN t USING (l_orderkey)), 6) AS micro_f1, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS micro_auc, (SELECT count(*) FROM t) AS n FROM r")
def e22_vote_scores(spark, d):
    """Quantities vote for a flag; the least flag of an order is taken to be the true one."""
    t = table(spark, d, "lineitem")
    voted = t.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("k"))
    truth = t.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    return reports.vote_scores(voted, truth, "l_orderkey", "l_returnflag").select(r6("micro_f1", "micro_f1"), r6("micro_auc", "micro_auc"), "n")


@registered("WITH i AS (SELECT l_orderkey, avg(ln(least(greatest(l_extendedprice, 1), 20000))) AS m FROM lineitem GROUP BY ALL) SELECT round(sqrt(avg(pow(m - ln(least(greatest(o_totalprice, 1), 20000)), 2))), 6) AS rmse, count(*) AS n FROM orders JOIN i ON l_orderkey = o_orderkey")
def e22_imputed_error(spark, d):
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    out = reports.imputed_error(reports.imputed_mean(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice"), truth, "l_orderkey", "o_totalprice")
    return out.select(r6("rmse", "rmse"), "n")


@registered("SELECT l_orderkey, round(avg(ln(least(greatest(l_extendedprice, 1), 20000))), 6) AS imputed FROM lineitem GROUP BY ALL")
def e22_imputed_values(spark, d):
    return reports.imputed_mean(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice").select("l_orderkey", r6("imputed", "imputed"))


@registered("SELECT 'set ' || n_regionkey AS dataset, n_name AS model, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS score FROM nation ORDER BY dataset, model")
def e23_compare_summaries(spark, d):
    n = table(spark, d, "nation")
    scores = F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.col("n_nationkey").alias("overall score")))
    text = F.to_json(F.struct(F.concat(F.lit("set "), F.col("n_regionkey").cast("string")).alias("dataset"), F.col("n_name").alias("model"), F.struct(scores.alias("fidelity")).alias("dimensions")))
    return reports.summary_rows(n.select(text.alias("summary")), "summary", {"dataset": ("dataset",), "model": ("model",), "score": ("dimensions", "fidelity", "overall score")}, ["dataset", "model"])


@registered("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std_pop, round(stddev_samp(l_extendedprice), 6) AS std_samp, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL")
def g04_moments(spark, d):
    return reports.moments(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", *[r6(c, c) for c in ("mean", "std_pop", "std_samp")], "low", "high")


@registered("SELECT column_name, n_distinct FROM (SELECT 'l_suppkey' AS column_name, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem UNION ALL SELECT 'flag', count(DISTINCT l_returnflag) FROM lineitem)")
def g06_distinct(spark, d):
    t = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return reports.distinct_counts(t, ["l_suppkey", "flag"])


@registered("SELECT column_name, low, high, whole, n_categories, categories FROM (SELECT 'l_quantity' AS column_name, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high, bool_and(l_quantity % 1 = 0) AS whole, NULL::BIGINT AS n_categories, NULL AS categories FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount)::DOUBLE, max(l_discount)::DOUBLE, bool_and(l_discount % 1 = 0), NULL, NULL FROM lineitem UNION ALL SELECT 'l_returnflag', NULL, NULL, NULL, count(DISTINCT l_returnflag), array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') FROM lineitem)")
def a22_column_info(spark, d):
    return audit.column_info(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])


_TREE = (
    "WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, sha256(concat_ws(chr(31), l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag, l_linestatus)) AS row, count(*) AS k FROM lineitem GROUP BY ALL), "
    "p AS (SELECT *, sum(k) OVER (ORDER BY l_orderkey, l_linenumber, row)::BIGINT AS upto FROM r), q AS (SELECT row, upto - k AS start, upto, unnest(range((upto - k) // 64, (upto - 1) // 64 + 1)) AS node FROM p), "
    "t(level, node, n, digest) AS (SELECT 0, node, sum(least(upto, (node + 1) * 64) - greatest(start, node * 64))::BIGINT, sha256(string_agg(row || '*' || (least(upto, (node + 1) * 64) - greatest(start, node * 64))::VARCHAR, chr(10) ORDER BY start)) FROM q GROUP BY node "
    "UNION ALL SELECT level + 1, node // 64, sum(n)::BIGINT, sha256(string_agg(digest, chr(10) ORDER BY node)) FROM (SELECT * FROM t WHERE (SELECT count(*) FROM t) > 1) GROUP BY level, node // 64) "
    "SELECT level, node, n, digest FROM t"
)


@registered(_TREE)
def a31_ordered_hash(spark, d):
    return audit.ordered_digest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], 64)


@registered("WITH k AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 2 = 0 AND p_partkey < 40)), e AS (SELECT max(code) AS m FROM k) SELECT p_partkey, coalesce(code, m + 1)::INT AS code FROM part LEFT JOIN k USING (p_type), e")
def b11_unknown_after_last(spark, d):
    part = table(spark, d, "part")
    return preprocess.ordinal(part, preprocess.category_codes(part.where("p_partkey % 2 = 0 and p_partkey < 40"), "p_type"), "p_type", None).select("p_partkey", F.col("p_type_code").cast("int").alias("code"))


@registered("SELECT p_partkey, p_type FROM part")
def b20_label_round_trip(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    codes = preprocess.category_codes(part, "p_type")
    return preprocess.decode(preprocess.ordinal(part, codes, "p_type").drop("p_type"), codes, "p_type").select("p_partkey", "p_type")


@registered("WITH f AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS target FROM orders, f")
def b14_target(spark, d):
    o = table(spark, d, "orders")
    return preprocess.standardise_target(o, "o_totalprice", o.where("o_orderkey % 2 = 0"))[0].select("o_orderkey", r6("o_totalprice", "target"))


@registered("WITH f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 2 = 0), g AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0)), t AS (SELECT avg(c_nationkey) AS m, stddev_pop(c_nationkey) AS s FROM customer WHERE c_custkey % 2 = 0) SELECT CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, c_custkey, round((coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END, x.a) - x.m) / x.s, 6) + 0.0 AS c_acctbal, code::INT AS c_mktsegment, round((c_nationkey - t.m) / t.s, 6) AS c_nationkey FROM customer JOIN g USING (c_mktsegment), t, (SELECT a, avg(coalesce(v, a)) AS m, stddev_pop(coalesce(v, a)) AS s FROM (SELECT CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS v, avg(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END) OVER () AS a FROM customer WHERE c_custkey % 2 = 0) GROUP BY a) x")
def b15_transform_splits(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    spec = preprocess.TransformSpec(("c_acctbal",), ("c_mktsegment",), "c_nationkey", regression=True, numeric_missing="mean", normalise="standard", encode="ordinal")
    out, _ = preprocess.transform_splits({"train": c.where("c_custkey % 2 = 0"), "test": c.where("c_custkey % 2 = 1")}, spec)
    return tables.union_splits(out).select("split", "c_custkey", r6("c_acctbal", "c_acctbal"), F.col("c_mktsegment").cast("int").alias("c_mktsegment"), r6("c_nationkey", "c_nationkey"))


@registered("WITH f AS (SELECT avg(c_acctbal) AS m FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 7 > 0), g AS (SELECT c_mktsegment AS g FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 11 > 0 GROUP BY g ORDER BY count(*) DESC, g LIMIT 1) SELECT CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, c_custkey, round(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal ELSE m END, 6) AS x, CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment ELSE g END AS g FROM customer, f, g")
def b05_preprocess_splits(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 7 > 0, F.col("c_acctbal").cast("string")).otherwise("?").alias("x"), F.when(k % 11 > 0, F.col("c_mktsegment")).otherwise(" ?").alias("g"))
    out, _ = preprocess.preprocess_splits({"train": c.where(k % 2 == 0), "test": c.where(k % 2 == 1)}, ["x"], ["g"])
    return tables.union_splits(out).select("split", "c_custkey", r6("x", "x"), "g")


@registered("SELECT o_orderkey, round((sum(o_totalprice) FILTER (o_orderkey % 2 = 0) OVER w) / count(*) FILTER (o_orderkey % 2 = 0) OVER w, 4) AS loo FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def b13_leave_one_out_test(spark, d):
    o = table(spark, d, "orders")
    return preprocess.leave_one_out(o, "o_orderpriority", "o_totalprice", train=o.where("o_orderkey % 2 = 0")).select("o_orderkey", F.round("o_orderpriority_loo", 4).alias("loo"))


@registered("SELECT p_partkey, p_size::BIGINT AS p_size FROM part")
def b16_dequantise_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return preprocess.dequantise_inverse(preprocess.dequantise(p, ["p_size"], "p_partkey", 4), ["p_size"])


@registered("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price FROM part")
def b19_log_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, -9999999.0).otherwise(F.col("p_retailprice")).alias("price"))
    return preprocess.log_inverse(preprocess.log_transform(p, {"price": -5.0}), {"price": -5.0}, {"price": 2})


@registered("SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def b21_mode_round_trip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    fitted = preprocess.fit_modes(c, "c_acctbal", 3)
    return preprocess.mode_restored(preprocess.mode_normalised(c, fitted, "c_custkey", 1, clip=10.0).drop("c_acctbal"), fitted).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


_ONE_MODE = "WITH x AS (SELECT l_orderkey, l_linenumber, pow(l_extendedprice / 1000, 3) AS v FROM lineitem), f AS (SELECT avg(v) AS m, sqrt((var_samp(v) + count(*) * (var_pop(v) + 1e-6)) / (1 + count(*))) AS s FROM x)"


@registered(_ONE_MODE + " SELECT l_orderkey, l_linenumber, 0 AS mode, round(least(greatest((v - m) / (4 * s), -0.3), 0.3), 6) AS within, abs((v - m) / (4 * s)) > 0.3 AS clipped FROM x, f")
def b21_one_mode(spark, d):
    """With one mode the variational fit has a closed form: the mean, and a variance that the prior and the rows share. The clip is seen."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pow(F.col("l_extendedprice") / 1000, F.lit(3.0)).alias("v"))
    fitted = preprocess.fit_modes(t, "v", 1)
    made = preprocess.mode_normalised(t, fitted, "l_orderkey", 1, clip=0.3)
    (_, m, s), = fitted.parts
    return made.select("l_orderkey", "l_linenumber", F.col("v_mode").cast("int").alias("mode"), r6("v_within", "within"), (F.abs((F.col("v") - m) / (4 * s)) > 0.3).alias("clipped"))


@registered("SELECT o_orderstatus, split, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN k / n::DOUBLE < 0.6 THEN 'train' WHEN k / n::DOUBLE < 0.6 + 0.2 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 3, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)) GROUP BY ALL")
def b25_ties(spark, d):
    """Sizes are exact though the key has three values only."""
    return preprocess.stratified_split(table(spark, d, "orders"), "o_orderstatus", F.col("o_custkey") % 3).groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


_NAN = "WITH t AS (SELECT *, l_linenumber = 5 AS nan FROM lineitem)"


@registered(_NAN + " SELECT 'column' AS scope_type, 'l_tax' AS scope_id, count(*) FILTER (NOT nan) AS n_valid, count(*) AS n_total FROM t UNION ALL SELECT 'column', 'l_discount', count(*) FILTER (nan OR l_discount <= 0.05), count(*) FROM t UNION ALL SELECT 'group', 'order', count(*) FILTER (NOT nan AND l_tax <= l_discount), count(*) FROM t UNION ALL SELECT 'dataset', 'fully_valid_rows', count(*) FILTER (NOT nan AND l_discount <= 0.05 AND l_tax <= l_discount), count(*) FROM t")
def d01_nan_is_missing(spark, d):
    t = table(spark, d, "lineitem").select(*[F.when(F.col("l_linenumber") == 5, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in ("l_tax", "l_discount")])
    held = rules.validity(t, {"l_tax": [{"type": "not_null"}, {"type": "finite"}], "l_discount": [{"type": "bounds", "max": 0.05}]}, {"order": {"type": "comparison", "left": "l_tax", "right": "l_discount", "op": "le"}})
    return held.select("scope_type", "scope_id", "n_valid", "n_total")


@registered("WITH t AS (SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN 'd' ELSE '' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderkey::VARCHAR || '.50' ELSE '-' || o_orderkey::VARCHAR || 'e-2' END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 'nan' ELSE '1' END AS c FROM orders) SELECT 'a' AS column_name, count(*) FILTER (NOT a LIKE '%d') AS n_numeric, 'categorical' AS role FROM t UNION ALL SELECT 'b', count(*), 'continuous' FROM t UNION ALL SELECT 'c', count(*) FILTER (c = '1'), 'categorical' FROM t")
def a20_texts_of_numbers(spark, d):
    """Texts such as ``5d`` and ``nan`` are no numbers, whatever the engine's cast makes of them."""
    key = F.col("o_orderkey").cast("string")
    t = table(spark, d, "orders").select(F.concat(key, F.when(F.col("o_orderkey") % 5 == 0, "d").otherwise("")).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), key, F.lit(".50"))).otherwise(F.concat(F.lit("-"), key, F.lit("e-2"))).alias("b"), F.when(F.col("o_orderkey") % 7 == 0, "nan").otherwise("1").alias("c"))
    return audit.infer_roles(t).select("column_name", "n_numeric", "role")


@registered("WITH f AS (SELECT min(c_acctbal) AS l, max(c_acctbal) AS h FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, round(least(greatest(c_acctbal, l), h), 4) AS c_acctbal FROM customer, f")
def b23_scale_inverse(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    train = c.where("c_custkey % 2 = 0")
    ends = train.agg(F.min("c_acctbal").alias("l"), F.max("c_acctbal").alias("h")).first()
    fitted = preprocess.fit_standard(train, ["c_acctbal"])
    return fitted.invert(fitted.apply(c), clip={"c_acctbal": (ends.l, ends.h)}).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@registered("SELECT count(DISTINCT p_type) AS n_types, count(*) AS n FROM part")
def b24_covering_split(spark, d):
    part = table(spark, d, "part")
    made, _ = preprocess.covering_split(part, "p_partkey", ["p_type"])
    return made.agg(F.count_distinct(F.when(F.col("split") == "train", F.col("p_type"))).alias("n_types"), F.count(F.lit(1)).alias("n"))


@registered("SELECT o_orderkey, o_orderstatus AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority FROM orders")
def b26_cleaning(spark, d):
    o = preprocess.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority")), "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus")
    o = preprocess.collapse_one_hot(o, ["o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"], "status", "o_orderstatus_")
    return preprocess.mapped(o, "priority", {"1-URGENT": "high", "2-HIGH": "high"}).select("o_orderkey", "status", "priority")


@registered("SELECT c_nationkey AS y, c_acctbal AS x, c_mktsegment AS g FROM customer")
def b29_target_first(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return preprocess.recover_order(preprocess.assemble_blocks(c, ["x"], ["g"], "y", target_first=True), ["y", "x", "g"])


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_tax AS d, 0.0::DOUBLE AS last FROM lineitem")
def b31_square_rows(spark, d):
    t = preprocess.square_rows(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.col("image")[0][0].alias("a"), F.col("image")[1][0].alias("d"), F.col("image")[2][2].alias("last"))


@registered("WITH f AS (SELECT min(c_acctbal) AS l, max(c_acctbal) AS h FROM customer WHERE c_custkey % 2 = 0), k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1 AS r, count(*) OVER () AS m FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)) SELECT c_custkey, round((c_acctbal - (l + h) / 2) / ((h - l) / 2), 6) AS c_acctbal, round(r / m::DOUBLE, 6) AS rank, c_mktsegment AS back FROM customer JOIN k USING (c_mktsegment), f")
def b30_tanh_and_ranks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    ranks = preprocess.frequency_rank(c, "c_mktsegment")
    out = preprocess.frequency_scaled(preprocess.min_max(c, ["c_acctbal"], c.where("c_custkey % 2 = 0"), tanh=True), ranks, "c_mktsegment").drop("c_mktsegment")
    out = preprocess.frequency_decoded(out, ranks, "c_mktsegment")
    return out.select("c_custkey", r6("c_acctbal", "c_acctbal"), r6("c_mktsegment_rank", "rank"), F.col("c_mktsegment").alias("back"))


@registered("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def fn_sentences(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name").select(X.sentence(["n_nationkey", "n_name"]).alias("s"))
    return n.select(*X.from_sentence(F.col("s"), ["n_nationkey", "n_name"]))


@registered("SELECT n_name, n_regionkey::VARCHAR AS region, sha256(n_nationkey::VARCHAR || chr(31) || n_name) AS digest FROM nation")
def fn_json_and_digest(spark, d):
    n = table(spark, d, "nation").withColumn("j", F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("the key")).alias("region"))))
    return n.select("n_name", X.nested(F.col("j"), "region", "the key").alias("region"), X.row_digest(["n_nationkey", "n_name"]).alias("digest"))


@registered("SELECT o_orderkey, epoch_ns(o_orderdate::TIMESTAMP) AS nanos, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS told FROM orders")
def fn_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.epoch_nanos(F.col("o_orderdate")).alias("nanos"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("told"))


@registered("SELECT 'l_returnflag' AS name, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_quantity', l_quantity::VARCHAR, count(*) FROM lineitem GROUP BY ALL")
def h_shuffled_columns(spark, d):
    """The generator keeps every column's values exactly; only how they meet changes."""
    t = table(spark, d, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    out = generate.shuffled_columns(t, "row_key", ["l_extendedprice", "l_returnflag", "l_quantity"], 3)
    met = out.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    long = met.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in ("l_returnflag", "l_quantity")])).alias("x")).select("x.*", "n")
    return long.groupBy("name", "v").agg(F.sum("n").alias("n"))


_RANKS = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{i}" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_returnflag"))) + f" FROM ({_RELATED}))"


@registered(f"WITH {_RANKS} SELECT 'l_quantity--l_extendedprice' AS name, round(corr(r0, r1), 6) AS told, true AS kept FROM r UNION ALL SELECT 'l_quantity--l_returnflag', round(corr(r0, r2), 6), true FROM r UNION ALL SELECT 'l_extendedprice--l_returnflag', round(corr(r1, r2), 6), true FROM r UNION ALL SELECT 'l_returnflag ' || l_returnflag, count(*)::DOUBLE, true FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_quantity ' || l_quantity::BIGINT::VARCHAR, count(*)::DOUBLE, true FROM lineitem GROUP BY l_quantity")
def h_rank_generator(spark, d):
    """As many rows as the table: each rank correlation within 0.02 of the table's, and every value as often as there."""
    train = _related(table(spark, d, "lineitem")).select("l_quantity", "l_extendedprice", "l_returnflag")
    made = working(generate.RankGenerator(["l_quantity", "l_extendedprice"], ["l_returnflag"]).fit(train).sample(train.count(), 3), "made")
    coded = lambda df: df.withColumn("l_returnflag", F.ascii("l_returnflag"))
    told = lambda df, name: generate.spearman(coded(df), ["l_quantity", "l_extendedprice", "l_returnflag"]).select(F.concat_ws("--", "left_column", "right_column").alias("name"), F.col("rho").alias(name))
    pairs = told(train, "told").join(told(made, "made"), "name").select("name", r6("told", "told"), (F.abs(F.col("made") - F.col("told")) < 0.02).alias("kept"))
    names = lambda c: F.concat_ws(" ", F.lit(c), F.when(F.lit(c == "l_quantity"), F.col(c).cast("double").cast("long").cast("string")).otherwise(F.col(c).cast("string")))
    counted = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(names(c).alias("name"), "n")
    values = lambda df, n: counted(df, "l_returnflag").unionByName(counted(df, "l_quantity")).groupBy("name").agg(F.sum("n").alias(n))
    both = values(train, "told").join(values(made, "made"), "name", "full").select("name", F.col("told").cast("double").alias("told"), F.coalesce(F.col("told") == F.col("made"), F.lit(False)).alias("kept"))
    return pairs.unionByName(both)


@registered("SELECT 500::BIGINT AS n, 0::BIGINT AS n_missing")
def h_network(spark, d):
    g = generate.NetworkGenerator(["l_quantity"], ["l_returnflag", "l_linestatus"], bins=4).fit(table(spark, d, "lineitem"))
    return g.sample(500, 1).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity").isNull() | F.col("l_returnflag").isNull() | F.col("l_linestatus").isNull()).alias("n_missing"))


@registered("SELECT 300::BIGINT AS n, true AS inside, 1::BIGINT AS n_labels")
def h_smote(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_mktsegment")
    out = generate.smote(c, "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment", "BUILDING", 300, 2)
    ends = c.where("c_mktsegment = 'BUILDING'").agg(F.min("c_acctbal").alias("l"), F.max("c_acctbal").alias("h"))
    return out.join(F.broadcast(ends)).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("c_acctbal").between(F.col("l"), F.col("h"))).alias("inside"), F.count_distinct("c_mktsegment").alias("n_labels"))


@registered(_FIDELITY + " SELECT count(*) AS n, 0::BIGINT AS n_problems FROM w")
def g18_verified_bundle(spark, d):
    out = evaluate.evaluate_table(*_two_arms(spark, d), PROFILE)
    found = bundle.verify(out.atoms, out.scores)
    return out.atoms.agg(F.count(F.lit(1)).alias("n")).join(found.agg(F.count(F.lit(1)).alias("n_problems")))


@registered("WITH s AS (SELECT o_orderstatus AS metric_id, sum(o_totalprice) AS v, bool_and(o_orderkey % 50 > 0) AS fine FROM orders GROUP BY ALL) SELECT CASE WHEN bool_and(fine) THEN 'success' ELSE 'partial' END AS status FROM s")
def g19_terminal_status(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 50 > 0, "computed").otherwise("mathematically_undefined").alias("state"))
    return evaluate.terminal_status(rows, o.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("score")), "p3")


@registered("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 2")
def w03_top_two(spark, d):
    out = stats.top_per_group(table(spark, d, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 2)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@registered("SELECT l_returnflag, l_linestatus, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT l_returnflag, l_linestatus, (sum(n) OVER w - n) / (sum(n) OVER p)::DOUBLE AS low, sum(n) OVER w / (sum(n) OVER p)::DOUBLE AS high FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_linestatus ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY l_returnflag))")
def h_conditional_table(spark, d):
    return generate.cumulative(table(spark, d, "lineitem"), "l_linestatus", ["l_returnflag"]).select("l_returnflag", "l_linestatus", r6("low", "low"), r6("high", "high"))


@registered("WITH t AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS half FROM lineitem) SELECT 'some' AS scope_id, count(*) FILTER (l_returnflag IN ('A', 'R') AND l_tax < l_discount) AS n_valid, count(*) FILTER (l_returnflag IN ('A', 'R')) AS n_total FROM t UNION ALL SELECT 'present', count(*) FILTER (half >= l_tax), count(half) FROM t UNION ALL SELECT 'skipped', count(*) FILTER (half <> l_tax), count(half) FROM t UNION ALL SELECT 'missing fails', count(*) FILTER (half >= l_tax), count(*) FROM t")
def d11_applicability(spark, d):
    t = table(spark, d, "lineitem").withColumn("half", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")))
    compare = lambda a, op, b, **more: {"type": "comparison", "left": a, "op": op, "right": b, **more}
    constraints = {"some": compare("l_tax", "lt", "l_discount", applies={"type": "column_in", "column": "l_returnflag", "values": ["A", "R"]}), "present": compare("half", "ge", "l_tax", applies={"type": "all_non_missing"}), "skipped": compare("half", "ne", "l_tax", missing="not_applicable"), "missing fails": compare("half", "ge", "l_tax")}
    return rules.validity(t, {"l_tax": [{"type": "not_null"}]}, constraints).where("scope_type = 'group'").select("scope_id", "n_valid", "n_total")


@registered("SELECT 'l_quantity' AS column_id, 3::BIGINT AS n_rules UNION ALL SELECT 'l_extendedprice', 3 UNION ALL SELECT 'l_returnflag', 1 UNION ALL SELECT 'l_linestatus', 1 UNION ALL SELECT 'l_partkey', 1")
def d10_selected_rules(spark, d):
    rules.check_contract(JUDGED, DEFINITIONS, {})
    return spark.createDataFrame([(c, len(r)) for c, r in rules.column_rules(JUDGED, DEFINITIONS).items()], "column_id string, n_rules long")


@registered("SELECT n_nationkey, n_name FROM nation")
def w08_permutation(spark, d):
    return generate.permuted(table(spark, d, "nation"), "n_nationkey", 5).select("n_nationkey", "n_name")


@registered("SELECT 400::BIGINT AS n, 0::BIGINT AS n_unknown")
def h_marginal(spark, d):
    c = table(spark, d, "customer")
    out = generate.MarginalGenerator(["c_mktsegment", "c_nationkey"]).fit(c).sample(400, 2)
    known = c.select("c_mktsegment").distinct()
    return out.agg(F.count(F.lit(1)).alias("n")).join(out.join(known, "c_mktsegment", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown")))


@registered("SELECT c_custkey, c_acctbal FROM customer")
def b02_sanitized(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    return preprocess.sanitize(c, ["c_acctbal"], [])


@registered("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 > 0")
def b07_dropped_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return preprocess.drop_missing_rows(c, ["c_acctbal"], "train")
