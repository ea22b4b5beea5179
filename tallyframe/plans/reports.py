"""Further registered queries: reports, audits of text and JSON, encodings and their inverses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import preprocess
from tallyframe.plans.registry import r6, registered, table

_AT = "greatest(ceil(n * i / 16.0), 1)"
_EDGES = f"WITH o AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS k, count(*) OVER () AS n FROM part), e AS (SELECT DISTINCT (SELECT (min(v) FILTER (k >= {_AT}) + min(v) FILTER (k >= CASE WHEN i > 0 AND i < 16 AND n * i % 16 = 0 THEN n * i / 16.0 + 1 ELSE {_AT} END)) / 2 FROM o) AS edge FROM (SELECT unnest(range(0, 17)) AS i))"


@registered(_EDGES + ", inner_edges AS (SELECT edge FROM e WHERE edge > (SELECT min(edge) FROM e) AND edge < (SELECT max(edge) FROM e)) SELECT p_partkey, (SELECT count(*) FROM inner_edges WHERE edge <= p_retailprice)::VARCHAR AS bin FROM part")
def b22_quantile_bins(spark, d):
    part = table(spark, d, "part")
    return preprocess.quantile_bins(part, "p_retailprice", preprocess.fit_quantile_bins(part, "p_retailprice")).select("p_partkey", F.col("p_retailprice_bin").alias("bin"))


@registered("SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 'nan' ELSE trim(c_mktsegment) END AS segment, regexp_replace(trim(c_comment), '\\.$', '') AS comment, ' ' || trim(c_name) AS name FROM (SELECT c_custkey, c_mktsegment, c_name, c_name || '.' AS c_comment FROM customer)")
def b27_cleaning(spark, d):
    c = table(spark, d, "customer").withColumn("c_comment", F.concat("c_name", F.lit(".")))
    c = preprocess.clean_categories(c, ["c_mktsegment"], marker="BUILDING")
    c = preprocess.clean_categories(c, ["c_comment"], strip_dot=True)
    c = preprocess.clean_categories(c, ["c_name"], leading_space=True)
    return c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_comment").alias("comment"), F.col("c_name").alias("name"))


@registered("SELECT s_suppkey, round(least(greatest(s_acctbal, (SELECT min(c_acctbal) FROM customer)), (SELECT max(c_acctbal) FROM customer)), 6) AS s_acctbal, least(greatest(s_nationkey, (SELECT min(c_nationkey) FROM customer)), (SELECT max(c_nationkey) FROM customer))::BIGINT AS s_nationkey FROM supplier")
def f11_clamp(spark, d):
    observed = table(spark, d, "customer").select(F.col("c_acctbal").alias("s_acctbal"), F.col("c_nationkey").alias("s_nationkey"))
    out = preprocess.clamp_to_observed(table(spark, d, "supplier"), observed, ["s_acctbal", "s_nationkey"])
    return out.select("s_suppkey", r6("s_acctbal", "s_acctbal"), F.col("s_nationkey").cast("long").alias("s_nationkey"))


