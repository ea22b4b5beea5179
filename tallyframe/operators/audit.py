"""Structural gate, audits and reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.contracts import ColumnSpec, GateError, Profile
from tallyframe.functions.expressions import canonical_boolean, number, present, row_digest
from tallyframe.operators.stats import ranked
from tallyframe.sources.working import working


def check_columns(df: DataFrame, profile: Profile) -> DataFrame:
    """The canonical projection; a wrong column set is refused."""
    if len(set(df.columns)) != len(df.columns):
        raise GateError("duplicate_columns")
    if set(df.columns) != set(profile.names()):
        raise GateError("schema_mismatch", ", ".join(sorted(set(df.columns) ^ set(profile.names()))))
    return df.select(*[F.col(f"`{c}`") for c in profile.names()])


def violations(df: DataFrame, profile: Profile) -> DataFrame:
    """(column_name, n_missing, n_type_mismatch, n_nonfinite, n_unreadable) of all columns from one aggregation. NaN is missing."""
    rows = []
    for spec in profile.columns:
        c = F.col(f"`{spec.name}`")
        text = c.cast("string")
        mismatch, nonfinite, unreadable, missing = F.lit(False), F.lit(False), F.lit(False), c.isNull()
        if spec.semantic_type in ("continuous", "integer"):
            read = number(c)
            mismatch = unreadable = read.isNull() & c.isNotNull()
            missing = c.isNull() | F.coalesce(F.isnan(read), F.lit(False))
            nonfinite = F.coalesce(F.abs(read) == float("inf"), F.lit(False))
        if spec.semantic_type == "integer":
            exact = number(c, "decimal(38,18)")
            mismatch = ~missing & ~nonfinite & (exact.isNull() | (exact != F.floor(exact)) | (exact < -(2**63)) | (exact > 2**63 - 1))
        if spec.semantic_type == "boolean":
            mismatch = unreadable = c.isNotNull() & canonical_boolean(c).isNull()
        if spec.semantic_type == "datetime":
            mismatch = unreadable = c.isNotNull() & F.try_to_timestamp(text).isNull()
        rows.append(F.struct(F.lit(spec.name).alias("column_name"), F.count_if(missing).alias("n_missing"), F.count_if(mismatch).alias("n_type_mismatch"), F.count_if(nonfinite).alias("n_nonfinite"), F.count_if(unreadable).alias("n_unreadable")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gate(df: DataFrame, profile: Profile, expected_rows: int | None = None, *, preserve: bool = False) -> DataFrame:
    """The canonical table, or a ``GateError`` with the first reason found.

    ``preserve`` keeps what a validity score is to judge: missing values, infinities and fractions in integer columns stay
    (such a column becomes double), and only what cannot be read as its type at all is refused.
    """
    out = check_columns(df, profile)
    if expected_rows is not None and out.count() != expected_rows:
        raise GateError("row_count_mismatch")
    nullable = {s.name for s in profile.columns if s.nullable}
    found = violations(out, profile).collect()  # one row per column
    for row in found:
        strict = ((0 if row.column_name in nullable else row.n_missing, "missing_values_prohibited"), (row.n_type_mismatch, "type_mismatch"), (row.n_nonfinite, "nonfinite_values"))
        for n, code in strict if not preserve else ((row.n_unreadable, "type_mismatch"),):
            if n:
                raise GateError(code, row.column_name)
    if preserve:
        broken = {r.column_name for r in found if r.n_type_mismatch or r.n_nonfinite}
        return out.select(*[_typed(s, double=s.name in broken).alias(s.name) for s in profile.columns])
    return out.select(*[_typed(s).alias(s.name) for s in profile.columns])


def _typed(spec: ColumnSpec, *, double: bool = False) -> Column:
    """A column as its semantic type. Whole numbers go through an exact decimal, so that ``5.0`` is 5 and none above 2**53 is rounded."""
    c = F.col(f"`{spec.name}`")
    if spec.semantic_type == "boolean":
        return canonical_boolean(c)
    if spec.semantic_type == "integer" and not double:
        return number(c, "decimal(38,18)").cast("decimal(20,0)").cast("long")
    if spec.semantic_type in ("continuous", "integer"):
        return present(number(c))
    return c.cast({"datetime": "timestamp"}.get(spec.semantic_type, "string"))


def gate_arms(arms: dict[str, DataFrame], profile: Profile, *, expected_rows: int | None = None, synthetic: str = "synthetic") -> dict[str, DataFrame]:
    """The strict gate on every arm of a utility evaluation; the synthetic arm has as many rows as the first one unless told otherwise.

    Arms are read for counts only: the held-out arm never enters a fit here.
    """
    sizes = {}
    for name, df in arms.items():
        check_columns(df, profile)
        sizes[name] = df.count()
        if not sizes[name]:
            raise GateError("empty_table", name)
    wanted = sizes[next(iter(arms))] if expected_rows is None else expected_rows
    if isinstance(wanted, bool) or not isinstance(wanted, int) or wanted <= 0:
        raise GateError("invalid_row_count", str(wanted))
    if sizes[synthetic] != wanted:
        raise GateError("row_count_mismatch", f"{sizes[synthetic]} rows, expected {wanted}")
    return {name: gate(df, profile) for name, df in arms.items()}


def gate_report(arms: dict[str, DataFrame], profile: Profile) -> DataFrame:
    """(arm, column_name, n_rows, n_missing, n_type_mismatch, n_nonfinite, reason_code) of every arm and column, without refusing any."""
    nullable = [s.name for s in profile.columns if s.nullable]
    made = []
    for name, df in arms.items():
        rows = violations(check_columns(df, profile), profile).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))
        missing = (F.col("n_missing") > 0) & ~F.col("column_name").isin(nullable)
        code = F.when(missing, "missing_values_prohibited").when(F.col("n_type_mismatch") > 0, "type_mismatch").when(F.col("n_nonfinite") > 0, "nonfinite_values")
        made.append(rows.select(F.lit(name).alias("arm"), "column_name", "n_rows", "n_missing", "n_type_mismatch", "n_nonfinite", code.alias("reason_code")))
    return reduce(DataFrame.unionByName, made)


def model_view(df: DataFrame, profile: Profile, order: list[str]) -> DataFrame:
    """The columns of the model view in canonical order; any other column has to be one to ignore or to audit only."""
    rest = [s for s in profile.columns if s.name not in order]
    wrong = [s.name for s in rest if not set(s.roles) & {"ignored", "audit_only"}]
    unknown = [c for c in order if c not in profile.names()]
    if wrong or unknown or len(set(order)) != len(order):
        raise GateError("invalid_model_view", ", ".join([*wrong, *unknown]))
    return df.select(*[F.col(f"`{c}`") for c in order])


def partition_columns(df: DataFrame, *, numeric: list[str] | None = None, categorical: list[str] | None = None, target: str | None = None) -> dict[str, list[str]]:
    """Groups of columns: those given, which have to be disjoint, known and to cover the table; else inferred from the values."""
    if numeric is not None or categorical is not None:
        groups = {"numeric": list(numeric or []), "categorical": list(categorical or []), "target": [target] if target else []}
        named = [c for g in groups.values() for c in g]
        if len(named) != len(set(named)):
            raise GateError("overlapping_roles")
        if set(named) != set(df.columns):
            raise GateError("schema_mismatch", ", ".join(sorted(set(named) ^ set(df.columns))))
        return groups
    roles = {r.column_name: r.role for r in infer_roles(df).collect()}
    return {"numeric": [c for c in df.columns if roles[c] != "categorical" and c != target], "categorical": [c for c in df.columns if roles[c] == "categorical" and c != target], "target": [target] if target else []}


def summaries(df: DataFrame, columns: list[str], target: str, marker: str = "?") -> DataFrame:
    """(kind, name, n): rows, rows whose column holds the missing marker or nothing, and rows of each class."""
    missing = lambda c: F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == marker)
    row = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.alias("n"))
    one = df.agg(F.array(row("rows", "all", F.count(F.lit(1))), *[row("missing", c, F.count_if(missing(c))) for c in columns]).alias("x"))
    classes = df.groupBy(F.col(f"`{target}`").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.explode("x").alias("x")).select("x.*").unionByName(classes.select(F.lit("class").alias("kind"), "name", "n"))


def domain_checks(df: DataFrame, domains: dict[str, dict], by: str | None = None) -> DataFrame:
    """(by, column_name, n, n_not_integer, n_outside): text values that are no canonical integer where one is asked, or not in the domain.

    A domain has ``integer`` (bool), ``min`` and ``max``, ``values``, and ``marker`` for a text that stands for missing.
    """
    rows = []
    for name, domain in domains.items():
        c = F.col(f"`{name}`")
        there = c.isNotNull() & (c.cast("string") != domain["marker"] if "marker" in domain else F.lit(True))
        shape = F.lit(True) if not domain.get("integer") else c.cast("string").rlike(r"\A(?:0|-?[1-9][0-9]*)\z")
        inside = F.lit(True)
        if "min" in domain or "max" in domain:
            read = present(number(c))
            inside = read.isNotNull() & (read >= domain.get("min", float("-inf"))) & (read <= domain.get("max", float("inf")))
        if "values" in domain:
            inside = inside & c.cast("string").isin(*domain["values"])
        rows.append(F.struct(F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count_if(there & ~shape).alias("n_not_integer"), F.count_if(there & ~inside).alias("n_outside")))
    group = df.groupBy(F.col(by).alias("by")) if by else df.groupBy()
    out = group.agg(F.array(*rows).alias("x")).select(*(["by"] if by else []), F.explode("x").alias("x"))
    return out.select(*(["by"] if by else []), "x.*")


def column_info(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column_name, low, high, whole, n_categories, categories): ranges of numbers, whether all are whole, and sorted categories.

    Categories are distinct values of a declared categorical column, whose number the profile bounds.
    """
    number = lambda c: F.struct(F.lit(c).alias("column_name"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"), F.bool_and(F.col(c) % 1 == 0).alias("whole"), F.lit(None).cast("long").alias("n_categories"), F.lit(None).cast("string").alias("categories"))
    made = []
    if numeric:
        made.append(df.agg(F.array(*[number(c) for c in numeric]).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    for c in categorical:
        seen = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
        made.append(seen.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("g")).select(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("boolean").alias("whole"), F.col("n").alias("n_categories"), F.col("g").alias("categories")))
    return reduce(DataFrame.unionByName, made)


def ordered_digest(df: DataFrame, order: list[str], columns: list[str], fan: int = 1024) -> DataFrame:
    """(level, node, n, digest): a tree of digests over the rows in ``order``; the one node of the last level stands for the table.

    A row's digest is SHA-256 of its fields, apart by a unit separator; rows equal in order follow their digests. A leaf
    (level 0) holds ``fan`` rows by exact rank and digests ``<row digest>*<how often>`` of each run of equal rows, joined by
    line breaks; a node above digests its ``fan`` children's digests, joined alike. So two tables of equal rows in equal
    order have equal trees, a difference is found by going down, and no row of any stage holds more than ``fan`` digests.
    Equal rows are counted before they are ranked: copies are never gathered. Empty table: no nodes.
    """
    by = [f"_o{i}" for i in range(len(order))] + ["_row"]
    runs = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row_digest(columns).alias("_row")).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranged = working(runs.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_part").agg(F.sum("_n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    leaf = F.explode(F.sequence(F.floor(F.col("_from") / fan), F.floor((F.col("_upto") - 1) / fan))).alias("node")
    pieces = placed.select("_from", "_upto", "_row", leaf).withColumn("_k", F.least("_upto", (F.col("node") + 1) * fan) - F.greatest("_from", F.col("node") * fan))
    text = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_from").alias("at"), value.alias("x")))), lambda p: p["x"]), "\n")
    level = working(pieces.groupBy("node").agg(F.sum("_k").alias("n"), F.sha2(text(F.concat_ws("*", "_row", F.col("_k").cast("string"))), 256).alias("digest")), "leaves")
    nodes, out, depth = level.count(), level.withColumn("level", F.lit(0)), 0
    while nodes > 1:
        nodes, depth = -(-nodes // fan), depth + 1
        level = level.withColumn("_from", F.col("node")).groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n").alias("n"), F.sha2(text(F.col("digest")), 256).alias("digest"))
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("level", "node", "n", "digest")


def infer_roles(df: DataFrame) -> DataFrame:
    """(column_name, n, n_numeric, n_whole, role): numeric if every present value is a finite number; a NaN of a number column is missing."""
    floating = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    rows = []
    for c in df.columns:
        value = present(F.col(f"`{c}`")) if c in floating else F.col(f"`{c}`")
        read = number(value)
        read = F.when(F.abs(read) < float("inf"), read)  # NaN counts as more than that
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count(value).alias("n"), F.count(read).alias("n_numeric"), F.count_if(read == F.floor(read)).alias("n_whole")))
    out = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("role", F.when((F.col("n") > 0) & (F.col("n") == F.col("n_numeric")), F.when(F.col("n_whole") == F.col("n"), "integer").otherwise("continuous")).otherwise("categorical"))


def duplicate_audit(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(duplicates_train, duplicates_test, distinct_overlap, train_rows_in_overlap, test_rows_in_overlap), nulls equal."""
    keyed = [df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"), F.lit(i).alias("side")) for i, df in enumerate((train, test))]
    g = keyed[0].unionByName(keyed[1]).groupBy("row").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    over = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0))
    return g.agg(F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("duplicates_train"), F.sum(F.greatest(F.col("b") - 1, F.lit(0))).alias("duplicates_test"), F.count_if(both).alias("distinct_overlap"), over("a").alias("train_rows_in_overlap"), over("b").alias("test_rows_in_overlap"))


def slugs(df: DataFrame, name: str, slug: str) -> DataFrame:
    """Slugs made unique in the order of names: a slug that is taken gets -2, -3 and so on, the first that is free.

    A made id may meet a given slug (``a, a, a-2``), so ids depend on one another; slugs that can meet share what is left when
    numbers at their end are cut off, and each such family, which is that of a few columns, is settled by itself.
    """
    family = F.regexp_replace(F.col(slug), "(-[0-9]+)+$", "")
    rows = df.select(F.col(name).alias("name"), F.col(slug).alias("slug"), family.alias("family"))

    def settle(columns: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        made = []
        for own in columns.sort_values("name")["slug"]:
            found, n = own, 2
            while found in used:
                found, n = f"{own}-{n}", n + 1
            used.add(found)
            made.append(found)
        return columns.sort_values("name").assign(column_id=made)[["name", "column_id"]]

    ids = rows.where(F.col("slug").isNotNull()).groupBy("family").applyInPandas(settle, f"name {df.schema[name].dataType.simpleString()}, column_id string")
    return df.join(ids.withColumnRenamed("name", "_name"), F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def largest_remainder(counts: DataFrame, weight: str, total: int) -> DataFrame:
    """Allocates ``total`` in proportion: floors, then one more by descending remainder (ties by key order)."""
    total_weight = counts.agg(F.sum(F.col(weight).cast("double")).alias("_all"))
    held = counts.join(F.broadcast(total_weight)).withColumn("_s", F.col(weight).cast("double") * total / F.col("_all")).withColumn("_f", F.floor("_s")).drop("_all")
    left = held.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    out = ranked(held, [F.desc(F.col("_s") - F.col("_f")), counts.columns[0]], name="_place").join(F.broadcast(left))
    return out.withColumn("allocated", (F.col("_f") + F.when(F.col("_place") < F.col("_left"), 1).otherwise(0)).cast("long")).drop("_s", "_f", "_left", "_place")
