"""Declarative validity rules and cross-column constraints, compiled to boolean expressions and evaluated in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.contracts import ColumnSpec, Profile
from tallyframe.functions.expressions import finite, integral, is_close, python_fullmatch, truthy
from tallyframe.operators.contract import check_contract, constraint_columns, selects  # noqa: F401  the contract's door
from tallyframe.operators.stats import by_value


def column_rule(name: str, rule: Mapping, *, floating: bool = False) -> Column:
    """A rule's verdict per row; all but ``not_null`` pass on missing. ``unique`` needs ``with_unique_counts``.

    In a ``floating`` column NaN is missing, but ``finite`` fails on it.
    """
    c = F.col(name)
    kind = rule["type"]
    missing = c.isNull() | F.isnan(c) if floating else c.isNull()
    made: dict[str, Callable[[], Column]] = {
        "not_null": lambda: ~missing,
        "finite": lambda: finite(c),
        "integer": lambda: integral(c),
        "allowed_values": lambda: c.isin(*rule["values"]),
        "bounds": lambda: (c >= F.lit(rule["min"]) if "min" in rule else F.lit(True)) & (c <= F.lit(rule["max"]) if "max" in rule else F.lit(True)),
        "regex": lambda: python_fullmatch(c.cast("string"), rule["pattern"]),
        "length": lambda: F.char_length(c.cast("string")).between(rule.get("min", 0), rule.get("max", 2**31 - 1)),
        "unique": lambda: F.col(f"_n_{name}") == 1,
        "datetime_range": lambda: (c >= F.lit(rule["min"]).cast("timestamp") if "min" in rule else F.lit(True)) & (c <= F.lit(rule["max"]).cast("timestamp") if "max" in rule else F.lit(True)),
    }
    verdict = truthy(made[kind]())
    return verdict if kind == "not_null" else c.isNull() | verdict if kind == "finite" else missing | verdict


def column_rules(profile: Profile, definitions: list[Mapping]) -> dict[str, list[Mapping]]:
    """The rules of each column: those whose selector matches it, with values and bounds from its domain where they name none."""

    def resolved(rule: Mapping, spec: ColumnSpec) -> Mapping:
        if rule["type"] == "allowed_values" and "values" not in rule:
            return {**rule, "values": spec.valid_domain["values"]}
        if rule["type"] == "bounds" and not {"min", "max"} & set(rule):
            return {**rule, **{k: spec.valid_domain[k] for k in ("min", "max") if k in spec.valid_domain}}
        return rule

    return {s.name: [resolved(r, s) for d in definitions if selects(d["selector"], s) for r in d["rules"]] for s in profile.columns}


def with_unique_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Group sizes for ``unique``: counted first and joined, so a hot value never gathers its rows in one task."""
    for name in names:
        sizes = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"_k_{name}")).agg(F.count(F.lit(1)).alias(f"_n_{name}"))
        df = by_value(df, sizes, [name], f"_n_{name}")
    return df


Read = Callable[[str], Column]
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b}


def applicable(rule: Mapping, columns: list[str], read: Read = F.col) -> Column:
    kind = rule.get("applies", {"type": "all_rows"})
    out = {
        "all_rows": lambda: F.lit(True),
        "all_non_missing": lambda: F.lit(True),
        "column_equals": lambda: read(kind["column"]) == F.lit(kind["value"]),
        "column_in": lambda: read(kind["column"]).isin(*kind["values"]),
    }[kind["type"]]()
    if kind["type"] == "all_non_missing" or rule.get("missing", "violation") == "not_applicable":
        for c in columns:
            out = out & read(c).isNotNull()
    return truthy(out)


def _determined(rule: Mapping, read: Read) -> Column:
    """The determinant tuple is one that the mapping names, and the dependent value is the named one."""
    known = [(k if isinstance(k, tuple) else (k,), v) for k, v in rule["mapping"].items()] if isinstance(rule["mapping"], Mapping) else [(tuple(r["determinant"]), r["dependent"]) for r in rule["mapping"]]
    return _is_one_of([read(c) for c in (*rule["columns"], rule["dependent"])], [(*determinant, dependent) for determinant, dependent in known])


def _is_one_of(columns: list[Column], rows: list[tuple]) -> Column:
    """Whether the columns together are one of the rows; a missing value is in none. Halves are joined, so the expression stays shallow."""
    made = [reduce(lambda a, b: a & b, [truthy(c == F.lit(v)) for c, v in zip(columns, row)]) for row in rows] or [F.lit(False)]
    while len(made) > 1:
        made = [made[i] | made[i + 1] if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    return made[0]


def constraint(rule: Mapping, read: Read = F.col) -> tuple[Column, Column]:
    """(applicable, satisfied) of a cross-column constraint; ``read`` gives a column with what counts as missing as null."""
    columns, kind = constraint_columns(rule), rule["type"]
    made: dict[str, Callable[[], Column]] = {
        "comparison": lambda: _COMPARE[rule["op"]](read(rule["left"]), read(rule["right"])),
        "conditional_domain": lambda: ~truthy(read(rule["condition"]).isin(*rule["when"])) | truthy(read(rule["target"]).isin(*rule["then"])),
        "mutual_exclusion": lambda: sum((F.when(read(c).isin(*rule["truthy"]), 1).otherwise(0) for c in rule["columns"]), F.lit(0)) <= rule["max"],
        "sum_equals": lambda: is_close(sum((read(c) for c in rule["columns"][1:]), read(rule["columns"][0])), read(rule["total"]), rule.get("relative", 1e-9), rule.get("absolute", 0.0)),
        "allowed_combinations": lambda: _is_one_of([read(c) for c in rule["columns"]], [tuple(combination) for combination in rule["allowed"]]),
        "functional_dependency": lambda: _determined(rule, read),
    }
    satisfied = truthy(made[kind]())
    if rule.get("missing", "violation") == "violation":
        for c in columns:
            satisfied = satisfied & read(c).isNotNull()
    return applicable(rule, columns, read), satisfied


def validity(df: DataFrame, column_rules: Mapping[str, list[Mapping]], constraints: Mapping[str, Mapping]) -> DataFrame:
    """Atomic rows (scope_type, scope_id, n_valid, n_total, score, weight) and the property's scores, from one aggregation.

    Column score: the mean of the columns' valid-cell rates. Constraint score: the mean over constraints that apply to any
    row. Validity: the mean of both, or the column score alone.
    """
    unique = [c for c, rules in column_rules.items() if any(r["type"] == "unique" for r in rules)]
    df = with_unique_counts(df, unique)
    floating = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    cells = {c: [column_rule(c, r, floating=c in floating) for r in rules] for c, rules in column_rules.items()}
    present = lambda c: F.nanvl(F.col(c), F.lit(None)) if c in floating else F.col(c)
    cell = {}
    for c, rules in cells.items():
        verdict = rules[0]
        for r in rules[1:]:
            verdict = verdict & r
        cell[c] = verdict
    pairs = {k: constraint(r, present) for k, r in constraints.items()}
    full = F.lit(True)
    for verdict in cell.values():
        full = full & verdict
    for applies, satisfied in pairs.values():
        full = full & (~applies | satisfied)
    row = lambda kind, key, good, total: F.struct(F.lit(kind).alias("scope_type"), F.lit(key).alias("scope_id"), good.alias("n_valid"), total.alias("n_total"))
    every = F.count(F.lit(1))
    rows = [row("column", c, F.count_if(v), every) for c, v in cell.items()]
    rows += [row("group", k, F.count_if(a & s), F.count_if(a)) for k, (a, s) in pairs.items()]
    rows += [row("dataset", "fully_valid_rows", F.count_if(full), every)]
    found = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    found = found.withColumn("score", F.try_divide(F.col("n_valid").cast("double"), F.col("n_total").cast("double")))
    n = F.count(F.when(F.col("scope_type") != "dataset", F.col("score"))).over(Window.partitionBy("scope_type"))
    return found.withColumn("weight", F.when(F.col("score").isNull() | (F.col("scope_type") == "dataset"), 0.0).otherwise(1.0 / F.greatest(n, F.lit(1))))


def validity_scores(rows: DataFrame) -> DataFrame:
    """(column_score, constraint_score, validity, fully_valid_row_rate)."""
    pick = lambda kind: F.avg(F.when(F.col("scope_type") == kind, F.col("score")))
    out = rows.agg(pick("column").alias("column_score"), pick("group").alias("constraint_score"), pick("dataset").alias("fully_valid_row_rate"))
    return out.withColumn("validity", F.coalesce((F.col("column_score") + F.col("constraint_score")) / 2, F.col("column_score")))
