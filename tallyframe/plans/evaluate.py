"""Table evaluation: a profile, two or three arms and a protocol in; atomic results, property scores and a terminal status out."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.contracts import ATOMIC, ColumnSpec, GateError, Profile
from tallyframe.operators import audit, estimators, fidelity, reports, rules
from tallyframe.operators.stats import seeded_sample
from tallyframe.plans import bundle
from tallyframe.sources.working import working

# Identities of the metrics.
SHAPES, TRENDS = "sdmetrics-column-shapes", "sdmetrics-column-pair-trends"
COLUMN_VALIDITY, CONSTRAINT_VALIDITY = "std-tabular-column-validity", "std-tabular-constraint-validity"
RETENTION = "std-local-utility-retention"
VERSION = "1.0.0"

NUMBERS = ("continuous", "integer", "datetime")
LABELS = ("categorical", "boolean")
CORRELATION_LEAST, ASSOCIATION_LEAST = 0.5, 0.3


@dataclass(frozen=True)
class Outcome:
    """``atoms`` is the result relation; ``scores`` (property, score); ``denominators`` (name, n)."""

    atoms: DataFrame
    scores: DataFrame
    denominators: DataFrame
    status: str


def _arms(reference: DataFrame, synthetic: DataFrame, profile: Profile) -> DataFrame:
    """Both arms in one table: numbers and dates as doubles, everything else as text."""
    as_kind = lambda s: (F.unix_micros(F.col(f"`{s.name}`")).cast("double") / 1e6 if s.semantic_type == "datetime" else F.col(f"`{s.name}`").cast("double" if s.semantic_type in NUMBERS else "string")).alias(s.name)
    return fidelity.union_arms(*[df.select(*[as_kind(s) for s in profile.columns]) for df in (reference, synthetic)])


def _counts(arms: DataFrame, profile: Profile, pairs: list[tuple[ColumnSpec, ColumnSpec]]) -> DataFrame:
    """(scope_id, n_reference, n_synthetic, n_valid, n_excluded) of every column and pair from one aggregation."""
    scopes = [(s.name, F.col(f"`{s.name}`").isNotNull()) for s in profile.columns]
    scopes += [(f"{a.name}--{b.name}", F.col(f"`{a.name}`").isNotNull() & F.col(f"`{b.name}`").isNotNull()) for a, b in pairs]
    every = F.count(F.lit(1))
    made = F.array(*[F.struct(F.lit(k).alias("scope_id"), F.count_if(v).alias("n_valid"), (every - F.count_if(v)).alias("n_excluded")) for k, v in scopes])
    one = arms.agg(F.count_if(~F.col(fidelity.ARM)).alias("n_reference"), F.count_if(F.col(fidelity.ARM)).alias("n_synthetic"), made.alias("x"))
    return one.select("n_reference", "n_synthetic", F.explode("x").alias("x")).select("x.scope_id", "n_reference", "n_synthetic", "x.n_valid", "x.n_excluded")


def shape_scores(arms: DataFrame, profile: Profile) -> DataFrame:
    """(scope_id, evaluated, score) of every column: KS for numbers and dates, TV for categories; others are not evaluated."""
    numbers, labels = profile.of_type(*NUMBERS), profile.of_type(*LABELS)
    found = [fidelity.ks_complement(arms, numbers)] if numbers else []
    found += [fidelity.tv_complement(arms, labels)] if labels else []
    known = arms.sparkSession.createDataFrame([(s.name, s.semantic_type in NUMBERS + LABELS) for s in profile.columns], "scope_id string, evaluated boolean")
    scored = reduce(DataFrame.unionByName, [x.select(F.col("column_name").alias("scope_id"), "score") for x in found]) if found else arms.sparkSession.createDataFrame([], "scope_id string, score double")
    return known.join(scored, "scope_id", "left")


def trend_scores(arms: DataFrame, profile: Profile) -> DataFrame:
    """(scope_id, evaluated, score, strength, least) of every pair of columns.

    Two numbers: correlation similarity, with the real correlation as the strength that has to exceed ``least``. With a
    category: contingency similarity of numbers in ten bins per arm, and Cramer's V of the real cells.
    """
    pairs = list(combinations(profile.columns, 2))
    kind = {s.name: "number" if s.semantic_type in NUMBERS else "label" if s.semantic_type in LABELS else None for s in profile.columns}
    both = [(a.name, b.name) for a, b in pairs if kind[a.name] == kind[b.name] == "number"]
    mixed = [(a.name, b.name) for a, b in pairs if "label" in (kind[a.name], kind[b.name]) and None not in (kind[a.name], kind[b.name])]
    known = arms.sparkSession.createDataFrame([(f"{a.name}--{b.name}", bool(kind[a.name] and kind[b.name])) for a, b in pairs], "scope_id string, evaluated boolean")
    found = []
    if both:
        numbers = [c for c, k in kind.items() if k == "number"]
        scored = fidelity.correlation_similarity(arms, numbers)
        found.append(scored.select(F.concat_ws("--", "left_column", "right_column").alias("scope_id"), "score", F.abs("real_rho").alias("strength"), F.lit(CORRELATION_LEAST).alias("least")))
    if mixed:
        cut = fidelity.binned(arms, sorted({c for p in mixed for c in p if kind[c] == "number"})) if any(kind[c] == "number" for p in mixed for c in p) else arms
        cut = working(cut, "cut")
        name = lambda c: F.regexp_replace(c, r"\|", "--").alias("scope_id")
        similar = fidelity.contingency_similarity(cut, mixed).select(name("pair_name"), "score")
        strong = fidelity.cramers_vs(cut.where(~F.col(fidelity.ARM)), mixed).select(name("pair_name"), F.col("v").alias("strength"))
        found.append(similar.join(strong, "scope_id", "left").select("scope_id", "score", "strength", F.lit(ASSOCIATION_LEAST).alias("least")))
    empty = arms.sparkSession.createDataFrame([], "scope_id string, score double, strength double, least double")
    return known.join(reduce(DataFrame.unionByName, found, empty), "scope_id", "left")


def _weighted(rows: DataFrame, counts: Column) -> DataFrame:
    """Equal weights of the rows that count, and their contributions."""
    n = rows.agg(F.count_if(counts).alias("_n"))
    return rows.join(F.broadcast(n)).withColumn("weight", F.when(counts, 1.0 / F.col("_n")).otherwise(0.0)).drop("_n").withColumn("aggregate_contribution", F.col("raw_value") * F.col("weight"))


def fidelity_atoms(reference: DataFrame, synthetic: DataFrame, profile: Profile) -> DataFrame:
    """Atomic rows of column shapes and pair trends."""
    arms = working(_arms(reference, synthetic, profile), "arms")
    pairs = list(combinations(profile.columns, 2))
    counts = _counts(arms, profile, pairs)
    why = lambda unsupported, weak: F.when(~F.col("evaluated"), "unsupported_semantic_type").when(weak, "below_source_threshold").when(F.col("score").isNull(), "upstream_nonfinite_result")  # noqa: E731, ARG005
    state = F.when(F.col("reason_code").isNull(), "computed").when(F.col("reason_code") == "upstream_nonfinite_result", "mathematically_undefined").otherwise("not_applicable")

    def finish(rows: DataFrame, metric: str, scope: str) -> DataFrame:
        rows = rows.withColumn("state", state).withColumn("raw_value", F.when(F.col("state") == "computed", F.col("score")))
        rows = _weighted(rows, F.col("state") == "computed").join(counts, "scope_id")
        warnings = F.when(F.col("reason_code") == "below_source_threshold", F.array(F.col("reason_code"))).otherwise(F.array().cast("array<string>"))
        return rows.select(F.lit(metric).alias("metric_id"), F.lit(scope).alias("scope_type"), "scope_id", "state", "reason_code", "raw_value", F.col("raw_value").alias("normalized_value"), "weight", "aggregate_contribution", "n_reference", "n_synthetic", "n_valid", "n_excluded", warnings.alias("warning_codes"))

    shapes = shape_scores(arms, profile)
    shapes = shapes.withColumn("reason_code", why(None, F.lit(False)))
    trends = trend_scores(arms, profile)
    trends = trends.withColumn("reason_code", why(None, F.col("strength") <= F.col("least")))
    return finish(shapes, SHAPES, "column").unionByName(finish(trends, TRENDS, "pair"))


def validity_atoms(synthetic: DataFrame, column_rules: Mapping[str, list[Mapping]], constraints: Mapping[str, Mapping], n_reference: int) -> DataFrame:
    """Atomic rows of column and constraint validity, judged on the synthetic arm as it came."""
    found = working(rules.validity(synthetic, column_rules, constraints).where("scope_id <> 'fully_valid_rows'"), "validity")
    column = F.col("scope_type") == "column"
    n = synthetic.agg(F.count(F.lit(1)).alias("n_synthetic"))
    rows = found.join(F.broadcast(n)).select(F.when(column, COLUMN_VALIDITY).otherwise(CONSTRAINT_VALIDITY).alias("metric_id"), "scope_type", "scope_id", F.when(F.col("score").isNull(), "not_applicable").otherwise("computed").alias("state"), F.when(F.col("score").isNull(), "no_applicable_rows").alias("reason_code"), F.col("score").alias("raw_value"), F.col("score").alias("normalized_value"), "weight", (F.col("score") * F.col("weight")).alias("aggregate_contribution"), F.lit(n_reference).cast("long").alias("n_reference"), "n_synthetic", F.col("n_total").alias("n_valid"), (F.col("n_synthetic") - F.col("n_total")).alias("n_excluded"), F.array().cast("array<string>").alias("warning_codes"))
    if constraints:
        return rows
    none = n.select(F.lit(CONSTRAINT_VALIDITY).alias("metric_id"), F.lit("dataset").alias("scope_type"), F.lit("constraints").alias("scope_id"), F.lit("not_applicable").alias("state"), F.lit("no_reviewed_constraints").alias("reason_code"), *[F.lit(None).cast("double").alias(c) for c in ("raw_value", "normalized_value")], F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("aggregate_contribution"), F.lit(n_reference).cast("long").alias("n_reference"), "n_synthetic", F.lit(0).cast("long").alias("n_valid"), F.col("n_synthetic").alias("n_excluded"), F.array().cast("array<string>").alias("warning_codes"))
    return rows.unionByName(none)


def utility_atoms(runs: DataFrame, n_test: int, n_synthetic: int) -> DataFrame:
    """Atomic rows of every raw arm and of the retention of each evaluator and seed."""
    scope = F.concat_ws("--", "target", "evaluator", F.concat(F.lit("seed-"), F.col("seed").cast("string")))
    sizes = [F.lit(n_test).cast("long").alias("n_reference"), F.lit(n_synthetic).cast("long").alias("n_synthetic"), F.lit(n_test).cast("long").alias("n_valid"), F.lit(0).cast("long").alias("n_excluded"), F.array().cast("array<string>").alias("warning_codes")]
    raw = runs.select(F.concat(F.lit("std-local-utility-"), F.col("metric")).alias("metric_id"), F.lit("evaluator").alias("scope_type"), F.concat_ws("--", scope, "arm").alias("scope_id"), "state", "reason_code", F.col("value").alias("raw_value"), F.lit(None).cast("double").alias("normalized_value"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("aggregate_contribution"), *sizes)
    primary = F.when(F.col("task") == "classification", estimators.PRIMARY["classification"]).otherwise(estimators.PRIMARY["regression"])
    arms = runs.where(F.col("metric") == primary)
    aligned = reports.aligned_arms(arms, ["target", "task", "evaluator", "seed"], "value", higher_is_better=F.col("task") == "classification")
    lacks = arms.groupBy("target", "task", "evaluator", "seed").agg(F.max("reason_code").alias("_why"), F.max(F.when(F.col("state") != "computed", F.col("state"))).alias("_state"), F.count(F.lit(1)).alias("_n"))
    held = aligned.join(lacks, ["target", "task", "evaluator", "seed"])
    state = F.when(F.col("_state").isNotNull(), F.col("_state")).when(F.col("retention").isNull(), "mathematically_undefined").otherwise("computed")
    reason = F.when(F.col("_state").isNotNull(), F.coalesce("_why", F.lit("raw_arm_undefined"))).when(F.col("retention").isNull(), "weak_trtr_baseline")
    expected = held.agg(F.count(F.lit(1)).alias("_e"))
    kept = held.join(F.broadcast(expected)).select(F.lit(RETENTION).alias("metric_id"), F.lit("evaluator").alias("scope_type"), scope.alias("scope_id"), state.alias("state"), reason.alias("reason_code"), F.col("retention").alias("raw_value"), F.col("retention").alias("normalized_value"), F.when(state == "computed", 1.0 / F.col("_e")).otherwise(0.0).alias("weight"), (F.col("retention") / F.col("_e")).alias("aggregate_contribution"), *sizes)
    return raw.unionByName(kept)


def property_scores(atoms: DataFrame, complete: tuple[str, ...] = ()) -> DataFrame:
    """(metric_id, score, n_rows, n_computed) by metric: the sum of contributions, null if none is computed; for metrics in ``complete`` null unless all are."""
    weighed = atoms.where(F.col("normalized_value").isNotNull() | (F.col("state") != "computed")).groupBy("metric_id").agg(F.sum("aggregate_contribution").alias("_s"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("state") == "computed").alias("n_computed"))
    whole = ~F.col("metric_id").isin(*complete) | (F.col("n_rows") == F.col("n_computed")) if complete else F.lit(True)
    return weighed.select("metric_id", F.when(whole, F.col("_s")).alias("score"), "n_rows", "n_computed")


def overall(scores: DataFrame) -> DataFrame:
    """(overall): the mean of the shape and trend scores, as older reports tell it; the reviewed protocol has no such number."""
    pick = lambda m: F.max(F.when(F.col("metric_id") == m, F.col("score")))
    return scores.agg(((pick(SHAPES) + pick(TRENDS)) / 2).alias("overall"))


def denominators(atoms: DataFrame) -> DataFrame:
    """(name, n): columns and pairs that were requested, evaluated and that contribute."""
    of = lambda m: F.col("metric_id") == m
    evaluated = F.col("reason_code").isNull() | (F.col("reason_code") != "unsupported_semantic_type")
    made = {"requested_columns": of(SHAPES), "source_evaluated_columns": of(SHAPES) & evaluated, "shape_contributing_columns": of(SHAPES) & (F.col("weight") > 0), "requested_column_pairs": of(TRENDS), "source_evaluated_column_pairs": of(TRENDS) & evaluated, "trend_contributing_column_pairs": of(TRENDS) & (F.col("weight") > 0)}
    return atoms.agg(F.array(*[F.struct(F.lit(k).alias("name"), F.count_if(v).alias("n")) for k, v in made.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def terminal_status(atoms: DataFrame, scores: DataFrame, protocol: str) -> DataFrame:
    """(status): success only if every atom is computed (for p2 and p3 or not applicable) and, for p2 and p4, every property has a score."""
    allowed = ("computed",) if protocol == "p4" else ("computed", "not_applicable")
    states = atoms.agg(F.bool_and(F.col("state").isin(*allowed)).alias("_fine"))
    told = scores.agg(F.bool_and(F.col("score").isNotNull()).alias("_told"))
    good = F.col("_fine") & (F.col("_told") if protocol != "p3" else F.lit(True))
    return states.join(told).select(F.when(F.coalesce(good, F.lit(False)), "success").otherwise("partial").alias("status"))  # single rows


def evaluate_table(
    reference: DataFrame, synthetic: DataFrame, profile: Profile, *, protocol: str = "p2", expected_rows: int | None = None, test: DataFrame | None = None,
    subsample: int | None = None, seed: int = 0, definitions: list[Mapping] = (), constraints: Mapping[str, Mapping] | None = None, target: str | None = None, task: str | None = None, evaluators: list[str] = (), seeds: list[int] = (0,), identity: Mapping[str, object] | None = None,
) -> Outcome:
    """One run of a protocol: ``p2`` fidelity, ``p3`` validity (the synthetic arm unrepaired), ``p4`` utility with a held-out ``test`` arm.

    ``p2`` reads whole arms; the source protocol's seeded subsample of 50,000 rows an arm is had by ``subsample``.
    """
    known = {"protocol_version": "1.0.0", "dataset_id": profile.dataset_id, "metric_version": VERSION, "raw_direction": "maximize", "result_schema_version": "1.0.0"} | dict(identity or {})
    if protocol == "p2":
        arms = audit.gate(reference, profile), audit.gate(synthetic, profile, expected_rows)
        if subsample is not None:
            arms = tuple(seeded_sample(df.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in profile.names()])), "_h", subsample, seed).drop("_h") for df in arms)
        rows, known["dimension"] = fidelity_atoms(*arms, profile), "fidelity"
    elif protocol == "p3":
        rules.check_contract(profile, list(definitions), constraints or {})
        judged = audit.gate(synthetic, profile, expected_rows, preserve=True)
        rows, known["dimension"] = validity_atoms(judged, rules.column_rules(profile, list(definitions)), constraints or {}, reference.count()), "validity"
    elif protocol == "p4":
        if test is None or target is None or task is None or not evaluators:
            raise GateError("invalid_protocol", "p4 needs a test arm, a target, a task and evaluators")
        arms = audit.gate_arms({"train": reference, "test": test, "synthetic": synthetic}, profile, expected_rows=expected_rows)
        kinds = {k: [c for c in profile.of_type(*t) if c != target] for k, t in (("numeric", ("continuous", "integer")), ("categorical", LABELS + ("string",)), ("datetime", ("datetime",)))}
        runs = estimators.local_evaluation(arms, target, task, kinds["numeric"], kinds["categorical"], datetime=kinds["datetime"], evaluators=list(evaluators), seeds=list(seeds))
        rows, known["dimension"] = utility_atoms(runs, arms["test"].count(), arms["synthetic"].count()), "local-utility"
    else:
        raise GateError("invalid_protocol", protocol)
    atoms = working(bundle.atomic(rows, **known), "atoms")
    scores = property_scores(atoms.where(F.col("metric_id") == RETENTION) if protocol == "p4" else atoms, (RETENTION,))
    return Outcome(atoms, scores, denominators(atoms), terminal_status(atoms, scores, protocol).first().status)


def check_protocol(datasets: list[Mapping], tasks: list[Mapping]) -> None:
    """Refuses repeated ids, and tasks whose target is no column that may be one."""
    for name, items, key in (("dataset", datasets, "dataset_id"), ("task", tasks, "task_id")):
        ids = [x[key] for x in items]
        if len(ids) != len(set(ids)):
            raise GateError("duplicate_ids", name)
    columns = {(d["dataset_id"], c["name"]): c for d in datasets for c in d["columns"]}
    for d in datasets:
        names = [c["name"] for c in d["columns"]]
        if len(names) != len(set(names)):
            raise GateError("duplicate_columns", d["dataset_id"])
    for t in tasks:
        found = columns.get((t["dataset_id"], t["target"]))
        if found is None or "target" not in found.get("roles", ()):
            raise GateError("invalid_task", t["task_id"])


def canonical_json(text: str) -> str:
    """A JSON text with sorted keys and no spaces; repeated keys and numbers that are not finite are refused."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise GateError("duplicate_json_key")
        return dict(pairs)

    def refuse(token: str) -> None:
        raise GateError("nonfinite_json_number", token)

    return json.dumps(json.loads(text, object_pairs_hook=once, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def packed_config(value: object, mark: str = "__none__") -> object:
    """A configuration without nulls, which a format without them can hold: each becomes the mark."""
    if isinstance(value, dict):
        return {k: packed_config(v, mark) for k, v in value.items()}
    if isinstance(value, list):
        return [packed_config(v, mark) for v in value]
    return mark if value is None else value


def unpacked_config(value: object, mark: str = "__none__") -> object:
    if isinstance(value, dict):
        return {k: unpacked_config(v, mark) for k, v in value.items()}
    if isinstance(value, list):
        return [unpacked_config(v, mark) for v in value]
    return None if value == mark else value


__all__ = ["ATOMIC", "Outcome", "evaluate_table"]
