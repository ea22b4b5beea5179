"""Types that all evaluation queries share: arms, column roles, and the atomic result relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The closed sets of the result relation.
STATES = ("computed", "mathematically_undefined", "insufficient_support", "not_applicable", "implementation_failure", "resource_failure")
SCOPES = ("column", "pair", "target", "evaluator", "attack", "group", "phase", "dataset")
SEMANTIC_TYPES = ("continuous", "integer", "categorical", "boolean", "datetime", "string")

# The fields of the result relation, in order.
ATOMIC = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("protocol_version", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("dataset_view", T.StringType()),
        T.StructField("split_id", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("comparison_track", T.StringType()),
        T.StructField("generation_seed", T.LongType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("metric_version", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("scope_type", T.StringType()),
        T.StructField("scope_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("raw_direction", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("n_reference", T.LongType()),
        T.StructField("n_synthetic", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("n_excluded", T.LongType()),
        T.StructField("computed_at", T.StringType()),
        T.StructField("raw_value", T.DoubleType()),
        T.StructField("normalized_value", T.DoubleType()),
        T.StructField("aggregate_contribution", T.DoubleType()),
        T.StructField("reference_value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("evaluator_id", T.StringType()),
        T.StructField("evaluator_version", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("reason_detail", T.StringType()),
        T.StructField("warning_codes", T.ArrayType(T.StringType())),
        T.StructField("artifact_ref", T.StringType()),
        T.StructField("result_schema_version", T.StringType()),
    ]
)


class GateError(ValueError):
    """A table that the structural gate refuses; ``reason_code`` is stable."""

    def __init__(self, reason_code: str, detail: str = ""):
        super().__init__(f"{reason_code}: {detail}" if detail else reason_code)
        self.reason_code = reason_code


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    semantic_type: str
    nullable: bool = False
    roles: tuple[str, ...] = ()
    valid_domain: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    """The column contract of one dataset view, in canonical order."""

    dataset_id: str
    columns: tuple[ColumnSpec, ...]

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def of_type(self, *kinds: str) -> list[str]:
        return [c.name for c in self.columns if c.semantic_type in kinds]
