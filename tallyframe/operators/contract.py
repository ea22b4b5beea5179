"""The closed language of validity contracts: what a contract may say, and everything that makes one refused.

A contract is a list of definitions (a selector and rules) for single columns, and named constraints across columns. A rule or
constraint may carry ``rule_id``, ``evidence``, ``severity`` and ``version``; what is given has to be sound.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Mapping, Sequence

from tallyframe.contracts import SEMANTIC_TYPES, ColumnSpec, GateError, Profile

# Rule types with the semantic types they apply to, constraint types, operators, evidence classes, version.
NUMBERS, TEXTS = ("continuous", "integer"), ("categorical", "string")
RULE_TYPES = {
    "not_null": SEMANTIC_TYPES,
    "finite": NUMBERS,
    "integer": ("integer",),
    "allowed_values": ("categorical", "boolean", "string"),
    "bounds": NUMBERS,
    "regex": TEXTS,
    "length": TEXTS,
    "unique": SEMANTIC_TYPES,
    "datetime_range": ("datetime",),
}
CONSTRAINT_TYPES = ("comparison", "conditional_domain", "mutual_exclusion", "sum_equals", "allowed_combinations", "functional_dependency")
OPERATORS = ("lt", "le", "eq", "ne", "ge", "gt")
EVIDENCE = ("authoritative-data-dictionary", "dataset-documentation", "legal-or-policy-requirement", "recorded-human-review")
VERSION = "1.0.0"

_ABOUT = {"rule_id", "evidence", "severity", "version"}
_RULE_FIELDS = {"allowed_values": {"values"}, "bounds": {"min", "max"}, "regex": {"pattern"}, "length": {"min", "max"}, "datetime_range": {"min", "max"}}
_CONSTRAINT_FIELDS = {  # required, optional
    "comparison": ({"left", "right", "op"}, set()),
    "conditional_domain": ({"condition", "when", "target", "then"}, set()),
    "mutual_exclusion": ({"columns", "truthy", "max"}, set()),
    "sum_equals": ({"columns", "total"}, {"relative", "absolute"}),
    "allowed_combinations": ({"columns", "allowed"}, set()),
    "functional_dependency": ({"columns", "dependent", "mapping"}, set()),
}
_APPLIES = {"all_rows": set(), "all_non_missing": set(), "column_equals": {"column", "value"}, "column_in": {"column", "values"}}
_COLUMN_FIELDS = ("left", "right", "condition", "target", "dependent", "total")


def refuse(detail: str) -> None:
    raise GateError("invalid_validity_contract", detail)


def constraint_columns(rule: Mapping) -> list[str]:
    """The columns a constraint reads, each once."""
    return list(dict.fromkeys([*rule.get("columns", []), *[rule[k] for k in _COLUMN_FIELDS if k in rule]]))


def selects(selector: Mapping, spec: ColumnSpec) -> bool:
    """Whether a selector's conditions, all of them, hold for a column of the profile."""
    return all(_SELECTORS[k][1](v, spec) for k, v in selector.items())


def _texts(x: object) -> bool:
    return isinstance(x, Sequence) and not isinstance(x, str) and bool(x) and all(isinstance(v, str) for v in x) and len(set(x)) == len(x)


#: A selector's conditions: whether one is well formed, and whether a column meets it.
_SELECTORS: dict[str, tuple[Callable[[object], bool], Callable[[object, ColumnSpec], bool]]] = {
    "column_ids": (_texts, lambda x, s: s.name in x),
    "semantic_types": (lambda x: _texts(x) and set(x) <= set(SEMANTIC_TYPES), lambda x, s: s.semantic_type in x),
    "nullable_model_input": (lambda x: isinstance(x, bool), lambda x, s: s.nullable == x),
    "roles_any": (_texts, lambda x, s: bool(set(s.roles) & set(x))),
    "valid_domain_keys": (_texts, lambda x, s: set(x) <= set(s.valid_domain)),
}


def _number(name: str, x: object, *, least: float = -math.inf) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < least:
        refuse(f"{name}: {x!r} is no finite number of at least {least}")
    return float(x)


def _scalars(name: str, values: object) -> None:
    """A non-empty list of different, present, finite scalars. Texts, numbers and truth values are never equal to one another."""
    if not isinstance(values, (list, tuple)) or not values:
        refuse(f"{name} names no values")
    if any(v is None or isinstance(v, (Mapping, list, tuple, set)) or (isinstance(v, float) and not math.isfinite(v)) for v in values):
        refuse(f"{name} holds a value that is no finite scalar")
    if len({json.dumps(v, default=str) for v in values}) != len(values):
        refuse(f"{name} names a value twice")


def _ends(name: str, rule: Mapping, read: Callable[[str, object], object]) -> None:
    """At least one of min and max, in order."""
    found = {k: read(f"{name}.{k}", rule[k]) for k in ("min", "max") if k in rule}
    if not found:
        refuse(f"{name} has neither min nor max")
    if len(found) == 2 and found["min"] > found["max"]:
        refuse(f"{name}: min exceeds max")


def _length(name: str, x: object) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 0:
        refuse(f"{name}: {x!r} is no length")
    return x


def _moment(name: str, x: object) -> dt.datetime:
    try:
        return dt.datetime.fromisoformat(str(x)).replace(tzinfo=None)
    except ValueError:
        refuse(f"{name}: {x!r} is no date")


def _pattern(name: str, x: object) -> None:
    try:
        re.compile(x)
    except (TypeError, re.error) as found:
        refuse(f"{name}: {found}")


def _about(name: str, rule: Mapping, seen: set[str]) -> None:
    if "rule_id" in rule:
        if not isinstance(rule["rule_id"], str) or not re.fullmatch(r"[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?", rule["rule_id"]):
            refuse(f"{name}: rule_id {rule['rule_id']!r}")
        if rule["rule_id"] in seen:
            refuse(f"{name}: rule_id {rule['rule_id']} occurs twice")
        seen.add(rule["rule_id"])
    if rule.get("severity", "hard") != "hard" or rule.get("version", VERSION) != VERSION:
        refuse(f"{name}: only hard rules of version {VERSION} count")
    if "evidence" in rule:
        e = rule["evidence"]
        if not isinstance(e, Mapping) or set(e) != {"source_type", "reference"} or e["source_type"] not in EVIDENCE or not str(e["reference"] or "").strip():
            refuse(f"{name}: evidence {e!r}")


def _check_rule(name: str, rule: Mapping, matched: list[ColumnSpec]) -> None:
    kind = rule["type"]
    if extra := set(rule) - {"type"} - _ABOUT - _RULE_FIELDS.get(kind, set()):
        refuse(f"{name}: {sorted(extra)}")
    if wrong := [s.name for s in matched if s.semantic_type not in RULE_TYPES[kind]]:
        refuse(f"{name} does not apply to {wrong}")
    if kind == "allowed_values":
        for where, values in [(name, rule["values"])] if "values" in rule else [(s.name, s.valid_domain.get("values")) for s in matched]:
            _scalars(f"{where}.values", values)
    elif kind == "bounds":
        for where, ends in [(name, rule)] if {"min", "max"} & set(rule) else [(s.name, s.valid_domain) for s in matched]:
            _ends(where, ends, _number)
    elif kind == "length":
        _ends(name, rule, _length)
    elif kind == "datetime_range":
        _ends(name, rule, _moment)
    elif kind == "regex":
        _pattern(name, rule.get("pattern"))


def _family(spec: ColumnSpec) -> str:
    return "number" if spec.semantic_type in NUMBERS else "date" if spec.semantic_type == "datetime" else "text"


def _check_constraint(name: str, rule: Mapping, specs: Mapping[str, ColumnSpec]) -> None:
    kind = rule["type"]
    required, optional = _CONSTRAINT_FIELDS[kind]
    if lacking := required - set(rule):
        refuse(f"{name} lacks {sorted(lacking)}")
    if extra := set(rule) - required - optional - {"type", "applies", "missing"} - _ABOUT:
        refuse(f"{name}: {sorted(extra)}")
    columns = rule.get("columns", [])
    if "columns" in required and not _texts(columns):
        refuse(f"{name}: columns {columns!r}")
    if unknown := set(constraint_columns(rule)) - set(specs):
        refuse(f"{name}: unknown columns {sorted(map(str, unknown))}")
    if kind == "comparison":
        if rule["op"] not in OPERATORS or rule["left"] == rule["right"]:
            refuse(f"{name}: {rule['left']} {rule['op']} {rule['right']}")
        if rule["op"] not in ("eq", "ne") and len({_family(specs[rule[k]]) for k in ("left", "right")}) > 1:
            refuse(f"{name}: columns of different kinds have no order")
    elif kind == "conditional_domain":
        _scalars(f"{name}.when", rule["when"])
        _scalars(f"{name}.then", rule["then"])
    elif kind == "mutual_exclusion":
        _scalars(f"{name}.truthy", rule["truthy"])
        if len(columns) < 2 or isinstance(rule["max"], bool) or not isinstance(rule["max"], int) or not 0 <= rule["max"] < len(columns):
            refuse(f"{name}: at most {rule['max']!r} of {len(columns)} columns")
    elif kind == "sum_equals":
        for k in ("relative", "absolute"):
            if k in rule:
                _number(f"{name}.{k}", rule[k], least=0)
        if wrong := [c for c in constraint_columns(rule) if specs[c].semantic_type not in NUMBERS]:
            refuse(f"{name}: no numbers in {wrong}")
    elif kind == "allowed_combinations":
        rows = rule["allowed"]
        if len(columns) < 2 or not isinstance(rows, (list, tuple)) or not rows or any(not isinstance(r, (list, tuple)) or len(r) != len(columns) for r in rows):
            refuse(f"{name}: combinations do not fit the columns")
        _distinct(f"{name}.allowed", rows)
    elif kind == "functional_dependency":
        mapping = rule["mapping"]
        if isinstance(mapping, Mapping):
            rows = [(k if isinstance(k, tuple) else (k,), v) for k, v in mapping.items()]
        elif isinstance(mapping, (list, tuple)) and all(isinstance(r, Mapping) and set(r) == {"determinant", "dependent"} and isinstance(r["determinant"], (list, tuple)) for r in mapping):
            rows = [(tuple(r["determinant"]), r["dependent"]) for r in mapping]
        else:
            rows = []
        if not rows or any(len(k) != len(columns) for k, _ in rows):
            refuse(f"{name}: mapping does not fit the columns")
        _distinct(f"{name}.mapping", [k for k, _ in rows])
        for _, v in rows:
            _scalars(f"{name}.dependent", [v])


def _distinct(name: str, rows: Sequence[Sequence]) -> None:
    if any(v is None or (isinstance(v, float) and not math.isfinite(v)) for r in rows for v in r):
        refuse(f"{name} holds a value that is no finite scalar")
    if len({json.dumps(list(r), default=str) for r in rows}) != len(rows):
        refuse(f"{name} names a combination twice")


def _check_applies(name: str, rule: Mapping, specs: Mapping[str, ColumnSpec]) -> None:
    if rule.get("missing", "violation") not in ("violation", "not_applicable"):
        refuse(f"{name}: missing behaviour {rule['missing']!r}")
    if "applies" not in rule:
        return
    a = rule["applies"]
    if not isinstance(a, Mapping) or a.get("type") not in _APPLIES or set(a) != {"type"} | _APPLIES[a["type"]]:
        refuse(f"{name}: applies {a!r}")
    if "column" in a and a["column"] not in specs:
        refuse(f"{name}: applies to the unknown column {a['column']!r}")
    if "value" in a or "values" in a:
        _scalars(f"{name}.applies", [a["value"]] if "value" in a else a["values"])


def check_contract(profile: Profile, definitions: Sequence[Mapping], constraints: Mapping[str, Mapping]) -> None:
    """Refuses, with the reason ``invalid_validity_contract``, whatever a contract must not say, and a column without any rule."""
    specs = {s.name: s for s in profile.columns}
    if len(specs) != len(profile.columns):
        refuse("column names occur twice")
    seen: set[str] = set()
    covered: set[str] = set()
    for i, d in enumerate(definitions):
        if not isinstance(d, Mapping) or set(d) != {"selector", "rules"} or not isinstance(d["selector"], Mapping) or not d["selector"] or not isinstance(d["rules"], (list, tuple)) or not d["rules"]:
            refuse(f"definition {i} needs a selector and rules")
        if wrong := [k for k, v in d["selector"].items() if k not in _SELECTORS or not _SELECTORS[k][0](v)]:
            refuse(f"definition {i}: selector {wrong}")
        if unknown := set(d["selector"].get("column_ids", [])) - set(specs):
            refuse(f"definition {i}: unknown columns {sorted(unknown)}")
        matched = [s for s in profile.columns if selects(d["selector"], s)]
        if not matched:
            refuse(f"definition {i} matches no column")
        covered |= {s.name for s in matched}
        for r in d["rules"]:
            if not isinstance(r, Mapping) or r.get("type") not in RULE_TYPES:
                refuse(f"definition {i}: rule {r!r}")
            name = f"definition {i}: {r['type']}"
            _about(name, r, seen)
            _check_rule(name, r, matched)
    for name, r in constraints.items():
        if not isinstance(r, Mapping) or r.get("type") not in CONSTRAINT_TYPES:
            refuse(f"constraint {name}: {r!r}")
        _about(name, r, seen)
        _check_constraint(name, r, specs)
        _check_applies(name, r, specs)
    if bare := [c for c in specs if c not in covered]:
        refuse(f"columns without a rule: {bare}")
