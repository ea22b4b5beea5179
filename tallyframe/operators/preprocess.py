"""Leakage-safe preparation: imputation, encoding, scaling and splitting. States are fitted on one table, the train split, and applied to others."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.contracts import GateError, Profile
from tallyframe.functions.expressions import exp_with_bound, log_with_bound, marker_to_null, nfc, normal_quantile, number, present, ratio
from tallyframe.operators.stats import places, quantiles, ranked
from tallyframe.sources.working import working


@dataclass(frozen=True)
class ImputationState:
    numeric: dict[str, float]
    categorical: dict[str, str]
    missing: dict[str, int] = field(default_factory=dict)


def normalise_markers(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Textual missing markers become null; numeric columns become doubles, NaN included among the missing."""
    as_number = lambda c: present(number(marker_to_null(F.col(c).cast("string"))))
    return df.withColumns({c: as_number(c) for c in numeric} | {c: marker_to_null(F.col(c).cast("string")) for c in categorical})


def fit_imputation(train: DataFrame, numeric: list[str], categorical: list[str]) -> ImputationState:
    """Means and modes; of modes that tie, the least by its NFC form. One aggregation, then one small one per column."""
    if set(numeric) & set(categorical):
        raise GateError("overlapping_roles")
    means = train.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    modes = {}
    for c in categorical:
        counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
        modes[c] = counts.agg(F.min_by("v", F.struct(-F.col("count"), nfc(F.col("v")), F.col("v")))).first()[0]
    empty = [c for c, v in (means | modes).items() if v is None]
    if empty:
        raise GateError("all_missing", ", ".join(empty))
    counts = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*numeric, *categorical]]).first().asDict() if empty == [] and (numeric or categorical) else {}
    return ImputationState(means, modes, counts)


def impute(df: DataFrame, state: ImputationState, *, indicators: bool = False, target: str | None = None) -> DataFrame:
    fills = state.numeric | state.categorical
    if target and df.where(F.col(target).isNull()).limit(1).count():
        raise GateError("missing_target", target)
    if indicators:
        df = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("byte") for c in fills})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def sanitize(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Markers to null and numbers to doubles; any missing value, or a text that is no number, is refused."""
    out = normalise_markers(df, numeric, categorical)
    lost = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*numeric, *categorical]]).first().asDict()
    if wrong := [c for c, n in lost.items() if n]:
        raise GateError("missing_values_prohibited", ", ".join(wrong))
    return out


def preprocess_splits(splits: dict[str, DataFrame], numeric: list[str], categorical: list[str], *, target: str | None = None, indicators: bool = False, fit_on: str = "train") -> tuple[dict[str, DataFrame], dict]:
    """Every split imputed with the state of one, and a manifest of what was fitted, where, and how many values it fills.

    Columns have to be the same in all splits and in the same order; a missing target is refused in any split.
    """
    order = splits[fit_on].columns
    for name, df in splits.items():
        if df.columns != order:
            raise GateError("schema_mismatch", name)
    clean = {name: normalise_markers(df, [c for c in numeric if c != target], [c for c in categorical if c != target]) for name, df in splits.items()}
    state = fit_imputation(clean[fit_on], [c for c in numeric if c != target], [c for c in categorical if c != target])
    out = {name: impute(df, state, indicators=indicators, target=target) for name, df in clean.items()}
    filled = {name: df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in state.numeric | state.categorical]).first().asDict() for name, df in clean.items()}
    manifest = {"fit_split": fit_on, "numeric": state.numeric, "categorical": state.categorical, "columns": order, "target": target, "indicators": indicators, "splits": {name: {"rows": x.pop("_rows"), "filled": x} for name, x in filled.items()}}
    return out, manifest


def drop_missing_rows(df: DataFrame, numeric: list[str], split: str) -> DataFrame:
    """The policy that drops rows without a number; a test split may not lose any."""
    if split == "test" and df.where(F.greatest(*[F.col(c).isNull() for c in numeric], F.lit(False))).limit(1).count():
        raise GateError("missing_values_prohibited", "test rows may not be dropped")
    return df.dropna(subset=numeric)


@dataclass(frozen=True)
class Scaling:
    """Fitted statistics of numeric columns: (shift, scale) of each; a scale of 0 gives null."""

    columns: dict[str, tuple[float | None, float | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: ratio(F.col(c) - F.lit(a), F.lit(b)) for c, (a, b) in self.columns.items()})

    def invert(self, df: DataFrame, *, clip: dict[str, tuple[float, float]] | None = None) -> DataFrame:
        """Back to the columns' own scale, and into the given ranges."""
        back = lambda c, a, b: F.col(c) * F.lit(b) + F.lit(a)
        inside = lambda c, x: F.least(F.greatest(x, F.lit(float(clip[c][0]))), F.lit(float(clip[c][1]))) if clip and c in clip else x
        return df.withColumns({c: inside(c, back(c, a, b)) for c, (a, b) in self.columns.items()})


def fit_standard(train: DataFrame, columns: list[str]) -> Scaling:
    """Mean and population deviation of each column."""
    row = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Scaling({c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)})


def fit_min_max(train: DataFrame, columns: list[str], *, tanh: bool = False) -> Scaling:
    """Ranges of each column, onto [0, 1] or, for ``tanh``, onto [-1, 1]."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("l", F.min), ("h", F.max))]).first()
    ends = {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(columns)}
    return Scaling({c: (None, None) if low is None else ((low + high) / 2, (high - low) / 2) if tanh else (low, high - low) for c, (low, high) in ends.items()})


def standardised(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the train table (of the table itself if none is given)."""
    return fit_standard(df if train is None else train, columns).apply(df)


def min_max(df: DataFrame, columns: list[str], train: DataFrame | None = None, *, tanh: bool = False) -> DataFrame:
    return fit_min_max(df if train is None else train, columns, tanh=tanh).apply(df)


def quantile_knots(rows: int) -> int:
    """How many knots the quantile transform of so many train rows has."""
    return max(min(rows // 30, 1000), 10)


def fit_quantile_normal(train: DataFrame, column: str, knots: int | None = None) -> list[float]:
    """The column's values at evenly spaced shares."""
    count = quantile_knots(train.count()) if knots is None else knots
    return list(quantiles(train, column, {f"q{i}": i / (count - 1) for i in range(count)}).first())


def quantile_normal(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """Quantile transform to a normal: linear between knots, then the normal quantile, clipped at its ends."""
    knots = len(points)
    k = F.array(*[F.lit(float(x)) for x in points])
    i = F.size(F.filter(k, lambda x: x <= F.col(column)))
    low, high = F.get(k, i - 1), F.get(k, i)
    p = F.when(i == 0, 0.0).when(i >= knots, 1.0).otherwise((i - 1 + F.coalesce(ratio(F.col(column) - low, high - low), F.lit(0.0))) / (knots - 1))
    return df.withColumn(f"{column}_normal", F.when(F.col(column).isNotNull(), normal_quantile(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7)))))


def fit_rare(train: DataFrame, column: str, share: float) -> DataFrame:
    """(category): those with fewer train rows than the (half-even rounded) share."""
    counts = train.groupBy(F.col(column).alias("category")).count()
    least = train.agg(F.bround(F.count(F.lit(1)) * F.lit(share), 0).alias("_least"))
    return counts.join(F.broadcast(least)).where(F.col("count") < F.col("_least")).select("category")


def fold_rare(df: DataFrame, column: str, share: float, mark: str = "__rare__", train: DataFrame | None = None) -> DataFrame:
    """Categories that are rare in the train table (in the table itself if none is given) become one."""
    rare = fit_rare(df if train is None else train, column, share).withColumn("_rare", F.lit(True)).withColumnRenamed("category", "_category")
    return df.join(rare, F.col(column) == F.col("_category"), "left").withColumn(column, F.when(F.col("_rare"), mark).otherwise(F.col(column))).drop("_rare", "_category")


def category_codes(train: DataFrame, column: str) -> DataFrame:
    """(category, code): sorted categories from 0. One row per category; numbering orders these only."""
    return ranked(train.where(F.col(column).isNotNull()).select(F.col(column).alias("category")).distinct(), ["category"], name="code")


def ordinal(df: DataFrame, codes: DataFrame, column: str, unknown: Column | int | None = -1) -> DataFrame:
    """The code of each value; unknown ones get ``unknown``, or the number after the last code if that is None."""
    other = F.lit(unknown) if isinstance(unknown, int) else unknown
    if unknown is None:
        other = F.col("_after")
        codes = codes.join(F.broadcast(codes.agg((F.max("code") + 1).alias("_most"))))
        df = df.join(F.broadcast(codes.agg(F.max("_most").alias("_after"))))
        codes = codes.drop("_most")
    out = df.join(codes.withColumnRenamed("category", "_category"), F.col(column) == F.col("_category"), "left").withColumn(f"{column}_code", F.coalesce("code", other))
    return out.drop("code", "_category", "_after")


def decode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """The category of each code, codes outside the known ones clipped to the nearest."""
    ends = codes.agg(F.min("code").alias("_low"), F.max("code").alias("_high"))
    inside = df.join(F.broadcast(ends)).withColumn("_code", F.least(F.greatest(F.rint(F.col(f"{column}_code").cast("double")).cast("int"), F.col("_low")), F.col("_high")))
    return inside.join(codes.select(F.col("category").alias(column), F.col("code").alias("_known")), F.col("_code") == F.col("_known"), "left").drop("_code", "_known", "_low", "_high")


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in categories})


def leave_one_out(df: DataFrame, column: str, target: str, train: DataFrame | None = None, *, sigma: float = 0.0, seed: int = 0, key: str | None = None) -> DataFrame:
    """Mean target of the category: of its other rows for train rows, of all train rows for a table that is not the train table.

    ``sigma`` multiplies train values by 1 + sigma * z, with z normal and drawn from the seed and the row's ``key``.
    """
    fitted = df if train is None else train
    sums = fitted.groupBy(F.col(column).alias("_category")).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    out = df.join(sums, F.col(column).eqNullSafe(F.col("_category")), "left")
    value = ratio(F.col("_s") - F.col(target), F.col("_n") - 1) if train is None else ratio(F.col("_s"), F.col("_n"))
    if sigma and train is None:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
        value = value * (1 + F.lit(sigma) * normal_quantile(u))
    return out.withColumn(f"{column}_loo", value).drop("_s", "_n", "_category")


def snap_to_observed(df: DataFrame, column: str, observed: list[float]) -> DataFrame:
    """The nearest observed value of a column with few of them; of two as near, the smaller."""
    values = F.array(*[F.lit(float(v)) for v in sorted(observed)])
    nearest = F.array_min(F.transform(values, lambda v: F.struct(F.abs(F.col(column) - v).alias("d"), v.alias("v"))))
    return df.withColumn(column, nearest["v"])


def frequency_rank(df: DataFrame, column: str) -> DataFrame:
    """(category, n, share, rank): by descending count, then value, from 0."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    out = ranked(counts, [F.desc("n"), "category"]).join(F.broadcast(whole))
    return out.select("category", "n", ratio(F.col("n"), F.col("_all")).alias("share"), "rank")


def frequency_scaled(df: DataFrame, ranks: DataFrame, column: str) -> DataFrame:
    """The frequency rank of each category as a share of their number, in [0, 1)."""
    size = ranks.agg(F.count(F.lit(1)).alias("_size"))
    known = ranks.select(F.col("category").alias("_category"), "rank").join(F.broadcast(size))
    return df.join(known, F.col(column) == F.col("_category"), "left").withColumn(f"{column}_rank", ratio(F.col("rank"), F.col("_size"))).drop("_category", "rank", "_size")


def frequency_decoded(df: DataFrame, ranks: DataFrame, column: str) -> DataFrame:
    """The inverse: the category whose rank is nearest, clipped to the known ones."""
    size = ranks.agg(F.count(F.lit(1)).alias("_size"))
    at = df.join(F.broadcast(size)).withColumn("_at", F.least(F.greatest(F.rint(F.col(f"{column}_rank") * F.col("_size")).cast("int"), F.lit(0)), F.col("_size").cast("int") - 1))
    return at.join(ranks.select(F.col("category").alias(column), F.col("rank").alias("_rank")), F.col("_at") == F.col("_rank"), "left").drop("_at", "_rank", "_size")


def stratified_split(df: DataFrame, by: str, key: Column, shares: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Per class, the first rows in the order of ``key`` (a number, null first) go to the first split, and so on; the sizes are exact.

    Rows of equal keys follow the hash of their fields. Places come from running sums, so a large class or a frequent key is
    never sorted in one task.
    """
    placed = places(df, [by], F.coalesce(key.cast("double"), F.lit(float("-inf"))), df.columns)
    share = ratio(F.col("_place"), F.col("_place_of"))
    out = F.lit(names[-1])
    for name, upto in reversed([*zip(names[:-1], accumulate(shares))]):
        out = F.when(share < upto, name).otherwise(out)
    return placed.withColumn("split", out).drop("_place", "_place_of")


def hash_key(seed: int, *columns: str) -> Column:
    """A seeded order of rows that does not depend on partitions."""
    return F.xxhash64(F.lit(seed), *columns)


def covering_split(df: DataFrame, key: str, categorical: list[str], share: float = 0.9, seed: int = 0, tries: int = 50) -> tuple[DataFrame, int]:
    """``df`` with a split of exactly ``share`` train rows (rounded down) by the least seed under which these hold every category, and that seed."""
    whole = df.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
    for at in range(seed, seed + tries):
        placed = places(df, [], hash_key(at, key), [key])
        made = placed.withColumn("split", F.when(F.col("_place") < F.floor(F.col("_place_of") * share), "train").otherwise("test")).drop("_place", "_place_of")
        if made.where("split = 'train'").agg(*[F.count_distinct(c).alias(c) for c in categorical]).first() == whole:
            return made, at
    raise GateError("no_covering_split", f"{tries} seeds")


def validation_rows(df: DataFrame, key: str, seed: int, part: int = 9) -> DataFrame:
    """``df`` with a split: one row in ``part`` (rounded down) validates, the least by seeded hash."""
    placed = places(df, [], hash_key(seed, key), [key])
    return placed.withColumn("split", F.when(F.col("_place") < F.floor(F.col("_place_of") / part), "val").otherwise("train")).drop("_place", "_place_of")


def fit_quantile_bins(train: DataFrame, column: str, bins: int = 16) -> list[float]:
    """Distinct edges at the shares i / ``bins``, each the averaged inverse of the empirical distribution."""
    return sorted({float(x) for x in quantiles(train, column, {f"q{i}": i / bins for i in range(bins + 1)}, rule="averaged").first() if x is not None})


def quantile_bins(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """The number of each value's bin as text; values beyond the edges fall into the outer bins, a constant column into "0"."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.size(F.filter(inner, lambda e: e <= F.col(column))).cast("string")))


def quantile_bins_inverse(df: DataFrame, column: str, edges: list[float], key: str, seed: int) -> DataFrame:
    """A uniform draw within each bin, from the seed and the row's key."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(column), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    at, known = F.col(f"{column}_bin").cast("int"), F.array(*[F.lit(e) for e in edges])
    low, high = F.get(known, at), F.coalesce(F.get(known, at + 1), F.get(known, at))
    return df.withColumn(column, low + u * (high - low))


def dequantise(df: DataFrame, columns: list[str], key: str, seed: int, kind: str = "uniform") -> DataFrame:
    """Noise on whole numbers: within [0, 1) for ``uniform``, within [-0.5, 0.5) for ``round``; ``none`` adds nothing."""
    u = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    noise = {"uniform": u, "round": lambda c: u(c) - 0.5, "none": lambda c: F.lit(0.0)}[kind]
    return df.withColumns({c: F.col(c).cast("double") + noise(c) for c in columns})


def dequantise_inverse(df: DataFrame, columns: list[str], kind: str = "uniform") -> DataFrame:
    """Whole numbers again: floors of uniform noise, half-even rounding else."""
    return df.withColumns({c: (F.floor(c) if kind == "uniform" else F.rint(F.col(c).cast("double"))).cast("long") for c in columns})


def round_columns(df: DataFrame, train: DataFrame, columns: list[str], most: int = 32) -> DataFrame:
    """Columns with at most ``most`` distinct values in the train table snap to the nearest of these."""
    for c in columns:
        seen = [r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().limit(most + 1).collect()]  # bounded: at most 33
        if len(seen) <= most:
            df = snap_to_observed(df, c, seen)
    return df


def log_transform(df: DataFrame, bounds: dict[str, float], sentinel: float = -9999999.0) -> DataFrame:
    """Logarithms by each column's fitted lower bound; the sentinel of a missing value stays."""
    return df.withColumns({c: F.when(F.col(c) == sentinel, F.lit(sentinel)).otherwise(log_with_bound(F.col(c), low)) for c, low in bounds.items()})


def log_inverse(df: DataFrame, bounds: dict[str, float], decimals: dict[str, int] | None = None, sentinel: float = -9999999.0) -> DataFrame:
    """The inverse for every kind of bound, rounded where told; the sentinel becomes null."""
    back = lambda c, low: exp_with_bound(F.col(c), low)
    put = lambda c, x: F.round(x, decimals[c]) if decimals and c in decimals else x
    return df.withColumns({c: F.when(F.col(c) != sentinel, put(c, back(c, low))) for c, low in bounds.items()})


def clamp_to_observed(df: DataFrame, observed: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond the least and greatest observed ones move to these."""
    row = observed.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("l", F.min), ("h", F.max))]).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(row[f"l{i}"])), F.lit(row[f"h{i}"]))) for i, c in enumerate(columns)})


def clean_categories(df: DataFrame, columns: list[str], *, strip_dot: bool = False, marker: str = "?", replacement: str | None = "nan", leading_space: bool = False) -> DataFrame:
    """Trimmed texts: a final dot goes if asked, the missing marker becomes the replacement, and a leading space is put back if asked."""

    def cleaned(c: str) -> Column:
        out = F.trim(F.col(c))
        out = F.regexp_replace(out, r"\.$", "") if strip_dot else out
        out = F.when(out == marker, F.lit(replacement)).otherwise(out)
        return F.concat(F.lit(" "), out) if leading_space else out

    return df.withColumns({c: cleaned(c) for c in columns})


def collapse_one_hot(df: DataFrame, columns: list[str], name: str, prefix: str = "") -> DataFrame:
    """One label from one-hot columns: that of the greatest value, the first of equal ones."""
    values = F.array(*[F.col(c) for c in columns])
    at = F.array_position(values, F.array_max(values)).cast("int")
    return df.withColumn(name, F.get(F.array(*[F.lit(c.removeprefix(prefix)) for c in columns]), at - 1)).drop(*columns)


def mapped(df: DataFrame, column: str, table: dict, default: object = None) -> DataFrame:
    """Values replaced by a small table; others become ``default``, or stay if that is None."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    kept = F.col(column) if default is None else F.lit(default)
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), kept))


def standardise_target(df: DataFrame, target: str, train: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """A regression target in units of its train deviation, and what undoes it."""
    fitted = fit_standard(train, [target])
    mean, std = fitted.columns[target]
    return fitted.apply(df), {"mean": mean, "std": std}


def assemble_blocks(df: DataFrame, numeric: list[str], categorical: list[str], target: str | None = None, *, target_first: bool = False) -> DataFrame:
    """Columns in the order numbers, categories, target; or the target first."""
    order = [*([target] if target and target_first else []), *numeric, *categorical, *([target] if target and not target_first else [])]
    return df.select(*[F.col(f"`{c}`") for c in order])


def recover_order(df: DataFrame, original: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in original])


def square_rows(df: DataFrame, columns: list[str], name: str = "image") -> DataFrame:
    """Each row's numbers, padded with zeros to a square, as an array of its lines."""
    side = 1
    while side * side < len(columns):
        side += 1
    flat = F.concat(F.array(*[F.col(c).cast("double") for c in columns]), F.array_repeat(F.lit(0.0), side * side - len(columns)))
    return df.withColumn(name, F.array(*[F.slice(flat, i * side + 1, side) for i in range(side)]))


@dataclass(frozen=True)
class TransformSpec:
    """What ``transform_splits`` does, in its fixed order."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    regression: bool = False
    numeric_missing: str | None = None  # "mean" or "drop-rows"
    normalise: str | None = None  # "standard", "minmax" or "quantile"
    categorical_missing: str | None = None  # "most_frequent"
    rare_share: float | None = None
    encode: str | None = None  # "ordinal" or "one-hot"


def transform_splits(splits: dict[str, DataFrame], spec: TransformSpec, fit_on: str = "train") -> tuple[dict[str, DataFrame], dict]:
    """All splits through the steps missing numbers, scaling, missing categories, rare categories, encoding, target; each fitted on one split."""
    out, state = dict(splits), {"spec": asdict(spec), "fit_split": fit_on}
    numbers, labels = list(spec.numeric), list(spec.categorical)
    each = lambda f: {k: f(k, df) for k, df in out.items()}
    if spec.numeric_missing == "drop-rows":
        out = each(lambda k, df: drop_missing_rows(df, numbers, k))
    elif spec.numeric_missing == "mean":
        fills = fit_imputation(out[fit_on], numbers, [])
        out, state["means"] = each(lambda k, df: impute(df, fills)), fills.numeric
    if spec.normalise == "quantile":
        state["knots"] = {c: fit_quantile_normal(out[fit_on], c) for c in numbers}
        for c, points in state["knots"].items():
            out = each(lambda k, df, c=c, points=points: quantile_normal(df, c, points).drop(c).withColumnRenamed(f"{c}_normal", c))
    elif spec.normalise:
        fitted = fit_standard(out[fit_on], numbers) if spec.normalise == "standard" else fit_min_max(out[fit_on], numbers)
        out, state["scaling"] = each(lambda k, df: fitted.apply(df)), fitted.columns
    if spec.categorical_missing == "most_frequent":
        modes = fit_imputation(out[fit_on], [], labels)
        out, state["modes"] = each(lambda k, df: impute(df, modes)), modes.categorical
    if spec.rare_share is not None:
        for c in labels:
            fitted_on = out[fit_on]
            out = each(lambda k, df, c=c, fitted_on=fitted_on: fold_rare(df, c, spec.rare_share, train=fitted_on))
    if spec.encode:
        for c in labels:
            codes = category_codes(out[fit_on], c)
            if spec.encode == "ordinal":
                out = each(lambda k, df, c=c, codes=codes: ordinal(df, codes, c, None).drop(c).withColumnRenamed(f"{c}_code", c))
            else:
                seen = [r[0] for r in codes.orderBy("code").select("category").collect()]  # categories of one declared column
                out = each(lambda k, df, c=c, seen=seen: one_hot(df, c, seen).drop(c))
    if spec.regression:
        mean, std = fit_standard(out[fit_on], [spec.target]).columns[spec.target]
        out, state["target"] = each(lambda k, df: Scaling({spec.target: (mean, std)}).apply(df)), {"mean": mean, "std": std}
    return out, state


@dataclass(frozen=True)
class Modes:
    """A fitted mixture of one numeric column: (weight, mean, deviation) of each mode that is kept, and the logarithm of each mode's
    share of a value up to -(x - mean)^2 / 2 deviation^2. ``modal`` values are modes of their own, after the others."""

    column: str
    parts: tuple[tuple[float, float, float], ...]
    levels: tuple[float, ...]
    rounds: int = 0
    modal: tuple[float, ...] = ()


def _digamma(x: float) -> float:
    """The derivative of the logarithm of the gamma function: recurrence up to 6, then its asymptotic series."""
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


class _Dirichlet:
    """A truncated Dirichlet-process mixture of normal distributions: the variational parameters, updated from each mode's weight,
    sum and sum of squares. Priors: the column's mean, its variance (n - 1), one degree of freedom, one observation."""

    def __init__(self, modes: int, mean: float, variance: float, concentration: float, floor: float):
        self.k, self.mean, self.variance, self.concentration, self.floor = modes, mean, variance, concentration, floor

    def update(self, n: np.ndarray, x: np.ndarray, xx: np.ndarray) -> None:
        n = n + 10 * np.finfo(float).eps
        center = x / n
        spread = np.maximum(xx / n - center * center, 0) + self.floor
        self.a = 1 + n
        self.b = self.concentration + np.append(np.cumsum(n[::-1])[-2::-1], 0)
        self.precision, self.freedom = 1 + n, 1 + n
        self.means = (self.mean + n * center) / self.precision
        self.variances = (self.variance + n * spread + n / self.precision * (center - self.mean) ** 2) / self.freedom
        psi = lambda v: np.array([_digamma(float(i)) for i in v])
        whole = psi(self.a + self.b)
        log_weight = psi(self.a) - whole + np.append(0, np.cumsum(psi(self.b) - whole)[:-1])
        log_scale = math.log(2) + psi(self.freedom / 2) - np.log(self.freedom)
        self.levels = log_weight - 0.5 * (math.log(2 * math.pi) + np.log(self.variances)) + 0.5 * (log_scale - 1 / self.precision)

    @property
    def weights(self) -> np.ndarray:
        w = self.a / (self.a + self.b) * np.append(1, np.cumprod(self.b / (self.a + self.b))[:-1])
        return w / w.sum()

    def bound(self, entropy: float) -> float:
        """The lower bound of the evidence, up to constants."""
        gamma = lambda v: np.array([math.lgamma(float(i)) for i in v])
        log_det = -0.5 * np.log(self.variances) - 0.5 * np.log(self.freedom)
        wishart = -(self.freedom * log_det + self.freedom * 0.5 * math.log(2) + gamma(self.freedom / 2))
        beta = gamma(self.a) + gamma(self.b) - gamma(self.a + self.b)
        return float(entropy - wishart.sum() + beta.sum() - 0.5 * np.log(self.precision).sum())


def fit_modes(train: DataFrame, column: str, modes: int = 10, *, least_weight: float = 0.005, concentration: float = 0.001, most_rounds: int = 100, tolerance: float = 1e-3, modal: Sequence[float] = ()) -> Modes:
    """A Bayesian mixture of the column's values (truncated Dirichlet process, variational updates): modes that are not needed get
    hardly any weight and are left out, as are those that are the likeliest of no value.

    Values are counted once; a round is one aggregation of 3 sums a mode and the entropy over the counts, until the evidence's
    bound moves by less than ``tolerance``. The first responsibilities are those of the quantile ranges, so a fit is the same
    whatever the partitions. ``modal`` values take no part: each is a mode of its own. Missing values are left out.
    """
    x = present(F.col(column))
    held = train.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.col("x").isin(*[float(v) for v in modal]) if modal else F.col("x").isNotNull())
    counts = working(held.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n")), "values")
    one = counts.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m")).first()
    if not one.n:
        raise GateError("insufficient_support", column)
    counts = counts.withColumn("d", F.col("x") - F.lit(one.m))
    variance = (counts.agg(F.sum(F.col("n") * F.col("d") * F.col("d"))).first()[0] or 0.0) / max(one.n - 1, 1)
    cuts = sorted({float(v) for v in quantiles(held, "x", {f"q{i}": i / modes for i in range(1, modes)}).first() or [] if v is not None}) if modes > 1 else []
    fit = _Dirichlet(modes, 0.0, max(variance, 1e-12), concentration, 1e-6)
    sums = lambda r: [F.sum(F.col("n") * r * p) for p in (F.lit(1.0), F.col("d"), F.col("d") * F.col("d"))]
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("x"))) if cuts else F.lit(0)
    first = counts.withColumn("p", place).agg(*[s.alias(f"s{k}_{i}") for k in range(modes) for i, s in enumerate(sums((F.col("p") == k).cast("double")))]).first()
    fit.update(*np.array(first).astype(float).reshape(modes, 3).T)
    last, rounds = -math.inf, 0
    for rounds in range(1, most_rounds + 1):
        logs = [F.lit(float(fit.levels[k])) - F.lit(0.5 / float(fit.variances[k])) * F.pow(F.col("d") - F.lit(float(fit.means[k])), F.lit(2.0)) for k in range(modes)]
        shifted = counts.select("n", "d", *[v.alias(f"l{k}") for k, v in enumerate(logs)])
        top = F.greatest(*[F.col(f"l{k}") for k in range(modes)]) if modes > 1 else F.col("l0")
        norm = top + F.log(sum((F.exp(F.col(f"l{k}") - top) for k in range(modes)), F.lit(0.0)))
        shares = shifted.withColumn("z", norm).select("n", "d", *[F.exp(F.col(f"l{k}") - F.col("z")).alias(f"r{k}") for k in range(modes)])
        entropy = sum((F.when(F.col(f"r{k}") > 0, -F.col(f"r{k}") * F.log(F.col(f"r{k}"))).otherwise(0.0) for k in range(modes)), F.lit(0.0))
        found = shares.agg(*[s for k in range(modes) for s in sums(F.col(f"r{k}"))], F.sum(F.col("n") * entropy)).first()
        fit.update(*np.array(found[:-1]).astype(float).reshape(modes, 3).T)
        bound = fit.bound(float(found[-1]))
        if abs(bound - last) < tolerance:
            break
        last = bound
    scores = F.array(*[F.lit(float(fit.levels[k])) - F.lit(0.5 / float(fit.variances[k])) * F.pow(F.col("d") - F.lit(float(fit.means[k])), F.lit(2.0)) for k in range(modes)])
    likeliest = {int(r.k) for r in counts.select((F.array_position(scores, F.array_max(scores)) - 1).alias("k")).distinct().collect()}  # a row per mode
    kept = sorted((k for k in range(modes) if fit.weights[k] > least_weight and k in likeliest), key=lambda k: fit.means[k])
    parts = tuple((float(fit.weights[k]), float(fit.means[k] + one.m), float(fit.variances[k]) ** 0.5) for k in kept)
    return Modes(column, parts, tuple(float(fit.levels[k]) for k in kept), rounds, tuple(float(v) for v in modal))


def mode_normalised(df: DataFrame, fitted: Modes, key: str, seed: int, clip: float = 0.99) -> DataFrame:
    """The number of a mode, drawn by its share of the value (no mode's share is quite 0) from the seed and the row's key, and the
    value within it: (x - mean) / 4 deviations, clipped. A modal value has its own mode and 0 within it. Missing stays missing."""
    x, parts = present(F.col(fitted.column)), fitted.parts
    logs = F.array(*[F.lit(level) - 0.5 * F.pow((x - F.lit(m)) / F.lit(s), F.lit(2.0)) for level, (_, m, s) in zip(fitted.levels, parts)])
    odds = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    whole = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    shares = F.transform(odds, lambda v: v / whole + 1e-6)
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(fitted.column), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53) * (1 + 1e-6 * len(parts))
    reached = F.aggregate(shares, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), lambda a, b: F.struct((a["sum"] + b).alias("sum"), F.when(a["sum"] + b <= u, a["at"] + 1).otherwise(a["at"]).alias("at")))
    at = F.least(reached["at"], F.lit(len(parts) - 1))
    mean, std = F.get(F.array(*[F.lit(m) for _, m, _ in parts]), at), F.get(F.array(*[F.lit(s) for *_, s in parts]), at)
    within = F.least(F.greatest((x - mean) / (4 * std), F.lit(-clip)), F.lit(clip))
    if fitted.modal:
        own = F.array_position(F.array(*[F.lit(v) for v in fitted.modal]), x)
        at, within = F.when(own > 0, (own + len(parts) - 1).cast("int")).otherwise(at), F.when(own > 0, 0.0).otherwise(within)
    return df.withColumns({f"{fitted.column}_mode": F.when(x.isNotNull(), at), f"{fitted.column}_within": F.when(x.isNotNull(), within)})


def mode_restored(df: DataFrame, fitted: Modes) -> DataFrame:
    """The inverse of ``mode_normalised``, but for what was clipped."""
    at = F.col(f"{fitted.column}_mode")
    mean = F.get(F.array(*[F.lit(m) for _, m, _ in fitted.parts], *[F.lit(v) for v in fitted.modal]), at)
    std = F.get(F.array(*[F.lit(s) for *_, s in fitted.parts], *[F.lit(0.0) for _ in fitted.modal]), at)
    return df.withColumn(fitted.column, F.col(f"{fitted.column}_within") * 4 * std + mean)


def zipped(left: DataFrame, right: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of ``right`` in place of its own, by explicit row ids: both tables have to hold the same ids."""
    named = right.select(row_id, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(named, row_id)
    return out.select(*[F.col(f"_r_{c}").alias(c) if c in columns else F.col(c) for c in left.columns], *[F.col(f"_r_{c}").alias(c) for c in columns if c not in left.columns])


def profile_frame(df: DataFrame, profile: Profile) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in profile.names()])
