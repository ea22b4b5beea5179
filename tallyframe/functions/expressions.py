"""Column expressions with the semantics the evaluation needs, all built in."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# Texts that are numbers. The engine's own cast takes more, such as "1d" and " 2f ".
NUMBER_TEXT = r"(?i)\A\s*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*\z"


def number(c: Column, kind: str = "double") -> Column:
    """The number a value or its text stands for; null if it stands for none."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast(kind))


def present(c: Column) -> Column:
    """A double whose NaN is missing."""
    return F.nanvl(c.cast("double"), F.lit(None))


def finite(c: Column) -> Column:
    """Null passes; infinities and NaN fail."""
    d = c.cast("double")
    return c.isNull() | (~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))))


def integral(c: Column) -> Column:
    """Null passes; whole numbers within 64 bits pass."""
    d = c.cast("double")
    return c.isNull() | ((d == F.floor(d)) & (d >= -(2.0**63)) & (d < 2.0**63))


def python_fullmatch(c: Column, pattern: str) -> Column:
    """The whole string matches, a final line break included."""
    re.compile(pattern)
    return c.rlike(rf"\A(?:{pattern})\z")


def is_close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def canonical_boolean(c: Column) -> Column:
    """Only the eight accepted spellings; anything else is null."""
    text = c.cast("string")
    return F.when(text.isin("True", "true", "1"), True).when(text.isin("False", "false", "0"), False)


def marker_to_null(c: Column, markers: tuple[str, ...] = ("?", " ?", "", " ")) -> Column:
    return F.when(~c.isin(*markers), c)


@F.pandas_udf(StringType())
def _nfc(c: pd.Series) -> pd.Series:
    return c.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """The composed Unicode form, for which there is no built-in function; used on distinct values only."""
    return _nfc(c)


def epoch_nanos(c: Column) -> Column:
    """Nanoseconds since 1970 of a date, a timestamp or its text; null if that is none."""
    return F.unix_micros(F.try_to_timestamp(c.cast("string"))) * 1000


def utc_text(c: Column) -> Column:
    """A timestamp as UTC text with seconds."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sentence(columns: list[str]) -> Column:
    """A row as the sentence "a is 1, b is x"; missing values are left out.

    A comma or backslash in a value has a backslash before it, so that a value is never taken for another column.
    """
    safe = lambda c: F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\\,]", r"\\$0")
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c} is "), safe(c)) for c in columns])


def from_sentence(c: Column, columns: list[str]) -> list[Column]:
    """The columns told in a sentence, as text; the first telling of a column counts, others are null."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(?:\A|, )((?:[^\\,]|\\.|,(?! ))+)"), 1)
    told = lambda name: F.get(F.filter(parts, lambda x: x.startswith(f"{name} is ")), F.lit(0))
    value = lambda name: F.substring(told(name), F.lit(len(name) + 5), F.length(told(name)))
    return [F.regexp_replace(value(name), r"(?s)\\(.)", "$1").alias(name) for name in columns]


def nested(c: Column, *path: str) -> Column:
    """A field of a JSON text by its path; null if it is not there or not JSON."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's fields, apart by a unit separator; a missing field is empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]), 256)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def log_with_bound(c: Column, low: float) -> Column:
    """Natural logarithm made safe by the fitted lower bound."""
    return F.ln(c) if low > 0 else F.ln(c + 1) if low == 0 else F.ln(c - F.lit(low) + 1)


def exp_with_bound(c: Column, low: float) -> Column:
    """The inverse of ``log_with_bound``."""
    return F.exp(c) if low > 0 else F.exp(c) - 1 if low == 0 else F.exp(c) - 1 + F.lit(low)


def ratio(a: Column, b: Column) -> Column:
    """Null instead of an error where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# Acklam's rational approximation of the normal quantile function.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _poly(values: list[float], x: Column) -> Column:
    out = F.lit(values[0])
    for v in values[1:]:
        out = out * x + F.lit(v)
    return out


def normal_quantile(p: Column) -> Column:
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    return F.when(p < 0.02425, _poly(_C, low) / _poly(_D, low)).when(p > 1 - 0.02425, -_poly(_C, high) / _poly(_D, high)).otherwise(_poly(_A, r) * q / _poly(_B, r))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of an array, for use in tasks."""
    tail, q = np.sqrt(-2 * np.log(np.minimum(p, 1 - p))), p - 0.5
    ends, middle = np.polyval(_C, tail) / np.polyval(_D, tail), np.polyval(_A, q * q) * q / np.polyval(_B, q * q)
    return np.where(p < 0.02425, ends, np.where(p > 1 - 0.02425, -ends, middle))
