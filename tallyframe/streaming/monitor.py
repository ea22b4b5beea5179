"""A validity monitor over a stream (an addition of this engine): rule pass rates per event-time window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.rules import column_rule


def windowed_validity(events: DataFrame, time: str, column_rules: Mapping[str, list[Mapping]], *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, pass_rate per column): one aggregation per window; rows later than ``late`` are left out. ``unique`` is not offered."""
    rates = []
    for name, rules in column_rules.items():
        verdict = F.lit(True)
        for rule in rules:
            verdict = verdict & column_rule(name, rule)
        rates.append(F.avg(verdict.cast("double")).alias(f"{name}_pass_rate"))
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *rates).select(F.col("w.start").alias("start"), "n", *[f"{c}_pass_rate" for c in column_rules])
