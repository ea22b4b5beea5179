"""Search for parameters by Parzen estimators over a table of trials that can be taken up again."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.contracts import GateError

TRIALS = "trial long, state string, value double, parameters string"


@dataclass(frozen=True)
class Choice:
    """A parameter: ``float`` or ``log`` (its logarithm is searched) or ``int`` between two ends, or one of ``values``."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()

    def unit(self, value: object) -> float:
        low, high, value = (math.log(x) for x in (self.low, self.high, value)) if self.kind == "log" else (self.low, self.high, value)
        if self.kind == "int":
            low, high = low - 0.5, high + 0.5
        return (value - low) / (high - low) if high > low else 0.5

    def value(self, unit: float) -> object:
        if self.kind == "log":
            return math.exp(math.log(self.low) + unit * (math.log(self.high) - math.log(self.low)))
        if self.kind == "int":
            return int(min(max(round(self.low - 0.5 + unit * (self.high - self.low + 1)), self.low), self.high))
        return self.low + unit * (self.high - self.low)


class _Parzen:
    """A density on [0, 1]: a normal kernel at each point, as wide as the wider gap to its neighbours, and a uniform part that
    counts as one point."""

    def __init__(self, points: list[float]):
        self.at = np.sort(np.array(points))
        around = np.concatenate([[0.0], self.at, [1.0]])
        gaps = np.diff(around)
        self.width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1.0 / min(100, 1 + len(points)), 1.0)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        which = rng.integers(0, len(self.at) + 1, n)
        out = rng.random(n)
        own = which < len(self.at)
        out[own] = rng.normal(self.at[which[own]], self.width[which[own]])
        return np.clip(out, 0.0, 1.0)

    def log(self, x: np.ndarray) -> np.ndarray:
        kernels = np.exp(-0.5 * ((x[:, None] - self.at) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi))
        return np.log((kernels.sum(axis=1) + 1.0) / (len(self.at) + 1))


def suggest(done: list[tuple[dict, float]], space: Mapping[str, Choice], seed: int, trial: int, *, startup: int = 10, share: float = 0.25, candidates: int = 24) -> dict:
    """The parameters of a trial, from those scored so far (greater is better), the seed and the trial's number only.

    The first ones are drawn evenly. Later each parameter by itself: of values drawn where the best ``share`` of trials lie,
    the one that is likeliest there against the rest.
    """
    rng = np.random.default_rng([seed, trial])
    if len(done) < startup:
        return {k: c.values[int(rng.integers(len(c.values)))] if c.kind == "values" else c.value(float(rng.random())) for k, c in space.items()}
    order = sorted(range(len(done)), key=lambda i: (-done[i][1], i))
    cut = max(1, math.ceil(share * len(done)))
    good, rest = ([done[i][0] for i in part] for part in (order[:cut], order[cut:]))
    out = {}
    for k, c in space.items():
        if c.kind == "values":
            odds = [np.array([1.0 + sum(p[k] == v for p in part) for v in c.values]) for part in (good, rest)]
            odds = [o / o.sum() for o in odds]
            drawn = rng.choice(len(c.values), candidates, p=odds[0])
            out[k] = c.values[int(drawn[np.argmax(np.log(odds[0][drawn]) - np.log(odds[1][drawn]))])]
        else:
            near, far = (_Parzen([c.unit(p[k]) for p in part]) for part in (good, rest))
            drawn = near.draw(rng, candidates)
            out[k] = c.value(float(drawn[np.argmax(near.log(drawn) - far.log(drawn))]))
    return out


def search(spark: SparkSession, objective: Callable[[dict], float | None], space: Mapping[str, Choice], trials: int, *, seed: int = 0, maximize: bool = True, folder: str | None = None, patience: int | None = None, startup: int = 10) -> DataFrame:
    """The table of trials: trial, state (``complete`` or ``failed``), value, parameters as JSON.

    ``objective`` runs what a trial costs, on the cluster, and gives its value; None, NaN or a refused table makes the trial
    a failed one, which later ones disregard. With a ``folder`` each trial is added to the table there as it ends, and a
    search that was stopped goes on after the last, with the same result. ``patience``: trials without a better value after
    which the search ends.
    """
    if not space or any(c.kind not in ("float", "log", "int", "values") or (c.kind == "values" and not c.values) or (c.kind != "values" and not c.low <= c.high) or (c.kind == "log" and c.low <= 0) for c in space.values()):
        raise GateError("invalid_search_space", ", ".join(space))
    rows: dict[int, tuple] = {}
    if folder:
        try:
            rows = {r.trial: tuple(r) for r in spark.read.schema(TRIALS).parquet(folder).collect()}  # a row per trial
        except AnalysisException as found:
            if "PATH_NOT_FOUND" not in (found.getCondition() or ""):
                raise
    sign = 1.0 if maximize else -1.0
    done: list[tuple[dict, float]] = []
    best = since = 0
    for trial in range(trials):
        if trial not in rows:
            point = suggest(done, space, seed, trial, startup=startup)
            try:
                value = objective(point)
            except GateError:
                value = None
            failed = value is None or not math.isfinite(value)
            rows[trial] = trial, "failed" if failed else "complete", None if failed else float(value), json.dumps(point, sort_keys=True)
            if folder:
                spark.createDataFrame([rows[trial]], TRIALS).coalesce(1).write.mode("append").parquet(folder)
        _, state, value, point = rows[trial]
        if state == "complete":
            done.append((json.loads(point), sign * value))
            since = 0 if len(done) == 1 or sign * value > best else since + 1
            best = max(best, sign * value) if len(done) > 1 else sign * value
        if patience is not None and since >= patience:
            break
    return spark.createDataFrame([rows[i] for i in sorted(rows) if i <= trial], TRIALS) if trials else spark.createDataFrame([], TRIALS)


def best_trial(trials: DataFrame, *, maximize: bool = True) -> DataFrame:
    """The row of the best complete trial, the first of those as good."""
    done = trials.where("state = 'complete'")
    return done.orderBy(F.desc("value") if maximize else F.asc("value"), "trial").limit(1)
