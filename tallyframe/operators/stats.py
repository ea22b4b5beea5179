"""Exact ranks, quantiles and running sums without a window over a whole column.

Values are counted first. Approximate split points then cut each key's values into buckets of like size; totals of the
buckets are summed up in a small table, and windows run inside one bucket only. The split points steer the work, not the
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.working import working

COARSE = 16


def _buckets(df: DataFrame) -> int:
    """As many buckets as a key's values need to keep the session's tasks busy."""
    return min(256, max(COARSE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def _bucket(cuts: Column, value: Column, buckets: int) -> Column:
    """How many cuts lie below the value; many are searched in two steps."""
    below = lambda part: F.size(F.filter(part, lambda x: x < value))
    if buckets <= 2 * COARSE:
        return below(cuts)
    coarse = below(F.transform(F.sequence(F.lit(1), F.floor(F.size(cuts) / COARSE).cast("int")), lambda i: F.element_at(cuts, i * COARSE)))
    coarse = F.when(F.size(cuts) < COARSE, 0).otherwise(coarse)
    return coarse * COARSE + below(F.slice(cuts, coarse * COARSE + 1, F.lit(COARSE)))


def running_sums(counts: DataFrame, keys: list[str], value: str, sums: list[str], *, descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``counts`` (a row per key and value) with ``upto_<s>``, the sum of s up to and with the row, and ``all_<s>``.

    Nulls of ``value`` are not allowed; keys may be null.
    """
    by, buckets = [F.col(k) for k in keys], buckets or _buckets(counts)
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000))).alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    renamed = lambda df: df.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    held = counts.join(renamed(cuts), same) if keys else counts.join(F.broadcast(cuts))  # one row
    held = held.withColumn("_bucket", _bucket(F.col("_cuts"), F.col(value), buckets)).drop("_cuts", *[f"_k_{k}" for k in keys])
    totals = held.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    small = Window.partitionBy(*by) if keys else Window.partitionBy(F.lit(1))  # at most ``buckets`` rows of a key
    before = small.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(f"_t_{s}").over(small).alias(f"all_{s}") for s in sums])
    joined = held.join(totals.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_bucket": "_k_bucket"}), [*same, F.col("_bucket") == F.col("_k_bucket")])
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({f"upto_{s}": F.col(f"_b_{s}") + F.sum(s).over(inside) for s in sums})
    return out.drop("_bucket", "_k_bucket", *[f"_k_{k}" for k in keys], *[f"_b_{s}" for s in sums])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = (), *, rule: str = "linear") -> DataFrame:
    """(by..., a column per share): exact quantiles of the present values, null for a key without any.

    ``linear`` interpolates between the two neighbours; ``averaged`` is the inverse of the empirical distribution, averaged
    where it jumps.
    """
    keys = list(by)
    held = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where("_v IS NOT NULL")
    placed = running_sums(held.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n")), keys, "_v", ["n"])
    first, last, n = F.col("upto_n") - F.col("n"), F.col("upto_n") - 1, F.col("all_n")
    made = []
    for name, share in shares.items():
        if rule == "linear":
            at = (n - 1) * F.lit(share)
            low, high, part = F.floor(at), F.ceil(at), at - F.floor(at)
        else:
            at = n * F.lit(share)
            whole = F.floor(at) == at
            low = F.greatest(F.ceil(at) - 1, F.lit(0))
            high, part = F.when(whole, F.least(low + 1, n - 1)).otherwise(low), F.when(whole & (at > 0), 0.5).otherwise(0.0)
        pick = lambda i: F.max(F.when((first <= i) & (i <= last), F.col("_v")))
        made += [pick(low).alias(f"_l_{name}"), pick(high).alias(f"_h_{name}"), F.max(part).alias(f"_p_{name}")]
    out = placed.groupBy(*keys).agg(*made) if keys else placed.agg(*made)
    return out.select(*keys, *[(F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * F.col(f"_p_{k}")).alias(k) for k in shares])


def at_places(df: DataFrame, value: str, wanted: Callable[[int], list[int]], pieces: int = 256) -> list[float]:
    """The present values at the places that ``wanted`` asks of their number, from 0 in the order of values.

    Approximate split points cut the values into pieces, which are counted; only those that hold a wanted place are sorted. The
    table is not shuffled.
    """
    held = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    one = held.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 1000).alias("cuts")).first()
    places = wanted(one.n) if one.n else []
    if not places:
        return []
    cuts = np.unique(one.cuts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.searchsorted(cuts, batch.column("v").to_numpy()), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["piece", "n"])

    sizes = dict(held.mapInArrow(count, "piece int, n long").groupBy("piece").agg(F.sum("n")).collect())  # a small row per piece
    upto = np.cumsum([sizes[k] for k in range(len(cuts) + 1)])
    within = np.searchsorted(upto, places, side="right")
    open_pieces = np.unique(within)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").to_numpy()
            piece = np.searchsorted(cuts, v)
            there = np.isin(piece, open_pieces)
            yield pa.RecordBatch.from_arrays([pa.array(piece[there], pa.int32()), pa.array(v[there])], names=["piece", "v"])

    counts = held.mapInArrow(keep, "piece int, v double").groupBy("piece", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("last", F.sum("n").over(Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    met = F.lit(False)
    for piece in open_pieces:
        inside = [int(k - (upto[piece - 1] if piece else 0)) for k, x in zip(places, within) if x == piece]
        met = met | ((F.col("piece") == int(piece)) & F.exists(F.array(*[F.lit(x) for x in inside]), lambda x: (x <= F.col("last")) & (x > F.col("last") - F.col("n"))))
    found = [(x.piece, x.last, x.v) for x in counts.where(met).collect()]  # a row per wanted place at most
    return [min((last, v) for p, last, v in found if p == piece and last >= k - (upto[piece - 1] if piece else 0))[1] for k, piece in zip(places, within)]


def ranked(counts: DataFrame, order: list[Column | str], *, name: str = "rank") -> DataFrame:
    """A small table (one row per category) numbered from 0 in ``order``. Its size is that of the categories, not of the rows."""
    return counts.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows with the least hash of seed and key: the same on every run, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(rows)


def head(df: DataFrame, order: list[Column | str], rows: int) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(rows)


def by_value(df: DataFrame, counts: DataFrame, columns: list[str], size: str, share: int = 1000) -> DataFrame:
    """``df`` joined to what ``counts`` says of its values (columns ``_k_<column>``, nulls equal), whatever value is frequent.

    ``size`` is how many rows hold a value. Values of more than one in ``share`` rows, fewer than ``share`` of them, are
    broadcast, so their rows stay where they are; rows of other values are shuffled. Rows without a match get nulls.
    """
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns]
    counts = working(counts, "counts")
    one = counts.agg(F.sum(size).alias("n"), F.max(size).alias("most")).first()
    total = one.n or 0
    if (one.most or 0) * share <= total:  # no frequent value: one join for all
        return df.join(counts, same, "left").drop(*[f"_k_{c}" for c in columns])
    hot, cold = counts.where(F.col(size) * share > total), counts.where(F.col(size) * share <= total)
    found = df.join(F.broadcast(hot), same).unionByName(df.join(F.broadcast(hot), same, "left_anti").join(cold, same, "left"))
    return found.drop(*[f"_k_{c}" for c in columns])


def duplicated(df: DataFrame, columns: list[str], name: str = "duplicated") -> DataFrame:
    """``df`` with a flag of the rows whose ``columns`` occur in another row as well, nulls equal."""
    sizes = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in columns]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return by_value(df, sizes, columns, "_n").withColumn(name, F.col("_n").isNotNull()).drop("_n")


def places(df: DataFrame, group: list[str], value: Column, tie: list[str], name: str = "_place") -> DataFrame:
    """``df`` with each row's exact place in its group, from 0 in the order of ``value`` (never null) and then a hash of ``tie``,
    and the group's size as ``<name>_of``.

    Values are counted and summed up in buckets; rows of equal value are told apart by 64-bit hashes, summed up alike, so
    neither a large group nor a frequent value is ever sorted in one task. Rows that agree in ``tie`` follow one another.
    """
    held = df.withColumns({"_v": value, "_h": F.xxhash64(*tie)})
    counts = held.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    at = running_sums(counts, group, "_v", ["_n"]).withColumnsRenamed({c: f"_k_{c}" for c in (*group, "_v")} | {"all__n": f"{name}_of"})
    met = by_value(held, at.withColumn("_start", F.col("upto__n") - F.col("_n")).drop("upto__n"), [*group, "_v"], "_n")
    alone, tied = met.where("_n = 1"), met.where("_n > 1")
    inner = running_sums(tied.groupBy(*group, "_v", "_h").agg(F.count(F.lit(1)).alias("_m")), [*group, "_v"], "_h", ["_m"])
    inner = inner.select(*[F.col(c).alias(f"_k_{c}") for c in (*group, "_v", "_h")], (F.col("upto__m") - F.col("_m")).alias("_in"), F.col("_m"))
    again = Window.partitionBy(*group, "_v", "_h").orderBy(*tie)  # rows that are equal in all of ``tie``
    tied = by_value(tied, inner, [*group, "_v", "_h"], "_m").withColumn("_in", F.col("_in") + F.row_number().over(again) - 1).drop("_m")
    both = alone.withColumn("_in", F.lit(0).cast("long")).unionByName(tied)
    return both.withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_h", "_n", "_start", "_in")


def value_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v, start, stop, n, rows): of each value of column c (a number, none missing) the places that its ``n`` rows take from
    ``start`` on among all rows, in the order of values.

    Values are counted, then sorted by range; sums run within a partition, and those of the partitions before are added.
    """
    counts = df.select(F.posexplode(F.array(*columns)).alias("c", "v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, n = batch.column("c").to_numpy(), batch.column("n").to_numpy()
            begins = np.append(0, np.flatnonzero(np.diff(c)) + 1)
            start = np.cumsum(n) - n
            start -= np.repeat(start[begins], np.diff(np.append(begins, len(c))))
            if c[0] == last:
                start[c == last] += before
            last, before = c[-1], start[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start), pa.array(np.full(len(c), part, np.int32))], names=["c", "v", "n", "start", "part"])

    placed = working(counts.repartitionByRange("c", "v").sortWithinPartitions("c", "v").mapInArrow(upto, "c int, v double, n long, start long, part int"), "places")
    within = Window.partitionBy("c")  # a row per partition
    totals = placed.groupBy("c", "part").agg(F.sum("n").alias("_n"))
    totals = working(totals.select("c", "part", F.coalesce(F.sum("_n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(within).alias("rows")), "totals")
    return placed.join(F.broadcast(totals), ["c", "part"]).select("c", "v", (F.col("start") + F.col("_before")).alias("start"), (F.col("start") + F.col("_before") + F.col("n")).alias("stop"), "n", "rows")


def average_ranks(df: DataFrame, key: str, columns: list[str], placed: DataFrame) -> DataFrame:
    """``df`` with r0.., the ranks of its columns' values by ``value_places``, ties by average ranks.

    Frequent values' ranks are broadcast. Where a column has others too, rows of frequent ones are dealt by ``key``, so none
    meet in one task.
    """
    frequent = F.col("n") * 1000 > F.col("rows")
    found = {x.c: x for x in placed.groupBy("c").agg(F.count_if(frequent).alias("hot"), F.count_if(~frequent).alias("cold")).collect()}
    for i, c in enumerate(columns):
        if i not in found:
            df = df.withColumn(f"r{i}", F.lit(None).cast("double"))
            continue
        of = placed.where(F.col("c") == i)
        hot, cold = (of.where(x).select(F.col("v").alias(f"_k{k}"), ((F.col("start") + F.col("stop") + 1) / 2).alias(f"_r{k}")) for k, x in enumerate((frequent, ~frequent)))
        met = []
        if found[i].hot:
            df, met = df.join(F.broadcast(hot), F.col(c) == F.col("_k0"), "left").drop("_k0"), ["_r0"]
        if found[i].cold:
            same = F.col(c) == F.col("_k1")
            if met:  # the rows that have a rank already
                df = df.withColumn("_deal", F.when(F.col("_r0").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(1 << 20)).cast("int")))
                cold, same = cold.withColumn("_cold", F.lit(0)), (F.when(F.col("_deal") == 0, F.col(c)).otherwise(0.0) == F.col("_k1")) & (F.col("_deal") == F.col("_cold"))
            df, met = df.join(cold, same, "left").drop("_k1", "_deal", "_cold"), [*met, "_r1"]
        df = df.withColumn(f"r{i}", F.coalesce(*met)).drop("_r0", "_r1")
    return df


def co_moments(df: DataFrame, columns: list[str], by: str | None = None, about: float | None = None) -> DataFrame:
    """(by, i, j, n, x, y, xx, yy, xy): over the rows where columns i and j (i < j) are both present, their number, sums, sums of
    squares and of products, relative to the columns' overall means, or to ``about``, which saves a pass where they are known.

    Each task sums whole matrices of its rows; the sums of tasks are added by pair. So the plan does not grow with the pairs.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    means = [about] * len(columns) if about is not None else df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    plain = df.select((F.col(by).cast("string") if by else F.lit("")).alias("by"), *[(value(c) - F.lit(float(means[i] or 0.0))).alias(f"v{i}") for i, c in enumerate(columns)])
    i, j = np.triu_indices(len(columns), 1)
    names = ("n", "x", "y", "xx", "yy", "xy")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(f"v{k}").to_numpy(zero_copy_only=False) for k in range(len(columns))]).astype(float)
            group = batch.column("by").dictionary_encode(null_encoding="encode")
            for at, name in enumerate(group.dictionary.to_pylist()):
                v = values[group.indices.to_numpy() == at]
                there = (~np.isnan(v)).astype(float)
                v = np.where(there > 0, v, 0.0)
                x, xx = v.T @ there, (v * v).T @ there
                held[name] = held.get(name, 0) + np.stack([m[i, j] for m in (there.T @ there, x, x.T, xx, xx.T, v.T @ v)])
        for name, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, sums)], names=["by", "i", "j", *names])

    parts = plain.mapInArrow(task, "by string, i int, j int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("by", "i", "j").agg(*[F.sum(c).alias(c) for c in names])


def rho() -> Column:
    """The correlation of a row of ``co_moments``; null where a column is constant."""
    n, x, y, xx, yy, xy = (F.col(k) for k in ("n", "x", "y", "xx", "yy", "xy"))
    vx, vy = n * xx - x * x, n * yy - y * y
    flat = (vx <= n * xx * 1e-13) | (vy <= n * yy * 1e-13)
    return F.when(~flat, F.try_divide(n * xy - x * y, F.sqrt(vx) * F.sqrt(vy)))


def top_per_group(df: DataFrame, group: str, order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= rows).drop("_place")
