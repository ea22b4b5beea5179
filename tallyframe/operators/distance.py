"""Nearest-record distances, collisions and privacy filters.

Nearest rows come from the metric index: a candidate block first meets the reference blocks beside it in the order of cells,
which bounds how far its rows' nearest ones can be, and then only the blocks that can hold nearer ones. No pair of rows is a
row, no table passes the driver, and no task holds more than a few blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import metric
from tallyframe.operators.metric import BLOCK_ROWS, Points, Space
from tallyframe.operators.stats import quantiles, seeded_sample
from tallyframe.sources.working import working


def _closest(space: Space, mine: Points, theirs: Points, count: int, skip_equal_key: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the ``count`` nearest of ``theirs``, ascending, the first in order among equals; infinite if there are fewer."""
    best, rows = np.full((len(mine), count), np.inf), np.zeros((len(mine), count), dtype=np.int64)
    place = {k: i for i, k in enumerate(theirs.keys.to_pylist())} if skip_equal_key else {}
    at = 0
    for own in metric.slices(mine, len(theirs)):
        d = space.distances(own, theirs)
        if skip_equal_key:
            same = [(i, place[k]) for i, k in enumerate(own.keys.to_pylist()) if k in place]
            if same:
                d[tuple(np.array(same).T)] = np.inf
        each = np.arange(len(own))
        for k in range(min(count, d.shape[1])):
            rows[at : at + len(own), k] = nearest = d.argmin(axis=1)
            best[at : at + len(own), k] = d[each, nearest]
            d[each, nearest] = np.inf
        at += len(own)
    return best, rows


def _within(space: Space, mine: Points, theirs: Points, count: int, skip_equal_key: bool, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_closest`` up to a bound for each row, by small stretches of ``theirs``: a row meets those whose boxes come as near as its bound,
    which falls with what is found. Of rows as near, the least key comes first."""
    best, rows, kth = np.full((len(mine), count), np.inf), np.zeros((len(mine), count), dtype=np.int64), bound.copy()
    if not len(theirs) or not len(mine):
        return best, rows
    by_key = compute.sort_indices(theirs.keys).to_numpy().astype(np.int64)
    place = np.empty(len(theirs), dtype=np.int64)
    place[by_key] = np.arange(len(theirs))
    starts = np.arange(0, len(theirs), metric.SMALL)
    low, high = np.minimum.reduceat(theirs.numbers, starts), np.maximum.reduceat(theirs.numbers, starts)
    gaps = np.vstack([space.gaps(x.numbers[:, None], x.numbers[:, None], low[None], high[None]) for x in metric.slices(mine, len(starts))])
    parts = [s + np.argsort(place[s : s + metric.SMALL]) for s in starts]
    held = [theirs.at(x) for x in parts]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(k: int, who: np.ndarray) -> None:
        d, r = _closest(space, mine.at(who), held[k], count, skip_equal_key)
        kth[who] = np.minimum(kth[who], d[:, -1])
        row, at = np.nonzero(np.isfinite(d) & (d <= kth[who][:, None]))
        found.append((who[row], d[row, at], place[parts[k][r[row, at]]]))

    if np.isinf(kth).any():  # the nearest stretch first
        first = np.where(np.isinf(kth), gaps.argmin(axis=1), -1)
        for k in range(len(parts)):
            if len(who := np.flatnonzero(first == k)):
                meet(k, who)
                gaps[who, k] = np.inf
    for k in range(len(parts)):
        if len(who := np.flatnonzero((gaps[:, k] <= kth) & np.isfinite(gaps[:, k]))):
            meet(k, who)
    if found:
        who, d, at = (np.concatenate(x) for x in zip(*found))
        left = np.flatnonzero(d <= kth[who])
        left = left[np.lexsort((at[left], d[left], who[left]))]
        who, d, at = who[left], d[left], at[left]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        kept = nth < count
        best[who[kept], nth[kept]], rows[who[kept], nth[kept]] = d[kept], by_key[at[kept]]
    return best, rows


def _by_key(p: Points) -> Points:
    return p.at(compute.sort_indices(p.keys).to_numpy())


def _found(best: np.ndarray, rows: np.ndarray, keys: pa.Array) -> pa.Array:
    held = np.isfinite(best)
    values = pa.StructArray.from_arrays([pa.array(best[held]), keys.take(pa.array(rows[held]))], names=["d", "k"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held.sum(axis=1))), pa.int32()), values)


def _beside(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(x, y, z): blocks of ``mine`` with the reference blocks before and after them in the order of their cell."""
    both = mine.select("cell", "second", "near", F.col("block").alias("x"), F.lit(None).cast("long").alias("y")).unionByName(theirs.select("cell", "second", "near", F.lit(None).cast("long").alias("x"), F.col("block").alias("y")))
    within = Window.partitionBy("cell")  # a row per block
    up, down = (within.orderBy(*[f(c) for c in ("second", "near")], "x").rowsBetween(Window.unboundedPreceding, 0) for f in (F.asc, F.desc))
    return both.select("x", F.last("y", True).over(up).alias("y"), F.last("y", True).over(down).alias("z")).where("x IS NOT NULL").withColumn("z", F.when(~F.col("z").eqNullSafe(F.col("y")), F.col("z")))


def index(candidate: DataFrame, reference: DataFrame, space: Space, block: int, **reach) -> tuple[DataFrame, DataFrame, Points]:
    """Blocks of both sides, given as ``metric.features``, over the same pivots of the reference, and the pivots."""
    rows = reference.count()
    if space.boxed:
        pivots, tree = metric.choose(reference, space, metric.BOUND_PIVOTS), metric.grow(reference, space, rows, block)
        return metric.blocks(candidate, space, pivots, block, "candidate", tree=tree, **reach), metric.blocks(reference, space, pivots, block, "reference", tree=tree), pivots
    pivots = metric.choose(reference, space, min(metric.MOST_PIVOTS, max(8, int(rows**0.5) // 4)))
    return metric.blocks(candidate, space, pivots, block, "candidate", **reach), metric.blocks(reference, space, pivots, block, "reference"), pivots


def nearest(candidate: DataFrame, reference: DataFrame, key: str, numeric: list[str], categorical: list[str], *, kind: str = "l1", mismatch: float = 2.0, neighbours: int = 1, block: int = BLOCK_ROWS, reference_key: str | None = None, skip_equal_key: bool = False, report: list | None = None) -> DataFrame:
    """(key, distances, neighbours): the least distances of each candidate row, ascending, and the keys of the rows they lead to.

    ``l1``: sum of range-scaled differences plus ``mismatch`` per differing category. ``l2``: root of squared scaled
    differences plus ``mismatch`` per differing category. ``mean``: differences capped at 1, mismatches 1, divided by the
    number of columns. Ranges come from the reference arm; a column without range counts as 0 where equal, else 1. Two
    missing values (null or NaN) agree, one is a mismatch (1 for a number). Of rows as near, the least key comes first.
    ``skip_equal_key`` leaves out the row itself when a table is compared with itself. Keys are unique on either side. An
    empty reference gives empty lists. Of equal reference rows only those with the least keys enter, as many as can be
    among the nearest. ``report`` gets (pairs of blocks compared, pairs of blocks there are).
    """
    own_key, key_type = reference_key or key, candidate.schema[key].dataType.simpleString()
    space = Space(tuple(numeric), tuple(categorical), kind, mismatch, metric.ranges(reference, numeric))
    theirs = working(metric.fewest(metric.features(reference, own_key, space), space, neighbours + skip_equal_key), "reference")
    if theirs.isEmpty():
        return candidate.select(key, F.array().cast("array<double>").alias("distances"), F.array().cast(f"array<{key_type}>").alias("neighbours"))
    mine, theirs, pivots = index(metric.features(candidate, key, space), theirs, space, block)
    few, found_type = pivots.at(slice(0, metric.BOUND_PIVOTS)), f"array<struct<d:double,k:{key_type}>>"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A candidate block against the blocks beside it: what is found, and a bound for each row."""
        for batch in batches:
            for x, a, *others in zip(*(batch.column(c) for c in ("x", "mine", "before", "after"))):
                own = pickle.loads(a.as_py())
                p = metric.joined([pickle.loads(b.as_py()) for b in others if b.is_valid] or [own.at(slice(0, 0))])
                if space.boxed:
                    best, rows = _within(space, own, p, neighbours, skip_equal_key, np.full(len(own), np.inf))
                else:
                    p = _by_key(p)
                    best, rows = _closest(space, own, p, neighbours, skip_equal_key)
                found, whole = _found(best, rows, p.keys), pa.array([0, len(own)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()]), pa.array([[float(best[rows, -1].max()) for rows in metric.leaf_rows(len(own))]]), pa.array([best[:, -1].tobytes()]), pa.ListArray.from_arrays(whole, own.keys), pa.ListArray.from_arrays(whole, found)], names=["x", "most", "bounds", "keys", "found"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A candidate block's rows that a further block may hold nearer rows of, against that block."""
        for batch in batches:
            for a, u, lo, hi, b in zip(*(batch.column(c) for c in ("mine", "bounds", "lo", "hi", "theirs"))):
                own, bound = pickle.loads(a.as_py()), np.frombuffer(u.as_py())
                if space.boxed:
                    p = pickle.loads(b.as_py())
                    left = np.flatnonzero(space.gaps(own.numbers, own.numbers, p.numbers.min(axis=0), p.numbers.max(axis=0)) <= bound)
                    own, bound = own.at(left), bound[left]
                d = space.distances(own, few, 2.0)
                left = np.flatnonzero(metric.apart(d, d, np.array(lo.as_py()), np.array(hi.as_py())) <= bound)
                if not len(left):
                    continue
                own, bound = own.at(left), bound[left]
                if space.boxed:
                    best, rows = _within(space, own, p, neighbours, skip_equal_key, bound)
                else:
                    p = _by_key(pickle.loads(b.as_py()))
                    best, rows = _closest(space, own, p, neighbours, skip_equal_key)
                    best[best > bound[:, None]] = np.inf
                near = np.flatnonzero(np.isfinite(best[:, 0]))
                yield pa.RecordBatch.from_arrays([own.keys.take(pa.array(near)), _found(best[near], rows[near], p.keys)], names=["key", "found"])

    payload = lambda df, c, name: df.select(F.col("block").alias(c), F.col("payload").alias(name))
    # pairs of blocks are small rows with much work: without a told number the engine would put them into a few tasks
    tasks = max(int(candidate.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * candidate.sparkSession.sparkContext.defaultParallelism)
    tasks = min(tasks, max(mine.count(), theirs.count()))
    beside = working(_beside(mine, theirs), "beside")
    loaded = beside.repartition(tasks, "x").join(payload(mine, "x", "mine").repartition(tasks, "x"), "x").join(payload(theirs, "y", "before"), "y", "left").join(payload(theirs, "z", "after"), "z", "left")
    first = working(loaded.select("x", "mine", "before", "after").mapInArrow(begin, f"x long, most array<double>, bounds binary, keys array<{key_type}>, found array<{found_type}>"), "first")
    leaf = F.transform(F.arrays_zip("leaves", "most"), lambda x: F.struct(*[x["leaves"][k].alias(k) for k in ("lo", "hi", "a", "b")], x["most"].alias("u")))
    bounded = mine.join(first.select(F.col("x").alias("block"), "most"), "block").withColumn("leaves", leaf)
    done = beside.select("x", F.explode(F.array("y", "z")).alias("y")).where("y IS NOT NULL")
    pairs = metric.near_pairs(bounded, theirs, space).join(done, ["x", "y"], "left_anti")
    if report is not None:
        pairs = working(pairs, "pairs")
        report.append((pairs.count() + done.count(), mine.count() * theirs.count()))
    more = pairs.repartition(tasks, "x").join(payload(mine, "x", "mine").join(first.select("x", "bounds"), "x").repartition(tasks, "x"), "x")
    more = more.repartition(tasks, "y").join(theirs.select(F.col("block").alias("y"), "lo", "hi", F.col("payload").alias("theirs")).repartition(tasks, "y"), "y")
    rest = more.select("mine", "bounds", "lo", "hi", "theirs").mapInArrow(go_on, f"key {key_type}, found {found_type}")
    met = first.select(F.inline(F.arrays_zip("keys", "found"))).withColumnRenamed("keys", "key")
    merged = met.unionByName(rest).groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, neighbours).alias("found"))
    return merged.select(F.col("key").alias(key), F.transform("found", lambda x: x["d"]).alias("distances"), F.transform("found", lambda x: x["k"]).alias("neighbours"))


def least(column: str = "distances") -> Column:
    return F.get(F.col(column), F.lit(0))


def dcr(candidate: DataFrame, train: DataFrame, test: DataFrame, key: str, numeric: list[str], categorical: list[str], **options) -> DataFrame:
    """(key, dcr_train, dcr_test)."""
    a = nearest(candidate, train, key, numeric, categorical, **options).select(key, least().alias("dcr_train"))
    return a.join(nearest(candidate, test, key, numeric, categorical, **options).select(key, least().alias("dcr_test")), key)


def fifth_percentiles(found: DataFrame) -> DataFrame:
    """(dcr, nndr): the fifth percentiles of the least distance and of its ratio to the second (``nearest`` with two neighbours); a
    ratio of 0 to 0 counts as missing."""
    first, second = F.get("distances", F.lit(0)), F.get("distances", F.lit(1))
    held = working(found.select(first.alias("a"), F.try_divide(first, second).alias("b")), "two-nearest")
    return quantiles(held, "a", {"dcr": 0.05}).join(quantiles(held, "b", {"nndr": 0.05}))  # single rows


def dcr_share(scored: DataFrame) -> DataFrame:
    """(share, n): of candidate rows nearer to the train arm than to the test arm."""
    return scored.agg(F.avg(F.when(F.col("dcr_train") < F.col("dcr_test"), 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))


def collisions(candidate: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(n_candidate, n_equal, share_equal, distinct_matched, most_copies, internal_duplicates): exact row matches, nulls equal."""
    keyed = lambda df, name: df.groupBy(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row")).agg(F.count(F.lit(1)).alias(name))
    both = keyed(candidate, "s").join(keyed(train, "r"), "row", "left")
    hit = F.col("r").isNotNull()
    return both.agg(F.sum("s").alias("n_candidate"), F.coalesce(F.sum(F.when(hit, F.col("s"))), F.lit(0)).alias("n_equal"), F.try_divide(F.coalesce(F.sum(F.when(hit, F.col("s"))), F.lit(0)).cast("double"), F.sum("s").cast("double")).alias("share_equal"), F.count_if(hit).alias("distinct_matched"), F.max(F.when(hit, F.col("s"))).alias("most_copies"), F.sum(F.col("s") - 1).alias("internal_duplicates"))


def drop_too_close(scored: DataFrame, distance: str, quantile: float) -> DataFrame:
    """Rows at or beyond the quantile of distances."""
    bound = quantiles(scored, distance, {"_least": quantile})  # one row
    return scored.join(F.broadcast(bound)).where(F.col(distance) >= F.col("_least")).drop("_least")


def resample(rounds: list[DataFrame], distance: str, key: str, quantile: float, rows: int) -> DataFrame:
    """Rows far enough from the train arm, topped up from further rounds by the first round's bound, cut to ``rows`` in the order of rounds and keys."""
    bound = quantiles(rounds[0], distance, {"_least": quantile})
    kept = None
    for i, scored in enumerate(rounds):
        here = scored.join(F.broadcast(bound)).where(F.col(distance) >= F.col("_least")).drop("_least").withColumn("round", F.lit(i))
        kept = here if kept is None else kept.unionByName(here)
        if kept.count() >= rows:
            break
    return kept.orderBy("round", key).limit(rows)


def privacy_curve(scored: DataFrame, distance: str, shares: list[float]) -> DataFrame:
    """(quantile, n_kept, median_distance) of what is left when the rows below each quantile of distances are dropped."""
    scored = working(scored.select(distance), "distances")  # made once, read for the levels and once for each share
    levels = quantiles(scored, distance, {f"q{i}": s for i, s in enumerate(shares)})
    long = levels.select(F.explode(F.array(*[F.struct(F.lit(s).alias("quantile"), F.col(f"q{i}").alias("least")) for i, s in enumerate(shares)])).alias("x")).select("x.*")
    kept = scored.join(F.broadcast(long), F.col(distance) >= F.col("least")).select("quantile", distance)  # a row per share
    middle = quantiles(kept, distance, {"median_distance": 0.5}, ["quantile"])
    return kept.groupBy("quantile").agg(F.count(F.lit(1)).alias("n_kept")).join(middle, "quantile")


def authenticity(synthetic: DataFrame, real: DataFrame, key: str, numeric: list[str], categorical: list[str], **options) -> DataFrame:
    """(key, d_real, d_other, authentic): a row is authentic if its nearest real row has another real row nearer to it."""
    own = nearest(synthetic, real, key, numeric, categorical, **options).select(key, least().alias("d_real"), F.get("neighbours", F.lit(0)).alias("_r"))
    among = nearest(real, real, key, numeric, categorical, skip_equal_key=True, **options).select(F.col(key).alias("_r"), least().alias("d_other"))
    return own.join(among, "_r").select(key, "d_real", "d_other", (F.col("d_real") > F.col("d_other")).alias("authentic"))


def ball_counts(points: DataFrame, centres: DataFrame, space: Space, *, block: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """(side, key, n): for each row of ``centres`` how many ``points`` lie in its ball (side ``centre``), for each of ``points`` in
    how many balls it lies (side ``point``); rows with none are left out.

    Both are ``metric.features`` with a ``weight`` each row counts for; ``centres`` have a ``radius``, whose power of two is
    part of their order, so that one wide ball widens no other's search. Counts are summed in tasks: no pair is a row.
    """
    mine, theirs, pivots = index(centres, points, space, block, reach="radius")
    few, key_type = pivots.at(slice(0, metric.BOUND_PIVOTS)), points.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, lo, hi, b in zip(*(batch.column(c) for c in ("mine", "lo", "hi", "theirs"))):
                own, p = pickle.loads(a.as_py()), pickle.loads(b.as_py())
                d = space.distances(own, few, 2.0)
                own = own.at(np.flatnonzero(metric.apart(d, d, np.array(lo.as_py()), np.array(hi.as_py())) <= own.extra))
                held = np.zeros(len(p), dtype=np.int64)
                for part in metric.slices(own, len(p)):
                    inside = space.distances(part, p) <= part.extra[:, None]
                    told = inside @ p.weight
                    held += part.weight @ inside
                    near = np.flatnonzero(told)
                    yield pa.RecordBatch.from_arrays([pa.array(["centre"] * len(near), pa.string()), part.keys.take(pa.array(near)), pa.array(told[near])], names=["side", "key", "n"])
                near = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(["point"] * len(near), pa.string()), p.keys.take(pa.array(near)), pa.array(held[near])], names=["side", "key", "n"])

    pairs = metric.near_pairs(mine, theirs, space)
    if report is not None:
        pairs = working(pairs, "ball-pairs")
        report.append((pairs.count(), mine.count() * theirs.count()))
    loaded = pairs.join(mine.select(F.col("block").alias("x"), F.col("payload").alias("mine")), "x").join(theirs.select(F.col("block").alias("y"), "lo", "hi", F.col("payload").alias("theirs")), "y")
    return loaded.select("mine", "lo", "hi", "theirs").mapInArrow(count, f"side string, key {key_type}, n long").groupBy("side", "key").agg(F.sum("n").alias("n"))


def _weighed(df: DataFrame, key: str, space: Space, *more: str) -> DataFrame:
    """Equal rows as one with their number: the least key, the features and what else equal rows share."""
    plain = metric.features(df, key, space, *[F.col(c) for c in more])
    by = [c for c in plain.columns if c != "key"]
    return working(plain.groupBy(*by).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")), "weighed")


def _balls(points: DataFrame, centres: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int, block: int, report: list | None) -> DataFrame:
    """(points, points_in, centres, centres_met, pairs): one row of the balls around ``centres`` that reach to the ``k``-th neighbour there."""
    options = {"kind": "l2", "mismatch": 1.0, "block": block}
    radius = nearest(centres, centres, key, numeric, categorical, neighbours=k, skip_equal_key=True, **options).select(F.col(key).alias("_c"), F.get("distances", F.lit(k - 1)).alias("radius"))
    space = Space(tuple(numeric), tuple(categorical), "l2", 1.0, metric.ranges(centres, numeric))
    told, own = _weighed(points, key, space), _weighed(centres.join(radius, F.col(key) == F.col("_c")).where("radius IS NOT NULL"), key, space, "radius")
    if told.isEmpty() or own.isEmpty():
        counts = points.sparkSession.createDataFrame([], f"side string, key {points.schema[key].dataType.simpleString()}, n long")
    else:
        counts = working(ball_counts(told, own, space, block=block, report=report), "balls")
    met = lambda df, side: df.join(counts.where(F.col("side") == side), "key").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("met"), F.coalesce(F.sum(F.col("weight") * F.col("n")), F.lit(0)).alias("pairs"))
    a, b = met(told, "point").select(F.col("met").alias("points_in"), "pairs"), met(own, "centre").select(F.col("met").alias("centres_met"))
    return a.join(b).join(points.agg(F.count(F.lit(1)).alias("points"))).join(centres.agg(F.count(F.lit(1)).alias("centres")))  # single rows


def prdc(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], categorical: list[str] = (), *, k: int = 5, block: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """(precision, recall, density, coverage) by the balls around each row that reach to its ``k``-th neighbour in its own arm.

    Distances are scaled by the ranges of the arm that the balls are around. An arm of ``k`` rows or fewer has no balls.
    Empty arms give null.
    """
    fore = _balls(synthetic, real, key, numeric, list(categorical), k, block, report)
    back = _balls(real, synthetic, key, numeric, list(categorical), k, block, report).select(F.col("points_in").alias("back"))
    div = lambda x, y: F.try_divide(F.col(x).cast("double"), y.cast("double"))
    return fore.join(back).select(div("points_in", F.col("points")).alias("precision"), div("back", F.col("centres")).alias("recall"), div("pairs", F.col("points") * F.lit(k)).alias("density"), div("centres_met", F.col("centres")).alias("coverage"))


def diversity(real: DataFrame, fakes: list[DataFrame], key: str, numeric: list[str], categorical: list[str] = (), *, k: int = 5, rows: int = 50_000, seed: int = 0) -> DataFrame:
    """(metric, mean, std): precision, recall, density and coverage over several candidate tables, the deviation with n - 1.

    Arms of ``rows`` rows or more are sampled down to ``rows`` by seeded hashes of their keys, which is the protocol.
    """
    arm = lambda df: seeded_sample(df, key, rows, seed)
    names = ("precision", "recall", "density", "coverage")
    scored = None
    for fake in fakes:
        one = prdc(arm(real), arm(fake), key, numeric, categorical, k=k)
        scored = one if scored is None else scored.unionByName(one)
    made = [F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in names]
    return scored.agg(F.array(*made).alias("x")).select(F.inline("x"))
