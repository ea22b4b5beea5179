"""Statistical generators: every one gives the asked number of rows, no missing values and known categories only."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.contracts import GateError
from tallyframe.functions.expressions import normal_quantiles
from tallyframe.operators.distance import nearest
from tallyframe.operators.preprocess import category_codes, fit_quantile_bins, quantile_bins, quantile_bins_inverse
from tallyframe.operators.stats import at_places, average_ranks, co_moments, places, rho, running_sums, value_places
from tallyframe.sources.working import working


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only, so a retried task repeats it."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The same rows in a seeded order: the surrogate under which every fidelity score is 1."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def cumulative(df: DataFrame, column: str, given: list[str], prior: float = 0.0) -> DataFrame:
    """(given..., column, low, high): each value's stretch of [0, 1) under its conditional frequency.

    With a ``prior``, that weight is shared by all combinations of the parents' and the column's seen values (BDeu), so that
    a combination of parents that never occurs gets even chances; without one it has no rows. Sums run over the categories
    of one combination.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*given, column).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if prior:
        grid = df.where(F.col(column).isNotNull()).select(column).distinct()
        cells = df.select(column).where(F.col(column).isNotNull()).distinct().count()
        for g in given:
            seen = df.where(F.col(g).isNotNull()).select(g).distinct()
            cells *= seen.count()
            grid = grid.join(seen)  # categories of declared columns: the table of a node, not of rows
        counts = grid.join(counts, [*given, column], "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)) + F.lit(prior / max(1, cells)))
    part = Window.partitionBy(*given) if given else Window.partitionBy(F.lit(1))
    upto = part.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(part), "_last": F.row_number().over(part.orderBy(F.desc(column))) == 1})
    high = F.when(F.col("_last"), F.lit(1.0)).otherwise(F.col("_upto") / F.col("_all"))
    return out.select(*given, column, ((F.col("_upto") - F.col("_n")) / F.col("_all")).alias("low"), high.alias("high"))


def network_sample(df: DataFrame, parents: dict[str, list[str]], rows: int, seed: int, prior: float = 0.0) -> DataFrame:
    """Forward sampling of a Bayesian network with the given structure: exactly ``rows`` rows, one join per column in topological order.

    A drawn combination of parents that has no rows in the table falls back to the column's own frequencies.
    """
    out = df.sparkSession.range(rows).withColumnRenamed("id", "row_id")
    done: list[str] = []
    while len(done) < len(parents):
        ready = [c for c in parents if c not in done and set(parents[c]) <= set(done)]
        if not ready:
            raise ValueError("the structure has a cycle")
        for c in ready:
            draws = out.withColumn("_u", uniform(seed, F.lit(c), F.col("row_id")))
            pick = lambda name, table, by: table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("high", F.col(c).alias("v")))).alias(name))
            chosen = lambda name: F.get(F.filter(name, lambda x: x["high"] > F.col("_u")), F.lit(0))["v"]
            own = pick("_own", cumulative(df, c, []), [])  # one row
            held = draws.join(F.broadcast(own))
            if parents[c]:
                table = pick("_table", cumulative(df, c, parents[c], prior), parents[c]).withColumnsRenamed({p: f"_p_{p}" for p in parents[c]})
                held = held.join(table, [F.col(p) == F.col(f"_p_{p}") for p in parents[c]], "left").drop(*[f"_p_{p}" for p in parents[c]])
                out = held.withColumn(c, F.coalesce(chosen("_table"), chosen("_own"))).drop("_u", "_own", "_table")
            else:
                out = held.withColumn(c, chosen("_own")).drop("_u", "_own")
            done.append(c)
    return out


def bic(df: DataFrame, child: str, parents: list[str]) -> float:
    """The discrete BIC of a node with its parents, from one grouped count."""
    cells = df.groupBy(*parents, child).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    c = cells.withColumn("m", F.sum("n").over(whole))
    keys = F.struct(*parents) if parents else F.lit(1)
    got = c.agg(F.sum(F.col("n") * F.ln(F.col("n") / F.col("m"))).alias("ll"), F.sum("n").alias("total"), F.count_distinct(child).alias("k"), F.count_distinct(keys).alias("q")).selectExpr("ll - 0.5 * ln(total) * q * (k - 1) AS b").first()
    return float(got.b)


def hill_climb(df: DataFrame, columns: list[str], most_parents: int = 2, tolerance: float = 1e-6) -> dict[str, list[str]]:
    """A structure that no added, dropped or turned edge betters by BIC; each family's score is counted once."""
    known: dict[tuple[str, tuple[str, ...]], float] = {}

    def family(child: str, parents: frozenset[str]) -> float:
        key = child, tuple(sorted(parents))
        if key not in known:
            known[key] = bic(df, child, list(key[1]))
        return known[key]

    parents: dict[str, frozenset[str]] = {c: frozenset() for c in columns}

    def reaches(a: str, b: str, graph: dict[str, frozenset[str]]) -> bool:
        """Whether a is an ancestor of b."""
        seen, todo = set(), [b]
        while todo:
            for p in graph[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        return a in seen

    while True:
        best, change = tolerance, None
        for a, b in combinations(columns, 2):
            for x, y in ((a, b), (b, a)):
                if x in parents[y]:
                    dropped = parents | {y: parents[y] - {x}}
                    gains = [(family(y, dropped[y]) - family(y, parents[y]), dropped)]
                    turned = dropped | {x: parents[x] | {y}}
                    if len(turned[x]) <= most_parents and not reaches(x, y, dropped):
                        gains.append((gains[0][0] + family(x, turned[x]) - family(x, parents[x]), turned))
                elif y not in parents[x] and len(parents[y]) < most_parents and not reaches(y, x, parents):
                    added = parents | {y: parents[y] | {x}}
                    gains = [(family(y, added[y]) - family(y, parents[y]), added)]
                else:
                    continue
                for gain, made in gains:
                    if gain > best:
                        best, change = gain, made
        if change is None:
            return {c: sorted(p) for c, p in parents.items()}
        parents = change


def smote(df: DataFrame, key: str, numeric: list[str], label: str, minority: object, rows: int, seed: int, k: int = 5, low: float = 0.0, high: float = 1.0, categorical: list[str] = ()) -> DataFrame:
    """``rows`` new rows of a class, each between a row and one of its ``k`` nearest of the class.

    Numbers lie at a step in [``low``, ``high``] towards the neighbour, whose key the nearest rows name; a category is the
    most frequent one of the row's neighbours, the least of those as frequent. With categories only, numbers are left out.
    """
    own = df.where(F.col(label) == F.lit(minority)).select(key, *numeric, *categorical)
    n = own.count()
    if n < 2:
        raise GateError("insufficient_support", "a class needs two rows or more")
    near = nearest(own, own, key, list(numeric), list(categorical), kind="l2", mismatch=1.0, neighbours=min(k, n - 1), skip_equal_key=True)
    held = places(own, [], F.xxhash64(F.lit(seed), key), [key], "_i").drop("_i_of").join(near.select(key, "neighbours"), key)
    draws = df.sparkSession.range(rows).select(F.col("id").alias("row_id"), F.pmod(F.col("id"), F.lit(n)).alias("_i"), uniform(seed, F.lit("rank"), F.col("id")).alias("_rank"), uniform(seed, F.lit("step"), F.col("id")).alias("_step"))
    base = draws.join(held, "_i").withColumn("_other", F.get("neighbours", F.floor(F.col("_rank") * F.size("neighbours")).cast("int")))
    if numeric:
        other = own.select(F.col(key).alias("_other"), *[F.col(c).alias(f"_o_{c}") for c in numeric])
        base = base.join(other, "_other")
    step = F.lit(low) + F.col("_step") * (high - low)
    out = base.select("row_id", key, *[(F.col(c) + step * (F.col(f"_o_{c}") - F.col(c))).alias(c) for c in numeric], F.lit(minority).alias(label))
    for c in categorical:
        votes = near.select(key, F.explode("neighbours").alias("_n")).join(own.select(F.col(key).alias("_n"), F.col(c).alias("_v")), "_n").groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
        out = out.join(votes.groupBy(key).agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias(c)), key)
    return out.drop(key).select("row_id", *numeric, *categorical, label)


def median_label(df: DataFrame, target: str, name: str = "above_median") -> DataFrame:
    """The two halves of a numeric target, which stand for classes when a regression table is oversampled."""
    from tallyframe.operators.stats import quantiles

    return df.join(F.broadcast(quantiles(df, target, {"_m": 0.5}))).withColumn(name, (F.col(target) > F.col("_m")).cast("int")).drop("_m")


def swapped_shares(shares: dict[str, float]) -> dict[str, float]:
    """Class probabilities with the order of frequencies turned round."""
    names = sorted(shares, key=lambda x: (shares[x], x))
    return dict(zip(names, (shares[x] for x in reversed(names))))


def topped_up(counts: dict[str, int]) -> dict[str, int]:
    """How many rows each class lacks to be as frequent as the largest."""
    most = max(counts.values(), default=0)
    return {c: most - n for c, n in counts.items()}


def shuffled_columns(df: DataFrame, key: str, columns: list[str], seed: int, levels: int = 30) -> DataFrame:
    """Each column's values dealt anew among the rows of one level of the first column, so that marginals stay exactly and dependence on it roughly.

    Rows are cut into ``levels`` ranges of the lead column's ranks, those without a value apart; within a range the values of
    each further column follow a seeded order. Rows and values are matched by exact ranks: every value is used once. The order
    is that of a hash, whose first byte cuts a level into pieces of like size; pieces are sorted and those before are counted.
    """
    lead = columns[0]
    ends = at_places(df, lead, lambda n: [-(-k * n // levels) - 1 for k in range(1, levels)])
    above = sum(((F.col(lead).cast("double") > F.lit(x)).cast("int") for x in ends), F.lit(0))
    order = {c: F.xxhash64(F.lit(seed), F.lit("rows" if c == lead else c), key) for c in columns}
    piece = lambda c: F.shiftrightunsigned(order[c], 56).cast("int")
    held = df.select(key, *columns).withColumn("_level", F.coalesce(above, F.lit(-1)))
    sizes = held.select("_level", F.posexplode(F.array(*[piece(c) for c in columns])).alias("_c", "_piece")).groupBy("_level", "_c", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_level", "_c").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    sizes = working(sizes.select("_level", "_c", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "sizes")

    def placed(i: int, c: str) -> DataFrame:
        """Rows with their rank by the column's order within the level."""
        rows = held.select(key, "_level", c).withColumns({"_order": order[c], "_piece": piece(c)})
        rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_level", "_piece").orderBy("_order", key, c)) - 1)
        first = sizes.where(F.col("_c") == i).select("_level", "_piece", "_first")
        return rows.join(F.broadcast(first), ["_level", "_piece"]).withColumn("_rank", F.col("_first") + F.col("_in"))

    base = placed(0, lead).select(key, "_level", "_rank", lead)
    for i, c in enumerate(columns[1:], 1):
        base = base.join(placed(i, c).select("_level", "_rank", c), ["_level", "_rank"])
    return base.select(key, *columns)


SPAN = 128  # ranks of a stretch, within which values and draws are matched
PIECE = 50_000  # scores that a task sorts at once


def spans(places: DataFrame) -> DataFrame:
    """Values with their ranks from ``start`` up to ``stop``, a row for each stretch of ranks that they reach into."""
    return places.withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("stop") - 1) / SPAN))))


def independent(df: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """Every column drawn by its own frequencies; missing values are left out.

    A draw is a rank among the column's rows, and values hold as many ranks as rows. Values are counted and ranked in buckets,
    and ranks meet values by stretches: no column's values are gathered or broadcast, however many they are.
    """
    ids = df.sparkSession.range(rows).withColumnRenamed("id", "row_id")
    out = ids
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", F.xxhash64("v"))
        placed = working(running_sums(counts, [], "_h", ["n"]).select("v", (F.col("upto_n") - F.col("n")).alias("start"), F.col("upto_n").alias("stop"), "all_n"), "places")
        whole = placed.agg(F.max("all_n").alias("_all"))  # one row
        drawn = ids.join(F.broadcast(whole)).withColumn("at", F.floor(uniform(seed, F.lit(c), F.col("row_id")) * F.col("_all"))).withColumn("span", F.floor(F.col("at") / SPAN))
        met = drawn.join(spans(placed), "span").where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop")))
        out = out.join(met.select("row_id", F.col("v").alias(c)), "row_id")
    return out


class Generator(ABC):
    """What every generator offers: fitted once on a table, it gives as many rows as asked."""

    @abstractmethod
    def fit(self, train: DataFrame) -> "Generator": ...

    @abstractmethod
    def sample(self, rows: int, seed: int) -> DataFrame: ...


class NetworkGenerator(Generator):
    """A Bayesian network over binned columns: structure by hill climbing, tables smoothed by a prior, numbers drawn within their bins."""

    def __init__(self, numeric: list[str], categorical: list[str], bins: int = 16, most_parents: int = 2, prior: float = 1.0):
        self.numeric, self.categorical, self.bins, self.most_parents, self.prior = list(numeric), list(categorical), bins, most_parents, prior

    def fit(self, train: DataFrame) -> "NetworkGenerator":
        self.edges = {c: fit_quantile_bins(train, c, self.bins) for c in self.numeric}
        for c, edges in self.edges.items():
            train = quantile_bins(train, c, edges)
        self.names = [f"{c}_bin" for c in self.numeric] + self.categorical
        self.table = train.select(*self.names)
        self.parents = hill_climb(self.table, self.names, self.most_parents)
        return self

    def sample(self, rows: int, seed: int) -> DataFrame:
        out = network_sample(self.table, self.parents, rows, seed, self.prior)
        for c, edges in self.edges.items():
            out = quantile_bins_inverse(out, c, edges, "row_id", seed)
        return out.select("row_id", *self.numeric, *self.categorical)


class PermutationGenerator(Generator):
    """The train rows in a seeded order, cut to the asked number."""

    def __init__(self, key: str):
        self.key = key

    def fit(self, train: DataFrame) -> "PermutationGenerator":
        self.table = train
        return self

    def sample(self, rows: int, seed: int) -> DataFrame:
        return permuted(self.table, self.key, seed).limit(rows)


class MarginalGenerator(Generator):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, train: DataFrame) -> "MarginalGenerator":
        self.table = train
        return self

    def sample(self, rows: int, seed: int) -> DataFrame:
        return independent(self.table, self.columns, rows, seed)


class RankGenerator(Generator):
    """Every column's own values, put in an order that keeps the rank correlations of all pairs of columns.

    Rows draw normal scores whose correlations are the train table's Spearman correlations, taken to normal ones; the row of
    the k-th least score of a column gets the k-th least train value. As many rows as the train table have exactly its
    marginals. The correlations that come out are measured and what they lack is added to those drawn, ``rounds`` times.
    Categories count in sorted order; rows with a missing value take no part.
    """

    def __init__(self, numeric: list[str], categorical: list[str], rounds: int = 2):
        self.numeric, self.categorical, self.rounds = list(numeric), list(categorical), rounds
        self.names = [*self.numeric, *self.categorical]

    def fit(self, train: DataFrame) -> "RankGenerator":
        coded = train.select(*[F.col(c).cast("double").alias(c) for c in self.numeric], *[F.col(c).cast("string").alias(c) for c in self.categorical]).dropna()
        self.codes = {}
        for c in self.categorical:
            self.codes[c] = category_codes(coded, c)
            coded = coded.join(F.broadcast(self.codes[c]), F.col(c) == F.col("category")).drop("category", c).withColumnRenamed("code", c)  # declared categories
        self.values = [f"v{i}" for i in range(len(self.names))]
        coded = working(coded.select(F.monotonically_increasing_id().alias("id"), *[F.col(c).cast("double").alias(v) for v, c in zip(self.values, self.names)]), "coded")
        self.places, self.rows = value_places(coded, self.values), coded.count()
        self.spearman = _matrix(average_ranks(coded, "id", self.values, self.places), len(self.names), self.rows)
        return self

    def _drawn(self, rows: int, seed: int, latent: np.ndarray, what: str) -> DataFrame:
        """(row_id, v0.. or r0..): values, or their average ranks in the train table.

        Scores are cut into pieces of like size, since their distribution is known; a piece is sorted in a task, and the rows
        of those before it are added. Values go to the pieces whose ranks they reach into.
        """
        d, all_rows, pieces = len(self.names), self.rows, max(1, rows // PIECE)
        values, vectors = np.linalg.eigh(latent)
        near = (vectors * np.maximum(values, 1e-6)) @ vectors.T  # the nearest matrix that is one of correlations
        mixed = np.linalg.cholesky(near / np.sqrt(np.outer(np.diag(near), np.diag(near))))
        ids = self.places.sparkSession.range(rows)
        chances = ids.select(F.col("id").alias("row_id"), *[(uniform(seed, F.lit(j), F.col("id")) + F.lit(2.0**-54)).alias(f"u{j}") for j in range(d)])

        def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """(column x row) scores and their pieces, by a curve near the normal distribution."""
            y = mixed @ normal_quantiles(np.stack([batch.column(f"u{j}").to_numpy() for j in range(d)]))
            return y, np.minimum(np.floor(pieces / (1 + np.exp(-1.702 * y))), pieces - 1).astype(np.int32)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """How many scores each piece has."""
            n = np.zeros((d, pieces), dtype=np.int64)
            for batch in batches:
                for c, piece in enumerate(scored(batch)[1]):
                    n[c] += np.bincount(piece, minlength=pieces)
            c, piece = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(piece, pa.int32()), pa.array(n[c, piece])], names=["c", "piece", "n"])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column("row_id")
                for c, (y, piece) in enumerate(zip(*scored(batch))):
                    yield pa.RecordBatch.from_arrays([row, pa.array(np.full(len(y), c), pa.int32()), pa.array(y), pa.array(piece)], names=["row_id", "c", "y", "piece"])

        long = chances.mapInArrow(spread, "row_id long, c int, y double, piece int")
        sizes = np.zeros((d, pieces), dtype=np.int64)
        for x in chances.mapInArrow(tell, "c int, piece int, n long").groupBy("c", "piece").agg(F.sum("n").alias("n")).collect():  # a small row per piece
            sizes[x.c, x.piece] = x.n
        first = np.cumsum(sizes, axis=1) - sizes

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Values for each piece that they reach into."""
            for batch in batches:
                column, start, stop, v = (batch.column(k).to_numpy() for k in ("c", "start", "stop", "v"))
                for c in np.unique(column).tolist():
                    there, own = np.flatnonzero(sizes[c]), np.flatnonzero(column == c)
                    least, most = first[c, there] * all_rows // rows, (first[c, there] + sizes[c, there] - 1) * all_rows // rows
                    low, high = np.searchsorted(most, start[own]), np.searchsorted(least, stop[own] - 1, side="right")
                    times = np.maximum(high - low, 0)
                    row = np.repeat(own, times)
                    at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(row))
                    x = v[row] if what == "v" else (start[row] + stop[row] + 1) / 2
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), c), pa.int32()), pa.array(there[at], pa.int32()), pa.array(start[row]), pa.array(x, pa.float64())], names=["c", "piece", "start", "x"])

        def deal(scores: pa.Table, held: pa.Table) -> pa.Table:
            """The values of a piece, by the order of its scores."""
            y, row, start, x = scores["y"].to_numpy(), scores["row_id"].to_numpy(), held["start"].to_numpy(), held["x"].to_numpy()
            if not len(y) or not len(start):
                return pa.table({"row_id": pa.array([], pa.int64()), "c": pa.array([], pa.int32()), "x": pa.array([], pa.float64())})
            c, order, by = scores["c"][0].as_py(), np.lexsort((row, y)), np.argsort(start)
            at = (first[c, scores["piece"][0].as_py()] + np.arange(len(y))) * all_rows // rows
            return pa.table({"row_id": row[order], "c": pa.array(np.full(len(y), c), pa.int32()), "x": x[by][np.searchsorted(start[by], at, side="right") - 1]})

        held = self.places.select("c", "start", "stop", "v").mapInArrow(reach, "c int, piece int, start long, x double")
        met = long.groupBy("c", "piece").cogroup(held.groupBy("c", "piece")).applyInArrow(deal, "row_id long, c int, x double")
        return met.groupBy("row_id").agg(*[F.max(F.when(F.col("c") == i, F.col("x"))).alias(f"{what}{i}") for i in range(d)])

    def sample(self, rows: int, seed: int) -> DataFrame:
        latent = 2 * np.sin(np.pi / 6 * self.spearman)
        for _ in range(self.rounds):
            made = _matrix(self._drawn(rows, seed, latent, "r"), len(self.names), self.rows)
            latent = np.clip(latent + 2 * np.sin(np.pi / 6 * self.spearman) - 2 * np.sin(np.pi / 6 * made), -0.9999, 0.9999)
            np.fill_diagonal(latent, 1.0)
        out = self._drawn(rows, seed, latent, "v")
        for v, c in zip(self.values, self.names):
            if c in self.codes:
                out = out.join(F.broadcast(self.codes[c].select(F.col("category").alias(c), F.col("code").alias("_code"))), F.col(v) == F.col("_code")).drop("_code")
            else:
                out = out.withColumn(c, F.col(v))
        return out.select("row_id", *self.names)


def _matrix(df: DataFrame, columns: int, rows: int) -> np.ndarray:
    """Correlations of all pairs of the ranks r0.. among ``rows`` rows, 0 where a column is constant: a small matrix."""
    out = np.eye(columns)
    for r in co_moments(df, [f"r{i}" for i in range(columns)], about=(rows + 1) / 2).select("i", "j", rho().alias("rho")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.rho or 0.0
    return out


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left_column, right_column, rho): rank correlations of all pairs of numeric columns over rows without missing values, ties by average ranks."""
    values = [f"v{i}" for i in range(len(columns))]
    coded = working(df.select(*[F.col(c).cast("double").alias(v) for v, c in zip(values, columns)]).dropna().select(F.monotonically_increasing_id().alias("id"), *values), "coded")
    ranked = average_ranks(coded, "id", values, value_places(coded, values))
    names = F.array(*[F.lit(c) for c in columns])
    moments = co_moments(ranked, [f"r{i}" for i in range(len(columns))], about=(coded.count() + 1) / 2)
    return moments.select(F.get(names, "i").alias("left_column"), F.get(names, "j").alias("right_column"), rho().alias("rho"))


#: Generators by name.
GENERATORS: dict[str, Callable[..., Generator]] = {"bn": NetworkGenerator, "permutation": PermutationGenerator, "marginal": MarginalGenerator, "tabsds": RankGenerator}


def checked_sample(generator: Generator, rows: int, seed: int, known: dict[str, list] | None = None) -> DataFrame:
    """A sample that keeps what every generator promises: the number of rows, no missing value, known categories only."""
    out = generator.sample(rows, seed)
    wrong = F.lit(False)
    for c in out.columns:
        wrong = wrong | F.col(f"`{c}`").isNull()
    for c, values in (known or {}).items():
        wrong = wrong | ~F.col(f"`{c}`").isin(*values)
    got = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("bad")).first()
    if got.n != rows or got.bad:
        raise GateError("invalid_sample", f"{got.n} rows, {got.bad} of them invalid")
    return out
