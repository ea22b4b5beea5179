"""Metric index over rows of numbers and categories, for nearest rows and for balls around rows.

Pivots, chosen far apart from a bounded sample of the reference, cut the space into cells. Rows are sorted by their nearest
pivot, then the second nearest, and packed into blocks. A block keeps the least and the greatest distance of its rows to the
first pivots and the box of its values; the triangle inequality and the box tell how near two blocks can come, and only
pairs of blocks that can come near enough are joined. Distances are computed block against block in tasks.

Where a space has numbers only, two or more, cells are boxes instead: a tree of halves, fitted on a bounded sample, cuts the
space, and rows of a block are put in the order of such a tree too. Stretches of a few rows then have small boxes, which leave
a row few stretches of a block to look at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.working import working

BLOCK_ROWS = 4_000
SAMPLE_ROWS = 4_000  # rows of the reference that pivots are chosen from, by least hash
MOST_PIVOTS = 256
BOUND_PIVOTS = 32  # pivots whose distances bound a block
LEAVES = 8  # stretches of a block that are bounded one by one where pairs are planned
SMALL = 64  # rows of the smallest boxes within a block
MOST_BOXES = 1024  # leaves of the tree of halves, 16 sampled rows each
BOX_VALUES = 64  # a block with more distinct categories in a column has no bound there
_CELLS = 2_000_000  # distances that a task holds at once


@dataclass
class Points:
    """Rows of a block: keys, numbers (rows x columns, NaN for missing), and each category's values with the rows' codes."""

    keys: pa.Array
    numbers: np.ndarray
    labels: list[tuple[list, np.ndarray]]
    extra: np.ndarray | None = None  # radii
    weight: np.ndarray | None = None  # how many rows each stands for

    def __len__(self) -> int:
        return len(self.keys)

    def at(self, rows) -> Points:
        cut = lambda x: None if x is None else x[rows]
        return Points(self.keys.take(pa.array(np.arange(len(self))[rows])), self.numbers[rows], [(v, c[rows]) for v, c in self.labels], cut(self.extra), cut(self.weight))


def joined(parts: list[Points]) -> Points:
    """Several blocks as one."""
    labels = []
    for column in zip(*(p.labels for p in parts)):
        place = {v: i for i, v in enumerate(dict.fromkeys(v for values, _ in column for v in values))}
        labels.append((list(place), np.concatenate([np.array([place[v] for v in values], dtype=np.int64)[codes] for values, codes in column])))
    return Points(pa.concat_arrays([p.keys for p in parts]), np.vstack([p.numbers for p in parts]), labels)


@dataclass(frozen=True)
class Space:
    """``l1``: sum of range-scaled differences plus ``mismatch`` per differing category. ``l2``: root of squared scaled differences
    plus ``mismatch`` per differing category. ``mean``: differences capped at 1, mismatches 1, divided by the number of columns.

    A column without range counts as 0 where equal, else 1. Two missing values agree, one is a mismatch (1 for a number).
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    kind: str
    mismatch: float
    ranges: tuple[float, ...]

    @property
    def width(self) -> int:
        return max(1, len(self.numeric) + len(self.categorical))

    def _number(self, gap: np.ndarray, j: int, cap: float | None) -> np.ndarray:
        gap = gap / self.ranges[j] if self.ranges[j] > 0 else (gap > 0).astype(float)
        gap = np.minimum(gap, 1) if self.kind == "mean" else gap if cap is None else np.minimum(gap, cap)
        return gap * gap if self.kind == "l2" else gap

    @property
    def boxed(self) -> bool:
        """Whether boxes of numbers alone tell rows apart."""
        return len(self.numeric) > 1 and not self.categorical

    def scaled(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers by their ranges, for the choice of cuts only."""
        return np.nan_to_num(numbers / [r if r > 0 else np.inf for r in self.ranges], nan=-1.0)

    @property
    def _category(self) -> float:
        return 1.0 if self.kind == "mean" else self.mismatch

    def _total(self, d: np.ndarray) -> np.ndarray:
        return np.sqrt(d) if self.kind == "l2" else d / self.width if self.kind == "mean" else d

    def distances(self, a: Points, b: Points, cap: float | None = None) -> np.ndarray:
        """Rows of ``a`` by rows of ``b``. With differences capped at 2 a missing value keeps the triangle inequality."""
        d = np.zeros((len(a), len(b)))
        for j in range(len(self.numeric)):
            x, y = a.numbers[:, j], b.numbers[:, j]
            gap = self._number(np.abs(x[:, None] - y[None, :]), j, cap)
            nx, ny = np.isnan(x), np.isnan(y)
            if nx.any() or ny.any():
                gap[nx[:, None] ^ ny[None, :]] = 1.0
                gap[nx[:, None] & ny[None, :]] = 0.0
            d += gap
        for (values, x), (others, y) in zip(a.labels, b.labels):
            place = {v: i for i, v in enumerate(values)}
            d += (x[:, None] != np.array([place.get(v, -1) for v in others], dtype=np.int64)[y][None, :]) * self._category
        return self._total(d)

    def box(self, p: Points) -> tuple:
        """(least, greatest) of each number, NaN if one is missing, and each category's values, None if many."""
        ends = (p.numbers.min(axis=0), p.numbers.max(axis=0)) if len(self.numeric) else (np.zeros(0), np.zeros(0))
        used = [{v[i] for i in np.unique(c).tolist()} for v, c in p.labels]
        return *ends, [x if len(x) <= BOX_VALUES else None for x in used]

    def box_gap(self, a: tuple, b: tuple) -> float:
        """How near rows of two boxes can come."""
        d = 0.0
        for j in range(len(self.numeric)):
            gap = np.fmax(np.maximum(b[0][j] - a[1][j], a[0][j] - b[1][j]), 0.0)  # 0 where a value is missing
            d += float(self._number(np.float64(gap), j, None))
        for x, y in zip(a[2], b[2]):
            d += self._category if x is not None and y is not None and x.isdisjoint(y) else 0.0
        return float(self._total(np.float64(d)))

    def gaps(self, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
        """``box_gap`` of arrays of boxes of numbers, a little loosened against rounding."""
        d = 0.0
        for j in range(len(self.numeric)):
            gap = np.fmax(np.maximum(lo_b[..., j] - hi_a[..., j], lo_a[..., j] - hi_b[..., j]), 0.0)
            d = d + self._number(gap, j, None)
        return self._total(d) * (1 - 1e-9) - 1e-12


def ranges(df: DataFrame, numeric: list[str]) -> tuple[float, ...]:
    """The range of each numeric column: one small row."""
    if not numeric:
        return ()
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    found = df.agg(*[(F.max(value(c)) - F.min(value(c))).alias(f"r{i}") for i, c in enumerate(numeric)]).first()
    return tuple(float(x or 0.0) for x in found)


def features(df: DataFrame, key: str, space: Space, *more: Column) -> DataFrame:
    """key, n0.., c0.. alone, whatever other columns are called; NaN is missing."""
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"n{i}") for i, c in enumerate(space.numeric)]
    return df.select(F.col(key).alias("key"), *numbers, *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(space.categorical)], *more)


def names(space: Space) -> list[str]:
    return [f"n{i}" for i in range(len(space.numeric))] + [f"c{i}" for i in range(len(space.categorical))]


def fewest(plain: DataFrame, space: Space, copies: int) -> DataFrame:
    """At most ``copies`` of equal rows, those with the least keys: no more can be among a row's nearest."""
    by = names(space) or [F.lit(1)]
    return plain.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("_place") <= copies).drop("_place")


def points(batch: pa.RecordBatch | pa.Table, space: Space, extra: str | None = None) -> Points:
    column = lambda c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c)
    numbers = np.column_stack([column(f"n{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(space.numeric))]) if space.numeric else np.empty((batch.num_rows, 0))
    labels = []
    for i in range(len(space.categorical)):
        coded = column(f"c{i}").dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        labels.append((coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)))
    number = lambda c, kind: column(c).to_numpy(zero_copy_only=False).astype(kind)
    return Points(column("key"), numbers, labels, number(extra, float) if extra else None, number("weight", np.int64) if "weight" in batch.schema.names else None)


def choose(plain: DataFrame, space: Space, n: int) -> Points:
    """Pivots far apart: of a bounded sample, always the row that is farthest from those chosen."""
    by = names(space)
    table = plain.orderBy(F.xxhash64(*[F.col(c) for c in by]) if by else F.lit(0), "key").limit(SAMPLE_ROWS).toArrow()
    sample = points(table, space)
    taken, left = [0], space.distances(sample, sample.at([0]), 2.0)[:, 0]
    while len(taken) < n and left.max() > 0:
        taken.append(int(left.argmax()))
        left = np.minimum(left, space.distances(sample, sample.at([taken[-1]]), 2.0)[:, 0])
    return sample.at(taken)


@dataclass(frozen=True)
class Tree:
    """Halves of a space: row x goes right of node i if its number ``dims[i]`` is above ``cuts[i]``; the children of i are 2 i + 1 and 2 i + 2."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaf(self, numbers: np.ndarray) -> np.ndarray:
        at, each = np.zeros(len(numbers), dtype=np.int64), np.arange(len(numbers))
        for _ in range(self.depth):
            at = 2 * at + 1 + (numbers[each, self.dims[at]] > self.cuts[at])
        return at - (2**self.depth - 1)


def grow(plain: DataFrame, space: Space, rows: int, block: int) -> Tree:
    """A tree with two leaves or more for each block of ``rows`` rows, cut at the medians of the widest numbers of a bounded sample."""
    depth = int(np.ceil(np.log2(min(MOST_BOXES, max(2, 2 * rows / block)))))
    sample = points(plain.orderBy(F.xxhash64(*names(space)), "key").limit(16 * 2**depth).toArrow(), space).numbers
    dims, cuts, held = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf), {0: sample}
    for i in range(len(dims)):
        own = held.pop(i)
        if len(own) > 1:
            dims[i] = np.ptp(space.scaled(own), axis=0).argmax()
            cuts[i] = np.nanmedian(own[:, dims[i]]) if not np.isnan(own[:, dims[i]]).all() else np.inf
        right = own[:, dims[i]] > cuts[i]
        held[2 * i + 1], held[2 * i + 2] = own[~right], own[right]
    return Tree(dims, cuts, depth)


def halved(x: np.ndarray) -> np.ndarray:
    """An order of rows in which stretches of ``SMALL`` are boxes: halved again and again by the widest column."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= SMALL:
            done.append(own)
            continue
        j, left = np.ptp(x[own], axis=0).argmax(), -(-len(own) // SMALL // 2) * SMALL
        own = own[np.argpartition(x[own, j], left)]
        todo += [own[left:], own[:left]]
    return np.concatenate(done) if done else np.arange(0)


_LEAF = "struct<lo:array<double>,hi:array<double>,a:array<double>,b:array<double>,u:double>"
BLOCK = f"block long, cell int, second int, near double, rows long, leaves array<{_LEAF}>, lo array<double>, hi array<double>, a array<double>, b array<double>, box binary, payload binary"
_BLOCK = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("second", pa.int32()), ("near", pa.float64()), ("rows", pa.int64()), ("leaves", pa.list_(pa.struct([("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64())), ("u", pa.float64())]))), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64())), ("box", pa.binary()), ("payload", pa.binary())])
_GROUND = ("cell", "level", "second", "near")


def blocks(plain: DataFrame, space: Space, pivots: Points, rows: int, tag: str, *, reach: str | None = None, tree: Tree | None = None) -> DataFrame:
    """Blocks of at most ``rows`` rows of one cell, and the bounds of the stretches (leaves) of each: distances to pivots from ``lo``
    to ``hi``, numbers from ``a`` to ``b``. With a ``tree`` cells are its leaves, or a few that follow one another. With ``reach``, a column of
    radii, rows of a block have radii of one power of two, and a leaf's ``u`` is the greatest of them. Cells are cut by range,
    so a crowded one is dealt over many tasks."""
    few = pivots.at(slice(0, BOUND_PIVOTS))
    level = F.floor(F.log2(F.greatest(F.col(reach), F.lit(1e-300)))).cast("int") if reach else F.lit(0)
    base = plain.withColumn("level", level)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if tree:
                second = tree.leaf(points(batch, space).numbers)
                cell, near = second >> max(0, tree.depth - 8), np.zeros(len(second))
            else:
                d = np.vstack([space.distances(own, pivots, 2.0) for own in slices(points(batch, space), len(pivots))])
                cell, near = d.argmin(axis=1), d.min(axis=1)
                d[np.arange(len(d)), cell] = np.inf
                second = d.argmin(axis=1) if d.shape[1] > 1 else cell
            made = {"cell": pa.array(cell, pa.int32()), "second": pa.array(second, pa.int32()), "near": pa.array(near)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    placed = working(base.mapInArrow(place, f"{fields}, cell int, second int, near double"), f"{tag}-rows")
    order = ["cell", "level", "second", *[f"c{i}" for i in range(len(space.categorical))], "near", *[f"n{i}" for i in range(len(space.numeric))], "key"]
    arranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, last = TaskContext.get().partitionId() << 32, [], 0, None

        def packed() -> pa.RecordBatch:
            nonlocal number, held, size
            table, held, size = pa.Table.from_batches(held), [], 0
            own = points(table, space, reach)
            own = own.at(halved(space.scaled(own.numbers))) if tree else own
            d = np.vstack([space.distances(x, few, 2.0) for x in slices(own, len(few))])
            number += 1
            leaves = [{"lo": d[x].min(axis=0), "hi": d[x].max(axis=0), "a": own.numbers[x].min(axis=0), "b": own.numbers[x].max(axis=0), "u": float(own.extra[x].max()) if reach else None} for x in leaf_rows(len(own))]
            row = [number - 1, table.column("cell")[0].as_py(), table.column("second")[0].as_py(), float(np.mean(table.column("near").to_numpy())), len(own), leaves, d.min(axis=0), d.max(axis=0), own.numbers.min(axis=0), own.numbers.max(axis=0), pickle.dumps(space.box(own)), pickle.dumps(own, protocol=5)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            kind = np.stack([batch.column(c).to_numpy() for c in _GROUND[:2]])
            starts = np.append(0, np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1)
            for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if held and last != tuple(kind[:, at]):
                    yield packed()
                while at < stop:
                    take = min(stop - at, rows - size)
                    held.append(batch.slice(at, take))
                    at, size, last = at + take, size + take, tuple(kind[:, at])
                    if size == rows:
                        yield packed()
        if held:
            yield packed()

    return working(arranged.mapInArrow(pack, BLOCK), f"{tag}-blocks")


def slices(p: Points, others: int) -> Iterator[Points]:
    step = max(1, _CELLS // max(1, others))
    for at in range(0, len(p), step):
        yield p.at(slice(at, at + step))


def leaf_rows(n: int) -> list[slice]:
    """The stretches of a block of ``n`` rows."""
    step = -(-n // LEAVES)
    step = -(-step // SMALL) * SMALL if step > SMALL else step
    return [slice(at, at + step) for at in range(0, n, step)]


def _floats(values: pa.ListArray) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def apart(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """The triangle inequality's bound, a little loosened against rounding."""
    return np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a).max(axis=-1), 0.0) * (1 - 1e-9) - 1e-12


def near_pairs(mine: DataFrame, theirs: DataFrame, space: Space) -> DataFrame:
    """(x, y): blocks of ``mine`` with a leaf that can have rows of a block of ``theirs`` within its ``u``.

    Cells come first: what bounds the blocks of a cell, at most 256 small rows, goes to every task, and a block meets the
    blocks of the cells that are left by an equi-join on the cell.
    """
    ends = theirs.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "x")).groupBy("cell", "p").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    found = sorted(map(tuple, ends.collect()))  # at most 256 cells times 32 pivots
    known = sorted({x[0] for x in found})
    lo, hi = (np.array([x[k] for x in found]).reshape(len(known), -1) for k in (2, 3))
    if space.boxed:
        boxes = theirs.select("cell", F.posexplode(F.arrays_zip("a", "b")).alias("p", "x")).groupBy("cell", "p").agg(F.min("x.a").alias("a"), F.max("x.b").alias("b"))
        boxes = sorted(map(tuple, boxes.collect()))  # and as many boxes; with a missing value one end at least is NaN, which bounds nothing
        least, most = (np.array([x[k] for x in boxes]).reshape(len(known), -1) for k in (2, 3))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not known:
                continue
            a, b, u = _floats(batch.column("lo")), _floats(batch.column("hi")), batch.column("u").to_numpy()
            for cut in range(0, len(u), 256):
                near = apart(a[cut : cut + 256, None, :], b[cut : cut + 256, None, :], lo[None], hi[None]) <= u[cut : cut + 256, None]
                if space.boxed:
                    ends = [_floats(batch.column(k))[cut : cut + 256, None, :] for k in ("a", "b")]
                    near &= space.gaps(*ends, least[None], most[None]) <= u[cut : cut + 256, None]
                x, c = np.nonzero(near)
                yield batch.take(pa.array(x + cut)).append_column("cell", pa.array(np.array(known)[c], pa.int32()))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = apart(*[_floats(batch.column(c)) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]) <= batch.column("u").to_numpy()
            a, b, u = batch.column("box_a"), batch.column("box_b"), batch.column("u").to_numpy()
            if space.boxed:
                near &= space.gaps(*[_floats(batch.column(c)) for c in ("a_a", "b_a", "a_b", "b_b")]) <= u
                yield batch.select(["x", "y"]).take(pa.array(np.flatnonzero(near)))
                continue
            kept = [i for i in np.flatnonzero(near).tolist() if space.box_gap(pickle.loads(a[i].as_py()), pickle.loads(b[i].as_py())) * (1 - 1e-9) - 1e-12 <= u[i]]
            yield batch.select(["x", "y"]).take(pa.array(kept, pa.int64()))

    leaves = mine.select(F.col("block").alias("x"), "box", F.inline("leaves"))
    reached = leaves.mapInArrow(to_cells, "x long, box binary, lo array<double>, hi array<double>, a array<double>, b array<double>, u double, cell int").withColumnsRenamed({k: f"{k}_a" for k in ("lo", "hi", "a", "b", "box")})
    others = theirs.select(F.col("block").alias("y"), "cell", *[F.col(k).alias(f"{k}_b") for k in ("lo", "hi", "a", "b", "box")])
    return reached.join(others, "cell").mapInArrow(to_blocks, "x long, y long").distinct()
