"""Connected components of a link table, without collecting links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import materialize


def find_root(parent: dict, x):
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while x != root:
        parent[x], x = root, parent.get(x, x)
    return root


def join_roots(parent: dict, a, b) -> None:
    a, b = find_root(parent, a), find_root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker's links, replaced by one from each node to the least node it reaches among them."""

    def stars(parent: dict) -> pa.RecordBatch:
        pairs = [(x, find_root(parent, x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["a", "b"])

    parent: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            join_roots(parent, a, b)
        if len(parent) > 500_000:
            yield stars(parent)
            parent = {}
    if kind is not None:
        yield stars(parent)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: of one type, long or binary); the component is its least node.

    Links are contracted within workers first, then large-star and small-star steps alternate until nothing changes. Each
    step is a partially aggregated minimum and a join, so a hub's links are never gathered in one task; each round is
    written to the shared folder, so a lost executor costs one round. Null ends, loops and repeated links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    kind = links.schema["a"].dataType.simpleString()
    edges = edges.mapInArrow(_contract, f"a {kind}, b {kind}")
    edges = materialize(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("u")).select("b", "u", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u"), F.col("m"))).where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def local_components(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The same on a list, for tests and bounded groups."""
    parent: dict = {}
    for a, b in pairs:
        join_roots(parent, a, b)
    return {x: find_root(parent, x) for x in np.unique(np.array(pairs, dtype=np.int64).reshape(-1)).tolist()}
