"""Removal of long repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Sorting every suffix is not needed. In each window of ``passage`` bytes one position, an anchor, is chosen by the least hash
of the ``gram`` bytes that start there; equal windows choose the same place, so two equal windows meet at an anchor. Only
suffixes at anchors whose gram occurs twice are sorted: each worker sorts its own into runs, runs are exchanged front-coded
(the length of the prefix shared with the run's previous suffix, then the rest), and the receiver merges them with a loser
tree that carries those lengths along, so bytes known to be equal are never compared again. The merge yields each suffix
with the prefix length it shares with its predecessor; from these and from the bytes left of the anchors follows how far
every repeated string reaches.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import binary16, grouped, materialize, narrow, partitions, rows
from tallyframe.llm.shingles import mix, powers


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400  # bytes of a string that goes where it repeats
    passage: int = 256  # bytes of a string that is only told where it repeats; at most ``length``
    gram: int = 64
    block_bytes: int = 1 << 20


def _sliding(extreme, values: np.ndarray, span: int) -> np.ndarray:
    """The extreme of each ``span`` neighbours: over powers of two, then two that overlap."""
    width = 1
    while width * 2 <= span:
        values = extreme(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return extreme(values[: len(values) - rest], values[rest:])


def anchors(data: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors and the hashes of their grams; none if the text is shorter than ``passage``."""
    if len(data) < params.passage:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    count = len(data) - params.gram + 1
    hashes = mix((total[params.gram :] - total[:count]) * down[:count])
    span = params.passage - params.gram + 1  # grams in a window
    # A place is chosen if it holds the least hash of a span around it (all places that tie): the largest of the least
    # hashes of its spans is then its own.
    least = _sliding(np.minimum, hashes, span)
    around = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    around[span - 1 : span - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(np.maximum, around, span) == hashes)
    return at, hashes[at]


ANCHOR = np.dtype([("hash", "<u8"), ("key", "V16"), ("at", "<i4")])


def text_key(data: bytes) -> bytes:
    """128 bits that name a text."""
    return sha256(data).digest()[:16]


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[bytes]:
    for batch in grouped(batches, "text", limit):
        for x in batch.column("text").cast(pa.binary()):
            yield x.as_buffer().to_pybytes() if x.is_valid else b""


def anchor_index(docs: DataFrame, parts: int, params: RepeatParams) -> DataFrame:
    """Packed anchors: (part, entries). Copies of a text within a block count once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, seen = [], 0, set()

        def packed() -> pa.RecordBatch:
            entries = np.concatenate(made)
            part = ((entries["hash"] >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            blobs = [b"".join(np.ascontiguousarray(entries[n][a:b]).tobytes() for n in ANCHOR.names) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])

        for data in _texts(batches, params.block_bytes):
            key = text_key(data)
            if len(data) < params.passage or key in seen:
                continue
            seen.add(key)
            at, hashes = anchors(np.frombuffer(data, dtype=np.uint8), params)
            entry = np.empty(len(at), dtype=ANCHOR)
            entry["hash"], entry["key"], entry["at"] = hashes, np.void(key), at
            made.append(entry)
            size += len(at)
            if size > 500_000:
                yield packed()
                made, size = [], 0
            if len(seen) > 500_000:
                seen.clear()
        if made:
            yield packed()

    return docs.mapInArrow(task, "part int, entries binary")


def repeated_anchors(index: DataFrame) -> DataFrame:
    """(key, at, hash) of the anchors whose gram occurs at two places or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for blob in batch.column("entries").to_pylist():
                count = len(blob) // ANCHOR.itemsize
                entry, at = np.empty(count, dtype=ANCHOR), 0
                for n in ANCHOR.names:
                    entry[n] = np.frombuffer(blob, dtype=ANCHOR[n], count=count, offset=at)
                    at += count * ANCHOR[n].itemsize
                held.append(entry)
        if not held:
            return
        e = np.concatenate(held)
        halves = np.ascontiguousarray(e["key"]).view("<u8").reshape(-1, 2)
        order = np.lexsort((e["at"], halves[:, 0], halves[:, 1], e["hash"]))
        e, halves = e[order], halves[order]
        new = np.concatenate([[True], (e["hash"][1:] != e["hash"][:-1]) | (halves[1:] != halves[:-1]).any(axis=1) | (e["at"][1:] != e["at"][:-1])])
        e = e[new]
        same = e["hash"][1:] == e["hash"][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        e = e[keep]
        for a in range(0, len(e), 100_000):
            x = e[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([binary16(x["key"]), pa.array(x["at"].astype(np.int64)), pa.array(x["hash"].view(np.int64))], names=["key", "at", "hash"])

    return index.repartition(partitions(index.sparkSession), "part").mapInArrow(task, "key binary, at long, hash long")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """How many leading bytes agree, ``start`` of which are known to."""
    stop = min(len(a), len(b))
    step = 16
    while start < stop:
        end = min(start + step, stop)
        if a[start:end] == b[start:end]:
            start = end
            step *= 2
            continue
        if end - start == 1:
            return start
        step = max(1, (end - start) // 2)
        if step < 8:
            while a[start] == b[start]:
                start += 1
            return start
    return stop


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length shared with the previous one, and the rest."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = common_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


class LoserTree:
    """Merges sorted front-coded runs.

    A loser stays in its node with the length it shares with the winner that passed there. A challenger carries the same
    length against the same suffix (the last one put out), so of two with different lengths the longer is the smaller
    without any comparison, and of two with equal lengths comparison starts behind them.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        """``runs`` give (shared length with the run's previous suffix, whole suffix, payload)."""
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.nodes: list = [None] * self.size
        first = [self._next(i) if i < len(runs) else None for i in range(self.size)]
        self.winner = self._build(1, first)

    def _next(self, i: int):
        got = next(self.runs[i], None)
        return None if got is None else [got[0], got[1], got[2], i]

    def _build(self, node: int, first: list):
        if node >= self.size:
            item = first[node - self.size]
            if item is not None:
                item[0] = 0  # nothing has been put out yet
            return item
        return self._play(node, self._build(2 * node, first), self._build(2 * node + 1, first))

    def _play(self, node: int, a, b):
        """Leaves the loser in ``node`` and returns the winner."""
        if a is None or b is None:
            self.nodes[node] = None if a is None and b is None else None
            return b if a is None else a
        if a[0] != b[0]:
            win, lose = (a, b) if a[0] > b[0] else (b, a)
        else:
            n = common_prefix(a[1], b[1], a[0])
            win, lose = (a, b) if a[1][n:] <= b[1][n:] else (b, a)
            lose[0] = n
        self.nodes[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(length shared with the previous suffix put out, suffix, payload) in order."""
        while self.winner is not None:
            shared, suffix, payload, run = self.winner
            yield shared, suffix, payload
            item, node = self._next(run), (run + self.size) // 2
            while node:
                other = self.nodes[node]
                if item is None:
                    item, self.nodes[node] = other, None
                elif other is not None:
                    item = self._play(node, item, other)
                node //= 2
            self.winner = item


def reaches(right: list[bytes], shared: list[int], left: list[bytes], lengths: tuple[int, ...]) -> list[tuple[list[int], list[int]]]:
    """For each of ``lengths``, how far left and right of each anchor the repeated strings of that length or more reach.

    ``right`` holds the sorted suffixes, ``shared`` the prefix lengths of neighbours, ``left`` the reversed bytes before
    the anchors. Suffixes are united from the longest shared prefix down, and each set keeps its left sides sorted, so a
    newcomer meets its two neighbours there; whatever lies further off is outdone by a pair that met before.
    """
    m = len(right)
    far = [([0] * m, [0] * m) for _ in lengths]
    owner, members = list(range(m)), [[(left[i], i)] for i in range(m)]

    def meet(i: int, j: int, r: int) -> None:
        n = common_prefix(left[i], left[j])
        for length, (to_left, to_right) in zip(lengths, far):
            if n + r >= length:
                for x in (i, j):
                    to_left[x] = max(to_left[x], n)
                    to_right[x] = max(to_right[x], r)

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for k in sorted(range(1, m), key=lambda k: -shared[k]):
        a, b, r = root(k - 1), root(k), shared[k]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big = members[a]
        for item in members[b]:
            at = bisect.bisect_left(big, item)
            if at < len(big):
                meet(item[1], big[at][1], r)
            if at:
                meet(item[1], big[at - 1][1], r)
        if len(members[b]) * 8 > len(big):
            big += members[b]
            big.sort()
        else:
            for item in members[b]:
                bisect.insort(big, item)
        owner[b], members[b] = a, []
    return far


RUNS = pa.schema([("part", pa.int32()), ("run", pa.binary())])
_HEAD = "<HHH16si"  # shared prefix, rest, left side; key, position


def _encoded(items: list[tuple[bytes, bytes, bytes, int]]) -> bytes:
    pack = struct.Struct(_HEAD).pack
    shared, rest = front_code([x[0] for x in items])
    return b"".join(pack(n, len(r), len(x[1]), x[2], x[3]) + r + x[1] for n, r, x in zip(shared, rest, items))


def sorted_runs(texts: DataFrame, parts: int, params: RepeatParams) -> DataFrame:
    """Front-coded runs (part, run) from rows (key, text, anchors): each worker sorts the suffixes at its anchors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            numbers, blobs = [], []
            for part, items in held.items():
                items.sort()
                numbers.append(part)
                blobs.append(_encoded(items))
            return rows(RUNS, [numbers, blobs])

        for batch in batches:
            for key, text, places in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                data = text.encode()
                for place in places:
                    at, part = place["at"], (place["hash"] >> 20) % parts
                    held.setdefault(part, []).append((data[at : at + params.length], data[max(0, at - params.length + params.gram) : at][::-1], key, at))
                    size += 700
            if size > 48 << 20:
                yield packed()
                held, size = {}, 0
        if held:
            yield packed()

    return texts.select("key", "text", "places").mapInArrow(task, "part int, run binary")


def _decoded(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    at, last, head = 0, b"", struct.Struct(_HEAD)
    while at < len(run):
        shared, rest, side, key, place = head.unpack_from(run, at)
        at += head.size
        last = last[:shared] + run[at : at + rest]
        at += rest
        yield shared, last, (run[at : at + side], key, place)
        at += side


def repeated_spans(runs: DataFrame, params: RepeatParams) -> DataFrame:
    """(key, kind, start, stop) of the repeated strings around each anchor, from the merged runs; kind 0: of ``length`` bytes or more, 1: of ``passage``."""
    schema = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    lengths = (params.length, params.passage)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist()):
                parts.setdefault(part, []).append(run)
        out: list[tuple[bytes, int, int, int]] = []

        def close(group: list) -> None:
            if len(group) < 2:
                return
            # Anchors with equal bytes on both sides repeat in full; one of them stands for all against the others.
            alike: dict[tuple[bytes, bytes], list[int]] = {}
            for i, (_, suffix, (side, _, _)) in enumerate(group):
                alike.setdefault((suffix, side), []).append(i)
            chosen = sorted(v[0] for v in alike.values())
            shared, low = [], 1 << 30
            wanted = set(chosen)
            for i, x in enumerate(group):
                low = min(low, x[0]) if i else 0
                if i in wanted:
                    shared.append(low)
                    low = 1 << 30
            far = reaches([group[i][1] for i in chosen], shared, [group[i][2][0] for i in chosen], lengths)
            for kind, (length, (lefts, rights)) in enumerate(zip(lengths, far)):
                for i, a, b in zip(chosen, lefts, rights):
                    suffix, (side, _, _) = group[i][1], group[i][2]
                    members = alike[suffix, side]
                    if len(members) > 1 and len(suffix) + len(side) >= length:
                        a, b = len(side), len(suffix)
                    if a + b >= length:
                        out.extend((group[j][2][1], kind, group[j][2][2] - a, group[j][2][2] + b) for j in members)

        for blobs in parts.values():
            group: list = []
            for item in LoserTree([_decoded(x) for x in blobs]):
                if item[0] < params.gram and group:
                    close(group)
                    group = []
                group.append(item)
                if len(out) > 200_000:
                    yield rows(schema, [[x[i] for x in out] for i in range(4)])
                    out.clear()
            close(group)
        yield rows(schema, [[x[i] for x in out] for i in range(4)])

    return runs.repartition(partitions(runs.sparkSession), "part").mapInArrow(task, "key binary, kind int, start long, stop long")


def _key(text: Column) -> Column:
    """``text_key`` as an expression: the first 16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _covered(size: int, whole: bool, found: list[tuple[int, int]]) -> list[list[int]]:
    """The maximal runs of spans that overlap or touch."""
    runs: list[list[int]] = [[0, size]] if whole else []
    for start, stop in sorted(found) if not whole else []:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return runs


def removal(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, n_repeated and the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. n_repeated counts the bytes that
    strings of ``passage`` bytes cover in the same way; these are told, not removed. Null text: no bytes. Rows with
    equal texts repeat one another in full. A null doc_id and repeated rows are answered like others; matches never cross
    texts; texts are read whole; the empty table gives none. Texts too short for a passage are not shuffled.
    """
    spark = docs.sparkSession
    base = narrow(docs, "doc_id", "text")
    parts = 4 * partitions(spark)
    enough = F.octet_length("text") >= params.passage
    long = base.where(enough).withColumn("key", _key(F.col("text")))
    places = materialize(repeated_anchors(anchor_index(long.select("text"), parts, params)), "anchors")
    by_text = places.groupBy("key").agg(F.collect_list(F.struct("at", "hash")).alias("places"))
    once = long.select("key", "text").mapInArrow(_first_of_each, "key binary, text string")
    texts = once.join(by_text, "key").dropDuplicates(["key"])
    spans = materialize(repeated_spans(sorted_runs(texts, parts, params), params), "spans")
    copies = long.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    marks = spans.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("spans"))
    marks = marks.join(copies, "key", "full_outer")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64()), ("kept", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "text", 4 << 20):
            columns: list[list] = [[], [], [], [], [], []]
            for text, copied, found in zip(batch.column("text").to_pylist(), batch.column("copied").to_pylist(), batch.column("spans").to_pylist()):
                data, kinds = text.encode(), ([], [])
                for x in found or []:
                    kinds[x["kind"]].append((x["start"], x["stop"]))
                runs = _covered(len(data), bool(copied) and len(data) >= params.length, kinds[0])
                told = sum(b - a for a, b in _covered(len(data), bool(copied) and len(data) >= params.passage, kinds[1]))
                kept, at = [], 0
                for start, stop in runs:
                    kept.append(data[at:start])
                    at = stop
                kept = b"".join([*kept, data[at:]])
                for column, value in zip(columns, (len(data), len(data) - len(kept), len(runs), sha256(kept).hexdigest(), told, kept)):
                    column.append(value)
            yield rows(out, [batch.column("doc_id"), *columns])

    own = long.join(marks, "key", "left").select("doc_id", "text", "copied", "spans")
    short = base.where(~enough).select("doc_id", "text", F.lit(None).cast("boolean").alias("copied"), F.lit(None).cast(own.schema["spans"].dataType).alias("spans"))
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary"
    return own.union(short).mapInArrow(task, names)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a worker's further copies of a text, so a hot text's copies never travel together."""
    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        keep = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.take(pa.array(keep, pa.int64()))
