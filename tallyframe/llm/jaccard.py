"""Exact Jaccard self-join of shingle sets, with skipping by set relations.

Sets are ordered by one global order of shingles, rare ones first by exact counts over the whole table and the frequent ones
last, and each set is indexed under its prefix: two sets that are similar enough share shingles there. Shingles that occur
once have no lists. A long list is sorted into blocks of one size, by position within a block;
for each set the blocks of other sizes, and within a block the positions, that cannot reach the overlap are skipped whole.
Shared prefix shingles are counted per pair, which leaves few pairs to verify.
Frequent shingles have no lists. Each has a pivot, the least set that holds it, so near copies share one; a set is compared
once with each pivot of its prefix, and its answers are then derived from the pivot's computed ones: from |a & p| and
|b & p| follow bounds of |a & b|; pairs that are connected already, or whose bounds decide them, are skipped, and only the
rest is verified, block against block of a pivot's sets. So it goes with other shingles that more than ``longest`` sets hold:
they keep their place in the order, but of their list only the least set, their pivot, makes pairs, one with each other set.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components, find_root, join_roots
from tallyframe.llm.shared import binary16, bound_batches, grouped, materialize, narrow, partitions, release, rows, small_side, trimmed
from tallyframe.llm.shingles import set_key, shingle_sets


_GROUP = 450_000  # bytes of texts that are hashed at once


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    percent: int = 75
    frequent: int = 16  # sets that hold a shingle, from which on it may count as frequent
    locally: int = 2  # and of these within one worker's block of sets
    most_frequent: int = 1_000_000  # so many are broadcast at most (8 MB); the order stays exact with any choice
    longest: int = 16  # sets that hold a shingle (254 at most), from which on its list makes pairs with a pivot only
    block_tokens: int = 1 << 19
    group: int = 2_000  # sets of one pivot that a task compares with as many others


def overlap_needed(percent: int, m, n):
    """The least intersection of sets of m and n members that reaches the similarity."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_length(percent: int, n):
    return n - (-(-percent * n // 100)) + 1


class Sets:
    """Distinct sets of a worker's block: tokens by key."""

    def __init__(self, params: JaccardParams):
        self.params = params

    def blocks(self, batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[list], list[np.ndarray]]]:
        """Values of ``columns`` and the sets of the texts, about ``block_tokens`` members at a time."""
        held, sets, size = [[] for _ in columns], [], 0
        for batch in grouped(batches, "text", _GROUP):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary())]
            for values, name in zip(held, columns):
                values += batch.column(name).to_pylist()
            for tokens in shingle_sets(texts, self.params.words):
                sets.append(tokens)
                size += len(tokens)
            if size >= self.params.block_tokens:
                yield held, sets
                held, sets, size = [[] for _ in columns], [], 0
        if sets:
            yield held, sets


PROFILE = pa.schema([("ident", pa.binary()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("token", pa.int64()), ("held", pa.int64())])


def profile(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """A row per document (ident, doc_id, key of its set, n) and a row per shingle that is frequent in a block (token, held, key of the least set with it)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (idents, ids), sets in Sets(params).blocks(batches, "ident", "doc_id"):
            keys = [set_key(s) if len(s) else None for s in sets]
            distinct = sorted({k: s for k, s in zip(keys, sets) if k is not None}.items())
            tokens, first, held = np.unique(np.concatenate([*[s for _, s in distinct], np.empty(0, np.uint64)]), return_index=True, return_counts=True)
            often = held >= params.locally
            owner = np.searchsorted(np.cumsum([len(s) for _, s in distinct]), first[often], side="right")
            tokens, held = tokens[often].view(np.int64), held[often]
            none, zero = [None] * len(tokens), [None] * len(ids)
            yield rows(PROFILE, [idents + none, ids + none, keys + [distinct[k][0] for k in owner.tolist()], [len(s) for s in sets] + none, zero + tokens.tolist(), zero + held.tolist()])

    return materialize(docs.mapInArrow(trimmed(task), "ident binary, doc_id long, key binary, n long, token long, held long"), "sets")


class Frequent:
    """Frequent shingles, sorted, with the number of each one's pivot, and the pivots' keys: a bounded table."""

    def __init__(self, tokens: list[int], pivots: list[bytes]):
        values = np.array(tokens, dtype=np.int64).view(np.uint64)
        order = np.argsort(values)
        self.keys = sorted(set(pivots))
        number = {k: i for i, k in enumerate(self.keys)}
        self.tokens, self.pivots = values[order], np.array([number[p] for p in pivots], dtype=np.int64)[order]


def frequent_shingles(sets: DataFrame, params: JaccardParams) -> Frequent:
    """The most frequent shingles: a bounded list, which steers the order and nothing else."""
    counted = sets.where("token is not null").groupBy("token").agg(F.sum("held").alias("held"), F.min("key").alias("key")).where(F.col("held") >= params.frequent)
    found = counted.orderBy(F.desc("held"), "token").limit(params.most_frequent).select("token", "key").toArrow()
    return Frequent(found.column(0).to_pylist(), found.column(1).to_pylist())


def _in_sorted(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


ENTRY = np.dtype([("token", "<u8"), ("key", "V16"), ("n", "<i4"), ("at", "<i4"), ("hot", "<i4")])
_STAR, _LONG = -1, -2  # instead of a position: the token is a pivot's number, the token's list is a long one


def _numbered(batches: Iterator[pa.RecordBatch], params: JaccardParams) -> Iterator[tuple[int, dict[bytes, np.ndarray], list[str]]]:
    """Blocks of distinct sets with their texts, under an id that every pass over the same partition gives them again; it holds the sets, so other partitions are noticed."""
    part = TaskContext.get().partitionId()
    for at, ((texts,), sets) in enumerate(Sets(params).blocks(batches, "text")):
        distinct, told = {}, []
        for s, t in zip(sets, texts):
            key = set_key(s) if len(s) else None
            if key is not None and key not in distinct:
                distinct[key] = s
                told.append(t)
        yield int.from_bytes(blake2b(f"{part} {at} ".encode() + b"".join(distinct), digest_size=8).digest(), "little") >> 1, distinct, told


def _slices(tokens: np.ndarray, parts: int) -> list[int]:
    """Where the parts of a sorted array of tokens begin and end: a part is a range of values."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]


ASKED = "part int, block long, tokens binary, several binary"
TOLD = "block long, part int, told binary"


def token_counts(docs: DataFrame, parts: int, params: JaccardParams) -> DataFrame:
    """For each block and part, in how many sets of the whole table each of the block's tokens is (255 at most); and each block's texts.

    Tokens travel as the 6 bytes that are not given by the part; those that agree in them count as one, for every block.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, distinct, _ in _numbered(batches, params):
            tokens, held = np.unique(np.concatenate([*distinct.values(), np.empty(0, np.uint64)]), return_counts=True)
            cuts = _slices(tokens, parts)
            short = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6])
            out: list[list] = [[], [], [], []]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    at = np.flatnonzero(held[a:b] > 1)
                    for column, value in zip(out, (part, block, short[a:b].tobytes(), at.astype("<u4").tobytes() + held[a:b][at].astype("<u4").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "tokens", "several"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, list] = {}
        for batch in batches:
            for part, block, tokens, several in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "tokens", "several"))):
                held.setdefault(part, []).append((block, tokens, several))
        for part in list(held):
            found = held.pop(part)
            wide = [np.zeros((len(t) // 6, 8), dtype=np.uint8) for _, t, _ in found]
            counts = []
            for w, (_, tokens, several) in zip(wide, found):
                w[:, :6] = np.frombuffer(tokens, dtype=np.uint8).reshape(-1, 6)
                own = np.ones(len(w), dtype=np.int64)
                at = np.frombuffer(several, "<u4").reshape(2, -1)
                own[at[0]] = at[1]
                counts.append(own)
            values, where = np.unique(np.concatenate(wide).view("<u8").ravel(), return_inverse=True)
            total = np.minimum(np.bincount(where, weights=np.concatenate(counts)), 255).astype(np.uint8)[where]
            edges = np.cumsum([0, *map(len, wide)])
            for (block, _, _), a, b in zip(found, edges, edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([zlib.compress(total[a:b].tobytes(), 1)], pa.binary())], names=["block", "part", "told"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _numbered(batches, params):
            sink = pa.BufferOutputStream()
            table = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "part", "told"])

    tasks = partitions(docs.sparkSession)
    counted = docs.mapInArrow(trimmed(ask), ASKED).repartition(tasks, "part").mapInArrow(trimmed(tell), TOLD)
    return docs.mapInArrow(trimmed(home), TOLD).unionByName(counted).repartition(tasks, "block")


def prefix_index(counted: DataFrame, hot, parts: int, count_parts: int, params: JaccardParams) -> DataFrame:
    """Packed index entries: (part, entries). An entry is a prefix shingle that is in several sets, its set, the set's size, the shingle's
    position and the number of those in the prefix that have pivots. Frequent ones make one entry for each pivot: its number, at _STAR; those with long lists are at _LONG."""

    def block_entries(texts: list[str], told: dict[int, bytes]) -> np.ndarray:
        sets, part, size = [], [], 0
        for text in [*texts, None]:  # in small groups, which bounds what hashing them takes
            if part and (text is None or size > _GROUP):
                sets += shingle_sets(part, params.words)
                part, size = [], 0
            if text is not None:
                part.append(text.encode())
                size += len(part[-1])
        tokens, where = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
        counts, cuts = np.zeros(len(tokens), dtype=np.int32), _slices(tokens, count_parts)
        for part, blob in told.items():
            counts[cuts[part] : cuts[part + 1]] = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
        if len(counts) and counts.min() < 1:
            raise RuntimeError("the documents came in other partitions when they were read again")
        frequent = hot.value
        last = _in_sorted(tokens, frequent.tokens)
        rank, last = np.where(last, 256, counts)[where], last[where]
        made, at = [], 0
        for own in sets:
            n = len(own)
            ranks, often = rank[at : at + n], last[at : at + n]
            at += n
            length = prefix_length(params.percent, n)
            order = np.argsort(ranks, kind="stable")[:length]  # a set's tokens are sorted, so ties keep their order
            place = np.flatnonzero((ranks[order] > 1) & ~often[order])
            plain, common = own[order[place]], own[order[often[order]]]
            if not len(plain) and not len(common):
                continue
            key = set_key(own)
            pivots = np.unique(frequent.pivots[np.searchsorted(frequent.tokens, common)]) if len(common) else np.empty(0, np.int64)
            pivots = pivots[[frequent.keys[i] != key for i in pivots.tolist()]] if len(pivots) else pivots
            long = ranks[order[place]] > min(params.longest, 254)  # by exact counts, so in all blocks alike
            entry = np.empty(len(plain) + len(pivots), dtype=ENTRY)
            entry["token"] = np.concatenate([plain, pivots.astype(np.uint64)])
            entry["at"] = np.concatenate([np.where(long, _LONG, place), np.full(len(pivots), _STAR)])
            entry["key"], entry["n"], entry["hot"] = np.void(key), n, len(common) + int(long.sum())
            made.append(entry)
        return np.concatenate(made) if made else np.empty(0, dtype=ENTRY)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[int, dict] = {}
        for batch in batches:
            for block, part, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "told"))):
                held.setdefault(block, {})[part] = blob
        for block in list(held):
            told = held.pop(block)
            if -1 not in told:
                raise RuntimeError("the documents came in other partitions when they were read again")
            with pa.ipc.open_stream(told.pop(-1)) as source:
                entries = block_entries(source.read_all().column("text").to_pylist(), told)
            if not len(entries):
                continue
            # A pivot's sets are dealt out by their own keys, so that a hot pivot's do not meet in one task.
            spread = np.where(entries["at"] == _STAR, np.ascontiguousarray(entries["key"]).view("<u8").reshape(-1, 2)[:, 0], entries["token"])
            part = ((spread >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            # Column by column, so that repeated values lie together and compress.
            packed = [b"".join(np.ascontiguousarray(entries[name][a:b]).tobytes() for name in ENTRY.names) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["part", "entries"])

    return counted.mapInArrow(trimmed(task), "part int, entries binary")


def _unpacked(blob: bytes) -> np.ndarray:
    count = len(blob) // ENTRY.itemsize
    out, at = np.empty(count, dtype=ENTRY), 0
    for name in ENTRY.names:
        width = ENTRY[name].itemsize
        out[name] = np.frombuffer(blob, dtype=ENTRY[name], count=count, offset=at)
        at += width * count
    return out


PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("na", pa.int32()), ("nb", pa.int32()), ("ha", pa.int32()), ("hb", pa.int32()), ("shared", pa.int32()), ("star", pa.int32())])


def _passing(e: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs that pass the size and position tests."""
    m, n = e["n"][left].astype(np.int64), e["n"][right].astype(np.int64)
    i, j = e["at"][left].astype(np.int64), e["at"][right].astype(np.int64)
    room = np.minimum(i, j) + np.minimum(m - i, n - j)
    keep = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (room >= overlap_needed(percent, m, n))
    return left[keep], right[keep]


def _long_list(e: np.ndarray, start: int, stop: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one long list, in blocks of one size ordered by position.

    Of a block of size n, a set of size m at position i needs the positions from i - (m - o) to i + (n - o) only, where o is
    the overlap the two sizes need; blocks of other sizes, and the rest of a block, are skipped unread.
    """
    order = start + np.lexsort((e["at"][start:stop], e["n"][start:stop]))
    n, at = e["n"][order].astype(np.int64), e["at"][order].astype(np.int64)
    edges = np.append(np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])), len(n))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        size = int(n[a])
        low = int(np.searchsorted(n, -(-percent * size // 100)))
        who = np.arange(low, b)  # sets of this size or smaller, down to the least that can match
        need = overlap_needed(percent, n[who], size)
        first = a + np.searchsorted(at[a:b], at[who] - (n[who] - need))
        first = np.where(who >= a, np.maximum(first, who + 1), first)  # within the block each pair once
        last = a + np.searchsorted(at[a:b], at[who] + (size - need), side="right")
        many = np.maximum(last - first, 0)
        left = np.repeat(who, many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        if len(left):
            yield order[left], order[right]


def _pairs_of(e: np.ndarray, edges: np.ndarray, percent: int, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all lists (``edges`` bound them), in blocks; short lists of one length are expanded together."""
    sizes, held, count = np.diff(edges), [], 0
    for m in np.unique(sizes[sizes > 1]).tolist():
        starts = edges[:-1][sizes == m]
        if m > 16:
            blocks = (pair for a in starts.tolist() for pair in _long_list(e, a, a + m, percent))
        else:
            x, y = np.triu_indices(m, 1)
            step = max(1, limit // len(x))
            blocks = (((starts[k : k + step, None] + x).ravel(), (starts[k : k + step, None] + y).ravel()) for k in range(0, len(starts), step))
        for left, right in blocks:
            held.append(_passing(e, left, right, percent))
            count += len(held[-1][0])
            if count > limit:
                yield tuple(np.concatenate(k) for k in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(k) for k in zip(*held))


def _pair_rows(e: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """The distinct pairs of a block, each in one order of its keys, with how often it occurs."""
    swap = (keys[left, 0] > keys[right, 0]) | (keys[left, 0] == keys[right, 0]) & (keys[left, 1] > keys[right, 1])
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    order = np.lexsort((keys[right, 1], keys[right, 0], keys[left, 1], keys[left, 0]))
    left, right = left[order], right[order]
    fresh = (keys[left][1:] != keys[left][:-1]).any(axis=1) | (keys[right][1:] != keys[right][:-1]).any(axis=1)
    first = np.flatnonzero(np.concatenate([[True], fresh])[: len(left)])
    counts = np.diff(np.append(first, len(left))).astype(np.int32)
    left, right = left[first], right[first]
    values = [np.ascontiguousarray(x) for x in (e["n"][left], e["n"][right], e["hot"][left], e["hot"][right], counts, np.zeros(len(first), np.int32))]
    return rows(PAIRS, [binary16(e["key"][left]), binary16(e["key"][right]), *map(pa.array, values)])


def _star_rows(pivots: pa.Array, e: np.ndarray) -> pa.RecordBatch:
    """Pairs of a pivot and a set."""
    none = np.zeros(len(e), np.int32)
    return rows(PAIRS, [pivots, binary16(e["key"]), *map(pa.array, (none, np.ascontiguousarray(e["n"]), none, np.ascontiguousarray(e["hot"]), none, none + np.int32(1)))])


def candidate_pairs(index: DataFrame, hot, params: JaccardParams) -> DataFrame:
    """Pairs of sets that share prefix shingles, with how many; pairs of a pivot and a set (star = 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        blobs = [_unpacked(x) for batch in batches for x in batch.column("entries").to_pylist()]
        if not blobs:
            return
        e = np.concatenate(blobs)
        del blobs
        halves = np.ascontiguousarray(e["key"]).view(">u8").reshape(-1, 2).astype(np.uint64)  # in the order of the keys
        kind = np.minimum(e["at"], 0)
        order = np.lexsort((halves[:, 1], halves[:, 0], e["token"], kind))
        e, halves, kind = e[order], halves[order], kind[order]
        new = np.ones(len(e), dtype=bool)
        new[1:] = (e["token"][1:] != e["token"][:-1]) | (kind[1:] != kind[:-1])
        fresh = new.copy()  # copies of a set from other blocks go
        fresh[1:] |= (halves[1:] != halves[:-1]).any(axis=1)
        e, new, kind, halves = e[fresh], new[fresh], kind[fresh], halves[fresh]
        pivots = e[kind == _STAR]
        for k in range(0, len(pivots), 200_000):
            x = pivots[k : k + 200_000]
            yield _star_rows(pa.array([hot.value.keys[i] for i in x["token"].tolist()], pa.binary()), x)
        here = kind == _LONG
        if here.any():
            x, own, first = e[here], halves[here], np.flatnonzero(new[here])
            of = np.repeat(first, np.diff(np.append(first, len(x))))  # a list begins with its least set
            order = np.lexsort((own[:, 1], own[:, 0], own[of, 1], own[of, 0]))  # near copies share many lists: each pair once
            x, own, to = x[order], own[order], own[of][order]
            of = of[order]
            keep = (own != to).any(axis=1)
            keep[1:] &= ((own[1:] != own[:-1]) | (to[1:] != to[:-1])).any(axis=1)
            least = e[here][of[keep]]
            for k in range(0, len(least), 200_000):
                yield _star_rows(binary16(least["key"][k : k + 200_000]), x[keep][k : k + 200_000])
        e, new, halves = e[kind == 0], new[kind == 0], halves[kind == 0]
        several = np.concatenate([~new[1:], [False]])[: len(new)] | ~new
        e, new, halves = e[several], new[several], halves[several]
        for left, right in _pairs_of(e, np.append(np.flatnonzero(new), len(e)), params.percent):
            yield _pair_rows(e, halves, left, right)

    return index.repartition(partitions(index.sparkSession), "part").mapInArrow(trimmed(task), "a binary, b binary, na int, nb int, ha int, hb int, shared int, star int")


def _possible(percent: int, shared):
    """Pairs whose shared prefix shingles allow the overlap: beyond its prefix a set adds its remaining members at most."""
    needed = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    beyond = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    return shared + F.least("ha", "hb") + beyond >= needed


VERIFIED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("na", pa.int64()), ("nb", pa.int64()), ("ha", pa.int32()), ("hb", pa.int32()), ("star", pa.int32()), ("overlap", pa.int64())])


def verify(pairs: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """Adds the exact overlap of each pair; ``texts`` has (key, text)."""
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ha", "hb", "star", "ta", "tb")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def tokens(key: bytes, text: str) -> np.ndarray:
            found = known.get(key)
            if found is None:
                found = known[key] = shingle_sets([text.encode()], params.words)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            return found

        for batch in grouped(batches, "ta", 1 << 20):
            a, b, ha, hb, star, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ha", "hb", "star", "ta", "tb"))
            na, nb, overlap = [], [], []
            for x, y, s, t in zip(a, b, ta, tb):
                s, t = tokens(x, s), tokens(y, t)
                na.append(len(s)), nb.append(len(t))
                if len(s) > len(t):
                    s, t = t, s
                overlap.append(int(_in_sorted(s, t).sum()))
            yield rows(VERIFIED, [a, b, na, nb, ha, hb, star, overlap])

    return both.mapInArrow(trimmed(task), "a binary, b binary, na long, nb long, ha int, hb int, star int, overlap long")


def derived_links(verified: DataFrame, joined: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """Links (a, b) among sets that were compared with one pivot, are still apart, and that the pivot's answers leave open.

    Only pivots whose sets lie in several components are looked at, only sets outside a pivot's largest component are
    compared with its others, and only links that join two components are put out. Both sides are cut into blocks of about
    ``group`` sets, and a task compares one block with one other.
    """
    p = params.percent
    own = verified.where("star = 1").select(F.col("a").alias("pivot"), F.col("b").alias("key"), F.col("nb").alias("n"), F.col("hb").alias("hot"), "overlap")
    own = own.where("hot > 0").join(joined.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    counted = own.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    of = counted.groupBy("pivot").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("component", "n").alias("largest")).where("all > most")
    blocks = lambda n: F.ceil(n / F.lit(params.group)).cast("int")
    of = of.select("pivot", "largest", blocks(F.col("all")).alias("rights"), blocks(F.col("all") - F.col("most")).alias("lefts"))
    own = own.join(of, "pivot").join(texts, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    columns = ["pivot", "x", "y", "side", "key", "n", "hot", "overlap", "component", "largest", "text"]
    left = own.where("component <> largest").withColumns({"x": block("lefts"), "side": F.lit(0)}).withColumn("y", every("rights"))
    right = own.withColumns({"y": block("rights"), "side": F.lit(1)}).withColumn("x", every("lefts"))

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("n", "ascending"), ("key", "ascending")])
        n, hot, o, side = (table.column(x).to_numpy() for x in ("n", "hot", "overlap", "side"))
        key, c = (np.array(table.column(x).to_pylist(), dtype=object) for x in ("key", "component"))
        big, texts, known, parent, out = table.column("largest")[0].as_py(), table.column("text").to_pylist(), {}, {}, []

        def tokens(i: int) -> np.ndarray:
            if i not in known:
                known[i] = shingle_sets([texts[i].encode()], params.words)[0]
            return known[i]

        cut = int(np.searchsorted(side, 1))
        theirs = n[cut:]
        for i in range(cut):
            lo, hi = np.searchsorted(theirs, -(-p * n[i] // 100)), np.searchsorted(theirs, n[i] * 100 // p, side="right")
            j = cut + np.arange(lo, hi)
            j = j[(c[j] != c[i]) & ((c[j] == big) | (key[j] > key[i]))]
            needed = overlap_needed(p, n[i], n[j])
            most = np.minimum(o[i], o[j]) + np.minimum(n[i] - o[i], n[j] - o[j])
            held = np.minimum(hot[i], hot[j]) + -(-p * np.maximum(n[i], n[j]) // 100) - 1
            keep = (most >= needed) & (held >= needed)
            for x, need in zip(j[keep].tolist(), needed[keep].tolist()):
                if find_root(parent, c[i]) == find_root(parent, c[x]):
                    continue  # connected by now
                if int(_in_sorted(tokens(i), tokens(x)).sum()) >= need:
                    join_roots(parent, c[i], c[x])
                    out.append((key[i], key[x]))
        return pa.table([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return left.select(*columns).union(right.select(*columns)).groupBy("pivot", "x", "y").applyInArrow(group, "a binary, b binary").distinct()


def _links(base: DataFrame, sets: DataFrame, params: JaccardParams) -> DataFrame:
    """(node, component) of the keys of sets that are linked with other sets.

    ``base`` is read several times and has to give the same partitions each time; else the run fails.
    """
    spark = base.sparkSession
    parts = 4 * partitions(spark)
    hot = spark.sparkContext.broadcast(frequent_shingles(sets, params))
    found = candidate_pairs(prefix_index(token_counts(base, parts, params), hot, parts, parts, params), hot, params)
    found = found.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("ha", "hb")], F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("star").alias("star"))
    pairs = materialize(found.where((F.col("star") == 1) | _possible(params.percent, F.col("shared"))).select("a", "b", "ha", "hb", "star"), "pairs")
    texts = _texts(base, pairs, params)
    verified = materialize(verify(pairs, texts, params), "verified")
    similar = (100 * F.col("overlap") >= params.percent * (F.col("na") + F.col("nb") - F.col("overlap"))) & (F.col("overlap") > 0)
    links = verified.where(similar).select("a", "b")
    joined = components(links)
    if not verified.where("star = 1").isEmpty():
        more = materialize(derived_links(verified, joined, texts, params), "derived")
        if not more.isEmpty():
            joined = components(links.union(more))
    return joined


def _labelled(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """A row per row of ``docs`` (ident, doc_id, text): ident, doc_id, n, and the component of its set (null for an empty set)."""
    sets = profile(docs, params)
    joined = _links(docs.select("text"), sets, params)
    own = sets.where("n is not null").select("ident", "doc_id", "key", "n")
    return own.join(joined.select(F.col("node").alias("key"), "component"), "key", "left").select("ident", "doc_id", "n", F.coalesce("component", "key").alias("component"))


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Component: the least doc_id that links reach, the document's own included. Null or blank text: no shingles, no links.
    Fewer than ``words`` words: the whole sequence is the one shingle. Rows with equal sets are linked; so are repeated
    rows. A row with a null doc_id counts for links, but never names a component that has another id. Whole texts are
    read, and the empty table gives none.
    """
    own = materialize(_labelled(narrow(docs, "doc_id", "text").withColumn("ident", F.lit(b"")), params), "labelled")
    named = own.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    # A row alone in its component needs no name from it; a component of many rows is joined split by the engine.
    named = named.where("rows > 1").drop("rows")
    return own.join(named, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _texts(base: DataFrame, pairs: DataFrame, params: JaccardParams) -> DataFrame:
    """(key, text) of the sets in ``pairs``, one text each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for (texts,), sets in Sets(params).blocks(batches, "text"):
            keys = [set_key(s) if len(s) else None for s in sets]
            keep = [i for i, k in enumerate(keys) if k is not None and not (k in seen or seen.add(k))]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.binary()), pa.array([texts[i] for i in keep], pa.string())], names=["key", "text"])
            if len(seen) > 1_000_000:
                seen.clear()

    wanted = small_side(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b"))).distinct())
    return materialize(base.mapInArrow(trimmed(task), "key binary, text string").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id, null ids last, ties by a digest of id and text.

    Rows without shingles are linked with nothing and all stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), ident.alias("ident"))
    bound_batches(docs.sparkSession)
    own = materialize(_labelled(base.select("ident", "doc_id", "text"), params), "labelled")
    chosen = own.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ident")).alias("first"))
    chosen = chosen.select("first.ident")
    rows = own.where("component is not null").join(chosen, "ident", "left_semi").groupBy("ident").agg(F.count(F.lit(1)).alias("rows"))
    rows = materialize(rows.unionByName(own.where("component is null").select("ident", F.lit(0).cast("long").alias("rows")).distinct()), "kept")
    held = base.select("own", "ident")
    kept = held.join(rows.where("rows < 2"), "ident", "left_semi")
    if not rows.where("rows > 1").isEmpty():
        kept = kept.unionByName(held.join(rows.where("rows > 1"), "ident", "left_semi").dropDuplicates(["ident"]))
    return kept.select("own.*")
