"""Line dedup by a segment-partition edit join.

Two lines within edit distance t share at least one of t + 1 segments exactly, at a place shifted by t at most. Every
distinct line is indexed under its t + 1 segments and its length, and probes the index with the substrings that a segment
of a line up to t shorter could be. What meets is verified by a bit-parallel edit distance inside the band of width t.
Distinct lines go through the join once, however many documents hold them.

Pairs are spelled out for short lists only. The lines of a crowded list are linked where they meet, and only links that
connect go out: what is left of its lines without what they share is partitioned anew, for the whole error budget is left to
it, until few lines meet or little is left of them. A list beyond ``crowd`` lines is dealt over tasks by such a split first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.llm.components import components, find_root, join_roots
from tallyframe.llm.shared import binary16, bound_batches, grouped, materialize, partitions, release, rows, small_side, trimmed
from tallyframe.llm.shingles import mix, powers


@dataclass(frozen=True)
class LineParams:
    distance: int = 2
    line_chars: int = 24  # shorter lines meet by equality only
    rare_chars: int = 12  # a line shorter than that may repeat by chance: it goes if it stands in ``documents`` documents
    documents: int = 3
    crowd: int = 65_536  # lines of one list beyond which it is dealt over tasks by a further common segment


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, size) of the even partition of a line; the last ones take what is left over."""
    small, more = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        size = small + (i >= count - more)
        out.append((at, size))
        at += size
    return out


def probes(length: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings to look up for a line of ``length``.

    Lines as long or shorter are probed, so each pair meets from its longer side. A segment is sought only at shifts that
    leave few enough errors to its left and to its right.
    """
    out = []
    for other in range(max(0, length - distance), length + 1):
        gap = length - other
        for i, (start, size) in enumerate(segments(other, distance + 1)):
            low = max(0, start - i, start + gap - (distance - i))
            high = min(length - size, start + i, start + gap + (distance - i))
            out += [(other, i, at, size) for at in range(low, high + 1)]
    return out


def edit_within(a: str, b: str, limit: int) -> int:
    """Edit distance of two lines, or limit + 1 if above, in a band of 2 * limit + 1 diagonals.

    Register e holds a bit per diagonal of the current column: the cells reached with e errors at most. A column takes a
    few operations on words as wide as the band.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    cut = 0
    while cut < stop - start and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[start : len(a) - cut], b[start : len(b) - cut]
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (i + limit)
    band = (1 << (2 * limit + 1)) - 1
    reached = [((1 << (e + 1)) - 1) << limit & band for e in range(limit + 1)]  # column 0: the first e rows
    for j, c in enumerate(b):
        same = masks.get(c, 0) >> j & band
        before = reached[0]
        reached[0] = before & same
        for e in range(1, limit + 1):
            own = reached[e]
            reached[e] = (own & same | before | before >> 1 | reached[e - 1] << 1) & band
            before = own
        if not reached[limit]:
            return limit + 1
    last = len(a) - len(b) + limit
    return next((e for e in range(limit + 1) if reached[e] >> last & 1), limit + 1)


def line_key(line: str) -> bytes:
    """128 bits that name a line."""
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


ENTRY = np.dtype([("sign", "<u8"), ("key", "V16"), ("parity", "<u4"), ("probe", "u1")])


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block of lines, where each line starts, and the lines' lengths."""
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    return data, np.cumsum(sizes) - sizes, sizes


def parities(lines: list[str]) -> np.ndarray:
    """For each line, which of 32 classes of characters occur an odd number of times."""
    data, starts, sizes = _points(lines)
    bits = np.append(np.uint32(1) << (mix(data) >> np.uint64(59)).astype(np.uint32), np.uint32(0))
    return np.where(sizes > 0, np.bitwise_xor.reduceat(bits, starts), np.uint32(0)) if lines else np.empty(0, np.uint32)


def signs(lines: list[str], distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries of a block of lines: the line's number, the plan's row (place, size, tag, probe), the segment's sign."""
    data, starts, sizes = _points(lines)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=total[1:])
    plans = [_plan(n, distance) for n in sizes.tolist()]
    plan = np.concatenate(plans) if plans else np.empty((0, 4), dtype=np.int64)
    who = np.repeat(np.arange(len(lines)), [len(x) for x in plans])
    first = starts[who] + plan[:, 0]
    return who, plan, mix(((total[first + plan[:, 1]] - total[first]) * down[first]) ^ mix(plan[:, 2].astype(np.uint64)))


def entries(lines: list[str], keys: list[bytes], distance: int) -> np.ndarray:
    """Index and probe entries of a block of lines, with the parities of their character counts."""
    who, plan, sign = signs(lines, distance)
    out = np.empty(len(plan), dtype=ENTRY)
    out["sign"], out["key"], out["parity"], out["probe"] = sign, np.frombuffer(b"".join(keys), dtype="V16")[who], parities(lines)[who], plan[:, 3]
    return out


def split_further(wanted: np.ndarray, lines: list[str], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, finer sign) of lines that meet in the lists ``wanted`` (a sign per line).

    Without the common segment, what is left of two lines of a list is within the distance as well, so it shares a segment
    of its own partition. The indexed side's length is one in a list; the probing side seeks that length only.
    """
    who, plan, sign = signs(lines, distance)
    here = np.flatnonzero(sign == wanted[who])
    who, plan, sign = who[here], plan[here], sign[here]
    rests = [lines[k][:a] + lines[k][a + n :] for k, (a, n) in zip(who.tolist(), plan[:, :2].tolist())]
    number, finer, own = signs(rests, distance)
    tag = finer[:, 2] // 64  # the indexed length that a finer entry is for
    target = plan[:, 2] // 64 - plan[:, 1]
    keep = (tag == target[number]) & (finer[:, 3] == plan[number, 3])
    number, own = number[keep], own[keep]
    return who[number], mix(own ^ mix(sign[number]))


@lru_cache(maxsize=20_000)
def _plan(length: int, distance: int) -> np.ndarray:
    """(place, size, tag of indexed length and segment, probe) of all entries of a line of ``length``."""
    own = [(at, size, length * 64 + i, 0) for i, (at, size) in enumerate(segments(length, distance + 1))]
    return np.array(own + [(at, size, other * 64 + i, 1) for other, i, at, size in probes(length, distance)], dtype=np.int64)


def _lines(text: str, least: int) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate(text.split("\n")) if len(x) >= least and not x.isspace()]


def occurrences(base: DataFrame, params: LineParams) -> DataFrame:
    """(key, ident, doc_id, line, lead, rare) of every line that is not blank.

    lead: the first of its key in the document; rare: so short that it takes several documents to go.
    """
    schema = pa.schema([("key", pa.binary()), ("ident", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int64()), ("lead", pa.bool_()), ("rare", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for ident, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("ident", "doc_id", "text"))):
                seen = set()
                for i, line in _lines(text, 1):
                    key = line_key(line)
                    for column, value in zip(out, (key, ident, doc_id, i, key not in seen, len(line) < params.rare_chars)):
                        column.append(value)
                    seen.add(key)
            yield rows(schema, out)

    return base.select("ident", "doc_id", "text").mapInArrow(trimmed(task), "key binary, ident binary, doc_id long, line long, lead boolean, rare boolean")


def _blocks(batches: Iterator[pa.RecordBatch], params: LineParams, chars: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Lines and keys, new ones of a worker only, about ``chars`` characters at a time."""
    lines, keys, size, seen = [], [], 0, set()
    for batch in grouped(batches, "text", 1 << 20):
        for text in batch.column("text").to_pylist():
            for _, line in _lines(text, params.line_chars):
                key = line_key(line)
                if key not in seen:
                    seen.add(key)
                    lines.append(line)
                    keys.append(key)
                    size += len(line)
            if size >= chars:
                yield lines, keys
                lines, keys, size = [], [], 0
        if len(seen) > 300_000:
            seen.clear()
    if lines:
        yield lines, keys


def index(base: DataFrame, parts: int, params: LineParams) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, keys in _blocks(batches, params, 500_000):
            e = entries(lines, keys, params.distance)
            part = ((e["sign"] >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            e, part = e[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            blobs = [b"".join(np.ascontiguousarray(e[n][a:b]).tobytes() for n in ENTRY.names) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return base.select("text").mapInArrow(trimmed(task), "part int, entries binary")


FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sign", pa.int64()), ("size", pa.int64())])


def candidates(indexed: DataFrame, params: LineParams) -> DataFrame:
    """What meets at a segment: (a, b) keys of lines whose character counts differ in few enough parities.

    A list whose product is a multiple of its size gives its members instead: (a, null, sign, size).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = []
        for batch in batches:
            for blob in batch.column("entries").to_pylist():
                count, at = len(blob) // ENTRY.itemsize, 0
                entry = np.empty(count, dtype=ENTRY)
                for n in ENTRY.names:
                    entry[n] = np.frombuffer(blob, dtype=ENTRY[n], count=count, offset=at)
                    at += count * ENTRY[n].itemsize
                held.append(entry)
        if not held:
            return
        e = np.concatenate(held)
        del held
        sign, probe, bits = e["sign"], e["probe"], e["parity"]
        halves = np.ascontiguousarray(e["key"]).view("<u8").reshape(-1, 2)
        del e
        order = np.lexsort((halves[:, 0], halves[:, 1], probe, sign))
        sign, probe, bits, halves = sign[order], probe[order], bits[order], halves[order]
        new = np.concatenate([[True], (sign[1:] != sign[:-1]) | (probe[1:] != probe[:-1]) | (halves[1:] != halves[:-1]).any(axis=1)])
        sign, probe, bits, halves = sign[new], probe[new], bits[new], halves[new]
        edges = np.append(np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])), len(sign))
        indexed_here = np.add.reduceat((probe == 0).astype(np.int64), edges[:-1])
        sizes = np.diff(edges)
        # A line always meets its own probe; lists with nothing else drop out at once.
        own_only = (halves[edges[:-1]] == halves[edges[1:] - 1]).all(axis=1)
        open_lists = np.flatnonzero((indexed_here > 0) & (sizes > indexed_here) & ((sizes > 2) | ~own_only))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for k in open_lists.tolist():
            a, b, m = int(edges[k]), int(edges[k + 1]), int(indexed_here[k])
            if m * (b - a - m) > 8 * (b - a):
                members = np.unique(halves[a:b], axis=0)
                none = pa.nulls(len(members), pa.binary())
                yield rows(FOUND, [binary16(members.view("V16").ravel()), none, np.full(len(members), sign[a]).view(np.int64).tolist(), [len(members)] * len(members)])
                continue
            for i in range(a, a + m):  # one row of the product at a time
                near = np.bitwise_count(bits[a + m : b] ^ bits[i]) <= 2 * params.distance
                near &= (halves[a + m : b] != halves[i]).any(axis=1)
                hits = a + m + np.flatnonzero(near)
                if len(hits):
                    out.append((np.full(len(hits), i), hits))
                    count += len(hits)
            if count > 200_000:
                yield _pairs(halves, out)
                out, count = [], 0
        if out:
            yield _pairs(halves, out)

    return indexed.repartition(partitions(indexed.sparkSession), "part").mapInArrow(trimmed(task), "a binary, b binary, sign long, size long")


def _pairs(halves: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct pairs of keys, each in one order of the two."""
    i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    swap = (halves[i, 0] > halves[j, 0]) | (halves[i, 0] == halves[j, 0]) & (halves[i, 1] > halves[j, 1])
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    both = np.unique(np.concatenate([halves[i], halves[j]], axis=1), axis=0)
    none = pa.nulls(len(both), pa.int64())
    return rows(FOUND, [binary16(np.ascontiguousarray(both[:, k : k + 2]).view("V16").ravel()) for k in (0, 2)] + [none, none])


def link_crowd(keys: list[bytes], lines: list[str], parent: dict, distance: int) -> list[tuple[bytes, bytes]]:
    """Links that connect the lines of a list, beyond what ``parent`` connects already.

    What all lines begin and end with changes no distance and is put aside. What is left is partitioned anew, so that only
    lines with a further common segment meet, without that segment; short rests meet where they agree after as many
    deletions on either side as the distance allows. So lines that are alike but for a number or two are not compared with
    one another, unless the numbers are alike. Lists that have become short are compared outright, most pairs by the parities
    of their grams alone: an edit changes no more than six.
    """
    out: list[tuple[bytes, bytes]] = []
    root = lambda i: find_root(parent, keys[i])
    bits, sizes = gram_parities(lines), np.array([len(x) for x in lines])

    def meet(members: list[int]) -> None:
        """Compares what is not connected yet and agrees in all but so few parities."""
        at, names = np.array(members), {}
        label = np.array([names.setdefault(root(i), len(names)) for i in members])
        own, size = bits[at], sizes[at]
        for k in range(len(members) - 1):
            near = (label[k + 1 :] != label[k]) & (np.abs(size[k + 1 :] - size[k]) <= distance)
            if not near.any():
                continue
            left = k + 1 + np.flatnonzero(near)
            left = left[np.bitwise_count(own[left] ^ own[k]).sum(axis=1) <= 2 * _GRAM * distance]
            for j in left.tolist():
                if label[j] != label[k] and edit_within(lines[at[k]], lines[at[j]], distance) <= distance:
                    label[label == label[j]] = label[k]
                    join_roots(parent, keys[at[k]], keys[at[j]])
                    out.append((keys[at[k]], keys[at[j]]))

    todo = [[(i, x) for i, x in enumerate(lines)]]
    while todo:
        entries = todo.pop()
        members = {i for i, _ in entries}
        if len({root(i) for i in members}) < 2:
            continue
        if len(members) <= _FEW:
            meet(sorted(members))
            continue
        entries = _trimmed(entries)
        longest = max(len(x) for _, x in entries)
        met: dict = {}
        if longest <= _SHORT:
            for i, x in entries:
                for rest in _shortened(x, distance):
                    met.setdefault(rest, set()).add(i)
            for _, group in sorted(met.items(), key=lambda x: -len(x[0])):  # the more is left, the nearer the lines are
                if len(group) > 1:
                    meet(sorted(group))
            continue
        for i, x in entries:
            for k, (at, size) in enumerate(segments(len(x), distance + 1)):
                met.setdefault((len(x), k, x[at : at + size]), ([], []))[0].append((i, x[:at] + x[at + size :]))
        for i, x in entries:
            for other, k, at, size in _probes(len(x), distance):
                found = met.get((other, k, x[at : at + size]))
                if found is not None:
                    found[1].append((i, x[:at] + x[at + size :]))
        for mine, others in met.values():
            group = list(dict.fromkeys([*mine, *others]))
            if len({i for i, _ in group}) > 1:
                todo.append(group)
    return out


_FEW, _SHORT = 4_096, 12  # lists of so many lines are compared by parities; rests of so many characters meet by deletions
_GRAM = 3
_probes = lru_cache(maxsize=4_096)(probes)


def gram_parities(lines: list[str]) -> np.ndarray:
    """For each line, which of 256 classes of grams of three characters occur an odd number of times: four words a line."""
    data, starts, sizes = _points(lines)
    grams = np.zeros(len(data) + 1, dtype=np.uint64)
    if len(data) >= _GRAM:
        whole = mix(mix(mix(data[:-2]) ^ data[1:-1]) ^ data[2:])
        grams[: len(whole)] = whole
    kind = (grams >> np.uint64(56)).astype(np.int64)
    there = np.ones(len(grams), dtype=bool)
    for back in range(1, _GRAM):  # grams that would reach into the next line
        there[(starts + sizes - back)[sizes >= back]] = False
    there[-1] = False
    flag = np.where(there, np.uint64(1) << (kind & 63).astype(np.uint64), np.uint64(0))
    words = [np.bitwise_xor.reduceat(np.where(kind >> 6 == w, flag, np.uint64(0)), starts) for w in range(4)]
    return np.where(sizes[:, None] > 0, np.stack(words, axis=1), np.uint64(0))


def _trimmed(entries: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Without what all begin with and, of the rest, all end with."""

    def shared(texts: list[str]) -> int:
        low, high = min(texts), max(texts)
        return next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))

    start = shared([x for _, x in entries])
    rests = [x[start:] for _, x in entries]
    stop = shared([x[::-1] for x in rests])
    return list(dict.fromkeys((i, x[: len(x) - stop]) for (i, _), x in zip(entries, rests)))


def _shortened(text: str, deletions: int) -> set[str]:
    """The text and whatever is left of it after up to so many deletions."""
    out = now = {text}
    for _ in range(deletions):
        now = {x[:k] + x[k + 1 :] for x in now for k in range(len(x))}
        out = out | now
    return out


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def crowded_links(members: DataFrame, texts: DataFrame, params: LineParams) -> DataFrame:
    """(a, b) keys that connect the lines of crowded lists; ``members`` has (key, sign, size), ``texts`` (key, text)."""
    told = members.join(texts, "key").select("sign", "key", "text", "size")

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large = np.asarray(batch.column("size").to_numpy(zero_copy_only=False)) > params.crowd
            batch = batch.select(["sign", "key", "text"])
            yield batch.filter(pa.array(~large))
            batch = batch.filter(pa.array(large))
            who, sign = split_further(batch.column("sign").to_numpy().view(np.uint64), batch.column("text").to_pylist(), params.distance)
            made = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), made.column("key"), made.column("text")], names=["sign", "key", "text"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        sign, held = None, {}

        def done() -> pa.RecordBatch:
            found = link_crowd(list(held), list(held.values()), parent, params.distance) if len(held) > 1 else []
            return rows(LINKS, [[x[i] for x in found] for i in (0, 1)])

        for batch in batches:
            for s, key, text in zip(*(batch.column(c).to_pylist() for c in ("sign", "key", "text"))):
                if s != sign:
                    yield done()
                    sign, held = s, {}
                    if len(parent) > 1_000_000:
                        parent.clear()
                held[key] = text
        yield done()

    spread = told.mapInArrow(finer, "sign long, key binary, text string").repartition(partitions(members.sparkSession), "sign").sortWithinPartitions("sign")
    return spread.mapInArrow(trimmed(task), "a binary, b binary")


def links(base: DataFrame, params: LineParams) -> DataFrame:
    """(a, b) keys of different lines that connect what the edit distance connects."""
    spark = base.sparkSession
    found = materialize(candidates(index(base, 4 * partitions(spark), params), params), "line-pairs")
    pairs, members = found.where("sign is null").select("a", "b").distinct(), found.where("sign is not null").select(F.col("a").alias("key"), "sign", "size")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, keys in _blocks(batches, params, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lines, pa.string())], names=["key", "text"])

    wanted = small_side(found.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    texts = base.select("text").mapInArrow(trimmed(told), "key binary, text string").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    texts = materialize(texts, "line-texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_within(x, y, params.distance) <= params.distance for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    near = both.select("a", "b", "ta", "tb").mapInArrow(verified, "a binary, b binary")
    return materialize(near.union(crowded_links(members, texts, params)), "line-links")


def _removals(slim: DataFrame, params: LineParams) -> DataFrame:
    """(ident, removed, n_linked) of the documents that have a repeated or linked line."""
    found = materialize(occurrences(slim, params).distinct(), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ident", "line")
    keys = found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("documents"), F.bool_and("rare").alias("rare"))
    keys = materialize(keys.join(components(links(slim, params)).withColumnRenamed("node", "key"), "key", "left").where("n > 1 or component is not null"), "line-keys")
    goes = ~F.col("rare") | (F.col("documents") >= params.documents)
    alone = keys.where(F.col("component").isNull() & goes).select("key", "first", F.lit(False).alias("linked"), "n")
    of = keys.where("component is not null").groupBy("component").agg(F.min("first").alias("first"))
    shared = keys.where("component is not null").select("key", "component", "n").join(of, "component").select("key", "first", F.lit(True).alias("linked"), "n")
    told = materialize(alone.union(shared), "line-told")
    # At most a thousand lines hold a thousandth of all occurrences each: these are broadcast, the others spread well.
    hot = told.where(F.col("n") >= F.lit(max(1, found.count() // 1000))).drop("n")
    marks = found.select("key", "ident", place.alias("place"))
    often = marks.join(F.broadcast(hot), "key")
    seldom = marks.join(F.broadcast(hot.select("key")), "key", "left_anti").join(told.drop("n"), "key")
    return often.unionByName(seldom).groupBy("ident").agg(F.array_sort(F.collect_set(F.when(F.col("place") != F.col("first"), F.col("place.line")))).alias("removed"), F.count_if("linked").alias("n_linked"))


def _dedup(docs: DataFrame, params: LineParams) -> DataFrame:
    """``dedup`` with the rows of ``docs`` as a struct, so that no name of theirs can clash: (own, text, lines)."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), ident.alias("ident"))
    lost = _removals(base.select("ident", "doc_id", "text"), params)
    out = base.drop("doc_id").join(lost, "ident", "left")
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    # Removed lines are blanked out by position, which stays linear in the text: a map of their numbers is never searched.
    kept = F.when(F.size(removed) == 0, F.col("text")).otherwise(_without(F.col("text"), removed))
    of = F.struct(F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), removed.alias("removed"), kept.alias("kept"))
    return out.select("own", "text", of.alias("lines"))


def dedup(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with a struct ``_lines``: n_lines, n_removed, n_linked, removed (line numbers), kept (the text left).

    A line goes if a line of its class stands earlier, by doc_id (nulls last) and line number; one below ``rare_chars`` only
    if it stands in ``documents`` documents or more. Blank lines stay. Classes: equal lines; those of ``line_chars`` or more
    also linked, over others too, by an edit distance of ``distance`` at most. n_linked counts the lines that have a
    different line in their class. Null or empty text: one empty line, kept. Rows that repeat both id and text
    count as one and get the same answer. Other columns are not read; the empty table gives none.
    """
    if "_lines" in docs.columns:
        raise ValueError("the result's column _lines is taken")
    return _dedup(docs, params).select("own.*", F.col("lines").alias("_lines"))


@F.arrow_udf(StringType())
def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for t, gone in zip(text.to_pylist(), removed.to_pylist()):
        gone = set(gone)
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pa.array(out, pa.string())


def drop_repeated(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and ``n_chars`` told anew; a row goes if nothing is left of it."""
    done = _dedup(docs, params)
    whole, kept = F.col("lines.n_removed") == 0, F.col("lines.kept")
    done = done.where(whole | (F.btrim(kept, F.lit(" \t\n\x0b\x0c\r")) != ""))
    own = {c: F.col("own").getField(c) for c in docs.columns}
    anew = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return done.select(*[F.when(whole, own[c]).otherwise(anew[c]).alias(c) if c in anew else own[c].alias(c) for c in docs.columns])
