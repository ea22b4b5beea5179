"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are put into classes: the corpus's most frequent words each have their own, all others share hashed ones. The
network sees the classes left and right of a word and predicts the word's own class; its parameters are fitted in NumPy to
the counts of all (left, word, right) triples of the whole corpus, which hold everything the class likelihood depends on.
P(word | class) comes from the exact counts of all words, and where the two words on each side of a token stand around
other tokens too, the counts of the words there are mixed in. Both kinds of counts lie in shards that grow with the corpus.
A document's score is the sum of the conditional log-probabilities of all its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import grouped, narrow, partitions, rows
from tallyframe.llm.shingles import mix, words


@dataclass(frozen=True)
class LmParams:
    classes: int = 128  # one of them is the edge of a document
    frequent: int = 95
    share: int = 10_000  # a word is counted where it makes up one in so many words of a worker's block
    hidden: int = 24
    epochs: int = 120
    rate: float = 0.03
    seed: int = 5
    reach: int = 2  # words on either side of a token whose windows are counted
    prior: float = 1.0  # tokens that the network's probability counts as, against a window's own counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in grouped(batches, "text", 900_000):
        texts = [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())]
        yield batch, *words(texts)


def frequent_words(docs: DataFrame, params: LmParams) -> np.ndarray:
    """Hashes of the most frequent words, sorted. Each block of a worker names the words that stand out in it, with counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts * params.share >= size
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names=["word", "n"])

        for _, hashes, _ in _blocks(batches):
            held.append(hashes)
            size += len(hashes)
            if size > 2_000_000:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    counted = docs.mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(params.frequent).select("word").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def classes_of(hashes: np.ndarray, frequent: np.ndarray, params: LmParams) -> np.ndarray:
    """1 and on: the frequent words; then the shared classes. Class 0 is the edge."""
    rest = 1 + len(frequent) + (hashes % np.uint64(params.classes - 1 - len(frequent))).astype(np.int64)
    if not len(frequent):
        return rest
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, at + 1, rest)


def _triples(hashes: np.ndarray, edges: np.ndarray, frequent: np.ndarray, params: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = classes_of(hashes, frequent, params)
    left, right = np.zeros_like(own), np.zeros_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    starts = edges[:-1][edges[:-1] < edges[1:]]
    left[starts] = 0
    right[edges[1:][edges[:-1] < edges[1:]] - 1] = 0
    return left, own, right


def triple_counts(docs: DataFrame, frequent, params: LmParams) -> np.ndarray:
    """Counts (left, right, word) over the whole corpus; its size is fixed by the number of classes."""
    v = params.classes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(v**3, dtype=np.int64), False
        for _, hashes, edges in _blocks(batches):
            left, own, right = _triples(hashes, edges, frequent.value, params)
            codes, counts = np.unique((left * v + right) * v + own, return_counts=True)
            total[codes] += counts
            seen = True
        if seen:
            total = total.reshape(v, v * v)
            packed = []
            for row in total:
                at = np.flatnonzero(row)
                packed.append(zlib.compress(at.astype("<u4").tobytes() + row[at].astype("<u8").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(v), pa.int32()), pa.array(packed, pa.binary())], names=["left", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for left, blob in zip(batch.column("left").to_pylist(), batch.column("counts").to_pylist()):
                data = zlib.decompress(blob)
                n = len(data) // 12
                row = held.setdefault(left, np.zeros(v * v, dtype=np.int64))
                row[np.frombuffer(data, "<u4", n)] += np.frombuffer(data, "<u8", n, 4 * n).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["left", "counts"])

    kinds = "left int, counts binary"
    out = np.zeros((v, v * v), dtype=np.int64)
    for row in docs.mapInArrow(task, kinds).repartition(min(v, partitions(docs.sparkSession)), "left").mapInArrow(merge, kinds).toLocalIterator():
        out[row.left] += np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    return out.reshape(v, v, v)


class WindowNetwork:
    """tanh(L[left] + R[right] + b) W + c, softmax over the classes."""

    def __init__(self, params: LmParams):
        rng, v, h = np.random.default_rng(params.seed), params.classes, params.hidden
        small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        self.w = {"l": small(v, h), "r": small(v, h), "b": np.zeros(h, np.float32), "w": small(h, v), "c": np.zeros(v, np.float32)}

    def log_probabilities(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(self.w["l"][left] + self.w["r"][right] + self.w["b"])
        z = h @ self.w["w"] + self.w["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), h

    def fit(self, counts: np.ndarray, params: LmParams) -> "WindowNetwork":
        """Adam on the mean log-likelihood of all triples, every context in every step."""
        left, right = np.nonzero(counts.sum(axis=2))
        if not len(left):
            return self
        target = counts[left, right].astype(np.float32)
        total = target.sum()
        weight = target.sum(axis=1, keepdims=True)
        self.w["c"] = np.log((target.sum(axis=0) + 1) / (total + params.classes)).astype(np.float32)
        first, second = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, params.epochs + 1):
            log_p, h = self.log_probabilities(left, right)
            dz = (weight * np.exp(log_p) - target) / total
            dh = (dz @ self.w["w"].T) * (1 - h * h)
            grad = {"w": h.T @ dz, "c": dz.sum(0), "b": dh.sum(0), "l": np.zeros_like(self.w["l"]), "r": np.zeros_like(self.w["r"])}
            np.add.at(grad["l"], left, dh)
            np.add.at(grad["r"], right, dh)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] = self.w[k] - params.rate * (1 - step / (params.epochs + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
        return self

    def table(self) -> np.ndarray:
        """Log-probabilities (left, right, word) of every context, computed once for all words."""
        v = len(self.w["c"])
        left, right = np.divmod(np.arange(v * v), v)
        return self.log_probabilities(left, right)[0].astype(np.float32).reshape(v, v, v)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of texts with their words, under an id that every pass over the same partition gives them again.

    The id holds the texts, so other partitions are noticed. Batches are cut by all columns: each pass has to read the same.
    """
    part = TaskContext.get().partitionId()
    for at, batch in enumerate(grouped(batches, "text", 4 << 20)):
        texts = [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())]
        named = blake2b(f"{part} {at} {len(texts)} ".encode(), digest_size=8)
        for text in texts:
            named.update(text)
        yield int.from_bytes(named.digest(), "little") >> 1, batch, *words(texts)


def windows(hashes: np.ndarray, edges: np.ndarray, params: LmParams) -> np.ndarray:
    """A key per token: the ``reach`` words on either side (the document's edge counts as one) above, a tag of the word below."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    context = np.zeros(len(hashes), dtype=np.uint64)
    for step in [*range(-params.reach, 0), *range(1, params.reach + 1)]:
        near = np.zeros(len(hashes), dtype=np.uint64)
        a, b = max(0, -step), min(len(hashes), len(hashes) - step)
        if a < b:
            near[a:b] = np.where(doc[a + step : b + step] == doc[a:b], hashes[a + step : b + step], np.uint64(0))
        context = mix(context + near + np.uint64(step + 64))
    return context >> np.uint64(TAG) << np.uint64(TAG) | hashes >> np.uint64(64 - TAG)


TAG = 18
ASKED = "part int, block long, words boolean, keys binary, counts binary"
TOLD = "block long, part int, words boolean, a binary, b binary"


def asked(docs: DataFrame, parts: int, params: LmParams) -> DataFrame:
    """What each block wants to know of each shard: the words it holds, with counts, and the windows of its tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, hashes, edges in _shards(batches):
            out: list[list] = [[], [], [], [], []]
            values, counts = np.unique(hashes, return_counts=True)
            for told, keys, count in ((True, values, counts.astype("<u4")), (False, windows(hashes, edges, params), None)):
                _, order, cuts = _dealt(keys, parts)
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        for column, value in zip(out, (part, block, told, keys[order[a:b]].tobytes(), count[order[a:b]].tobytes() if told else b"")):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "block", "words", "keys", "counts"])

    return docs.mapInArrow(task, ASKED)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The shard of each key (of its context only), the order that puts the keys of a shard together, and where shards begin."""
    part = (mix(keys >> np.uint64(TAG)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return part, order, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def told(asking: DataFrame, parts: int) -> DataFrame:
    """Each shard's answers: a word's count in the whole corpus; of windows whose context occurs elsewhere, both counts there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            for part, block, is_words, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "words", "keys", "counts"))):
                held.setdefault((part, is_words), []).append((block, np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4")))
        for (part, is_words), found in held.items():
            keys = np.concatenate([x[1] for x in found])
            edges = np.cumsum([0, *[len(x[1]) for x in found]])
            values, where = np.unique(keys, return_inverse=True)
            if is_words:
                total = np.bincount(where, weights=np.concatenate([x[2] for x in found])).astype("<u8")[where]
                answers = [(total[a:b].tobytes(), b"") for a, b in zip(edges, edges[1:])]
            else:
                own = np.bincount(where)
                contexts, inside = np.unique(values >> np.uint64(TAG), return_inverse=True)
                whole = np.bincount(inside, weights=own).astype(np.int64)[inside]
                answers = []
                for a, b in zip(edges, edges[1:]):
                    at = np.flatnonzero(whole[where[a:b]] > 1)
                    here = where[a:b][at]
                    answers.append((at.astype("<u4").tobytes(), np.stack([own[here] - 1, whole[here] - 1]).astype("<u8").tobytes()))
            for (block, _, _), (x, y) in zip(found, answers):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([is_words]), pa.array([zlib.compress(x, 1)], pa.binary()), pa.array([zlib.compress(y, 1)], pa.binary())], names=["block", "part", "words", "a", "b"])

    return asking.repartition(parts, "part").mapInArrow(task, TOLD)


def score(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood (their sum), mean_log_likelihood.

    A token's probability: the network's P(class | classes beside it) times P(word | class) from the counts of all words,
    as the prior (weight ``prior``) of the counts of the word among all other tokens with the same ``reach`` words on both
    sides. Null or blank text: no tokens, a sum of 0 and no mean. A null doc_id and repeated rows are scored like others and
    count in training. Whole texts are read; the empty table gives none. What is broadcast is fixed by ``classes`` (8 MB);
    counts of words and windows lie in shards and grow with the corpus. ``docs`` is read several times and has to give the
    same partitions each time; else the run fails.
    """
    spark = docs.sparkSession
    base = narrow(docs, "doc_id", "text")
    parts = partitions(spark)
    frequent = spark.sparkContext.broadcast(frequent_words(base.select("text"), params))
    counts = triple_counts(base.select("text"), frequent, params)
    table = spark.sparkContext.broadcast(WindowNetwork(params).fit(counts, params).table())
    sizes_of_classes = counts.sum(axis=(0, 1))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64()), ("mean_log_likelihood", pa.float64())])
    names = ["block", "part", "words", "a", "b"]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch, _, _ in _shards(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([True]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary())], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for block, part, is_words, a, b in zip(*(batch.column(c).to_pylist() for c in names)):
                held.setdefault(block, {})[part, is_words] = a, b
        for block in list(held):
            answers = held.pop(block)
            if (-1, True) not in answers:
                raise RuntimeError("the documents came in other partitions when they were read again")
            for batch in pa.ipc.open_stream(answers.pop((-1, True))[0]):
                hashes, edges = words([x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())])
                values, where = np.unique(hashes, return_inverse=True)
                left, own, right = _triples(hashes, edges, frequent.value, params)
                everywhere = np.zeros(len(values))
                log_p = table.value[left, right, own].astype(np.float64)
                _, order, cuts = _dealt(values, parts)
                _, at_window, window_cuts = _dealt(windows(hashes, edges, params), parts)
                again = []
                for (part, is_words), (a, b) in answers.items():
                    a = zlib.decompress(a)
                    if is_words:
                        everywhere[order[cuts[part] : cuts[part + 1]]] = np.frombuffer(a, "<u8")
                    else:
                        again.append((at_window[window_cuts[part] : window_cuts[part + 1]][np.frombuffer(a, "<u4")], *np.frombuffer(zlib.decompress(b), "<u8").reshape(2, -1).astype(np.float64)))
                if len(values) and everywhere.min() < 1:
                    raise RuntimeError("the documents came in other partitions when they were read again")
                log_p += np.log(everywhere)[where] - np.log(sizes_of_classes[own])
                for at, same, among in again:
                    log_p[at] = np.log((same + params.prior * np.exp(log_p[at])) / (among + params.prior))
                total = np.concatenate([[0.0], np.cumsum(log_p)])
                sums, sizes = total[edges[1:]] - total[edges[:-1]], np.diff(edges)
                means = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist())]
                yield rows(schema, [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(np.where(sizes > 0, sums, 0.0)), means])

    met = base.mapInArrow(home, TOLD).unionByName(told(asked(base, parts, params), parts)).repartition(parts, "block")
    return met.mapInArrow(finish, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
