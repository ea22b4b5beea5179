"""Alignment of the tokens that two tokenizers give for the same text.

Both token sequences cover the same bytes. Tokens whose byte ranges overlap are the edges of a bipartite graph; its
connected components, found by union-find, are exactly the smallest groups that begin and end where both sequences have
a border. The members of a component give its links, all pairs across the two sides, and how many documents hold an id
pair linked is counted over the whole corpus.

Documents are aligned in blocks. A block keeps its distinct id pairs once, with the documents that hold each; counts are
sums of these over blocks, and come back to a block by its pairs, so what is shuffled is a block's vocabulary of pairs
and not its tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.packing import PATTERN, _stand_ins
from tallyframe.llm.shared import grouped, materialize, narrow, release, rows, trimmed

_MOST = 1 << 16  # entries of a vocabulary; an id pair is one number


@dataclass(frozen=True)
class AlignParams:
    byte_vocabulary: str | None = None  # path of the byte-level vocabulary; None: byte_bpe_50k.json as installed
    piece_vocabulary: str | None = None  # path of the piece vocabulary; None: piece_bpe_32k.model as installed
    block_bytes: int = 2 << 20  # texts are aligned in blocks of so many bytes; a longer text is a block of its own
    slice_links: int = 1 << 20  # links that are written out at once; steers memory only
    small_group: int = 64  # groups of more links collapse equal ids first; steers speed only


class ByteSide:
    """Tokens of a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the workers are processes of one core each
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.library, byte = Tokenizer.from_file(path), _stand_ins()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as source:
            model = json.load(source)
        words, self.added = model["model"]["vocab"], {x["id"] for x in model["added_tokens"]}
        self.bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes[i] = bytes(byte.get(c, 0) for c in word)

    def ids(self, text: str) -> list[int]:
        (found,) = self.library.encode_batch_fast([" " + text], add_special_tokens=False)
        return found.ids


class PieceSide:
    """Tokens of a piece vocabulary that puts the space before the text itself and falls back to bytes."""

    def __init__(self, path: str | None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


_RARE = re.compile(r"[^\S \n]")  # white space that encoders may class differently


class Encoder:
    """Both sides' ids of a text, little-endian unsigned 32-bit; nothing where a side does not give back the text.

    Byte-level ids come from another byte-pair encoder over the same vocabulary, which takes a third of the library's time;
    texts with rare white space go through the library.
    """

    def __init__(self, params: AlignParams):
        self.a, self.b = ByteSide(params.byte_vocabulary), PieceSide(params.piece_vocabulary)
        if max(len(self.a.bytes), len(self.b.bytes)) > _MOST:
            raise ValueError(f"a vocabulary has more than {_MOST} entries")
        ranks = {x: i for i, x in enumerate(self.a.bytes) if i not in self.a.added}
        self.pairs = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> tuple[bytes, bytes] | None:
        if not text:
            return None
        whole, a, b = b" " + text.encode(), self.a.ids(text) if _RARE.search(text) else self.pairs(" " + text), self.b.ids(text)
        if not (b"".join(map(self.a.bytes.__getitem__, a)) == whole == b"".join(map(self.b.bytes.__getitem__, b))):
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()


_loaded: dict[tuple, Encoder] = {}


def encoder(params: AlignParams) -> Encoder:
    """A worker loads the vocabularies once."""
    key = params.byte_vocabulary, params.piece_vocabulary
    if key not in _loaded:
        _loaded[key] = Encoder(params)
    return _loaded[key]


def union(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component, given edges ``u``-``v`` among ``n`` nodes: union-find over whole arrays."""
    root = np.arange(n)
    while True:
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = a[apart], b[apart]
        root[np.maximum(u, v)] = np.minimum(u, v)  # of several edges at one root one counts, the others do in the next round


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token on both sides, numbered in text order, and their number. Both sides end at the same byte."""
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    node_a = np.arange(len(ends_a)) + np.searchsorted(starts_b, starts_a, "left")  # nodes are in text order, so that
    node_b = np.arange(len(ends_b)) + np.searchsorted(starts_a, starts_b, "right")  # a component's least is its first
    at = np.sort(np.concatenate([starts_a, starts_b]), kind="stable")  # two sorted runs
    at = at[np.append(True, at[1:] != at[:-1])]  # between two borders lies one token of each side: an edge
    root = union(node_a[np.searchsorted(ends_a, at, "right")], node_b[np.searchsorted(ends_b, at, "right")], len(ends_a) + len(ends_b))
    order = np.cumsum(root == np.arange(len(root))) - 1
    return order[root[node_a]], order[root[node_b]], int(order[-1]) + 1


def collapsed(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each group's distinct ids and how often it holds them."""
    key, times = np.unique(group * _MOST + ids, return_counts=True)
    return key // _MOST, key % _MOST, times


def expanded(a: tuple, b: tuple, document: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document and id pair, links) of all pairs across the sides of each group; ``a`` and ``b``: group, id, times."""
    size = len(document)
    p, q = np.bincount(a[0], minlength=size), np.bincount(b[0], minlength=size)
    last = np.cumsum(p * q)
    first_a, first_b, total = np.cumsum(p) - p, np.cumsum(q) - q, int(last[-1]) if size else 0
    for low in range(0, total, most):
        link = np.arange(low, min(low + most, total))
        g = np.searchsorted(last, link, "right")
        x, y = np.divmod(link - (last[g] - p[g] * q[g]), q[g])
        x, y = first_a[g] + x, first_b[g] + y
        yield merged((document[g] << 32) | (a[1][x] << 16) | b[1][y], a[2][x] * b[2][y])


def merged(key: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, links = key[order], links[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(links, first) if len(first) else links


def _digits(n: int) -> np.ndarray:
    return np.array([str(i).encode() for i in range(n)], dtype="S5").view(np.uint8).reshape(n, 5)


_DIGITS = None


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, p: np.ndarray, q: np.ndarray, last_group: np.ndarray) -> list[bytes]:
    """Groups of each document as text: ids of a side joined by commas, sides by a bar, groups by a semicolon."""
    global _DIGITS
    if _DIGITS is None:
        _DIGITS = _digits(_MOST)
    after_a, after_b = np.cumsum(p), np.cumsum(q)
    place_a = np.arange(len(ids_a)) + (after_b - q)[of_a]
    place_b = np.arange(len(ids_b)) + after_a[of_b]
    cells = np.empty((len(ids_a) + len(ids_b), 6), dtype=np.uint8)
    cells[place_a, :5], cells[place_b, :5] = _DIGITS[ids_a], _DIGITS[ids_b]
    cells[:, 5] = ord(",")
    cells[after_a + after_b - q - 1, 5] = ord("|")
    cells[after_a + after_b - 1, 5] = ord(";")
    ends = (after_a + after_b)[last_group]
    cells[ends - 1, 5] = 0
    used = cells != 0
    text = cells[used].tobytes()
    stops = np.cumsum(used.sum(axis=1))[ends - 1]
    return [text[i:j] for i, j in zip(np.append(0, stops[:-1]).tolist(), stops.tolist())]


BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("which", pa.binary()), ("times", pa.binary()),
])
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, holders array<long>, held array<int>, which binary, times binary"


def packed(values: Sequence[int]) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest needs: a block has hundreds of thousands, most of them small."""
    values = np.asarray(values, dtype=np.int64)
    return values.astype(next(k for k in ("<u1", "<u2", "<u4", "<i8") if len(values) == 0 or values.max() <= np.iinfo(k).max)).tobytes()


def unpacked(blob: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``packed``."""
    return np.frombuffer(blob, dtype={1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(blob) // count] if count else "<u1").astype(np.int64)


def aligned(texts: Sequence[str], params: AlignParams) -> dict:
    """Columns of a block: per document sizes and digest, the block's id pairs, and which document holds which how often."""
    encode, n, told, all_a, all_b = encoder(params), len(texts), [], [], []
    for i, text in enumerate(texts):
        found = encode(text)
        if found is not None:
            told.append(i)
            all_a.append(found[0])
            all_b.append(found[1])
    out = {c: np.zeros(n, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "held")} | {"groups_sha256": [""] * n, "pairs": [], "holders": [], "which": [], "times": []}
    if not told:
        return out
    size_a, size_b = (np.array([len(x) // 4 for x in side]) for side in (all_a, all_b))
    ids_a, ids_b = (np.frombuffer(b"".join(side), dtype="<u4").astype(np.int64) for side in (all_a, all_b))
    of_a, of_b, count = groups(*[np.cumsum(np.array([len(x) for x in side.bytes])[ids]) for side, ids in ((encode.a, ids_a), (encode.b, ids_b))])
    p, q = np.bincount(of_a, minlength=count), np.bincount(of_b, minlength=count)
    last_group = of_a[np.cumsum(size_a) - 1]  # a document's end is a border of both sides
    at = np.array(told)
    document = np.searchsorted(last_group, np.arange(count))
    out["n_a"][at], out["n_b"][at], out["n_groups"][at] = size_a, size_b, np.diff(np.append(-1, last_group))
    out["n_links"][at] = np.add.reduceat(p * q, np.append(0, last_group[:-1] + 1))
    for i, text in zip(told, spelled(ids_a, ids_b, of_a, of_b, p, q, last_group)):
        out["groups_sha256"][i] = hashlib.sha256(text).hexdigest()
    large = p * q > params.small_group
    in_a, in_b = large[of_a], large[of_b]
    one = lambda group, ids: (group, ids, np.ones(len(ids), dtype=np.int64))
    keys, links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for a, b in ((one(of_a[~in_a], ids_a[~in_a]), one(of_b[~in_b], ids_b[~in_b])), (collapsed(of_a[in_a], ids_a[in_a]), collapsed(of_b[in_b], ids_b[in_b]))):
        for key, found in expanded(a, b, document, params.slice_links):
            keys, links = merged(np.concatenate([keys, key]), np.concatenate([links, found]))
    pairs, which, holders = np.unique(keys & 0xFFFFFFFF, return_inverse=True, return_counts=True)
    out["held"][at] = np.bincount(keys >> 32, minlength=len(told))
    return out | {"pairs": pairs, "holders": holders, "which": which, "times": links}


def blocks(docs: DataFrame, params: AlignParams) -> DataFrame:
    """A row per block of documents, see ``aligned``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in grouped(batches, "text", params.block_bytes):
            made = aligned(batch.column("text").to_pylist(), params)
            made |= {"doc_id": batch.column("doc_id").to_pylist(), "block": block, "which": packed(made["which"]), "times": packed(made["times"])}
            yield rows(BLOCKS, [[made[f.name]] for f in BLOCKS])
            block += 1

    return narrow(docs, "doc_id", "text").mapInArrow(trimmed(task), _BLOCKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): documents of the corpus that hold an id pair linked, and whether its first id has none with more.

    Counts come from blocks that have summed their own. The greatest counts are one row per id of the first vocabulary,
    at most 65,536, so they are broadcast.
    """
    counts = materialize(found.select(F.inline(F.arrays_zip("pairs", "holders"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")), "align-counts")
    first = F.shiftright("pair", 16)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks that have got their pairs' counts (``told``, in any order). The vocabularies are needed no more."""
    _loaded.clear()
    release()
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c: batch.column(c)[i].values
            number = lambda c: np.asarray(value(c), dtype=np.int64)
            told, held = batch.column("told")[i].values, number("held")
            if told is None or len(told) == 0:
                best = total = np.zeros(0, dtype=np.int64)
            else:
                pair, n, top = (np.asarray(told.field(k)) for k in range(3))
                order = np.argsort(pair)
                which, times = (unpacked(batch.column(c)[i].as_py(), int(held.sum())) for c in ("which", "times"))
                best, total = times * top[order][which], times * n[order][which]
            stops = np.append(0, np.cumsum(held))
            per = lambda x: np.diff(np.append(0, np.cumsum(x))[stops])
            yield rows(RESULT, [value("doc_id"), value("n_a"), value("n_b"), value("n_groups"), value("n_links"), per(best), per(total), value("groups_sha256")])


def align(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): tokens of both sides, groups, links, links whose pair is the commonest of its
    first id in the corpus (ties included), the sum of the links' counts, and a digest of the groups.

    A document is a row: repeated rows and a null doc_id count like others. A text that is null or empty, or that either
    side does not give back byte for byte, has no tokens: zeros and an empty digest. Empty table: no rows. A group's equal ids
    are collapsed before its links are written out, and those go through in slices, so a long group needs no more memory.
    """
    found = materialize(blocks(docs, params), "align-blocks")
    asked = found.select("block", F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(found), "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("told"))  # bounded by a block's pairs
    schema = ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in RESULT)
    return found.drop("pairs", "holders").join(told, "block", "left").mapInArrow(trimmed(summed), schema)
