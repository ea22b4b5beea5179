"""Harmonic packing of token documents into fixed sequences.

A worker cuts whole sequences off each document. What remains, of length r, belongs to the class k with
capacity / (k + 1) < r <= capacity / k, and a bin of class k takes exactly k documents; so bins close at a fixed count,
and every worker fills its own without hearing of the others. The gap that a closed bin leaves is filled by cutting
later documents, which is what keeps padding near zero.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyframe.llm.shared import grouped, narrow, rows

# Fixed value: the pre-tokenisation pattern of this byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHED = 300_000


@dataclass(frozen=True)
class PackingParams:
    capacity: int = 2048
    end_id: int = 1
    classes: int = 16  # remainders below capacity / (classes + 1) only fill gaps
    waiting: int = 64  # bins whose gap may wait for a document to cut
    vocabulary: str | None = None  # path of the vocabulary file; None: byte_bpe_50k.json as installed


class _Known(dict):
    """A function's results by argument; all go when there are too many."""

    def __init__(self, made):
        super().__init__()
        self.made = made

    def __missing__(self, piece: str) -> bytes:
        found = self.made(piece)
        if len(self) >= _CACHED:
            self.clear()
        self[piece] = found
        return found


def _stand_ins() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary, by their rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids that the ``tokenizers`` library gives for the vocabulary file, without adding special tokens.

    Pre-tokens never span from a visible character into a following space, so a text without unusual white space is cut
    at its spaces and each piece is encoded once, by another byte-pair encoder over the same file, which takes a quarter
    of the time for one word. Texts with unusual white space, or with the string of an added token, go through the library.
    """

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as source:
            model = json.load(source)
        added, byte = {x["content"] for x in model["added_tokens"]}, _stand_ins()
        ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in added}
        pairs = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.unusual = re.compile("|".join([r"[^\S \n]", "^ ", r" \Z", "  ", "\n \n", *map(re.escape, sorted(added))]))
        packed = lambda piece: np.array(pairs(piece), dtype="<u4").tobytes()
        self.first, self.later = _Known(packed), _Known(lambda piece: packed(" " + piece))

    def whole(self, text: str) -> bytes:
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the workers are processes of one core each
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.unusual.search(text):
            return self.whole(text)
        pieces = text.split(" ")
        later = self.later
        return self.first[pieces[0]] + b"".join([later[p] for p in pieces[1:]])


class Packer:
    """Harmonic bins of one worker. ``out`` gets (document, start, ids, sequence, offset) of every piece placed for good."""

    def __init__(self, params: PackingParams, first_sequence: int):
        self.p, self.next, self.out = params, first_sequence, []
        self.open: dict[int, list] = {}  # class -> [pieces, tokens]
        self.gaps: list[list] = []  # closed bins that lack tokens: [pieces, tokens]

    def add(self, document, ids: bytes) -> None:
        size, whole = len(ids) // 4, self.p.capacity
        at = 0
        while size - at >= whole:
            self._close([[(document, at, ids[at * 4 : (at + whole) * 4])], whole])
            at += whole
        if at == size:
            return
        rest, start = ids[at * 4 :], at
        if len(self.gaps) >= self.p.waiting or (size - at) * (self.p.classes + 1) <= whole:
            rest, start = self._fill(document, start, rest)
        if rest:
            k = min(whole // (len(rest) // 4), self.p.classes)
            box = self.open.setdefault(k, [[], 0])
            room = whole - box[1]
            if len(rest) // 4 > room:  # only the last class, whose members are short, may outgrow its bin
                box[0].append((document, start, rest[: room * 4]))
                box[1] = whole
                self._close(self.open.pop(k))
                box = self.open.setdefault(k, [[], 0])
                rest, start = rest[room * 4 :], start + room
            box[0].append((document, start, rest))
            box[1] += len(rest) // 4
            if len(box[0]) >= k and (k < self.p.classes or box[1] == whole):
                self._close(self.open.pop(k))

    def _fill(self, document, start: int, rest: bytes) -> tuple[bytes, int]:
        while rest and self.gaps:
            box = self.gaps[-1]
            take = min(self.p.capacity - box[1], len(rest) // 4)
            box[0].append((document, start, rest[: take * 4]))
            box[1] += take
            rest, start = rest[take * 4 :], start + take
            if box[1] == self.p.capacity:
                self._place(self.gaps.pop())
        return rest, start

    def _close(self, box: list) -> None:
        if box[1] == self.p.capacity:
            self._place(box)
        else:
            self.gaps.append(box)

    def _place(self, box: list) -> None:
        offset = 0
        for document, start, ids in box[0]:
            self.out.append((document, start, ids, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> None:
        """Bins without their full count are dissolved into the gaps; the tail goes into sequences of powers of two."""
        boxes = sorted([*self.open.values(), *self.gaps], key=lambda box: box[1])
        self.open, self.gaps = {}, boxes
        while len(self.gaps) > 1:
            pieces, _ = self.gaps.pop(0)
            rest = []
            for document, start, ids in pieces:
                ids, start = self._fill(document, start, ids)
                rest += [(document, start, ids)] if ids else []
            if rest:
                self.gaps.insert(0, [rest, sum(len(x[2]) // 4 for x in rest)])
        for pieces, tokens in self.gaps:
            while tokens:
                room = 1 << (tokens.bit_length() - 1)
                tokens -= room
                box = [[], room]
                while room:
                    document, start, ids = pieces.pop(0)
                    take = min(room, len(ids) // 4)
                    box[0].append((document, start, ids[: take * 4]))
                    room -= take
                    if take * 4 < len(ids):
                        pieces.insert(0, (document, start + take, ids[take * 4 :]))
                self._place(box)
        self.gaps = []


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
WITH_IDS = pa.schema([*SCHEMA, ("ids", pa.binary())])
_loaded: dict[str | None, Tokenizer] = {}


def tokenizer_of(path: str | None) -> Tokenizer:
    """A worker loads a vocabulary once."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def pack(docs: DataFrame, params: PackingParams = PackingParams(), *, ids: bool = False) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text); with ``ids``, each piece's token ids (uint32) as well.

    A document is its text's ids and then ``end_id``; each id lies in exactly one piece. Null or empty text: that one id.
    A null doc_id and repeated rows are packed like others. Empty table: no pieces. There is no shuffle: a partition is
    a worker, and a sequence's id holds the partition's number in its upper half.
    """
    schema = WITH_IDS if ids else SCHEMA

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_of(params.vocabulary), np.array([params.end_id], dtype="<u4").tobytes()
        packer = Packer(params, TaskContext.get().partitionId() << 32)

        def drain() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            columns = [[x[0][0] for x in out], [x[1] for x in out], [len(x[2]) // 4 for x in out], [zlib.crc32(x[2]) for x in out], [x[0][1] for x in out], [x[3] for x in out], [x[4] for x in out]]
            return rows(schema, columns + ([[x[2] for x in out]] if ids else []))

        for batch in grouped(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = tokenizer.ids(text) + end
                packer.add((doc_id, len(own) // 4), own)
            if packer.out:
                yield drain()
        packer.finish()
        if packer.out:
            yield drain()

    columns = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return narrow(docs, "doc_id", "text").mapInArrow(task, columns)
