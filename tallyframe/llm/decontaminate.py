"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces: in any passage within k edits, at least one piece is
intact. An automaton of all pieces scans each text; around each hit, grams of the item that are missing near their places rule
out what no edits within the budget can mend, and Myers' bit-parallel distance decides the rest, once where places of an item
overlap. Short items have no budget and match whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import bound_batches, grouped, materialize, narrow

# Signs that end a word: ASCII ones, some of Latin-1, the block of general punctuation and the ideographic space, in UTF-8.
_ASCII = {*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)}
_SPACED = bytes(32 if c in _ASCII else c for c in range(256))
_WIDE = re.compile(rb"\xc2[\xa0\xa1\xab\xbb\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80\x80")

_GRAM = 4  # characters; an edit spoils one of an item's disjoint grams at most


@dataclass(frozen=True)
class DecontaminationParams:
    error_share: float = 0.08  # of an item's normalised characters
    short_chars: int = 24  # items with fewer match exactly, from word border to word border
    block_bytes: int = 4 << 20  # of item texts that are broadcast at once
    blocks: int = 8  # that are broadcast at a time; after them the hits are written


def normalise(text: str) -> str:
    """Lower case, words apart by one space."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    if not data.isascii():
        data = _WIDE.sub(b" ", data)
    return " ".join(data.decode("utf-8", "surrogatepass").split())


def spoiled(grams: list[tuple[int, str]], text: str, start: int, limit: int) -> int:
    """Grams of an item, counted up to limit + 1, that ``text`` lacks within ``limit`` of their places for an item at ``start``.

    Each needs an edit of its own in a passage that has a piece of the item right at its place for ``start``: up to
    ``limit`` edits move what they leave whole by ``limit`` characters at most.
    """
    missing = 0
    for at, gram in grams:
        here = start + at
        if here + limit < 0 or text.find(gram, max(0, here - limit), here + limit + len(gram)) < 0:
            missing += 1
            if missing > limit:
                break
    return missing


def myers(pattern: str, text: str, limit: int) -> int:
    """The least edit distance of ``pattern`` to any substring of ``text``; limit + 1 if it is above ``limit``."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, limit + 1
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best = score
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], params: DecontaminationParams):
        self.items, places = [], {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            budget = int(len(text) * params.error_share) if len(text) >= params.short_chars else 0
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((len(self.items), a))
            grams = [(at, text[at : at + _GRAM]) for at in range(0, len(text) - _GRAM + 1, _GRAM)] if budget else []
            self.items.append((item_id, text, budget, grams, len(text) < params.short_chars))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> dict[int, int]:
        """Item id -> distance of the nearest passage, for items within their budget."""
        if self.empty:
            return {}
        text = normalise(text)
        best: dict[int, int] = {}
        near: dict[int, list[int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for k, at in places:
                if best.get(k) == 0:
                    continue
                start = last + 1 - size - at
                if (k, start) in seen:
                    continue
                seen.add((k, start))
                _, item, budget, grams, short = self.items[k]
                if start >= 0 and text.startswith(item, start):
                    stop = start + len(item)
                    if not short or (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " "):
                        best[k] = 0
                elif budget and spoiled(grams, text, start, budget) <= budget:
                    near.setdefault(k, []).append(start)
        for k, starts in near.items():
            if best.get(k) == 0:
                continue
            _, item, budget, _, _ = self.items[k]
            distance = min(myers(item, text[a:b], budget) for a, b in _windows(starts, budget, len(item) + budget))
            if distance <= budget:
                best[k] = distance
        out: dict[int, int] = {}
        for k, d in best.items():
            out[self.items[k][0]] = min(d, out.get(self.items[k][0], d))
        return out


def _windows(starts: list[int], before: int, after: int) -> list[tuple[int, int]]:
    """The ranges from ``before`` ahead of each start to ``after`` behind it, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        a, b = max(0, start - before), start + after
        if out and a < out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, so that what is broadcast never grows with the benchmark."""
    block, size = [], 0
    for row in narrow(benchmark, "item_id", "text").where(F.col("item_id").isNotNull()).toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


_built: dict[str, tuple] = {}


def matcher_of(items: list[tuple[int, str]], params: DecontaminationParams) -> Matcher:
    """A worker builds the automaton of the current block once."""
    held = _built.get("current")
    if held is None or held[0] != (items, params):
        held = _built["current"] = ((items, params), Matcher(items, params))
    return held[1]


def _matched(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(own, text, gone, hits): a row's other columns as a struct, so that no name of theirs can clash; its text, and whether that is null."""
    spark = docs.sparkSession
    bound_batches(spark)
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    out = docs.select(F.struct(*others, F.lit(True).alias("row")).alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("text").isNull().alias("gone"), F.array().cast("array<struct<item_id:long,distance:int>>").alias("hits"))
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    alive = []
    for block in _blocks(benchmark, params.block_bytes):
        held = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(held.value, params)
            for batch in grouped(batches, "text", 8 << 20):
                found = []
                for text, before in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                    best = matcher.find(text)
                    for x in before:
                        best[x["item_id"]] = min(x["distance"], best.get(x["item_id"], x["distance"]))
                    found.append([{"item_id": i, "distance": d} for i, d in sorted(best.items())])
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("own", "text", "gone")], pa.array(found, type=hit)], names=["own", "text", "gone", "hits"])

        out = out.mapInArrow(task, out.schema)
        alive.append(held)
        if len(alive) == params.blocks:
            out = materialize(out, "hits")
            while alive:
                alive.pop().destroy()
    return out


def match(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` with a column ``_hits``: an array of (item_id, distance), sorted, one for each item found in the text.

    Null or empty text, or an empty benchmark: no hits. Repeated rows and null ids are answered like others; other
    columns stay as they are. Items with a null id, or without any letter or digit, are skipped; of items with one id the
    nearest counts. Items shorter than ``short_chars`` match whole words exactly; others within ``error_share`` of their
    characters. Texts are read whole. One narrow stage per block of items; nothing is shuffled.
    """
    if "_hits" in docs.columns:
        raise ValueError("the result's column _hits is taken")
    found = _matched(docs, benchmark, params)
    return found.select(*_own(docs), F.col("hits").alias("_hits"))


def _own(docs: DataFrame) -> list:
    return [F.when(~F.col("gone"), F.col("text")).alias(c) if c == "text" else F.col("own").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of ``docs`` without any item of the benchmark."""
    return _matched(docs, benchmark, params).where(F.size("hits") == 0).select(*_own(docs))
