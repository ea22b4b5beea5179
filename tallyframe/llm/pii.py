"""Personal data in texts: plain patterns, and disguised identifiers found by offset-preserving deobfuscation.

A transducer rewrites a text and keeps, for each character it puts out, the source span it came from. Homoglyphs fold to
ASCII, invisible characters vanish, spelled digits become digits, at/dot disguises become their signs. The same patterns
then run over the rewritten text, and what they find there is mapped back to source characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.shared import grouped, narrow, rows

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")

# Words for digits in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_BETWEEN = r"(?:[ \t]*[-.,/][ \t]*|[ \t]+)"
_TWO_WORDS = re.compile(rf"\b(?:{_WORD}|plus)[ \t,./-]{{1,3}}(?:{_WORD})\b")
_SPELLED = re.compile(rf"(?i)(?:(?:\bplus\b|\+){_BETWEEN}?)?(?:\b(?:{_WORD})\b|(?<![0-9A-Za-z])[0-9]{{1,4}}(?![0-9A-Za-z]))(?:{_BETWEEN}(?:(?:dot|point|punkt|punto|dash|hyphen|space){_BETWEEN})?(?:\b(?:{_WORD})\b|[0-9]{{1,4}}(?![0-9A-Za-z])))+")
_PART = re.compile(rf"(?i)\b(?:{_WORD}|plus|dot|point|punkt|punto|dash|hyphen|space)\b|[0-9]+|\+|.", re.S)

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"(?i)\s?{_OPEN}\s*(?:at|@|arroba|arobase|arrobase|ät)\s*{_CLOSE}\s?")
_BRACKET_DOT = re.compile(rf"(?i)\s?{_OPEN}\s*(?:dot|point|punkt|punto|\.)\s*{_CLOSE}\s?")
_ANY_BRACKET = re.compile(rf"(?i){_OPEN}\s*(?:at|@|arroba|arobase|arrobase|ät|dot|point|punkt|punto|\.)\s*{_CLOSE}")
_NAME = r"[A-Za-z0-9_%+-]+"
_AT, _DOT = "(?:arroba|arobase|arrobase|ät)", "(?:dot|point|punkt|punto)"
# "at some point in" is English prose: after a plain "at", "point" counts only before a common top-level domain.
_SAID = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-]){_NAME}(?:(?: {_DOT} |\.){_NAME})*(?: at |_at_|-at-|@| @ | {_AT} |_{_AT}_|-{_AT}-)[A-Za-z0-9-]+(?:(?: {_DOT} |_{_DOT}_|-{_DOT}-|\.)[A-Za-z0-9-]+)*"
    rf"(?:(?: dot | punkt | punto |_{_DOT}_|-{_DOT}-)[A-Za-z]{{2,12}}| point (?:com|org|net|info|eu|fr|be|ch|de|es))(?![A-Za-z0-9])"
)
_NAMED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>{_NAME}(?:\.{_NAME})*)(?: (?i:{_AT}) | at )[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,12}}(?![A-Za-z0-9/])")
# Words before "at" and a site's name that are prose, not a mailbox.
_PROSE = frozenset("a all also and any are available be been bought buy by can check courses do find for found free from go here him her hosted i in is it items jobs join look looked looking me meet more now of on online only or order out page people posted published read search see seen shop shopping site sold staff store them there this those to today up us visit was we website were work worked working works you".split())
_SAID_GATE = re.compile(rf"[ _-](?:{_DOT}|{_AT})[ _-]| @ | at [a-z0-9-]+\.[a-z]")
_SPACED = re.compile(r"(?<!\S)[A-Za-z0-9._%+-]+( @ )[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)*( ?\. ?)[A-Za-z]{2,12}(?!\S)")
_SAID_PART = re.compile(rf"(?i)(?P<at> at |_at_|-at-| ?@ ?| {_AT} |_{_AT}_|-{_AT}-)|(?P<dot> {_DOT} |_{_DOT}_|-{_DOT}-| ?\. ?)")

_SUSPECT = re.compile("[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‏‐-―․‪-‮⁠-⁤⁰-₉①-⑨⓪﹒﹫﻿！-～\U0001d400-\U0001d7ff]")
# Greek and Cyrillic letters that look like ASCII ones, and stand-ins for signs.
_LOOK = dict(zip("АВЕЅІЈКМНОРСТХҮԚԜаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυхո", "ABESIJKMHOPCTXYQWaesijopcyxhdqwABEZHIKMNOPTYXoavikpuxn")) | {"․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-"}
_GONE = frozenset("­​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿")


class Traced:
    """A rewritten text and the source span of each of its characters."""

    __slots__ = ("text", "begin", "end")

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.begin = list(range(len(text))) if begin is None else begin
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> "Traced":
        """Applies (start, end, new text) edits, in order and apart; each new character stands for the whole edited span."""
        out, begin, end, at = [], [], [], 0
        for start, stop, new in edits:
            out += [self.text[at:start], new]
            begin += self.begin[at:start] + [self.begin[start]] * len(new)
            end += self.end[at:start] + [self.end[stop - 1]] * len(new)
            at = stop
        if not at:
            return self
        return Traced("".join([*out, self.text[at:]]), begin + self.begin[at:], end + self.end[at:])

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return self.begin[start], self.end[stop - 1]


def _folded(char: str) -> str:
    if char in _GONE:
        return ""
    if char in _LOOK:
        return _LOOK[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else char


def fold_homoglyphs(traced: Traced) -> Traced:
    def edits():
        for m in _SUSPECT.finditer(traced.text):
            new = _folded(m[0])
            if new != m[0]:
                yield m.start(), m.end(), new

    return traced.rewrite(edits())


def spelled_digits(traced: Traced) -> Traced:
    """Runs of digit words (digits may be mixed in) become digits; a spoken plus or dot inside a run its sign."""

    def edits():
        for m in _SPELLED.finditer(traced.text):
            parts = [(p.start(), p.end(), p[0].lower()) for p in _PART.finditer(m[0])]
            spelled = [p[2] for p in parts if p[2] in DIGIT_WORDS]
            digits = len(spelled) + sum(len(p[2]) for p in parts if p[2].isdigit())
            if len(spelled) < 3 or digits < 4 or len(set(spelled)) == 1 and len(spelled) == digits and len(spelled) > 4:  # one word said over and over is no number
                continue
            signed = False
            for start, stop, word in parts:
                if signed and word.isspace():  # a sign and its number are one
                    yield m.start() + start, m.start() + stop, ""
                    continue
                signed = word in ("plus", "+")
                new = DIGIT_WORDS.get(word, {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}.get(word, word if word.isdigit() or word in "+.- " else " " if word in ",/\t" else ""))
                if new != m[0][start:stop]:
                    yield m.start() + start, m.start() + stop, new

    return traced.rewrite(edits())


def at_and_dot(traced: Traced) -> Traced:
    for pattern, sign in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        traced = traced.rewrite((m.start(), m.end(), sign) for m in pattern.finditer(traced.text))
    at = [0]

    def edits():
        named = (m for m in _NAMED.finditer(traced.text) if m["name"].lower() not in _PROSE)
        for m in sorted([*_SAID.finditer(traced.text), *_SPACED.finditer(traced.text), *named], key=lambda m: m.start()):
            if m.start() < at[0]:
                continue
            at[0] = m.end()
            for p in _SAID_PART.finditer(m[0]):
                sign = "@" if p["at"] else "."
                if p[0] != sign:
                    yield m.start() + p.start(), m.start() + p.end(), sign

    return traced.rewrite(edits())


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the plain patterns, sorted; leftmost and non-overlapping within a kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if _DOTTED.search(text):
            found += [(a, 1, b) for a, b in _ips(text)]
        found += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in _phones(text)]
    return sorted(found)


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only after rewriting; one may reach over plain spans, which are then fragments of it.

    Left out is what lies within a plain span of its kind, and what overlaps an earlier disguised one.
    """
    suspect = not text.isascii() and _SUSPECT.search(text)
    lower = text.lower()
    said = bool(_SAID_GATE.search(lower) or _ANY_BRACKET.search(text))
    spelled = bool(_TWO_WORDS.search(lower))
    if not (suspect or said or spelled):
        return []
    traced = Traced(text)
    if suspect:
        traced = fold_homoglyphs(traced)
    if spelled or suspect and _TWO_WORDS.search(traced.text.lower()):
        traced = spelled_digits(traced)
    traced = at_and_dot(traced)
    if traced.text == text:
        return []
    found = []
    for k, kind in enumerate(KINDS):
        for a, b in _FINDERS[kind](traced.text):
            start, stop = traced.source(a, b)
            if text[start:stop] != traced.text[a:b]:
                found.append((start, k, stop))
    if spelled:  # a number told in words only is a disguise even without its plus sign
        for m in re.finditer(r"(?<![0-9+])[0-9](?:[ -]?[0-9]){8,14}(?![0-9])", traced.text):
            start, stop = traced.source(*m.span())
            words = re.findall(rf"\b(?:{_WORD})\b", text[start:stop].lower())
            if len(words) >= 5 and len(set(words)) >= 3:
                found.append((start, 3, stop))
    held: list[list[tuple[int, int]]] = [[(a, b) for a, kind, b in plain if kind == k] for k in range(len(KINDS))]  # sorted, apart
    out: list[tuple[int, int, int]] = []  # sorted, apart
    for start, k, stop in sorted(found, key=lambda x: (x[1], x[0])):
        i = bisect.bisect_right(held[k], start, key=lambda x: x[0]) - 1
        if i >= 0 and stop <= held[k][i][1]:
            continue
        at = bisect.bisect_left(out, start, key=lambda x: x[0])
        if (at and out[at - 1][2] > start) or (at < len(out) and out[at][0] < stop):
            continue
        out.insert(at, (start, k, stop))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): plain counts, the hash of the plain spans, all spans and their number.

    Offsets are code points, ends exclusive. Null or empty text: no spans. A null doc_id stays null and repeated rows are
    each answered. Whole texts of any length are read; the empty table gives none. One narrow stage, no shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "text", 8 << 20):
            ids, counts, hashes, spans, numbers = batch.column("doc_id"), [[], [], [], []], [], [], []
            for text in batch.column("text").to_pylist():
                plain = plain_spans(text)
                kinds = [k for _, k, _ in plain]
                for k in range(4):
                    counts[k].append(kinds.count(k))
                hashes.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                every = sorted(plain + disguised_spans(text, plain))
                spans.append(joined(every))
                numbers.append(len(every))
            yield rows(SCHEMA, [ids, *counts, hashes, spans, numbers])

    return narrow(docs, "doc_id", "text").mapInArrow(task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, mark: Callable[[str], str] = lambda kind: f"<{kind}>") -> str:
    """The text with every span replaced by its kind; spans that overlap are replaced as one, by the first one's kind."""
    plain = plain_spans(text)
    out, at, last = [], 0, -1
    for start, k, stop in sorted(plain + disguised_spans(text, plain)):
        if start >= last:
            out += [text[at:start], mark(KINDS[k])]
        at = last = max(last, stop)
    return "".join([*out, text[at:]])
