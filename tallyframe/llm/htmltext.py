"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each described by hashed vectors of its tag path and of its words. A
bidirectional LSTM, written and trained in NumPy, reads the whole sequence in both directions and labels every block as
article text or not, so what a block is depends on all of the page. It is trained on pages made from layouts whose blocks
have known labels.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.shared import grouped, narrow, rows

# Elements that end a block of text, elements whose content is no text, and elements without content.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math textarea canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = frozenset("ul ol table tbody thead dl select div section article nav form aside".split())

_OPEN_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST_OF_TAG = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_BROKEN_TAGS = 8  # with quotes left open, after which a page's quotes no longer count
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
PATH, WORDS, EXTRA = 48, 24, 8
WIDTH = PATH + WORDS + EXTRA


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def leaves(html: str) -> list[Leaf]:
    """The page's blocks of text in order, in linear time and whatever its markup lacks.

    A tag that never ends because a quote is left open ends at its first ``>``; a page with many of these is read without
    regard to quotes from there on, so that it is not searched to its end again and again.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = links = at = broken = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Leaf(tuple(mark for _, mark in stack), text, linked))
            parts, linked = [], 0

    while True:
        m = _OPEN_TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        if m[1]:
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        rest = _REST_OF_TAG.match(html, at) if broken < _BROKEN_TAGS else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            broken += 1
            end = html.find(">", at)
            if end < 0:  # no tag ends here or later
                parts.append(html[m.start() :])
                break
            attributes, at = html[at:end], end + 1
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at) if not attributes.endswith("/") else None
            at = end.end() if end else at if attributes.endswith("/") else len(html)
            continue
        if name in BLOCKS:
            flush()
            if name in _CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _CLOSES[name]:
                        del stack[i:]
                        break
                    if stack[i][0] in _KEEPS:
                        break
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _KEEPS:
                    break
        if name in VOID:
            parts.append(" ")
            continue
        if name == "a":
            links += 1
        if not attributes.endswith("/"):
            marks = " ".join(a or b or c for a, b, c in _MARK.findall(attributes)) if attributes else ""
            stack.append((name, f"{name} {marks.lower()}" if marks else name))
            if len(stack) > 200:
                del stack[100]
    flush()
    return out


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, dtype=np.float32)
    for depth, mark in enumerate(reversed(path)):
        name, *rest = mark.split(" ", 1)
        tokens = [name] + [f".{x}" for x in _PART.findall(rest[0] if rest else "")] + ([f"^{name}"] if depth == 0 else [])
        for token in tokens:
            h = zlib.crc32(token.encode())
            out[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
    return np.clip(out, -3, 3)


@lru_cache(maxsize=100_000)
def _word_slot(word: str) -> int:
    return _slot(word.lower().strip(".,;:!?\"'()"), WORDS)


def features(page: list[Leaf]) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), dtype=np.float32)
    for i, leaf in enumerate(page):
        words = leaf.text.split(" ")
        out[i, :PATH] = _path_vector(leaf.path)
        out[i, PATH : PATH + WORDS] = np.bincount([_word_slot(w) for w in words], minlength=WORDS) / len(words)
        size = len(leaf.text)
        stops = leaf.text.count(".") + leaf.text.count(",") + leaf.text.count("!") + leaf.text.count("?")
        out[i, PATH + WORDS :] = (np.log1p(size) / 6, np.log1p(len(words)) / 5, min(1.0, leaf.linked / size), min(1.0, 10 * stops / size), leaf.text[-1] in ".!?", i / len(page), min(len(leaf.path), 12) / 12, 1)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", scale(WIDTH, 4 * hidden)), ("h", scale(hidden, 4 * hidden)), ("c", np.zeros(4 * hidden, np.float32)))}
        for d in "fb":
            self.w[f"c{d}"][hidden : 2 * hidden] = 1.0
        self.w |= {"o": scale(2 * hidden, 1), "s": scale(WIDTH, 1) * 0.1, "k": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction over (time, page, feature); padded steps carry the state through."""
        n, (steps, pages) = self.hidden, x.shape[:2]
        gates_x = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((pages, n), np.float32)
        out = np.zeros((steps, pages, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_x[t] + h @ self.w["h" + d]
            i, f, o = (1 / (1 + np.exp(-z[:, k * n : (k + 1) * n])) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, s, m))
            c = np.where(m, new, c)
            h = np.where(m, o * s, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return (both @ self.w["o"] + x @ self.w["s"])[..., 0] + self.w["k"]

    def _step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by back-propagation through time."""
        n, kept = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        z = (both @ self.w["o"] + x @ self.w["s"])[..., 0] + self.w["k"]
        p = 1 / (1 + np.exp(-z))
        total = mask.sum()
        loss = -float((np.where(y, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / total)
        dz = ((p - y) * mask / total)[..., None]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"] = np.tensordot(both, dz, ([0, 1], [0, 1]))
        grad["s"] = np.tensordot(x, dz, ([0, 1], [0, 1]))
        grad["k"] = dz.sum((0, 1))
        dboth = dz @ self.w["o"].T
        for k, d in enumerate("fb"):
            dh_out = dboth[..., k * n : (k + 1) * n]
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, g, s, m in reversed(kept[d]):
                dh = dh + dh_out[t]
                ds = np.where(m, dh * o * (1 - s * s) + dc, 0)
                gates = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), np.where(m, dh * s, 0) * o * (1 - o), ds * i * (1 - g * g)], axis=1)
                grad["x" + d] += x[t].T @ gates
                grad["h" + d] += h.T @ gates
                grad["c" + d] += gates.sum(0)
                dc = np.where(m, ds * f, dc)
                dh = gates @ self.w["h" + d].T + np.where(m, 0, dh)
        return loss, grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.01, batch: int = 32, seed: int = 11) -> "Labeller":
        """Adam over shuffled batches of pages of like length."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(y) for _, y in pages], kind="stable")
        blocks = [order[i : i + batch] for i in range(0, len(order), batch)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            for b in rng.permutation(len(blocks)):
                x, mask = padded([pages[i][0] for i in blocks[b]])
                y = np.zeros(mask.shape, dtype=np.float32)
                for j, i in enumerate(blocks[b]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                _, grad = self._step(x, y, mask)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    now = rate * (1 - epoch / epochs) + 1e-4
                    self.w[k] = (self.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


class Layouts:
    """Makes training pages: article blocks and everything that may stand around or inside an article.

    Nothing in it follows a site: wrappers have telling names, meaningless names or none; paragraphs are marked, plain
    blocks or loose text; menus, notices and the rest are told by elements, by names, or only by what they hold.
    """

    def __init__(self, seed: int = 3):
        self.r = random.Random(seed)
        letters = lambda n: "".join(self.r.choice("aeiouéü" if i % 2 else "bcdfghjklmnprstvwz") for i in range(n))
        self.stock = [letters(self.r.randint(1, 11)) for _ in range(3000)] + "the of and to in a is that for it der die und das von le la et les des que el los y con".split() * 25

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [r.choice(self.stock) for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.04:
            out = [w.upper() for w in out]
        noise = r.choice(["***", "&amp;", "|", "%", "#", "!!"]) if r.random() < 0.12 else ""
        return " ".join(w + (r.choice([",", ".", ",", ";"]) if r.random() < 0.1 else "") + (noise if noise and r.random() < 0.8 else "") for w in out)

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", ""])

    def name(self) -> str:
        """An attribute that tells nothing, or none."""
        r = self.r
        return r.choice(["", "", f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"', f' class="col-{r.randint(1, 12)} {r.choice(["row", "wrap", "inner", "container", "box", "block"])}"', f' id="{r.choice(["page", "wrapper", "root", "app", "site"])}"', ' style="margin:0"'])

    def article(self, loose: bool) -> list[str]:
        r = self.r
        out = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{self.sentence(2, 16)}</{h}>"] if r.random() < 0.85 else []
        own = r.choice(["p", "p", "p", "div", "span"]) if not loose else "div"
        for _ in range(r.choice([1, 1, 2, 3, r.randint(1, 14), r.randint(1, 14), r.randint(1, 30)])):
            kind = r.random()
            if kind < 0.74:
                text = (f"<{r.choice(['b', 'i', 'em', 'strong'])}>" if r.random() < 0.15 else "") + self.sentence(1, r.choice([2, 4, 12, 60, 200]))
                if own == "span":
                    out.append(f"<div><span>{text}</span></div>")
                elif loose and r.random() < 0.5:
                    out.append(f"{r.choice(['<br><br>', '<hr>', ''])}<x>{text}</x>")
                else:
                    out.append(f"<{own}{self.name() if r.random() < 0.2 else ''}>{text}" + r.choice([f"</{own}>", f"</{own}>", f"</{own}>", "<br>" if own == "p" else f"</{own}>", "" if own == "p" else f"</{own}>"]))
            elif kind < 0.81:
                out.append(f"<{r.choice(['h2', 'h3', 'h4'])}>{self.words(1, 6)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{self.sentence(5, 30)}</p></blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(3, 12)}</figcaption></figure><pre>{self.words(3, 20)}</pre>")
        return out

    def links(self) -> str:
        item = lambda: f'<li><a href="/x">{self.words(1, 3)}</a></li>'
        return "<ul>" + "".join(item() for _ in range(self.r.randint(3, 9))) + "</ul>"

    def other(self, where: str) -> str:
        r = self.r
        mark = lambda names: f'{r.choice(["class", "id"])}="{r.choice(["", "", "site-", "page-", "b-"])}{r.choice(names.split())}"'
        text = lambda: self.sentence(2, r.choice([6, 20, 40]))
        made = {
            "nav": lambda: r.choice([f"<nav{self.name()}>{self.links()}</nav>", f"<nav>{' '.join(f'<a href=/x>{self.words(1, 2)}</a>' for _ in range(r.randint(2, 7)))}</nav>", f"<div {mark('menu nav navbar navigation breadcrumb breadcrumbs topbar')}>{self.links()}</div>", f"<ul {mark('menu nav')}>{self.links()[4:]}", f"<div{self.name()}>{self.links()}</div>"]),
            "header": lambda: r.choice([f"<header><a href=/>{self.words(1, 3)}</a><p>{text()}</p></header>", f"<div {mark('header masthead site-header branding logo')}><p>{text()}</p></div>"]),
            "ad": lambda: r.choice([f"<div {mark('ad ads advert advertisement banner sponsored promo promotion ad-slot adbox')}>{r.choice(['', '<p>'])}{text()}</div>", f"<aside {mark('ad promo sponsored')}>{text()}</aside>", f"<section {mark('ads sponsored')}><p>{text()}</p></section>"]),
            "side": lambda: r.choice([f"<aside>{r.choice(['', '<h3>' + self.words(1, 3) + '</h3>'])}<p>{text()}</p>{self.links()}</aside>", f"<div {mark('sidebar side widget related recommended trending popular')}><h3>{self.words(1, 3)}</h3><p>{text()}</p>{self.links()}</div>"]),
            "notice": lambda: f"<{r.choice(['div', 'section', 'dialog'])} {mark('cookie cookies consent notice gdpr banner popup modal newsletter subscribe signup alert paywall')}><p>{text()}</p><button>{self.words(1, 2)}</button></{r.choice(['div', 'section'])}>",
            "form": lambda: f"<form {mark('search form login contact')}><label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}</option></select><p>{text()}</p><button>{self.words(1, 2)}</button></form>",
            "comments": lambda: f"<{(t := r.choice(['div', 'section', 'ol']))} {mark('comments comment-list comment-section responses discussion disqus replies')}><h2>{self.words(1, 3)}</h2>" + "".join(f"<{(u := r.choice(['div', 'li', 'article']))} class=\"{r.choice(['comment', 'reply', 'response'])}\"><p>{text()}</p><p>{text()}</p></{u}>" for _ in range(r.randint(1, 6))) + f"</{t}>",
            "footer": lambda: r.choice([f"<footer>{r.choice(['&copy; ', '© ', '', 'Copyright '])}{self.words(1, 3)}{r.choice([' &middot; ', ' | ', ' - ', ' '])}{text()}</footer>", f"<footer><p>{text()}</p>{self.links()}</footer>", f"<div {mark('footer bottom copyright legal social share tags meta byline author')}><p>{text()}</p></div>"]),
        }
        return made[where]()

    def page(self) -> str:
        """A page whose article blocks carry a marker character."""
        r = self.r
        bare = r.random() < 0.3  # nothing tells the article but what it is and where it stands
        body = [re.sub(r">([^<]+)", lambda m: ">\x01" + m[1], x).replace("<x>", "").replace("</x>", "") for x in self.article(bare and r.random() < 0.5)]
        for where in r.sample(["ad", "side", "notice", "form", "comments"], r.choice([0, 0, 1, 2])):  # inside the article
            body.insert(r.randint(1, len(body)) if where != "comments" else len(body), self.other(where))
        name, mark = r.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article"'), ("div", ' class="post entry"'), ("section", ' class="story body"'), ("div", ' class="main text"')])
        if bare:
            name, mark = r.choice([("div", self.name()), ("div", self.name()), ("section", ""), ("", "")])
        few = r.random() < 0.25  # hardly anything around
        before = [self.other(x) for x in ("header", "nav", "notice", "form", "ad") if r.random() < (0.05 if few else 0.85 if x == "nav" else 0.4)]
        after = [self.other(x) for x in ("side", "ad", "comments", "form", "notice", "footer") if r.random() < (0.05 if few else 0.85 if x == "footer" else 0.35)]
        r.shuffle(before)
        text = "".join(body)
        text = f"<{name}{mark}>{text}</{name}>" if name else text
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            text = f"<div{self.name()}>{text}</div>"
        text = f"{''.join(before)}{text}{''.join(after)}"
        if r.random() < 0.1:  # a layout of tables
            text = f"<table><tr><td>{''.join(before)}</td><td>{''.join(body)}</td></tr></table>{''.join(after)}"
        if r.random() < (0.4 if few else 0.05):  # a fragment
            return text
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 10)}</title><style>p{{}}</style><script>var a;</script></head><body{self.name()}>{text}</body></html>"

    def labelled(self) -> tuple[list[Leaf], np.ndarray]:
        found = leaves(self.page())
        y = np.array(["\x01" in x.text for x in found], dtype=np.float32)
        return [Leaf(x.path, " ".join(x.text.replace("\x01", "").split()) or "-", x.linked) for x in found], y


@lru_cache(maxsize=1)
def trained(pages: int = 2400, epochs: int = 16) -> Labeller:
    """The labeller, trained on ``pages`` made pages; the same on every call and machine up to rounding."""
    layouts = Layouts()
    made = [layouts.labelled() for _ in range(pages)]
    return Labeller().fit([(features(x), y) for x, y in made], epochs)


def label(pages: list[list[Leaf]], model: Labeller, batch: int = 64) -> list[np.ndarray]:
    """For each page, whether each block is article text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    for k in range(0, len(order), batch):
        who = order[k : k + batch]
        x, mask = padded([features(pages[i]) for i in who])
        z = model.scores(x, mask)
        for j, i in enumerate(who):
            out[i] = z[: len(pages[i]), j] > 0
    return out


def main_text(pages: DataFrame, *, training_pages: int = 2400, epochs: int = 16) -> DataFrame:
    """A row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages without article blocks: an empty text. Blocks keep their order and are all kept, whatever
    their number or length. Repeated rows are each answered; the empty table gives none. One narrow stage, no shuffle.
    """
    model = trained(training_pages, epochs)
    held = pages.sparkSession.sparkContext.broadcast((model.hidden, model.w))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(held.value[0])
        own.w = held.value[1]
        for batch in grouped(batches, "html", 1 << 20):
            found = [leaves(x) for x in batch.column("html").to_pylist()]
            texts = ["\n\n".join(leaf.text for leaf, keep in zip(page, kept) if keep) for page, kept in zip(found, label(found, own))]
            yield rows(schema, [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]])

    return narrow(pages, "page_id", "url", "html").mapInArrow(task, "page_id long, url string, text string, n_chars long")
