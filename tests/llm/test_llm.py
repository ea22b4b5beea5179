import base64
import hashlib
import io
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import components, decontaminate, htmltext, jaccard, lines, lmscore, packing, pii, quality, suffixes, warc
from tallyframe.llm.shingles import shingle_sets

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def passage(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(9)) for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, blanks, repeats, ties, near copies and long texts; further columns have clashing names."""
    a, b = passage(1, 120), passage(2, 90)
    near = a.split()
    near[60] = "changed"
    rows = [(0, a), (1, a), (2, " ".join(near)), (3, b + "\n" + a), (4, None), (5, ""), (6, " \n\t"), (7, "two words"), (8, "Two WORDS"), (9, b + " tail"), (10, "x" * 1000), (None, passage(5, 80)), (None, passage(5, 80)), (11, passage(6, 30000)), (11, passage(7, 60))]
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, n long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_empty_tables(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert pii.find(none).count() == packing.pack(none).count() == jaccard.near_duplicates(none).count() == lines.dedup(none).count() == 0
    assert quality.score(none).count() == lmscore.score(none).count() == suffixes.removal(none).count() == decontaminate.match(none, bench).count() == 0
    assert htmltext.main_text(pages, training_pages=20, epochs=1).count() == warc.round_trip(pages).count() == 0


def test_pii(docs):
    assert pii.find(docs).count() == docs.count()
    for text, kind, found in (("mail jo (at) site (dot) com", "email", "jo (at) site (dot) com"), ("jо@exаmple.com", "email", "jо@exаmple.com"), ("plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"), ("１０.0.0.１", "ip", "１０.0.0.１")):
        plain = pii.plain_spans(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised_spans(text, plain)] == [(kind, found)]
    assert pii.disguised_spans("He is at home. The dot com bubble of one or two", []) == []
    assert pii.redact("a@b.co and +1 (555) 555-1234") == "<email> and <phone>"


def test_disguised_spans_reach_over_plain_fragments():
    for text in ("jоhn@example.com", "user@mail.exаmple.com", "jo@mail.example (dot) com", "name arroba firma punto com", "name ät firma punkt de", "nom arobase site point fr", "name at example.com", "jo at site dot com"):
        assert (0, 0, len(text)) in pii.disguised_spans(text, pii.plain_spans(text)), text
        assert pii.redact(f"to {text}!") == "to <email>!"
    for text in ("We arrive at some point in May.", "It is at example.com", "Plain jo@example.com stays", "El punto com y la arroba."):
        assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def brute_pii(text):
    """The four plain patterns as stated, each run over the text, failing matches dropped."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_plain_patterns_against_the_stated_ones(spark, sf):
    r = np.random.default_rng(21)
    made = ["".join(r.choice(list("0123456789 .-+()@ab"), r.integers(1, 60), p=[0.07] * 10 + [0.04, 0.06, 0.04, 0.05, 0.02, 0.02, 0.03, 0.02, 0.02])) for _ in range(4000)]
    made += [f"{k} 4111 1111 1111 1111 +1 (555) 555-12{k} a@b.c{k} 255.{k}.0.1" for k in range(300)] + ["1" * 5000, "+" * 900, "a@" * 900, "1.1.1.1." * 700]
    assert sum(bool(brute_pii(t)) for t in made) > 300
    for t in made:
        assert pii.plain_spans(t) == brute_pii(t), t
    table = spark.read.parquet(f"{sf}/documents.parquet")
    told = {x.doc_id: x for x in pii.find(table).collect()}
    for x in table.collect():
        want = brute_pii(x.text or "")
        row = told[x.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()


def test_many_disguised_spans_in_one_text():
    text = "jo (at) site (dot) com " * 3000
    began = time.process_time()
    assert len(pii.disguised_spans(text, [])) == 3000 and time.process_time() - began < 5


def test_html_labeller_on_held_out_layouts():
    made = htmltext.Layouts(99)
    pages = [made.labelled() for _ in range(60)]
    kept = htmltext.label([p for p, _ in pages], htmltext.trained())
    right = sum(int((k == (y > 0)).sum()) for k, (_, y) in zip(kept, pages))
    assert right / sum(len(y) for _, y in pages) > 0.98
    assert htmltext.leaves("") == [] and htmltext.leaves("<script>x") == []
    assert [x.text for x in htmltext.leaves("<p>a&amp;<b>b</b>\n c<p>d<!-- e")] == ["a&b c", "d"]


PARA = "The quick brown house stands by the river, and people walk past it every day in summer. It was built in 1890."


@pytest.mark.parametrize(
    "html, blocks",
    [
        (f"<html><body><div>{PARA}</div><div>{PARA}</div></body></html>", [PARA, PARA]),
        (f"<body>{PARA}<br><br>{PARA}</body>", [PARA + " " + PARA]),
        (f"<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div><div>{PARA}</div><div>{PARA}</div></div><footer>(c) 2020 Site</footer></body></html>", [PARA, PARA]),
        (f"<p>{PARA}</p>", [PARA]),
        (PARA, [PARA]),
        (f"<table><tr><td><a href=x>Home</a> <a href=y>Two</a></td><td>{PARA}<p>{PARA}</td></tr></table>", [PARA, PARA]),
        ("", []),
        (None, []),
    ],
)
def test_text_of_pages_without_telling_marks(html, blocks):
    found = htmltext.leaves(html or "")
    (kept,) = htmltext.label([found], htmltext.trained())
    assert [x.text for x, k in zip(found, kept) if k] == blocks


def test_text_of_the_given_pages(spark, sf):
    """The article element of the given pages tells their text: its blocks, but for what is marked as something else inside."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in htmltext.main_text(pages.withColumn("text", F.lit("x"))).collect()}
    for r in pages.collect():
        inside = [x for x in htmltext.leaves(r.html or "") if "article" in x.path and not any(re.search(r" ad| comment| cookie|^aside|^nav|^footer|^form", m) for m in x.path)]
        want = "\n\n".join(x.text for x in inside)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_with_broken_tags_take_linear_time():
    for broken in ('<a "', "<a b='<", "<!-- ", "<p", "<<<", "</"):
        began = time.process_time()
        htmltext.leaves(broken * 50_000)
        assert time.process_time() - began < 10, broken
    assert [x.text for x in htmltext.leaves('<p title="a>b">one<p title="open>two<p>three')] == ["one", "two", "three"]


def test_packing_is_a_partition_of_the_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, ids=True).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = int(g.length.sum())
        assert total <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert total == 2048 or total & (total - 1) == 0
    own = sorted(tuple([*reference.encode(t, add_special_tokens=False).ids, 1]) for _, t in texts(docs))
    made, last = [], {}
    for row in got.sort_values(["doc_id", "start"]).itertuples():  # rows with one id, or none, are told apart by what they hold
        last.setdefault((row.doc_id if row.doc_id == row.doc_id else None, row.doc_tokens), []).append((row.start, tuple(np.frombuffer(row.ids, "<u4").tolist())))
    for (_, tokens), pieces in last.items():
        if sum(len(x) for _, x in pieces) == tokens:
            made.append(tuple(i for _, x in sorted(pieces) for i in x))
        else:  # equal rows, each cut in its own way: all their pieces are of one text
            copies = sum(len(x) for _, x in pieces) // tokens
            assert copies * tokens == sum(len(x) for _, x in pieces)
            text = next(x for x in own if len(x) == tokens and all(x[a : a + len(y)] == y for a, y in pieces))
            covered = np.zeros(tokens, int)
            for a, y in pieces:
                covered[a : a + len(y)] += 1
            assert (covered == copies).all()
            made += [text] * copies
    assert own == sorted(made)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n \nb", "a\tb c", "it's 5's", "a b c", "é ß\r\n x", "<|endoftext|> a", "a \n b", "x<|endoftext|>", "a <|endoftext|>  <|endoftext|> b", "<|endoftext>"])
def test_tokenizer_on_white_space(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.tokenizer_of(None).ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_tokenizer_on_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference, own, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer_of(None), np.random.default_rng(2)
    parts = ["a", "Word", "ñandú", "straße", "12", "'s", "'LL", ".", ",", "!!", "\n", " ", " ", " ", " ", "\t", "x", "<|endoftext|>", "<|", "日本", "🙂", "\u00a0", "e\u0301", "-", "_", "\r\n"]
    texts = ["".join(r.choice(parts, r.integers(1, 30))) for _ in range(4000)]
    for text, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == e.ids, text


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components.local_components(links)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(root.get(i, i), []).append(d)
    return [(d, len(sets[i]), min((x for x in group[root.get(i, i)] if x is not None), default=d)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("params", [jaccard.JaccardParams(), jaccard.JaccardParams(frequent=2, locally=1), jaccard.JaccardParams(longest=2)])
def test_jaccard(spark, docs, params):
    key = lambda x: str(x)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, params).collect()]
    assert sorted(got, key=key) == sorted(brute_components(texts(docs)), key=key)


@pytest.mark.parametrize("params", [jaccard.JaccardParams(frequent=4, locally=1, group=7), jaccard.JaccardParams(locally=99), jaccard.JaccardParams(locally=99, longest=5)])
def test_jaccard_with_one_hot_family(spark, params):
    """Every shingle is frequent: pairs come from pivots and derived answers; or none is known to be: from long lists, or from lists found to be too long."""
    r = np.random.default_rng(3)
    base = passage(9, 60).split()
    rows = []
    for i in range(80):
        own = list(base)
        for k in r.integers(0, 60, r.integers(0, 4)):
            own[k] = f"w{r.integers(5)}"
        rows.append((i, " ".join(own[: 60 - i % 9])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, params).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_candidates_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Near copies whose shingles no worker's block finds frequent."""
    made, write = {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag: made.__setitem__(tag, write(df, tag)) or made[tag])
    for n in (40, 200):
        docs = spark.createDataFrame([(i, f"{passage(9, 60)} own{i}") for i in range(n)], "doc_id long, text string")
        assert {r.component_id for r in jaccard.near_duplicates(docs, jaccard.JaccardParams(locally=999)).collect()} == {0}
        assert made["pairs"].count() < 2 * n


def test_long_lists_skip_only_what_cannot_match():
    r = np.random.default_rng(6)
    e = np.zeros(300, dtype=jaccard.ENTRY)
    e["n"] = r.integers(4, 60, 300)
    e["at"] = [r.integers(0, jaccard.prefix_length(75, n)) for n in e["n"].tolist()]
    got = {tuple(sorted(x)) for left, right in jaccard._long_list(e, 0, 300, 75) for x in zip(left.tolist(), right.tolist())}
    x, y = np.triu_indices(300, 1)
    want = {tuple(sorted(p)) for p in zip(*(k.tolist() for k in jaccard._passing(e, x, y, 75)))}
    assert got == want and 0 < len(want) < len(x) / 3


def test_one_row_of_each_component_stays(spark):
    a, b = passage(1, 60), passage(2, 60)
    rows = [(3, a), (1, a), (1, b), (1, b), (None, a), (None, passage(3, 50)), (None, passage(3, 50)), (5, None), (5, None), (6, ""), (2, b + " tail")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ident string")
    wide = df.withColumns({c: F.lit(1) for c in ("component", "own", "rows", "key")})
    got = sorted(((x.doc_id, x.text) for x in jaccard.keep_one(wide).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, passage(3, 50)), (5, None), (5, None), (6, "")], key=str)


def test_shingles_of_few_words():
    a, b, c, d = shingle_sets([b"a b", b"A  b\n", b"", b"a b c d e"])
    assert a.tolist() == b.tolist() and len(a) == 1 and len(c) == 0 and len(d) == 1


def test_quality(docs):
    got = {(r.doc_id, r.text): r._q for r in quality.score(docs).collect()}
    for (_, t), q in got.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (q.n_words, q.word_chars) == (len(w), sum(map(len, w)))
    assert not got[4, None].kept and set(quality.keep(docs).columns) == set(docs.columns)


def brute_quality(text, lang, p=quality.QualityParams()):
    w, long = re.findall(r"[^\x20\x09-\x0D]+", text), len(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    inside = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))

    def js(own, ref):
        part = lambda a, m: a * np.log2(a / m) if a > 0 else 0.0
        return max(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(own, ref)) / 2, 0) ** 0.5

    digits, stops = len(re.findall("[0-9]", text)), len(re.findall(r"[.,;:!?'\"()-]", text))
    shares = [x / long for x in (chars - digits - stops - symbols, digits, long - chars, stops, symbols)] if long else None
    low = [x.lower() for x in w]
    hist = lambda code: [low.count(x) / max(len(w), 1) for x in quality.COMMON_WORDS[code]] + [sum(x not in quality.COMMON_WORDS[code] for x in low) / max(len(w), 1)]
    codes = [lang] if lang in quality.COMMON_WORDS else list(quality.COMMON_WORDS) if lang is None else []
    a = min((js(shares, quality.CLASS_SHARES[c]) for c in codes), default=0.0) if shares else 0.0
    b = min((js(hist(c), quality.word_reference(c)) for c in codes), default=0.0)
    failed = len(w) < p.min_words or 100 * len(inside) > p.max_repeat_percent * len(w)
    strays = len(w) >= p.guard_words and long >= p.guard_chars and (a > p.max_class_distance or b > p.max_word_distance + p.word_slack / max(len(w), 1) ** 0.5)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(inside), failed, not failed and not strays


def test_quality_against_brute_force(spark, sf):
    r = np.random.default_rng(31)
    common = quality.COMMON_WORDS["en"]
    made = [" ".join(str(x) for x in r.choice([*common * 2, *WORDS, "x#1", "a\nb", "Z."], r.integers(40, 160))) for _ in range(40)] + ["the " * 80, "", None, "\n\n \x0b\n", "#$% " * 60, "12 34, " * 90]
    rows = [(i, t, [None, "en", "de", "zz"][i % 4]) for i, t in enumerate(made)]
    rows += [(1000 + x.doc_id, x.text, x.lang) for x in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(60).collect()]
    got = {x.doc_id: x._q for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, lang in rows:
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed, q.kept) == brute_quality(t or "", lang), (i, t)


@pytest.mark.parametrize("column", ["_q", "__q_text", "__q_own", "kept", "n_words"])
def test_quality_beside_any_column(docs, column):
    wide = docs.withColumn(column, F.lit("x"))
    got = quality.keep(wide)
    assert got.columns == wide.columns and got.where(F.col(f"`{column}`") == "x").count() == quality.keep(docs).count()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    r = np.random.default_rng(4)
    for _ in range(1500):
        a, b = ("".join(r.choice(list("abc"), r.integers(1, 9))) for _ in range(2))
        for t in (1, 2, 3):
            assert lines.edit_within(a, b, t) == min(edit(a, b), t + 1)
        ends = min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.myers(a, b, 9) == min(ends, 10)


def test_line_dedup(spark):
    line = passage(1, 8)
    rows = [(0, f"{line}\nshort\n{passage(2, 8)}"), (1, f"{line[:10]}X{line[10:]}\nshort"), (2, f"{passage(3, 8)}\n{line[:-1]}"), (3, None), (4, passage(4, 9)), (None, line)]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n_chars long, ident string")
    got = {r.doc_id: (r._lines.n_removed, r._lines.kept) for r in lines.dedup(df).collect()}
    assert got[0][0] == 0 and got[1] == (1, "short") and got[2] == (1, passage(3, 8)) and got[4][0] == 0 and got[None] == (1, "")
    left = {r.doc_id: (r.text, r.n_chars) for r in lines.drop_repeated(df).collect()}
    assert left[1] == ("short", 5) and None not in left and left[3] == (None, 0)


def brute_lines(rows, params):
    """All pairs of lines: (doc_id -> removed line numbers)."""
    held = [(i is None, i if i is not None else 0, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    distinct = sorted({x for *_, x in held})
    long = [x for x in distinct if len(x) >= params.line_chars]
    near = [(distinct.index(a), distinct.index(b)) for k, a in enumerate(long) for b in long[:k] if lines.edit_within(a, b, params.distance) <= params.distance]
    root = components.local_components(near)
    of = {x: root.get(k, k) for k, x in enumerate(distinct)}
    first, docs_with, members = {}, {}, {}
    for last, i, n, x in sorted(held):
        first.setdefault(of[x], (last, i, n))
        docs_with.setdefault(of[x], set()).add((last, i))
        members.setdefault(of[x], set()).add(x)
    out = {i: [] for i, _ in rows}
    for last, i, n, x in sorted(held):
        short = all(len(y) < params.rare_chars for y in members[of[x]])
        if first[of[x]] != (last, i, n) and not (short and len(docs_with[of[x]]) < params.documents):
            out[None if last else i].append(n)
    return out


@pytest.mark.parametrize("crowd", [4096, 3])
def test_line_dedup_against_all_pairs(spark, crowd):
    r = np.random.default_rng(12)
    heads = [passage(k, 6) for k in range(6)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(int(r.integers(0, 6))):
            line = list(heads[int(r.integers(0, 6))] if r.random() < 0.7 else passage(int(r.integers(40)), 3)[:23])
            for _ in range(int(r.integers(0, 4))):
                at = int(r.integers(0, len(line)))
                line[at : at + int(r.integers(0, 2))] = r.choice(list("abc ")) if r.random() < 0.7 else ""
            own.append("".join(line))
        rows.append((i if i % 17 else None if i == 17 else i, "\n".join(own)))
    params = lines.LineParams(crowd=crowd)
    got = {x.doc_id: x._lines.removed for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()}
    assert got == brute_lines(rows, params)


def test_crowded_list_is_linked_without_its_pairs():
    r = np.random.default_rng(5)
    base = passage(3, 10)
    made = sorted({base[:k] + c + base[k + 1 :] for k in range(0, len(base), 3) for c in "xyz"} | {passage(int(k), 10) for k in r.integers(9, 99, 20)})
    keys = [lines.line_key(x) for x in made]
    found = lines.link_crowd(keys, made, {}, 2)
    near = [(i, j) for i in range(len(made)) for j in range(i) if lines.edit_within(made[i], made[j], 2) <= 2]
    assert len(found) < len(made) < len(near)
    want, got = components.local_components(near), components.local_components([(keys.index(a), keys.index(b)) for a, b in found])
    assert want == got


def test_crowded_lists_against_all_pairs():
    """Lines with changing numbers, and lines over a small alphabet, for each distance."""
    r = np.random.default_rng(17)
    lists = [(2, sorted({f"The order with the number {r.integers(0, 10**4):04d} of {r.integers(0, 99)} was sent" for _ in range(400)}))]
    for k in range(30):
        base, made = "".join(r.choice(list("ab "), 50)), set()
        for _ in range(100):
            line = list(base)
            for _ in range(int(r.integers(0, 9))):
                at = int(r.integers(0, len(line)))
                line[at : at + int(r.integers(0, 2))] = r.choice(list("abc")) if r.random() < 0.7 else ""
            made.add("".join(line))
        lists.append((1 + k % 3, sorted(made)))
    for distance, made in lists:
        keys = [lines.line_key(x) for x in made]
        near = [(i, j) for i in range(len(made)) for j in range(i) if lines.edit_within(made[i], made[j], distance) <= distance]
        found = [(keys.index(a), keys.index(b)) for a, b in lines.link_crowd(keys, made, {}, distance)]
        assert components.local_components(near) == components.local_components(found) and len(found) < len(made)


@pytest.mark.parametrize("digits, most", [(8, 9), (5, 9)])
def test_crowded_lists_take_linear_time(digits, most):
    """Sixteen times the lines that differ in a number: far from 256 times the work."""
    r, took = np.random.default_rng(18), []
    for n in (1000, 16_000):
        made = sorted({f"The order with the number {r.integers(0, 10**digits):0{digits}d} was sent to the customer today" for _ in range(n)})
        began = time.process_time()
        lines.link_crowd([lines.line_key(x) for x in made], made, {}, 2)
        took.append(time.process_time() - began)
    assert took[1] < 16 * most * max(took[0], 0.05)


def test_languages_without_a_reference_are_not_judged_by_distances(spark):
    rows = [(0, "zh", "漢字仮名 交じり文 " * 40 + " ".join(f"語{i}" for i in range(80))), (1, "th", " ".join(f"ภาษา{i}ไทย" for i in range(90)))]
    assert [r._q.class_distance for r in quality.score(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()] == [0.0, 0.0]
    assert quality.keep(spark.createDataFrame(rows[1:], "doc_id long, lang string, text string")).count() == 1


def test_clashing_names_of_line_dedup(spark):
    df = spark.createDataFrame([(1, "a line that stands twice here", "x"), (2, "a line that stands twice here\nmore", "y")], "doc_id long, text string, ident string")
    names = ("removed", "n_linked", "_ident", "_text", "text_", "own", "lines", "key", "n_lines")
    wide = df.withColumns({c: F.lit(5) for c in names})
    got = {x.doc_id: x for x in lines.drop_repeated(wide).collect()}
    assert got[2]["text"] == "more" and all(got[1][c] == got[2][c] == 5 for c in names) and list(got[1].asDict()) == wide.columns


def test_short_lines_are_linked_by_equality(spark):
    equal, near = "a line of 23 characters", "a line of 23 charakters"
    texts = [f"{equal}\nMenu\n\n{passage(1, 8)}", f"Menu\n{near}\nonly two\n\nx", f"{equal}\nMenu\n\n{equal}", "only two\ny"]
    assert len(equal) == 23
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r._lines.removed for r in lines.dedup(df).collect()}
    assert got == {0: [], 1: [0], 2: [0, 1, 3], 3: []}


def test_lm_prefers_what_the_corpus_holds(spark):
    rows = [(i, "the cat sat on the mat and the dog lay by the door " * 3) for i in range(30)] + [(99, "door the by lay dog the and mat the on sat cat the"), (100, None)]
    got = {r.doc_id: r for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), lmscore.LmParams(classes=32, frequent=20, epochs=60)).collect()}
    assert got[0].mean_log_likelihood > got[99].mean_log_likelihood and got[100].n_tokens == 0 and got[100].mean_log_likelihood is None


def test_lm_counts_are_the_corpus(spark):
    params = lmscore.LmParams(classes=16, frequent=5)
    df = spark.createDataFrame([("a b c",), ("a b",), ("",)], "text string")
    held = spark.sparkContext.broadcast(lmscore.frequent_words(df, params))
    assert lmscore.triple_counts(df, held, params).sum() == 5


def test_lm_scores_words_and_wide_windows(spark):
    """Against a brute-force version: exact P(word | class), and counts of windows of two words a side, the token itself left out."""
    params = lmscore.LmParams(classes=8, frequent=2, epochs=20)
    docs = [(1, "a b c d e f a b a"), (2, "a b x d e a a b"), (3, "a b c d e"), (4, ""), (None, "z a"), (None, "z a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).cache()
    got = lmscore.score(df, params).collect()
    held = spark.sparkContext.broadcast(lmscore.frequent_words(df, params))
    counts = lmscore.triple_counts(df, held, params)
    table = lmscore.WindowNetwork(params).fit(counts, params).table().astype(float)
    number, seen, around = {}, {}, {}
    split = [t.split() for _, t in docs]
    context = lambda w, i: tuple(w[j] if 0 <= j < len(w) else None for j in (i - 2, i - 1, i + 1, i + 2))
    for w in split:
        for i, x in enumerate(w):
            number[x] = number.get(x, 0) + 1
            seen[context(w, i), x] = seen.get((context(w, i), x), 0) + 1
            around[context(w, i)] = around.get(context(w, i), 0) + 1
    want = []
    for (d, t), w in zip(docs, split):
        left, own, right = lmscore._triples(*lmscore.words([t.encode()]), held.value, params) if w else ([], [], [])
        total = 0.0
        for i, x in enumerate(w):
            p = np.exp(table[left[i], right[i], own[i]]) * number[x] / counts.sum(axis=(0, 1))[own[i]]
            total += np.log((seen[context(w, i), x] - 1 + params.prior * p) / (around[context(w, i)] - 1 + params.prior))
        want.append((d, len(w), round(total, 4)))
    assert sorted(((r.doc_id, r.n_tokens, round(r.log_likelihood, 4)) for r in got), key=str) == sorted(want, key=str)


def test_decontamination(spark, docs):
    item = " ".join(passage(1, 120).split()[20:60])
    bench = spark.createDataFrame([(7, item), (8, passage(77, 40)), (9, "tiny"), (None, item), (10, "Two words!")], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r._hits] for r in decontaminate.match(docs, bench).collect()}
    assert got[0] == got[1] == got[2] == got[3] == [7] and got[9] == [] and got[4] == [] and got[7] == got[8] == [10]
    near = item.replace("a", "A").replace(" ", ",  ", 3)[:50] + "zz" + item[52:]
    assert decontaminate.match(spark.createDataFrame([(1, near)], "doc_id long, text string"), bench).first()._hits[0].item_id == 7
    assert set(decontaminate.drop_contaminated(docs, bench).columns) == set(docs.columns)


@pytest.mark.parametrize("column", ["_text", "hits", "own", "gone", "item_id", "row"])
def test_decontamination_beside_any_column(spark, docs, column):
    bench = spark.createDataFrame([(1, passage(77, 40))], "item_id long, text string")
    wide = docs.withColumn(column, F.lit("x"))
    got = decontaminate.drop_contaminated(wide, bench)
    assert got.columns == wide.columns and got.where(F.col(f"`{column}`") == "x").count() == docs.count() and got.where("text is null").count() == 1


def test_decontamination_in_blocks(spark):
    """Several blocks of items, with writes between; the nearest of items with one id counts."""
    texts = [passage(k, 12) for k in range(9)]
    bench = spark.createDataFrame([(k % 5, t) for k, t in enumerate(texts)], "item_id long, text string")
    df = spark.createDataFrame([(k, "so " + t[:30] + "x" * (k % 2) + t[30:]) for k, t in enumerate(texts)], "doc_id long, text string")
    params = decontaminate.DecontaminationParams(block_bytes=50, blocks=2)
    got = {r.doc_id: [(h.item_id, h.distance) for h in r._hits] for r in decontaminate.match(df, bench, params).collect()}
    assert got == {k: [(k % 5, k % 2)] for k in range(9)}


def test_matcher_against_all_places():
    """Every passage within the budget is found, glued to its neighbours or not; and the distance is the least."""
    r = np.random.default_rng(14)
    params = decontaminate.DecontaminationParams()
    words = "a in of the two three seven house garden plus minus equals what is river".split()
    caught = 0
    for n in range(400):
        item = " ".join(words[k] for k in r.integers(0, len(words), r.integers(2, 14)))
        budget = int(len(item) * params.error_share) if len(item) >= params.short_chars else 0
        made = list(item)
        for _ in range(r.integers(0, budget + 2)):
            at = int(r.integers(0, len(made)))
            spaces = [k for k, c in enumerate(made) if c == " "]
            at = int(r.choice(spaces)) if spaces and r.random() < 0.6 else at
            made[at : at + int(r.integers(0, 2))] = r.choice(["x", "", " "])
        text = decontaminate.normalise(" ".join(words[k] for k in r.integers(0, len(words), 5)) + r.choice(["", " "]) + "".join(made) + r.choice(["", " "]) + "tail of it")
        least = min(edit(item, text[a:b]) for a in range(len(text)) for b in range(a, min(len(text), a + len(item) + budget) + 1)) if n < 60 else decontaminate.myers(item, text, len(item))
        found = decontaminate.Matcher([(1, item)], params).find(text)
        if budget or len(item) >= params.short_chars:
            assert found == ({1: least} if least <= budget else {}), (item, text, least, budget)
        else:
            assert found == ({1: 0} if f" {item} " in f" {text} " else {})
        caught += bool(found)
    assert 100 < caught < 399


def test_matcher_measures_few_places(monkeypatch):
    """A piece of an item in another text is ruled out without a distance; an edited passage is measured once."""
    item, other = passage(77, 24), passage(3, 30)
    budget = int(len(item) * decontaminate.DecontaminationParams().error_share)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    matcher = decontaminate.Matcher([(1, item)], decontaminate.DecontaminationParams())
    calls, plain = [], decontaminate.myers
    monkeypatch.setattr(decontaminate, "myers", lambda *a: calls.append(a) or plain(*a))
    for a, b in zip(cuts, cuts[1:]):
        assert matcher.find(other + item[a:b] + other) == {}
    assert not calls
    edited = item[:20] + "xx" + item[20:60] + item[61:90] + "zz" + item[92:120] + item[122:]
    assert matcher.find(f"{other} {edited} {other}") == {1: plain(item, edited, len(item))} and len(calls) == 1
    assert matcher.find(f"{edited} {other} {edited[:70]}x{edited[70:]}") == {1: plain(item, edited, len(item))} and len(calls) == 3


def test_normalised_text_of_every_character():
    spaced = str.maketrans({chr(c): " " for c in [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128), 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2000, 0x2070), 0x3000]})
    for n in range(0, 0x110000, 64):
        text = "a".join(chr(c) + "B" for c in range(n, n + 64))
        assert decontaminate.normalise(text) == " ".join(text.lower().translate(spaced).split())


def brute_removal(rows, length):
    data = [t.encode() for _, t in rows]
    seen = {}
    for x in data:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for (d, _), x in zip(rows, data):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((d, len(x), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, passage_bytes, gram", [(400, 256, 64), (60, 60, 20), (60, 30, 10)])
def test_suffix_removal(docs, length, passage_bytes, gram):
    got = [tuple(r) for r in suffixes.removal(docs, suffixes.RepeatParams(length=length, passage=passage_bytes, gram=gram)).drop("kept").collect()]
    told = brute_removal(texts(docs), passage_bytes)
    want = [(*x, y[2]) for x, y in zip(brute_removal(texts(docs), length), told)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nb", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "ü", "<p>é</p>" * 3000), (None, "n", "same"), (6, "x", "other"), (6, "y", "other")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    top = {"same": 2, "": 4, "<p>é</p>" * 3000: 5, "other": 6}
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i == top[h or ""] else ("revisit", top[h or ""]))) for i, _, h in rows]
    assert got == sorted(want, key=str)


def test_broken_archives_are_refused():
    writer = warc.ArchiveWriter(warc.WarcParams())
    for i in range(3):
        writer.add(warc.record(i, "u", b"payload" * 50, None, "1970-01-01T00:00:00Z"))
    data = writer.done()
    assert len(list(warc.frames(io.BytesIO(data)))) == 3
    for bad in (data[:-5], data[8:], b""):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(bad)))
    raw = warc.record(1, "u", b"payload", None, "d")
    for bad in (raw.replace(b"WARC/1.1", b"WARC/0.9"), raw.replace(b"payload", b"payl0ad"), raw[:-2], raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_components(spark):
    r = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2)) if a != b] + [(100 + i, 101 + i) for i in range(12)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components.local_components(pairs)


def test_pipeline_against_brute_force(spark, sf):
    """Every stage's rows from the previous stage's, by the plain versions above, down to the packed ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}
    assert len(held) == docs.count()
    held = {i: t for i, (t, lang) in held.items() if brute_quality(t, lang)[-1]}
    out, stages = docs, dict(corpus_pipeline.STAGES)

    def same(name):
        nonlocal out
        made = stages[name](spark, out, sf)
        assert made.columns == docs.columns
        rows = made.collect()
        out = spark.createDataFrame(rows, docs.schema)
        assert {r.doc_id: r.text or "" for r in rows} == held and len(rows) == len(held), name

    same("quality rules")
    gone = brute_lines([(i, t) for i, t in held.items()], lines.LineParams())
    kept = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(gone[i])) if gone[i] else t for i, t in held.items()}
    held = {i: t for i, t in kept.items() if not gone[i] or t.strip(" \t\n\x0b\x0c\r")}
    same("line dedup")
    held = {d: held[d] for d, _, c in brute_components(list(held.items())) if d == c}
    same("n-gram Jaccard join")
    params = decontaminate.DecontaminationParams()
    items = [decontaminate.normalise(r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        for item in filter(None, items):
            budget = int(len(item) * params.error_share) if len(item) >= params.short_chars else 0
            cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
            if any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) and (decontaminate.myers(item, text, budget) <= budget if len(item) >= params.short_chars else f" {item} " in f" {text} "):
                return True
        return False

    held = {i: t for i, t in held.items() if not leaks(decontaminate.normalise(t))}
    same("benchmark decontamination")
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(reference.encode(t, add_special_tokens=False).ids) + 1 for i, t in held.items()}
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: r.t for r in packed} == want
