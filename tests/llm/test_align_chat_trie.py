import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import align, chat, queries, shared, trie

SCHEMA = "doc_id long, text string, block int, pairs string, told int"
CONV = "conv_id long, turn long, role string, text string, at int, real string, depth int, owner long, example int"


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    made = ["the cat sat", "The cat  sat\non the mat.", "", None, "▁odd", "a<|endoftext|>b </s> <0x41>", "naïve café 漢字 😀‍😀", "x" * 3000, "ab " * 2000, "\x00\x01 \t\r\n", " lead", "word", "　ﬁ ①"]
    words = "stream ing tokens über été 漢 123 4567 don't !!! -- \n foo_bar".split(" ")
    return made + [" ".join(r.choice(words, r.integers(1, 60))) for _ in range(40)] + ["the cat sat"] * 3


def brute_alignment(texts):
    """Groups from common borders; counts from sets of linked pairs per document."""
    side_a, side_b = align.ByteSide(None), align.PieceSide(None)
    made = []
    for text in texts:
        whole, a, b = b" " + (text or "").encode(), side_a.ids(text or ""), side_b.ids(text or "")
        if not text or any(b"".join(s.bytes[i] for i in ids) != whole for s, ids in ((side_a, a), (side_b, b))):
            made.append(None)
            continue
        ends = lambda side, ids: np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
        ends_a, ends_b = ends(side_a, a), ends(side_b, b)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        made.append((len(a), len(b), groups))
    count = Counter(pair for x in made if x for pair in {(p, q) for a, b in x[2] for p in a for q in b})
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = []
    for x in made:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for a, b in x[2] for p in a for q in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x[2])
        out.append((x[0], x[1], len(x[2]), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("params", [align.AlignParams(), align.AlignParams(block_bytes=200, slice_links=7, small_group=0)])
def test_alignment_against_brute_force(spark, texts, params):
    ids = [None if i == 5 else i // 2 for i in range(len(texts))]  # a null id and repeated ids
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    got = [tuple(r) for r in align.align(docs, params).collect()]
    want = [(i, *x) for i, x in zip(ids, brute_alignment(texts))]
    assert sum(x[1] == 0 for x in want) >= 3
    assert sorted(got, key=str) == sorted(want, key=str)
    assert align.align(docs.where("false"), params).count() == 0


def test_ids_are_those_of_the_libraries(spark, sf, texts):
    found, r = align.Encoder(align.AlignParams()), np.random.default_rng(9)
    made = ["".join(r.choice(list("ab é漢\n.,'1 -é\t\x1c\x85\u3000\u200b\xa0<|>s٣ⅷ😀"), r.integers(1, 40))) for _ in range(4000)] + ["a" * 20_000, "\n" * 20_000, " " * 20_000, "=" * 20_000]
    for text in [*filter(None, texts), *made, *[x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect() if x.text]]:
        if told := found(text):
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in told] == [found.a.ids(text), found.b.ids(text)], text


def test_links_travel_in_few_bytes(spark, texts):
    for values in ([], [0], [255, 3], [256], [65_536], [1 << 33, 0]):
        blob = align.packed(values)
        assert align.unpacked(blob, len(values)).tolist() == values
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = align.blocks(docs, align.AlignParams()).selectExpr("octet_length(which) + octet_length(times) AS size", "aggregate(held, 0L, (a, b) -> a + b) AS links").collect()
    assert sum(r.links for r in found) > 0 and all(r.size <= 6 * r.links for r in found)


def test_an_ended_task_gives_its_memory_back(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "release", lambda: seen.append("release"))
    task = shared.trimmed(lambda batches: (seen.append(x) or x for x in batches))
    assert list(task(iter("ab"))) == ["a", "b"] and seen == ["a", "b", "release"]


def test_union_find():
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(1, 40))
        u, v = r.integers(0, n, (2, int(r.integers(0, 50))))
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v):
                least[a] = least[b] = min(least[a], least[b])
        assert align.union(u, v, n).tolist() == least
    line = np.arange(20_000)
    assert not align.union(line[:-1], line[1:], 20_000).any()


def test_long_groups_stay_small():
    """Two vocabularies without common borders make one group of all tokens; its equal ids collapse."""
    a, b = (np.zeros(5000, dtype=np.int64), np.repeat([7], 5000)), (np.zeros(4000, dtype=np.int64), np.repeat([9], 4000))
    (made,) = align.expanded(align.collapsed(*a), align.collapsed(*b), np.zeros(1, dtype=np.int64), 1 << 20)
    assert made[0].tolist() == [7 << 16 | 9] and made[1].tolist() == [20_000_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab:#\\</turn>\n ")), st.text(st.sampled_from("#\\</turn> \nx:é"))), max_size=6))
def test_template_is_reversible(turns):
    made = [chat.opening(role) + chat.escape(text) + chat.END for role, text in turns]
    assert list(chat.parse("".join(made))) == turns
    for role, text in turns:
        assert "##" not in chat.escape(role) + "|" + chat.escape(text) and "</turn>" not in chat.escape(role) + "|" + chat.escape(text)


def test_broken_formats_are_refused():
    for bad in ("### user: no end", "user: x</turn>\n", "### user x</turn>\n"):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


@pytest.fixture(scope="module")
def talk(spark):
    r = np.random.default_rng(5)
    rows = [(c, int(t), ["user", "assistant", None, "system:#"][r.integers(4)], ["hi", "so it is", "", None, "### x </turn> \\"][r.integers(5)]) for c in range(60) for t in range(r.integers(1, 7))]
    rows += [(70, None, "user", "first"), (70, 3, "assistant", "tie b"), (70, 3, "assistant", "tie a"), (70, 3, "assistant", "tie a"), (None, 0, "assistant", "no id"), (None, 1, "user", "y")]
    rows += [(100, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(300)] + [(101, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(290)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(2)] + [(300, 0, "assistant", "z" * 300_000)] + [(c, 0, "user", "alone") for c in range(421, 440)]
    return spark.createDataFrame([(*x, 1, "k", 2, 3, 4) for x in rows], CONV).repartition(5).cache()


def ordered(talk):
    held = defaultdict(list)
    for r in talk.collect():
        held[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    return {c: [(role, text) for _, role, text in sorted(x)] for c, x in held.items()}


@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_chat_against_the_turns(spark, talk, batch):
    examples = chat.expand(talk, chat.ChatParams(batch_chars=batch))
    held, of = ordered(talk), defaultdict(list)
    for r in examples.collect():
        of[r.conv_id].append(r)
    assert set(of) == set(held)
    for c, turns in held.items():
        targets = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        made = sorted(of[c], key=lambda r: r.example)
        assert [r.n_turns for r in made] == [i + 1 for i in targets] + ([len(turns)] if turns[-1][0] != "assistant" else [])
        for r in made:
            assert list(chat.parse(r.text)) == turns[: r.n_turns]
        assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in made] == [turns[i][1] for i in targets] + ([""] if turns[-1][0] != "assistant" else [])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for c, turns in held.items():
        said = "".join(t for role, t in turns if role == "assistant")
        want.append((c, len(turns), digest("".join(f"{role}\n{t}\n" for role, t in turns)), len(said), digest(said), sum(len(r.text) for r in of[c])))
    for got in (chat.read_back(examples, arranged=True), chat.read_back(examples.repartition(7))):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert chat.expand(talk.where("false")).count() == chat.read_back(examples.where("false")).count() == 0


def brute_trie(held):
    held = {c: x for c, x in held.items() if c is not None}
    of = defaultdict(list)
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            of[tuple(turns[:d])].append(c)
    saved = {k: (len(m) - 1) * (len(k[-1][1].encode().split()) if k else 0) for k, m in of.items()}
    children = Counter(k[:-1] for k in of if k)
    leaves, total = Counter(), Counter()
    for k in of:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            total[k[:d]] += saved[k]
    ends = lambda k: ",".join(map(str, sorted(c for c in of[k] if len(held[c]) == len(k))))
    return sorted(((min(m), len(k), min(of[k[:-1]]) if k else None, len(m), children[k], leaves[k], total[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in of.items()), key=str)


def brute_rebuilt(held):
    held = {c: x for c, x in held.items() if c is not None}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in held}
    return {c: held.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in held.items()}


@pytest.mark.parametrize("params", [trie.TrieParams(), trie.TrieParams(hot_share=10, chunk_ids=3)])
def test_trie_against_brute_force(spark, talk, params):
    held = ordered(talk)
    assert sorted(map(tuple, trie.trie(talk, params).collect()), key=str) == brute_trie(held)
    assert sorted(map(tuple, trie.rebuilt_trie(talk, params).collect()), key=str) == brute_trie(brute_rebuilt(held))
    assert any(not x for x in brute_rebuilt(held).values()) and trie.trie(talk.where("false"), params).count() == 0


def test_rows_of_the_trie_do_not_outnumber_prefixes(spark, monkeypatch):
    """A conversation that leaves the one before it a turn later each time: paths above grow, exploded rows stay below the prefixes."""
    rows = [(c, t, "user", f"{t}" if t < c else f"{c} alone {t}") for c in range(40) for t in range(c + 1)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {}
    kept = trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df, tag: made.setdefault(tag, kept(df, tag)))
    assert sorted(map(tuple, trie.trie(talk).collect()), key=str) == brute_trie(ordered(talk))
    assert made["trie-placed"].where("conv_id <> owner").groupBy("conv_id", "owner").count().count() < made["trie-prefixes"].count()


@pytest.mark.parametrize("name", ["op12_chat", "op13_trie"])
def test_queries_match_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_query_of_the_alignment(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, sf).collect()}
    assert got == {r.doc_id: x for r, x in zip(docs, brute_alignment([r.text for r in docs]))}
