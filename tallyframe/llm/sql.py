"""SQL that states the results of the operators that SQL can express on whole tables."""

from __future__ import annotations

from tallyframe.llm.quality import CLASS_SHARES, COMMON_WORDS, QualityParams, word_reference

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _js(own: str, reference: list[float]) -> str:
    """The distance of a list of shares from a reference."""
    p, q = "own[i]", "ref[i]"
    term = f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + {q} * log2({q} / (({p} + {q}) / 2)))"
    return f"sqrt(greatest(list_sum(list_transform(range(1, {len(reference) + 1}), lambda i: {term.replace('own[', own + '[').replace('ref[', str(reference) + '[')})) / 2, 0))"


def quality(p: QualityParams = QualityParams()) -> str:
    bins = lambda words: f"list_transform(range(1, {len(words) + 1}), lambda k: len(list_filter(w, lambda x: lower(x) = {words}[k]))::DOUBLE / greatest(n_words, 1))"
    full = lambda words: f"list_concat({bins(words)}, [(n_words - len(list_filter(w, lambda x: list_contains({words}, lower(x)))))::DOUBLE / greatest(n_words, 1)])"
    shares = "[" + ", ".join(f"({x})::DOUBLE / nullif(n_long, 0)" for x in ("joined_chars - digits - stops - n_symbols", "digits", "n_long - joined_chars", "stops", "n_symbols")) + "]"
    of = lambda made, untold: f"CASE WHEN lang IS NULL THEN least({', '.join(made.values())}) {' '.join(f"WHEN lang = '{code}' THEN {x}" for code, x in made.items())} {untold} END"
    classes = of({code: _js("shares", q) for code, q in CLASS_SHARES.items()}, "")
    words = of({code: _js(f"b_{code}", word_reference(code)) for code in COMMON_WORDS}, "")
    histograms = ", ".join(f"CASE WHEN lang IS NULL OR lang = '{code}' THEN {full(known)} END AS b_{code}" for code, known in COMMON_WORDS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(text="text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS k FROM g) WHERE k > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS joined, length(text)::BIGINT AS n_long,
 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits, len(regexp_extract_all(text, '[.,;:!?''"()-]'))::BIGINT AS stops,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS joined_chars, lang, w FROM w),
f AS (SELECT *, coalesce(joined, 0) AS word_chars, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words_, {shares} AS shares, {histograms} FROM c LEFT JOIN r USING (rid)),
s AS (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words_ > {p.max_repeat_percent} * n_words AS base_failed,
 coalesce({classes}, 0) AS a, coalesce({words}, 0) AS b FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words_ AS n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_words >= {p.guard_words} AND n_long >= {p.guard_chars} AND (a > {p.max_class_distance} OR b > {p.max_word_distance} + {p.word_slack} / sqrt(greatest(n_words, 1)))) AS kept FROM s"""


JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS t FROM d),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (na + nb - o)),
c(a, r) AS (SELECT DISTINCT a, a FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.r = l.a)
SELECT s.doc_id, len(t)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.r, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(r) AS r FROM c GROUP BY a) m ON s.doc_id = m.a"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {k}) & 31) + 1, 1)"
WARC = (
    "WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p) SELECT page_id, payload_bytes, "
    + "array_to_string(list_transform(range(8), lambda i: "
    + " || ".join(_DIGIT.format(v="('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT", k=k) for k in (15, 10, 5, 0))
    + "), '') AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM k"
)

_ESCAPED = r"replace(replace(replace(replace({c}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#')"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
f AS (SELECT *, row_number() OVER w AS i, sum(4 + length(replace({_ESCAPED.format(c="role")}, ':', '\:')) + 2 + length({_ESCAPED.format(c="text")}) + 8) OVER w AS upto, lead(turn) OVER w IS NULL AND lead(role) OVER w IS NULL AS ends
 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR ends), 0)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""

TRIE = r"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
 xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 4 AS h FROM c),
l AS (SELECT k.conv_id, c.at, c.x FROM k JOIN c ON c.conv_id = k.base AND c.at <= k.h UNION ALL SELECT c.conv_id, c.at, c.x FROM c JOIN k USING (conv_id) WHERE c.at > k.h),
s AS (SELECT k.conv_id, coalesce(list(l.x ORDER BY l.at) FILTER (WHERE l.at IS NOT NULL), []) AS turns FROM k LEFT JOIN l USING (conv_id) GROUP BY k.conv_id),
p AS (SELECT conv_id, d AS depth, len(turns) AS size, turns[1:d] AS head FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (SELECT head, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256,
 (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(head[depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM p GROUP BY head, depth),
m AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.head = n.head[1:n.depth - 1]),
w AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
o AS (SELECT m.*, coalesce(w.n_children, 0) AS n_children FROM m LEFT JOIN w USING (conv_id, depth)),
a AS (SELECT head[1:d] AS head, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM o) GROUP BY 1, 2)
SELECT o.conv_id, o.depth, o.parent_conv_id, o.n_convs, o.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256 FROM o JOIN a USING (head, depth)"""

SQL = {"op4_jaccard": JACCARD, "op5_quality": quality(), "op10_warc": WARC, "op12_chat": CHAT, "op13_trie": TRIE}
