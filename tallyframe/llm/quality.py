"""Quality rules: base counts, and the divergence of a document's histograms from its language's reference.

Everything is a built-in expression, so one narrow stage scans the table: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that ends a word.
WHITE = " \t\n\x0b\x0c\r"

# Common words of each language, from public frequency lists, the most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be", "by", "are", "this", "at", "from", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}

# Fixed value: share of these words in running text. By Zipf's law the k-th of them has 1 / k of it.
COMMON_SHARE = 0.25

# Shares of the character classes in running text of each language
# (letter or rare sign, digit, white space, sentence punctuation, symbol).
CLASS_SHARES = {
    "en": [0.800, 0.004, 0.165, 0.028, 0.003],
    "de": [0.828, 0.004, 0.140, 0.025, 0.003],
    "fr": [0.794, 0.004, 0.168, 0.031, 0.003],
    "es": [0.800, 0.004, 0.166, 0.027, 0.003],
}


def word_reference(code: str) -> list[float]:
    """The share of each common word of a language, and of all other words."""
    whole = sum(1 / k for k in range(1, len(COMMON_WORDS[code]) + 1))
    return [COMMON_SHARE / (k * whole) for k in range(1, len(COMMON_WORDS[code]) + 1)] + [1.0 - COMMON_SHARE]


@dataclass(frozen=True)
class QualityParams:
    """Thresholds. A document with fewer words or characters than the guards is judged by the base rules alone.

    A histogram of few words strays from any reference by chance, about as one over the root of their number: the limit of
    the word distance is ``max_word_distance`` plus ``word_slack`` times that.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_chars: int = 200
    guard_words: int = 50
    max_class_distance: float = 0.2
    max_word_distance: float = 0.14
    word_slack: float = 1.75


def _js(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two discrete distributions, as arrays of shares."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _word_distance(words: Column, n: Column, code: str) -> Column:
    """The distance of the document's histogram of a language's common words, one bin each, and the rest."""
    known = F.array(*[F.lit(w) for w in COMMON_WORDS[code]])
    found = F.filter(F.transform(words, lambda x: F.array_position(known, F.lower(x)).cast("int")), lambda k: k > 0)
    share = lambda count: count.cast("double") / n.cast("double")
    bins = lambda c: F.array(*[share(F.size(c) - F.size(F.array_remove(c, k))) for k in range(1, len(COMMON_WORDS[code]) + 1)], share(n - F.size(c)))
    reference = F.array(*[F.lit(q) for q in word_reference(code)])
    return F.get(F.transform(F.array(found), lambda c: _js(bins(c), reference)), F.lit(0))  # found once, used for every bin


def _by_language(lang: Column, made: dict[str, Column], untold: Column) -> Column:
    out = F.when(lang.isNull(), untold)
    for code, value in made.items():
        out = out.when(lang == code, value)
    return out


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _with_repeats(out: DataFrame) -> DataFrame:
    """Adds ``__q_repeat``: words inside 3-word windows that occur twice or more, from ``__q_words``.

    Each window's hash is packed with its index into one long, so a primitive sort brings equal windows together;
    windows without an equal neighbour drop out, and what is left is compared by its words. That takes n log n.
    """
    words = F.col("__q_words")
    bits = F.coalesce(F.length(F.bin(F.size(words))), F.lit(0))
    out = out.withColumns({"__q_bits": bits, "__q_hashes": F.transform(words, lambda x: F.xxhash64(x))})
    b = F.col("__q_bits")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
    # The last two windows lack words; their text has fewer spaces than any whole window and so never equals one.
    packed = F.transform("__q_hashes", lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get("__q_hashes", i + 1), F.get("__q_hashes", i + 2)), b).bitwiseOR(i.cast("long")))
    out = out.withColumn("__q_packed", F.sort_array(packed))
    near = F.filter("__q_packed", lambda x, k: (_shifted(x, b) == _shifted(F.get("__q_packed", k - 1), b)) | (_shifted(x, b) == _shifted(F.get("__q_packed", k + 1), b)))
    out = out.withColumn("__q_near", F.transform(near, lambda x: x.bitwiseAND(mask).cast("int")))
    out = out.withColumn("__q_sorted", F.array_sort(F.transform("__q_near", lambda i: F.struct(_window(words, i).alias("t"), i.alias("i")))))
    s = F.col("__q_sorted")
    hit = F.filter(s, lambda x, k: (x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return out.withColumn("__q_repeat", F.when(F.size(s) < 2, F.lit(0)).otherwise(covered).cast("long"))


def score(docs: DataFrame, params: QualityParams = QualityParams(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with its own columns kept and a struct ``_q`` of counts, distances and verdicts added.

    The word histogram holds the share of each common word of the document's language, and the rest; the class histogram
    those of the character classes. Both are compared with the references of the language. Where none is told, the nearest
    reference counts; a document in a language without a reference is not judged by distances.
    Null or blank text: no words, all counts 0, rejected by the word minimum. Empty table: empty result.
    Repeated rows are scored alike; other columns are not read. Long texts are read whole.
    """
    if "_q" in docs.columns:
        raise ValueError("the result's column _q is taken")
    return _scored(docs, params, text, lang).select("__q_own.*", "_q")


def _scored(docs: DataFrame, params: QualityParams, text: str, lang: str) -> DataFrame:
    """(__q_own, _q): a row's columns as a struct, so that no name of theirs can clash, and what ``score`` finds."""
    t, words, lines = F.col("__q_text"), F.col("__q_words"), F.col("__q_lines")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(row.alias("__q_own"), F.coalesce(F.col(text), F.lit("")).alias("__q_text"), F.col(lang).alias("__q_lang"))
    lines_of = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    out = out.withColumns({"__q_words": F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "__q_lines": lines_of})
    count = lambda characters: F.regexp_count(t, F.lit(characters)).cast("long")
    out = out.withColumns({
        "__q_n": F.size(words).cast("long"), "__q_chars": F.length(F.array_join(words, "")).cast("long"), "__q_long": F.length(t).cast("long"),
        "__q_symbols": count(r"[#*$%&|<>]"), "__q_dup": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "__q_digits": count("[0-9]"), "__q_stops": count(r"[.,;:!?'\"()-]"),
    })
    out = _with_repeats(out.drop("__q_text", "__q_lines"))
    c = {k: F.col(f"__q_{k}") for k in ("n", "chars", "long", "digits", "stops", "symbols", "repeat")}
    counts = (c["chars"] - c["digits"] - c["stops"] - c["symbols"], c["digits"], c["long"] - c["chars"], c["stops"], c["symbols"])
    out = out.withColumn("__q_shares", F.transform(F.array(*counts), lambda x: F.try_divide(x.cast("double"), c["long"].cast("double"))))
    languages = lambda each: {code: each(code) for code in COMMON_WORDS}
    by_class = languages(lambda code: _js(F.col("__q_shares"), F.array(*[F.lit(q) for q in CLASS_SHARES[code]])))
    class_distance = F.coalesce(_by_language(F.col("__q_lang"), by_class, F.least(*by_class.values())), F.lit(0.0))
    by_word = languages(lambda code: _word_distance(F.col("__q_words"), F.greatest(c["n"], F.lit(1)), code))
    word_distance = F.coalesce(_by_language(F.col("__q_lang"), by_word, F.least(*by_word.values())), F.lit(0.0))
    out = out.withColumns({"__q_class": class_distance, "__q_word": word_distance})
    base_failed = (c["n"] < params.min_words) | (100 * c["repeat"] > params.max_repeat_percent * c["n"])
    guarded = (c["n"] < params.guard_words) | (c["long"] < params.guard_chars)
    # A filter on the verdict must not be pushed below: it would be spelled out over all the steps above, again and again.
    fixed = F.monotonically_increasing_id() >= 0
    diverges = ~guarded & ((F.col("__q_class") > params.max_class_distance) | (F.col("__q_word") > params.max_word_distance + params.word_slack / F.sqrt(F.greatest(c["n"], F.lit(1)).cast("double"))))
    found = {"n_words": c["n"], "word_chars": c["chars"], "n_symbols": F.col("__q_symbols"), "n_dup_lines": F.col("__q_dup"), "n_repeat_words": c["repeat"], "base_failed": base_failed, "kept": ~base_failed & ~diverges & fixed, "class_distance": F.col("__q_class"), "word_distance": F.col("__q_word")}
    return out.select("__q_own", F.struct(*[v.alias(k) for k, v in found.items()]).alias("_q"))


def keep(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return _scored(docs, params, "text", "lang").where(F.col("_q.kept")).select("__q_own.*")
