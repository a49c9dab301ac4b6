"""Text columns: cleaning, tokens, stems, n-grams, estimates.  Built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .fixed import STEM_SUFFIXES, STOPWORDS


MARK = "\u0001"


def clean(text: Column) -> Column:
    """Control characters and tags to nothing and blanks, white space collapsed and trimmed (no Unicode normal form)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def normal_title(text: Column) -> Column:
    """Cleaned, lower-cased, only a-z, 0-9, + and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(text)), r"[^a-z0-9+ ]", " "), " +", " "))


def truncated(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - len(suffix))), F.lit(suffix)))


def slug(text: Column, limit: int = 80) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit), "-+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^ \t\r\n]+"), 0))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing; accented letters divide words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def meaningful(tokens_: Column) -> Column:
    """Tokens without stopwords, or all if nothing is left."""
    kept = F.filter(tokens_, lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens_)


def reduced(token: Column) -> Column:
    """Light reduction of tokens longer than six: -ing, then -ies to -y (of five letters or more), -es or -s."""
    less = lambda t, n: F.left(t, F.length(t) - n)
    cut = lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(less(t, 3), F.lit("y"))).when(t.endswith("es"), less(t, 2)).when(t.endswith("s"), less(t, 1)).otherwise(t)
    return F.when(F.length(token) <= 6, token).otherwise(let(F.when(token.endswith("ing"), less(token, 3)).otherwise(token), cut))


def light_tokens(text: Column) -> Column:
    """Runs of a-z, 0-9, +, # and . after lower-casing, without dots at their ends, lightly reduced; none of them empty."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9+#.]+"), 0)
    return F.filter(F.transform(F.transform(raw, lambda t: F.trim(t, F.lit("."))), reduced), lambda t: t != "")


def sentence_length(text: Column) -> Column:
    """Mean words (runs without blanks) a sentence of a cleaned text; 0 if it has no sentence."""
    inner = F.trim(F.regexp_replace(text, "[.!?][.!? ]*", MARK), F.lit(MARK))
    sentences = let(F.trim(inner), lambda t: F.when(F.replace(t, F.lit(MARK), F.lit("")) == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(MARK), F.lit(""))) + 1))
    words = blank_count(F.trim(F.regexp_replace(text, " *+[.!?][.!? ]*+", " ")))  # a cleaned text has single blanks: they stay as they are
    return let(sentences, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(words / n))


def stem(token: Column) -> Column:
    """The first suffix that leaves three letters goes; tokens under four letters stay."""
    out = token
    for s in reversed(STEM_SUFFIXES):
        out = F.when(token.endswith(s) & (F.length(token) >= len(s) + 3), F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return F.when(F.length(token) < 4, token).otherwise(out)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(at))


def phrases(words: Column, longest: int = 4, shortest: int = 2, cap: int = 12) -> Column:
    """N-gram phrases, longest first, at most cap."""
    empty = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(empty)

    return F.slice(F.concat(*map(grams, range(longest, shortest - 1, -1))), 1, cap)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def query_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text)) / F.size(q))


def token_estimate(text: Column) -> Column:
    """About four characters a token; empty text has none."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each item, in order."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def ascii_words(text: Column, letters: str = "a-z0-9") -> Column:
    """The runs of some ASCII characters of a lower-cased text, with one blank between them: one pass of one pattern."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{listed(letters)}]+", " "))


def listed(letters: str) -> str:
    """Ranges of ASCII letters and digits spelt out: Java looks single characters up in one table, but tries ranges in turn."""
    return re.sub("([a-z0-9])-([a-z0-9])", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), letters)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def blank_count(words: Column) -> Column:
    """How many words a text of words with one blank between them has."""
    return let(words, lambda w: F.when(w == "", F.lit(0)).otherwise(F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) + 1))


#: A word of three or more vowel groups, in words with a blank between them.  A word that fails from its beginning has no match further on,
#: so nothing is looked behind; it gives nothing back.
HARD_WORD = "[^aeiouy ]*+[aeiouy]++[^aeiouy ]++[aeiouy]++[^aeiouy ]++[aeiouy][^ ]*+"


def fog_grade(text: Column) -> Column:
    """Gunning fog: 0.4 * (words a sentence + percent of words of three or more vowel groups), 12 for no words, at most 20.

    Words, hard words and sentences are counted by what is left after one replacement each; no arrays are made.  The grade
    is long as an expression: make it a column of its own before it is used more than once."""
    marks = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(MARK), F.lit("")))
    words = let(ascii_words(text, "a-z0-9_"), lambda w: F.struct(blank_count(w).alias("words"), let(F.regexp_replace(w, HARD_WORD, MARK), marks).alias("hard")))
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.!?][.!?\s]*+", MARK)
    sentences = let(F.trim(ends, F.lit(MARK + " \t\n\x0b\f\r")), lambda t: F.when(t == "", F.lit(0)).otherwise(marks(t) + 1))
    return let(F.struct(words.alias("w"), sentences.alias("s")), lambda n: _fog(n["w"]["words"], n["w"]["hard"], n["s"]))


def _fog(words: Column, hard: Column, sentences: Column) -> Column:
    fog = 0.4 * (words / sentences + 100.0 * hard / words)
    return F.when((words == 0) | (sentences == 0), F.lit(12.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(20.0), fog)))


# Forms of credentials and what replaces them.
SECRETS = (
    (r"(?i)(bearer\s+)[A-Za-z0-9_\-\.=+/]{16,}", r"$1***"),
    (r"(?i)((api[_-]?key|token|secret|password|authorization)\s*[:=]\s*)['\"]?[A-Za-z0-9_\-\.=+/]{8,}['\"]?", r"$1***"),
    (r"(?i)(nvapi-|gsk_|sk-|AIza)[A-Za-z0-9_\-]{8,}", "***"),
)


def redacted(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def short_topic(title: Column) -> Column:
    """The first three words of a title that mean something, before a colon, a bracket or a dash."""
    head = F.regexp_replace(F.trim(F.regexp_extract(title, "^([^:(]*)", 1)), " +--? +.*$", "")
    return F.array_join(F.slice(F.filter(tokens(head), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)), 1, 3), " ")


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for pattern, _ in SECRETS:
        out = out | text.rlike(pattern)
    return out
