"""What comes back from services and what of a question must stay: vectors put in their places, and tokens to preserve."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..functions import text as tx

# Words that begin sentences and are no names.
STARTERS = (
    "the", "this", "that", "these", "those", "when", "where", "why", "how", "what", "who", "which", "whose", "whom", "an", "and", "but", "or", "if", "so", "yet", "for", "nor", "as", "at", "by", "in", "of", "on", "to", "up", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "i", "we", "you", "they", "it", "he", "she", "please", "kindly", "can", "could", "would", "should", "tell", "show", "give", "help", "explain", "find",
    "need", "want", "looking", "searching",
)
_WORD = lambda inner: f"(?<![A-Za-z0-9_]){inner}(?![A-Za-z0-9_])"
YEAR, ARTICLE = _WORD("(?:1[5-9][0-9]{2}|2[01][0-9]{2})"), "(?i)" + _WORD(r"(?:article|section|chapter|clause|paragraph|title|amendment)\s+[0-9]+")
ACRONYM = _WORD("[A-Z]{2,6}(?:[/-][A-Z]{2,6})*")
NAMES = _WORD(r"[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+")
TITLE_WORD = r"(?<!^)(?<![.!?])(?<![.!?]\s)" + _WORD("[A-Z][a-z]{2,}")


def preserved(query: Column, known: Column, starters: Iterable[str] = STARTERS) -> Column:
    """Tokens that a rewriting of a question must not lose, each once whatever its case, in this order: years, articles and sections with their numbers, acronyms, the words
    of names of several words, single capitalised words that begin no sentence, and words of ``known`` (lower-cased names).  Words are of ASCII letters."""
    every = lambda pattern: F.regexp_extract_all(query, F.lit(pattern), 0)
    no_starter = lambda items: F.filter(items, lambda t: ~F.lower(t).isin(*starters))
    names = F.flatten(F.transform(every(NAMES), lambda n: F.split(n, r"\s+")))
    told = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z]+"), 0), lambda w: F.array_contains(known, w))
    return tx.distinct_ignoring_case(F.concat(every(YEAR), every(ARTICLE), no_starter(every(ACRONYM)), no_starter(names), no_starter(every(TITLE_WORD)), told))


def placed(response: Column, expected: Column) -> Column:
    """The vectors of a response's JSON, in ``expected`` places (empty lists where none came).

    An item with an index goes there, whatever was there before; one without takes the first place that is free when it comes, or none.  Places out of range and items
    without a list go; so do components that are no numbers.  The items of a response, a bounded number, are folded in their order."""
    parsed = F.try_parse_json(response)
    items = F.coalesce(F.try_variant_get(parsed, "$.data", "array<variant>"), F.array().cast("array<variant>"))
    read = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$.index", "int").alias("at"), F.filter(F.transform(F.try_variant_get(x, "$.embedding", "array<variant>"), lambda v: F.try_variant_get(v, "$", "double")), lambda v: v.isNotNull()).alias("vector")))
    whole = F.filter(read, lambda x: x["vector"].isNotNull())

    def put(slots: Column, item: Column) -> Column:
        free = F.array_position(F.transform(slots, lambda s: F.size(s)), F.lit(0)) - 1
        return tx.let(F.coalesce(item["at"].cast("long"), free), lambda at: F.transform(slots, lambda s, i: F.when(i == at, item["vector"]).otherwise(s)))

    empty = F.array_repeat(F.array().cast("array<double>"), expected)
    return F.aggregate(whole, empty, put)
