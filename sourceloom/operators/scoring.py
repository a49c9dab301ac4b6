"""Numeric scores of source records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as tx

# Weights of the features, trust in platforms, and worth of types.
WEIGHTS = {"relevance": 0.42, "authority": 0.12, "type_quality": 0.10, "impact": 0.10, "recency": 0.08, "content": 0.08, "support": 0.05, "authors": 0.05}
AUTHORITY = {
    "arxiv": 0.95, "semantic_scholar": 0.92, "openalex": 0.88, "core": 0.86, "crossref": 0.90, "europe_pmc": 0.90, "pubmed": 0.92, "doaj": 0.84, "zenodo": 0.78,
    "datacite": 0.76, "github": 0.86, "huggingface": 0.84, "wikipedia": 0.82, "wikibooks": 0.78, "wikiversity": 0.76, "openstax": 0.88, "mit_ocw": 0.90,
    "libretexts": 0.84, "open_library": 0.78, "internet_archive": 0.76, "stack_exchange": 0.74, "hacker_news": 0.66, "web": 0.58, "tavily": 0.60, "exa": 0.62,
    "serper": 0.60, "serpapi": 0.60, "jina": 0.58,
}
TYPE_QUALITY = {"research_paper": 0.92, "course": 0.90, "book": 0.88, "documentation": 0.84, "repository": 0.82, "model": 0.80, "dataset": 0.72, "video": 0.68, "blog": 0.55, "other": 0.45}
TYPE_AUTHORITY = {"research_paper": 0.75, "course": 0.70, "book": 0.70, "documentation": 0.65, "repository": 0.70, "model": 0.65, "dataset": 0.60, "video": 0.55, "blog": 0.45, "other": 0.45}
EDUCATION = ("openstax", "libretexts", "mit_ocw", "wikibooks", "wikipedia", "open_library", "wikiversity", "khan_academy")
BEGINNER_LEVELS = {"beginner": 0.20, "intermediate": 0.06, "advanced": -0.24}
BEGINNER_TYPES = {"documentation": 0.10, "course": 0.10, "video": 0.10, "blog": 0.05, "research_paper": -0.06, "book": 0.15, "repository": 0.03, "model": 0.02}
ADVANCED_LEVELS = {"advanced": 0.12, "intermediate": 0.03, "beginner": -0.10}
ADVANCED_TYPES = {"research_paper": 0.05, "book": 0.02, "repository": 0.05, "model": 0.05}
MIXED_LEVELS = {"beginner": 0.12, "intermediate": 0.10, "advanced": 0.12, "unknown": 0.02}
MIXED_TYPES = {"documentation": 0.10, "course": 0.10, "book": 0.10, "repository": 0.05, "model": 0.05, "dataset": 0.04, "research_paper": 0.08}
ALIGN_CAP, MIXED_CAP = 0.30, 0.22
# What in a level or goal asks for the whole range, for beginners, or for the advanced.
RANGE_PHRASES = (
    "to advanced", "to advance", "to expert", "to expert level", "from basics", "from the basics", "from scratch", "zero to hero", "start to finish", "basics to advanced", "beginner to advanced",
    "beginner to expert", "foundations to advanced", "fundamentals to advanced", "introduction to advanced", "intro to advanced",
)
BEGINNER_MARKERS = ("beginner", "beginners", "basic", "basics", "fundamental", "fundamentals", "intro", "introduction", "introductory", "from zero", "no prior")
ADVANCED_MARKERS = ("advanced", "advance", "advances", "expert", "experts", "in depth", "in-depth", "deep dive", "deep-dive", "state of the art", "state-of-the-art", "cutting edge", "cutting-edge")
AS_OF_YEAR = 2025


def looked_up(key: Column, values: dict[str, float], default: float | Column) -> Column:
    out = F.lit(default) if not isinstance(default, Column) else default
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def authority() -> Column:
    """By platform, or by kind where the platform is not known."""
    return looked_up(F.col("platform"), AUTHORITY, looked_up(F.col("source_type"), TYPE_AUTHORITY, 0.45))


def type_quality() -> Column:
    return looked_up(F.col("source_type"), TYPE_QUALITY, 0.45)


def impact() -> Column:
    """By citations if they are known, 0 included; else by stars, else by downloads; else 0.35."""
    log_share = lambda c, top: unit(F.log1p(c) / F.log1p(F.lit(float(top))))
    cited = F.when(F.col("citation_count") <= 0, F.lit(0.20)).otherwise(log_share(F.col("citation_count"), 1000))
    return F.when(F.col("citation_count").isNotNull(), cited).when(F.col("stars").isNotNull(), log_share(F.col("stars"), 5000)).when(F.col("downloads").isNotNull(), log_share(F.col("downloads"), 100_000)).otherwise(F.lit(0.35))


def recency(as_of_year: int = AS_OF_YEAR) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of_year) - F.col("year"))
    return F.when(F.coalesce("year", F.lit(0)) == 0, F.lit(0.50)).otherwise(F.greatest(F.lit(0.20), F.exp(-age / 8.0)))


def content() -> Column:
    """By the cleaned abstract's length up to 600, a summary, metadata and code.  A long abstract shows in its beginning that it has
    600 characters (a tag that is cut off there left out); only others are cleaned whole."""
    begins = F.regexp_replace(F.left("abstract", F.lit(4000)), "<[^>]*$", "")
    text = F.when(F.length(tx.clean(begins)) >= 600, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.length(tx.clean(F.col("abstract"))) / 600.0))
    return unit(text + F.when(tx.clean(F.col("summary")) != "", 0.25).otherwise(0.0) + F.least(F.lit(0.20), F.col("meta_keys") / 8.0) + F.when(F.coalesce("has_code", F.lit(False)), 0.05).otherwise(0.0))


def support() -> Column:
    return unit(F.when(F.coalesce("has_code", F.lit(False)), 0.45).otherwise(0.0) + F.when(F.col("url") != "", 0.15).otherwise(0.0) + F.when(F.col("doi").isNotNull() | F.coalesce("has_pdf", F.lit(False)), 0.25).otherwise(0.0) + F.when(F.coalesce("open_access", F.lit(False)), 0.15).otherwise(0.0) + F.when(F.col("code_url").isNotNull(), 0.15).otherwise(0.0))


def authors() -> Column:
    return F.when(F.col("n_authors") > 0, unit(F.col("n_authors") / 4.0)).when(F.col("source_type").isin("repository", "model", "dataset"), 0.40).otherwise(0.20)


def reading_grade() -> Column:
    return tx.fog_grade(F.concat("title", F.lit(". "), "abstract"))


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def alignment(level: Column, goal: Column, grade: Column) -> Column:
    """What a record gains or loses by its level, kind, platform and reading grade, for a request by beginners, by the advanced or by both; 0 for others.

    ``grade`` must be a column that is already computed (see tx.fog_grade)."""
    level, goal = F.lower(level), F.lower(goal)
    beginner, advanced = level.contains("beginner") | _holds(goal, ("beginner", "basic")), level.contains("advanced") | goal.contains("advanced")
    by_maps = lambda levels, types: looked_up(F.col("difficulty"), levels, 0.0) + looked_up(F.col("source_type"), types, 0.0)
    capped = lambda x, cap: F.greatest(F.lit(-cap), F.least(F.lit(cap), x))
    for_beginners = F.when(F.col("platform").isin(*EDUCATION), 0.15).otherwise(0.0) + F.when(grade.between(8.0, 11.0), 0.10).when(grade >= 14.0, -0.15).otherwise(0.0) + by_maps(BEGINNER_LEVELS, BEGINNER_TYPES)
    for_advanced = F.when(grade >= 14.0, 0.05).when(grade < 10.0, -0.05).otherwise(0.0) + by_maps(ADVANCED_LEVELS, ADVANCED_TYPES)
    return F.when(beginner & advanced, capped(by_maps(MIXED_LEVELS, MIXED_TYPES), MIXED_CAP)).when(beginner, capped(for_beginners, ALIGN_CAP)).when(advanced, capped(for_advanced, ALIGN_CAP)).otherwise(0.0)


def mismatched(score: Column, level: Column, goal: Column, grade: Column) -> Column:
    """A fifth of the score for a hard record where beginners ask, half of it for an easy one where the advanced ask; all of it where both or neither do."""
    level, goal = F.lower(level), F.lower(goal)
    either = F.concat_ws(" ", level, goal)
    beginner, advanced = (_holds(level, m) | _holds(goal, m) for m in (BEGINNER_MARKERS, ADVANCED_MARKERS))
    hard, easy = F.coalesce(F.col("difficulty") == "advanced", F.lit(False)) | (grade >= 14.0), F.coalesce(F.col("difficulty") == "beginner", F.lit(False)) | (grade < 8.0)
    both = _holds(either, RANGE_PHRASES) | (beginner & advanced)
    return score * F.when(both, 1.0).when(beginner & hard, 0.2).when(advanced & ~beginner & easy, 0.5).otherwise(1.0)


def total(relevance: Column, alignment_: Column, content_: Column, level: Column, goal: Column, grade: Column) -> Column:
    """A record's score for a request's level and goal.  ``content_`` and ``grade`` are columns that are already computed."""
    features = {"relevance": relevance, "authority": authority(), "type_quality": type_quality(), "impact": impact(), "recency": recency(), "content": content_, "support": support(), "authors": authors()}
    base = sum((WEIGHTS[k] * v for k, v in features.items()), F.lit(0.0)) / sum(WEIGHTS.values()) + alignment_
    return unit(mismatched(base, level, goal, grade))


def confidence(score: Column, content_: Column) -> Column:
    raw = 0.18 + 0.38 * score + 0.18 * authority() + 0.14 * content_ + 0.10 * F.least(F.lit(1.0), F.col("meta_keys") / 6.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), raw))
