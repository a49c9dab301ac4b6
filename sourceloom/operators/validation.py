"""Relevance of records to a query as a vector of five measures, the gates before it, and the ladder from strict to no query.

Phrases, densities and concentration are built-in expressions.  Whether tokens match by their stems, beginnings or likeness has no
built-in form; two functions for that run in Arrow batches over titles and word lists, each distinct word of a batch once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import fixed as fx, fuzzy as fz, text as tx, url as ul
from ..sources import store

# Weights of the measures and least scores.
WEIGHTS = {"phrase_position": 0.30, "fingerprint_overlap": 0.25, "token_density": 0.15, "token_proximity": 0.15, "content_concentration": 0.15}
STRICT, RELAXED = 0.30, 0.12
PLATFORMS = (
    "arxiv", "semantic_scholar", "openalex", "crossref", "pubmed", "europe_pmc", "doaj", "core", "zenodo", "datacite", "github", "huggingface", "wikipedia", "wikibooks", "wikiversity", "openstax", "mit_ocw", "libretexts",
    "open_library", "internet_archive", "stack_exchange", "hacker_news", "web", "tavily", "exa", "serper", "serpapi", "jina",
)
TYPES = ("research_paper", "course", "book", "documentation", "repository", "model", "dataset", "video", "blog", "other")


def comparable(text: Column) -> Column:
    """Lower-cased, with blanks for hyphens and underscores, and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[-_]+", " "), r"\s+", " "))


def as_match(text: str) -> str:
    return " ".join(text.lower().replace("-", " ").replace("_", " ").split())


def times(text: Column, part: str) -> Column:
    """How often a text has a part, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def _first(*steps: tuple[Column, Column]) -> Column:
    out = F.lit(0.0)
    for holds, value in reversed(steps):
        out = F.when(holds, value).otherwise(out)
    return out


def phrase_position(phrase: str, tokens: list[str]) -> Column:
    """Where the phrase is: title before abstract before summary, and the earlier the better; else the share of tokens in the first of
    them that has any.  Of the columns _title, _abstract and _summary."""
    texts = [F.col(c) for c in ("_title", "_abstract", "_summary")]
    phrase, tokens = as_match(phrase), [as_match(t) for t in tokens if as_match(t)]
    if not phrase:
        return F.lit(0.0)
    whole = [(t.contains(phrase), base * (1.0 - (F.instr(t, phrase) - 1) / F.greatest(F.lit(1), F.length(t)) * 0.3)) for t, base in zip(texts, (1.0, 0.75, 0.50), strict=True)]
    share = lambda t: sum((t.contains(x).cast("int") for x in tokens), F.lit(0)) / max(1, len(tokens))
    some = [(share(t) > 0, base * share(t)) for t, base in zip(texts, (0.85, 0.60, 0.40), strict=True)]
    return _first(*whole, *some)


def density(text: Column, tokens: list[str]) -> Column:
    """Hits for a hundred words, d / (d + 3); of a comparable text."""
    hits = sum((times(text, as_match(t)) for t in tokens if as_match(t)), F.lit(0))
    per = hits / F.greatest(F.lit(1), tx.blank_count(text)) * 100.0
    return F.when(text == "", F.lit(0.0)).otherwise(tx.let(per, lambda d: F.least(F.lit(1.0), d / (d + 3.0))))


def concentration(abstract: Column, tokens: list[str]) -> Column:
    """How much more the first two sentences have of the tokens than their length would give them; 0.5 for fewer sentences."""
    count = lambda t: sum((times(t, x) for x in tokens), F.lit(0))
    sentences = F.filter(F.transform(F.split(abstract, r"[.!?]+\s+"), F.trim), lambda s: s != "")

    def of(x: Column) -> Column:
        share = (x["n_head"] / x["n_low"]) / (F.length(x["head"]) / F.greatest(F.lit(1), F.length(x["low"])))
        return F.when(x["few"], F.lit(0.5)).when(x["n_low"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), share / 2.0))

    # each text is made once, however many tokens are counted in it
    texts = tx.let(sentences, lambda s: F.struct((F.size(s) < 2).alias("few"), F.lower(F.array_join(F.slice(s, 1, 2), " ")).alias("head"), F.lower(abstract).alias("low")))
    counts = tx.let(texts, lambda x: F.struct(x["few"].alias("few"), x["head"].alias("head"), x["low"].alias("low"), count(x["head"]).alias("n_head"), count(x["low"]).alias("n_low")))
    return F.when(abstract == "", F.lit(0.0)).otherwise(tx.let(counts, of))


def signature(text: Column, generic=fx.GENERIC) -> Column:
    """The tokens of a title that name its subject, each once."""
    return F.array_distinct(F.filter(tx.light_tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*generic)))


def _needed(n: int) -> int:
    return 0 if n <= 0 else 1 if n <= 4 else max(1, math.ceil(n * 0.4))


def structural() -> Column:
    """Whether a record is well formed."""
    title = tx.clean(F.col("title"))
    low = F.lower(title)
    return (
        F.length(title).between(3, 500) & ~low.contains("this paper has been withdrawn") & ~low.isin("withdrawn", "retracted") & F.coalesce(ul.is_valid(F.col("url")), F.lit(False))
        & F.coalesce(F.col("platform").isin(*PLATFORMS), F.lit(False)) & F.coalesce(F.col("source_type").isin(*TYPES), F.lit(False)) & (F.length(F.coalesce("abstract", F.lit(""))) <= 5000)
        & F.coalesce(F.col("year").between(0, 2100), F.lit(True)) & F.coalesce(F.col("citation_count") >= 0, F.lit(True))
    )


def measured(sources: DataFrame, p: Row) -> DataFrame:
    """sources with the five measures, relevance_score, and whether the gates let a record pass (has_concept, has_title)."""
    cleaned = {c: tx.clean(F.col(c)) for c in ("title", "abstract", "summary")}
    rows = sources.withColumns({"_t": cleaned["title"], "_a": cleaned["abstract"], "_s": cleaned["summary"], "_head": comparable(F.left(F.coalesce("abstract", F.lit("")), F.lit(400)))})
    rows = rows.withColumns({"_title": comparable(F.col("_t")), "_abstract": comparable(F.col("_a")), "_summary": comparable(F.col("_s"))})
    if not p.tokens:
        every = {**{k: F.lit(1.0) for k in WEIGHTS}, "relevance_score": F.lit(1.0), "has_concept": F.lit(True), "has_title": F.lit(True)}
        return rows.withColumns(every).drop("_t", "_a", "_s", "_head", "_title", "_abstract", "_summary")
    joined = F.trim(F.concat_ws(" ", "_title", "_abstract", "_summary"))
    rows = rows.withColumns({"_all": F.trim(F.regexp_replace(joined, " +", " ")), "_sign": signature(F.col("_t"))})
    code = F.col("source_type").isin("repository", "model", "dataset")
    gate_text = F.when(code, F.trim(F.concat_ws(" ", "_t", F.left("_a", F.lit(400))))).otherwise(F.col("_t"))
    words = F.filter(F.split(F.concat_ws(" ", "_title", "_head"), "[^a-z0-9+#.]+"), lambda w: w != "")
    near = F.filter(F.split(F.when(F.col("_abstract") != "", F.col("_abstract")).otherwise(F.col("_all")), " "), lambda w: w != "")
    rows = rows.withColumns({"_gate": signature(gate_text), "_words": words, "_near": near})
    wanted = [as_match(t) for t in p.tokens if as_match(t)]
    rows = rows.withColumns({
        "_concept": fz.matched_of(wanted)("_words"), "_overlap": fz.matched_of(p.fingerprint)("_sign"), "_close": fz.proximity_of(wanted)("_near"),
        "_typed": fz.matched_of(p.typed)("_gate"), "_prints": fz.matched_of(p.fingerprint)("_gate"), "_short": fz.matched_of(p.abbreviations)("_gate"),
    })
    position = phrase_position(p.phrase, p.tokens)
    if p.fingerprint:
        position = tx.let(position, lambda x: F.when(x > 0, x).otherwise(phrase_position(" ".join(p.fingerprint), p.fingerprint)))
    overlap = F.when(F.size("_sign") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("_overlap") / len(p.fingerprint)))
    rows = rows.withColumns({"phrase_position": position, "fingerprint_overlap": overlap, "token_density": density(F.col("_all"), p.tokens), "token_proximity": F.col("_close"), "content_concentration": concentration(F.col("_a"), p.tokens)})
    inside = F.lit(False)
    for t in wanted:
        inside = inside | F.col("_title").contains(t) | F.col("_head").contains(t)
    some = (F.col("_title") != "") | (F.col("_head") != "")
    title = F.lit(True)
    if p.specific and (p.typed or p.fingerprint):
        enough = F.lit(False)
        enough = enough | (F.col("_typed") >= _needed(len(p.typed))) if p.typed else enough
        enough = enough | (F.col("_prints") >= _needed(len(p.fingerprint))) if p.fingerprint else enough
        enough = enough & (F.col("_short") > 0) if p.abbreviations else enough
        title = F.when(F.col("_t") == "", F.lit(True)).otherwise((F.size("_gate") > 0) & enough)
    total = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumns({"relevance_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), "has_concept": some & (inside | (F.col("_concept") > 0)), "has_title": title})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def judged(sources: DataFrame, p: Row, strict: float = STRICT, relaxed: float = RELAXED) -> DataFrame:
    """measured() with strict_drop and relaxed_drop: the first rule that drops a record, or null."""
    rows = measured(sources, p).withColumn("_ok", structural())
    advanced = F.lower(F.coalesce("difficulty", F.lit(""))) == "advanced"
    first = F.when(~F.col("_ok"), "structural").when(~F.col("has_concept"), "concept_presence")
    low = lambda least: F.col("relevance_score") < least
    hard = first.when(~F.col("has_title"), "title_fingerprint").when(F.lit(p.level == "beginner") & advanced, "level_advanced_for_beginner").when(low(strict), "below_threshold")
    return rows.withColumns({"strict_drop": hard, "relaxed_drop": first.when(low(relaxed), "below_threshold")}).drop("_ok")


def ladder(rows: DataFrame) -> DataFrame:
    """Of judged rows those of the first rung that has any: strict, relaxed, or all well-formed records; with rung.  Which rung it is shows
    only when all are judged, so they are written down and their texts are measured once."""
    rows = store.written(rows, "judged")
    strict, relaxed = F.col("strict_drop").isNull(), F.col("relaxed_drop").isNull()
    rung = rows.agg(F.when(F.bool_or(strict), 1).when(F.bool_or(relaxed), 2).otherwise(3).alias("rung"))
    formed = ~F.coalesce(F.col("strict_drop") == "structural", F.lit(False))
    return rows.crossJoin(F.broadcast(rung)).where((F.col("rung") == 1) & strict | (F.col("rung") == 2) & relaxed | (F.col("rung") == 3) & formed)


def annotated(rows: DataFrame, p: Row) -> DataFrame:
    """What a validator notes on a record: rounded score and vector, and signs of its level."""
    level = F.lower(F.coalesce("difficulty", F.lit("")))
    safe, advanced, learner = level.isin("beginner", "intermediate"), level == "advanced", F.lit(p.level == "beginner")
    return rows.select(
        "source_id", F.round("relevance_score", 4).alias("validator_relevance"), F.struct(*[F.round(k, 4).alias(k) for k in WEIGHTS]).alias("validator_vector"), F.lit(p.level).alias("level_profile"),
        F.lit(bool(p.abbreviations)).alias("has_abbreviation"), safe.alias("beginner_safe"), advanced.alias("advanced_signal"), F.when(learner & advanced, 0.20).alias("alignment_penalty"), F.when(learner & safe, 1.25).alias("alignment_boost"),
    )


def drop_report(rows: DataFrame, column: str, samples: int = 50) -> DataFrame:
    """reason, how many records it dropped, and the ids of the first of them; the samples are taken per part and then per reason.
    Reasons are written down before they are filtered, counted and sampled: a filter on them would work out all measures once more."""
    from .selection import first_of_each

    dropped = store.written(rows.select(F.col(column).alias("reason"), "source_id", "ordinal"), "reasons").where(F.col("reason").isNotNull())
    counts = dropped.groupBy("reason").agg(F.count("*").alias("n"))
    few = first_of_each(dropped, "reason", [F.asc("ordinal")], samples)
    ids = few.groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_id"))), lambda x: x["source_id"]).alias("samples"))
    return counts.join(ids, "reason")
