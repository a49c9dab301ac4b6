"""Queries of relevance vectors, validation and the gates after ranking."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import fixed as fx, text as tx
from ..operators import asked as ak, selection as sel, validation as va
from ..sources import store
from .records import SCORE_CTE, SCORED, _full_score, _scored
from .registry import query
from .understanding import TOK, questions
from .views import SOURCES, sources, table

@functools.lru_cache(maxsize=4)
def profile(spark):
    """The one query that records are measured by."""
    return ak.one(spark, "please show me machine learning thention for beginners", level="beginner", preserve=["thention"])


@query("query_profiles")
def query_profiles(spark, sf):
    """Questions, some with what a model takes them to be about, a level, an intent, and words that must stay."""
    k = F.col("item_id")
    words = F.split("text", " ")
    asked = questions(spark, sf).join(table(spark, sf, "benchmark").select("item_id", "text"), "item_id").select(
        "item_id", "q", F.when(k % 3 == 1, F.concat_ws(" ", F.slice(words, 1, 4), F.lit("and graph search frontier"))).alias("concept"), F.when(k % 4 == 1, "Beginner").when(k % 4 == 2, "advanced").alias("level"),
        F.when(k % 5 == 1, "learn").when(k % 5 == 2, "odd").alias("intent"), F.when(k % 6 > 2, F.array(F.upper(F.get(words, 1)), F.lit(" kept "))).alias("preserve"),
    )
    return ak.profiled(asked, "item_id", "q")


@query("relevance_measures")
def relevance_measures(spark, sf):
    rows = va.measured(sources(spark, sf), profile(spark))
    return rows.select("source_id", *[F.round(k, 6).alias(k) for k in (*va.WEIGHTS, "relevance_score")], "has_concept", "has_title")


@query("validation_ladder")
def validation_ladder(spark, sf):
    rows = va.judged(sources(spark, sf), profile(spark)).select("source_id", "relevance_score", "strict_drop", "relaxed_drop")
    return va.ladder(rows).select("source_id", F.round("relevance_score", 6).alias("relevance_score"), "rung")


@query("validation_drops")
def validation_drops(spark, sf):
    return va.drop_report(va.judged(sources(spark, sf), profile(spark)), "strict_drop")


@query("validator_notes")
def validator_notes(spark, sf):
    return va.annotated(va.judged(sources(spark, sf), profile(spark)), profile(spark))


STRUCTURE = "length(tc) BETWEEN 3 AND 500 AND NOT contains(lower(tc), 'this paper has been withdrawn') AND lower(tc) NOT IN ('withdrawn', 'retracted') AND regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') AND platform IN (" + ", ".join(f"'{p}'" for p in va.PLATFORMS) + ") AND length(coalesce(abstract, '')) <= 5000 AND coalesce(year BETWEEN 0 AND 2100, true) AND coalesce(citation_count >= 0, true)"
CLEAN_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("structural_validity", f"WITH {SOURCES}, c AS (SELECT *, {CLEAN_TITLE} AS tc FROM src) SELECT source_id, {STRUCTURE} AS valid FROM c")
def structural_validity(spark, sf):
    return sources(spark, sf).select("source_id", va.structural().alias("valid"))


TOPIC = ["the", "der", "les", "para"]
HEAD = "(" + " + ".join(f"contains(array_to_string(w[1 : greatest(2, floor(len(w) * 0.7::DOUBLE)::INTEGER)], ' '), '{t}')::INTEGER" for t in TOPIC) + ")"
GATED = f"""{SCORE_CTE}, w AS (SELECT *, list_filter(string_split_regex(trim(lower(title)), ' +'), lambda x: x <> '') AS w, len(list_intersect({TOPIC!r}, {TOK.format('title')})) AS hit FROM fin),
g1 AS (SELECT *, relevance >= greatest((SELECT max(relevance) FROM w) * 0.25::DOUBLE, 0.05) AS ok1 FROM w),
g2 AS (SELECT *, hit >= 1 AND len(w) > 0 AND {HEAD} / 4.0::DOUBLE >= 0.25 AS ok2 FROM g1 WHERE ok1),
g3 AS (SELECT *, score >= greatest(0.10, 0.35::DOUBLE * (SELECT max(score) FROM g2 WHERE ok2)) AS ok3 FROM g2 WHERE ok2)"""


def _written_scores(spark, sf):
    """What the gates go by, written down: each gate reads it for its best score and again for what passes, and the texts are scored once."""
    return store.written(_full_score(spark, sf).select("source_id", "ordinal", "title", "difficulty", "relevance", "score", "confidence"), "scores")


def _gates(spark, sf):
    """Relevance, topic and quality gates in a row: what passes, and what each drops."""
    rows = _written_scores(spark, sf)
    one = sel.gated(rows, "relevance", sel.relevance_floor(len(TOPIC)), 3).drop("rescued")
    hit = F.size(F.array_intersect(F.array(*map(F.lit, TOPIC)), tx.tokens(F.col("title"))))
    two = sel.passing(one, sel.on_topic(hit, F.col("title"), TOPIC), 3, F.desc("score"), F.asc("ordinal")).drop("rescued")
    three = sel.gated(two, "score", F.greatest(F.lit(0.10), 0.35 * F.col("best")), 3).drop("rescued")
    return rows, three


@query("gates_in_a_row", f"WITH {GATED} SELECT source_id, round(score, 6) AS score FROM g3 WHERE ok3")
def gates_in_a_row(spark, sf):
    return _gates(spark, sf)[1].select("source_id", F.round("score", 6).alias("score"))


@query("gate_topic_head", f"WITH {GATED} SELECT source_id, hit >= 1 AND len(w) > 0 AND {HEAD} / 4.0::DOUBLE >= 0.25 AS on_topic, CASE WHEN len(w) = 0 THEN 0 ELSE round({HEAD} / 4.0::DOUBLE, 6) END::DOUBLE AS head FROM w")
def gate_topic_head(spark, sf):
    hit = F.size(F.array_intersect(F.array(*map(F.lit, TOPIC)), tx.tokens(F.col("title"))))
    return sources(spark, sf).select("source_id", sel.on_topic(hit, F.col("title"), TOPIC).alias("on_topic"), F.round(sel.head_share(F.col("title"), TOPIC), 6).alias("head"))


@query("beginner_rescue", f"WITH {SCORE_CTE}, kept AS (SELECT * FROM fin WHERE difficulty = 'advanced'), b AS (SELECT max(score) AS best FROM kept), d AS (SELECT source_id, greatest(score, best * 0.55::DOUBLE) AS s FROM fin, b WHERE difficulty = 'beginner' AND relevance >= 0.15 AND best > 0 ORDER BY greatest(score, best * 0.55::DOUBLE) DESC, confidence DESC, ordinal LIMIT 3) SELECT source_id, round(s, 6) AS score FROM d")
def beginner_rescue(spark, sf):
    """Where only advanced records were kept, the best of the dropped beginners' come back."""
    rows = _written_scores(spark, sf)
    out = sel.beginner_rescue(rows.where("difficulty = 'advanced'"), rows.where("difficulty <> 'advanced'"), F.col("difficulty") == "beginner")
    return out.where("difficulty = 'beginner'").select("source_id", F.round("score", 6).alias("score"))


COMPLETE = "least(length(abstract) / 400.0::DOUBLE, 2) + least(length(title) / 40.0::DOUBLE, 1) + coalesce(least(citation_count / 500.0::DOUBLE, 2), 0) + CASE WHEN year >= 2015 THEN 0.5 ELSE 0 END"
_junk = " OR ".join([*[f"ends_with(lower(title), '{x}')" for x in fx.JUNK_TITLE_SUFFIXES], *[f"contains(lower(title), '{x}')" for x in fx.JUNK_TITLE_PARTS]])


@query("rescue_to_target", f"WITH {SOURCES}, k AS (SELECT *, doc_rank <= 3 AS ok FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS doc_rank FROM src)), c AS (SELECT source_id, row_number() OVER (ORDER BY {COMPLETE} DESC, ordinal) AS p FROM k WHERE NOT ok AND NOT ({_junk})) SELECT source_id, false AS rescued FROM k WHERE ok UNION ALL SELECT source_id, true FROM c WHERE p <= 5")
def rescue_to_target(spark, sf):
    """Up to the target of the mode (5 fast, 8 balanced, 10 deep) the most complete of the dropped records, junk aside, come back."""
    rows = sources(spark, sf)
    kept = rows.orderBy("ordinal").limit(3).select("source_id", F.lit(True).alias("kept"))
    both = rows.join(F.broadcast(kept), "source_id", "left")
    part = lambda c, unit, most: F.coalesce(F.least(c / unit, F.lit(most)), F.lit(0.0))
    complete = part(F.length("abstract"), 400.0, 2.0) + part(F.length("title"), 40.0, 1.0) + part(F.col("citation_count"), 500.0, 2.0) + F.when(F.col("year") >= 2015, 0.5).otherwise(0.0)
    low, junk = F.lower("title"), F.lit(False)
    for x in fx.JUNK_TITLE_SUFFIXES:
        junk = junk | low.endswith(x)
    for x in fx.JUNK_TITLE_PARTS:
        junk = junk | low.contains(x)
    usable = both.where(F.col("kept") | ~junk).withColumn("complete", complete)
    target = {"fast": 5, "balanced": 8, "deep": 10}["balanced"]
    return sel.passing(usable, F.col("kept"), target, F.desc("complete"), F.asc("ordinal")).select("source_id", "rescued")


@query("gate_relevance", f"WITH {SCORED}, v AS (SELECT source_id, ordinal, relevance AS v FROM s), b AS (SELECT max(v) AS best FROM v), p AS (SELECT v.*, v >= greatest(best * 0.20::DOUBLE, 0.05) AS ok FROM v, b), n AS (SELECT count(*) FILTER (ok) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY v DESC, ordinal) AS k FROM p) SELECT source_id, round(v, 6) AS score, NOT ok AS rescued FROM k, n WHERE ok OR n + k <= 3")
def gate_relevance(spark, sf):
    from .retrieval import TERMS

    out = sel.gated(_scored(spark, sf), "relevance", sel.relevance_floor(len(TERMS)), 3)
    return out.select("source_id", F.round("relevance", 6).alias("score"), "rescued")


@query("gate_quality_floor", f"WITH {SCORE_CTE}, b AS (SELECT max(score) AS best FROM fin), p AS (SELECT fin.*, score >= greatest(0.10, 0.35::DOUBLE * best) AS ok FROM fin, b), n AS (SELECT count(*) FILTER (ok) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, ordinal) AS k FROM p) SELECT source_id, round(score, 6) AS score, NOT ok AS rescued FROM k, n WHERE ok OR n + k <= 3")
def gate_quality_floor(spark, sf):
    out = sel.gated(_written_scores(spark, sf), "score", F.greatest(F.lit(0.10), 0.35 * F.col("best")), 3)
    return out.select("source_id", F.round("score", 6).alias("score"), "rescued")

