"""Queries over domains: texts tagged, scored and resolved by a dictionary of aliases that is itself a table.

The dictionary comes from the benchmark's items, each of which stands for a domain: its words of five letters or more, its words of two letters and its pairs of words
are aliases (thousands, growing with the table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aliases as al
from .records import CLEAN
from .registry import query
from .views import SOURCES, sources, table

DOMAINS = ("computing", "physics", "language", "biology", "history", "education", "general", "medicine", "law", "art")
_of = "['" + "', '".join(DOMAINS) + "']"
_plain = "trim(regexp_replace(lower({}), '[^a-z0-9+#]+', ' ', 'g'))"


def dictionary(spark, sf):
    """alias, domain and priority, before repeats are settled."""
    words = table(spark, sf, "benchmark").select("item_id", F.split(al.plain(F.col("text")), " ").alias("w"))
    single = F.filter("w", lambda x: (F.length(x) >= 5) | (F.length(x) == 2))
    pairs = F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), F.get("w", i + 1).alias("y"))), lambda p: p["y"].isNotNull()), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    rows = words.select(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("item_id") % 10 + 1).cast("int")).alias("domain"), F.explode(F.concat(single, pairs)).alias("alias"))
    return rows.unionByName(priorities(spark).select("domain", F.col("domain").alias("alias")))


def priorities(spark):
    return spark.createDataFrame([(d, i * 7 % 10) for i, d in enumerate(DOMAINS)], "domain string, priority int")


_ALIASES = f"""bw AS (SELECT item_id, string_split({_plain.format('text')}, ' ') AS w FROM benchmark),
a0 AS (SELECT {_of}[item_id % 10 + 1] AS domain, unnest(list_concat(list_filter(w, lambda x: length(x) >= 5 OR length(x) = 2), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS alias FROM bw
  UNION ALL SELECT unnest({_of}), unnest({_of})),
al AS MATERIALIZED (SELECT alias, min(domain) AS domain FROM a0 GROUP BY alias)"""
_HITS = """tw AS (SELECT k, string_split(p, ' ') AS w FROM texts),
g AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS alias FROM tw),
hits AS MATERIALIZED (SELECT DISTINCT k, alias, domain FROM g JOIN al USING (alias))"""
_SCORES = """sc AS (SELECT k, domain, least(0.98::DOUBLE, round(sum(CASE WHEN contains(alias, ' ') THEN 0.48 WHEN length(alias) <= 3 THEN 0.30 ELSE 0.38 END::DOUBLE
  + CASE WHEN contains(concept, alias) THEN 0.22 ELSE 0 END::DOUBLE + CASE WHEN len(list_filter(keywords, lambda x: contains(x, alias))) > 0 THEN 0.10 ELSE 0 END::DOUBLE), 6)) AS score FROM hits JOIN texts USING (k) GROUP BY k, domain)"""
_BEST = f"""rk AS (SELECT k, domain, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, (list_position({_of}, domain) - 1) * 7 % 10, domain) AS r
  FROM sc WHERE score >= 0.25 AND domain NOT IN ('education', 'general'))"""

_turns = f"texts AS (SELECT conv_id * 1000 + turn AS k, {_plain.format('text')} AS p, lower(left(text, 30)) AS concept, list_filter(string_split({_plain.format('text')}, ' '), lambda x: length(x) >= 8)[1:5] AS keywords FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


def _asked(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text", F.left("text", F.lit(30)).alias("concept"), F.slice(F.filter(F.split(al.plain(F.col("text")), " "), lambda x: F.length(x) >= 8), 1, 5).alias("keywords"))


@query("domain_scores", f"WITH {_ALIASES}, {_turns}, {_HITS}, {_SCORES}, {_BEST} SELECT k, string_agg(domain || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY r) AS domains FROM rk WHERE r <= 4 GROUP BY k")
def domain_scores(spark, sf):
    """Up to four domains of each question, the best first, with confidences in ten thousandths."""
    texts = _asked(spark, sf)
    scored = al.scores(al.hits(texts, "k", "text", dictionary(spark, sf)), texts, "k", F.col("concept"), F.col("keywords"))
    found = al.detected(scored, "k", priorities(spark))
    return found.select("k", F.array_join(F.transform("domains", lambda x: F.concat_ws(":", x["domain"], F.round(x["confidence"] * 10000).cast("long").cast("string"))), ",").alias("domains"))


_records = f"src2 AS (SELECT source_id AS k, title, {CLEAN.format('title')} || ' ' || coalesce(summary, '') || ' ' || {CLEAN.format('abstract')} AS every FROM src), texts AS (SELECT k, title, {_plain.format('every')} AS p, lower(title) AS concept, CAST([] AS VARCHAR[]) AS keywords FROM src2)"
_stop = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_topic = f"array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(trim(regexp_extract(title, '^([^:(]*)', 1)), ' +--? +.*$', '')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_stop}))[1:3], ' ')"


@query("domain_tagging", f"WITH {SOURCES}, {_ALIASES}, {_records}, {_HITS}, {_SCORES}, {_BEST}, lo AS (SELECT k, min((-length(alias), alias, domain)) AS h FROM hits WHERE length(alias) >= 3 GROUP BY k) SELECT k AS source_id, coalesce(h[3], rk.domain, 'general') AS domain, coalesce(h[2], {_topic}) AS topic FROM texts LEFT JOIN lo USING (k) LEFT JOIN (SELECT k, domain FROM rk WHERE r = 1) rk USING (k)")
def domain_tagging(spark, sf):
    every = F.concat(tx.clean(F.col("title")), F.lit(" "), F.coalesce("summary", F.lit("")), F.lit(" "), tx.clean(F.col("abstract")))
    rows = sources(spark, sf).select("source_id", "title", every.alias("every"))
    return al.tagged(rows, "source_id", "every", F.col("title"), dictionary(spark, sf), priorities(spark))


@query("alias_resolution", f"WITH {_ALIASES}, v AS (SELECT conv_id * 1000 + turn AS k, unnest(string_split(text, ' ')) AS name, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE text IS NOT NULL), f AS (SELECT k, domain, min(i) AS i FROM v JOIN al ON al.alias = {_plain.format('name')} GROUP BY ALL) SELECT k, string_agg(domain, ',' ORDER BY i) AS domains FROM f GROUP BY k")
def alias_resolution(spark, sf):
    """The domains that the words of a text stand for, each once, in their order."""
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.split("text", " ").alias("names"))
    return al.resolved(rows, "k", F.col("names"), dictionary(spark, sf)).select("k", F.array_join("domains", ",").alias("domains"))
