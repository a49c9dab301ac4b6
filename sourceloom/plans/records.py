"""Queries over source records: normalization, duplicates, scores, gates and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx, text as tx, url as ul
from ..operators import difficulty as df, records as rc, relevance as rel, scoring as sc, selection as sel
from .registry import query
from .retrieval import BM25, TERMS
from .views import SOURCES, sources, table

CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
NORMAL = "trim(regexp_replace(regexp_replace(lower(" + CLEAN + "), '[^a-z0-9+ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("normalize_text", f"SELECT page_id, md5({CLEAN.format('html')}) AS clean_md5, md5({NORMAL.format('html')}) AS normal_md5, len(regexp_extract_all({CLEAN.format('html')}, '[^ \\t\\r\\n]+'))::INTEGER AS words, CASE WHEN length(html) <= 60 THEN html ELSE rtrim(substring(html, 1, 57)) || '...' END AS short FROM pages")
def normalize_text(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean(html)).alias("clean_md5"), F.md5(tx.normal_title(html)).alias("normal_md5"), tx.word_count(tx.clean(html)).alias("words"), tx.truncated(html, 60).alias("short"))


@query("slugs_and_tokens", f"WITH {SOURCES} SELECT source_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug, CASE WHEN length(abstract) = 0 THEN 0 ELSE greatest(1, length(abstract) // 4) END::BIGINT AS est_tokens FROM src")
def slugs_and_tokens(spark, sf):
    return sources(spark, sf).select("source_id", tx.slug(F.col("title"), 40).alias("slug"), tx.token_estimate(F.col("abstract")).alias("est_tokens"))


TRACK = ", ".join(f"'{t}'" for t in ul.TRACKING)
URL_CTE = f"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({TRACK})) AS kept FROM pages)"""


@query("url_parts", f"WITH {URL_CTE} SELECT page_id, host, scheme IN ('http', 'https') AND host <> '' AS valid, scheme || '://' || regexp_replace(host, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS fingerprint FROM u")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", ul.host(u).alias("host"), ul.is_valid(u).alias("valid"), ul.without_tracking(u).alias("fingerprint"))


@query("html_anchors_text", "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS label FROM pages) SELECT page_id, href, label, count(*) AS n FROM a WHERE length(trim(label)) >= 2 GROUP BY ALL")
def html_anchors_text(spark, sf):
    html = table(spark, sf, "pages").select("page_id", F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), 1).alias("href"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1).alias("label"))).alias("a"))
    return html.select("page_id", "a.href", "a.label").where(F.length(F.trim("label")) >= 2).groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


ARXIV = "coalesce(" + ", ".join(f"nullif(regexp_extract(lower(trim(coalesce({c}, ''))), '{form}', {group}), '')" for c in rc.ARXIV_COLUMNS for form, group in rc.ARXIV_FORMS) + ")"
GIVEN_DOI = "regexp_replace(lower(coalesce(nullif(trim(coalesce(doi, '')), ''), nullif(trim(external_doi), ''), nullif(regexp_extract(lower(url), 'doi\\.org/(10\\.[^ \\t\\r\\n]+)', 1), ''))), 'https?://doi\\.org/|doi:|doi\\.org/', '', 'g')"
DOI = f"CASE WHEN starts_with({GIVEN_DOI}, '10.') AND NOT contains({GIVEN_DOI}, 'arxiv') THEN {GIVEN_DOI} END"
KEY = f"coalesce('arxiv:' || {ARXIV}, 'doi:' || {DOI}, CASE WHEN {NORMAL.format('title')} = '' THEN 'url:' || url END, CASE WHEN source_type = 'repository' THEN 'repo' ELSE source_type END || ':' || {NORMAL.format('title')})"
QUALITY = "least(length(coalesce(abstract, '')) / 1000::DOUBLE, 2) + " + " + ".join(f"coalesce(least({c} / {unit}::DOUBLE, {most}), 0)" for c, unit, most in rc.QUALITY_PARTS) + " + least(n_authors, 5) * 0.1::DOUBLE + CASE WHEN year IS NOT NULL OR published IS NOT NULL THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN coalesce(has_code, false) THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN coalesce(has_pdf, false) THEN 0.3 ELSE 0 END::DOUBLE + CASE platform " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rc.PLATFORM_QUALITY.items()) + " ELSE 0 END::DOUBLE"
_fill = lambda c: f"arg_min({c}, rk) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '') AS {c}"


@query("dedupe_key_merge", f"""WITH {SOURCES}, k AS (SELECT *, {KEY} AS key, {QUALITY} AS q FROM src), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q DESC, ordinal) AS rk FROM k),
nm AS (SELECT key, rk, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS name FROM (SELECT key, rk, string_split(authors_raw, ';') AS l FROM r)),
n1 AS (SELECT key, lower(name) AS low, arg_min(name, rk * 100 + pos) AS name, min(rk * 100 + pos) AS o FROM nm WHERE name <> '' GROUP BY ALL), n2 AS (SELECT key, string_agg(name, ';' ORDER BY o) AS authors FROM n1 GROUP BY key),
u1 AS (SELECT key, url, min(rk) AS o FROM r GROUP BY key, url QUALIFY row_number() OVER (PARTITION BY key ORDER BY min(rk)) <= 5), u2 AS (SELECT key, string_agg(url, ' ' ORDER BY o) AS urls FROM u1 GROUP BY key),
m AS (SELECT key, arg_min(source_id, rk) AS source_id, md5(arg_min(title, rk)) AS title_md5, arg_min(url, rk) AS url, arg_min(platform, rk) AS platform, md5(arg_max(coalesce(abstract, ''), {{'n': length(coalesce(abstract, '')), 'r': -rk}})) AS abstract_md5, max(citation_count)::BIGINT AS citation_count,
  CASE WHEN bool_or(coalesce(has_code, false)) THEN true ELSE max(has_code) FILTER (rk = 1) END AS has_code, {', '.join(map(_fill, rc.FILLED))}, round(max(q), 6) AS quality, count(*) AS duplicate_count FROM r GROUP BY key)
SELECT m.*, coalesce(authors, '') AS authors, urls FROM m LEFT JOIN n2 USING (key) LEFT JOIN u2 USING (key)""")
def dedupe_key_merge(spark, sf):
    out = rc.merged_by_key(sources(spark, sf))
    plain = ["key", "source_id", "url", "platform", "citation_count", "has_code", *rc.FILLED, "quality", "duplicate_count"]
    return out.select(*plain, F.md5("title").alias("title_md5"), F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"), F.array_join("authors", ";").alias("authors"), F.array_join("alternate_urls", " ").alias("urls"))


@query("record_ids", f"WITH {SOURCES} SELECT source_id, {ARXIV} AS arxiv, {DOI} AS doi FROM src")
def record_ids(spark, sf):
    return sources(spark, sf).select("source_id", rc.arxiv_id(*map(F.col, rc.ARXIV_COLUMNS)).alias("arxiv"), rc.doi(F.col("doi"), F.col("external_doi"), F.col("url")).alias("doi"))


@query("dedupe_exact_title", f"WITH {SOURCES}, k AS (SELECT *, {NORMAL.format('title')} AS tk, {QUALITY} AS q FROM src) SELECT source_id FROM k QUALIFY NOT (source_type = 'research_paper' AND length(tk) >= 8) OR row_number() OVER (PARTITION BY source_type = 'research_paper' AND length(tk) >= 8, tk ORDER BY q DESC, ordinal) = 1")
def dedupe_exact_title(spark, sf):
    return rc.exact_titles(sources(spark, sf))


URL_KEY = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("normalized_records", f"""WITH {SOURCES}, c AS (SELECT *, {CLEAN.format('title')} AS tc, {URL_KEY} AS link, list_filter(list_transform(string_split(authors_raw, ';'), lambda x: trim(x)), lambda x: x <> '') AS names FROM src)
SELECT sha256('{{"platform":' || to_json(platform) || ',"title":' || to_json(regexp_replace(lower(tc), ' +', ' ', 'g')) || ',"url":' || to_json(link) || '}}') AS source_id, ordinal, md5(tc) AS title_md5, link AS url, md5(nullif(left({CLEAN.format('abstract')}, 2000), '')) AS abstract_md5,
array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i), ';') AS authors, CASE WHEN year BETWEEN 0 AND 2100 THEN year END AS year, CASE WHEN citation_count >= 0 THEN citation_count END AS citation_count FROM c WHERE length(tc) >= 3 AND regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]')""")
def normalized_records(spark, sf):
    out = rc.normalized(sources(spark, sf))
    return out.select("source_id", "ordinal", F.md5("title").alias("title_md5"), "url", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", ";").alias("authors"), "year", "citation_count")


LEV = f"""t AS (SELECT {NORMAL.format('title')} AS title, min(ordinal) AS id FROM src GROUP BY 1 HAVING length({NORMAL.format('title')}) >= 3),
lev AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, 1 - levenshtein(a.title, b.title) / length(a.title)::DOUBLE AS ratio FROM t a JOIN t b ON left(a.title, 2) = left(b.title, 2) AND a.id <> b.id
AND (length(a.title) > length(b.title) OR (length(a.title) = length(b.title) AND a.id < b.id)) AND length(b.title) >= ceil(length(a.title) * 0.85) WHERE levenshtein(a.title, b.title) <= floor(0.15 * length(a.title) + 1e-9))"""
LEV_VALID = LEV.replace(">= 3)", "BETWEEN 3 AND 500)")  # of valid titles only


@query("dedupe_fuzzy_lev", f"WITH {SOURCES}, {LEV} SELECT id_a, id_b, round(ratio, 6) AS ratio FROM lev")
def dedupe_fuzzy_lev(spark, sf):
    return rc.fuzzy_titles(sources(spark, sf).select(F.col("ordinal").alias("id"), tx.normal_title(F.col("title")).alias("title")))


@query("dedupe_fuzzy_kept", f"WITH {SOURCES}, {LEV_VALID}, k AS (SELECT ordinal AS id, {QUALITY} AS q FROM src), l AS (SELECT id_a AS id, id_b AS other FROM lev UNION ALL SELECT id_b, id_a FROM lev) SELECT id FROM k WHERE id NOT IN (SELECT l.id FROM l JOIN k a ON a.id = l.id JOIN k b ON b.id = l.other WHERE b.q > a.q OR (b.q = a.q AND b.id < a.id))")
def dedupe_fuzzy_kept(spark, sf):
    """The records that are left when each worse one of a pair of like valid titles is gone."""
    rows = sources(spark, sf).select(F.col("ordinal").alias("id"), tx.normal_title(F.col("title")).alias("title"), rc.quality().alias("q"))
    return rc.without_losers(rows.select("id", "q"), rc.fuzzy_titles(rows.where(F.length("title") <= rc.LONGEST_TITLE))).select("id")


REASON = "CASE WHEN length(title) < 3 THEN 'title_short' WHEN length(title) > 500 THEN 'title_long' WHEN regexp_matches(lower(title), 'withdrawn|retracted') THEN 'withdrawn' WHEN NOT regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') THEN 'url_invalid' WHEN length(abstract) > 5000 THEN 'abstract_long' WHEN NOT coalesce(year BETWEEN 0 AND 2100, true) THEN 'year_range' END"


@query("drop_reasons", f"WITH {SOURCES}, r AS (SELECT source_id, ordinal, {REASON} AS reason FROM src) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, min(ordinal) AS first_ordinal FROM r GROUP BY ALL")
def drop_reasons(spark, sf):
    return sources(spark, sf).groupBy(F.coalesce(rc.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"))


@query("validate_ladder", f"WITH {SOURCES}, {BM25}, s AS (SELECT source_id, relevance, relevance >= 0.95::DOUBLE AS a, relevance >= 0.5::DOUBLE AS b FROM src JOIN rel ON rel.doc_id = ordinal WHERE {REASON} IS NULL), r AS (SELECT CASE WHEN bool_or(a) THEN 1 WHEN bool_or(b) THEN 2 ELSE 3 END AS rung FROM s) SELECT source_id, round(relevance, 6) AS relevance, rung FROM s, r WHERE rung = 3 OR (rung = 2 AND b) OR (rung = 1 AND a)")
def validate_ladder(spark, sf):
    rows = _scored(spark, sf).where(rc.drop_reason().isNull())
    return rc.fallback_rungs(rows, F.col("relevance") >= 0.95, F.col("relevance") >= 0.5).select("source_id", F.round("relevance", 6).alias("relevance"), "rung")


def _scored(spark, sf):
    """Sources with their relevance, in one pass over the texts after the one for the corpus statistics."""
    return rel.bm25(sources(spark, sf), TERMS, "abstract").drop("bm25")


RATIO = 0.2
SCORED = f"{SOURCES}, {BM25}, s AS (SELECT src.*, relevance FROM src JOIN rel ON rel.doc_id = ordinal)"


def _gate_sql(score: str, floor: str, least: int) -> str:
    return f"""WITH {SCORED}, v AS (SELECT source_id, ordinal, {score} AS v FROM s), b AS (SELECT max(v) AS best FROM v), p AS (SELECT v.*, v >= {floor} AS ok FROM v, b),
n AS (SELECT count(*) FILTER (ok) AS n FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY v DESC, ordinal) AS k FROM p) SELECT source_id, round(v, 6) AS score, NOT ok AS rescued FROM k, n WHERE ok OR n + k <= {least}"""


@query("gate_strict_rescue", _gate_sql("relevance", "best * 2", 3))
def gate_strict_rescue(spark, sf):
    """A gate that nothing passes gives the three best."""
    return sel.gated(_scored(spark, sf), "relevance", F.col("best") * 2, 3).select("source_id", F.round("relevance", 6).alias("score"), "rescued")


WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
FOG = "CASE WHEN len(" + WORDS + ") = 0 OR len(list_filter(string_split_regex({0}, '[.!?]+'), lambda x: regexp_matches(x, '[^\\s]'))) = 0 THEN 12.0::DOUBLE ELSE greatest(0, least(20, 0.4::DOUBLE * (len(" + WORDS + ") / len(list_filter(string_split_regex({0}, '[.!?]+'), lambda x: regexp_matches(x, '[^\\s]')))::DOUBLE + 100.0::DOUBLE * len(list_filter(" + WORDS + ", lambda w: len(regexp_extract_all(w, '[aeiouy]+')) >= 3)) / len(" + WORDS + ")))) END::DOUBLE"


@query("fog_grade", f"SELECT doc_id, round({FOG.format('text')}, 4) AS grade FROM documents")
def fog_grade(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.fog_grade(F.col("text")), 4).alias("grade"))


def _step(*steps: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v in steps) + " ELSE 0 END"


def _fired(*steps: tuple[str, float]) -> str:
    return "CASE WHEN " + " OR ".join(c for c, _ in steps) + " THEN 1 ELSE 0 END"


_q = lambda x: "'" + x.replace("'", "''") + "'"
_hits = lambda marks, text: "(" + " + ".join(f"contains({text}, {_q(m)})::INTEGER" for m in marks) + ")"
_forms = lambda patterns: "(" + " + ".join(f"regexp_matches(l, {_q(p)})::INTEGER" for p in patterns) + ")"
_found = lambda patterns, text: "(" + " + ".join(f"len(regexp_extract_all({text}, {_q(p)}))" for p in patterns) + ")"
_rate = lambda n, text: f"({n}) / (greatest(1, length({text})) / 1000.0::DOUBLE)"
_first = lambda words, head: "CASE " + " ".join(f"WHEN regexp_matches(n, {_q(head + w + chr(92) + 'b')}) THEN {_q(w)}" for w in words) + " END"
_times = lambda m: f"(length(l) - length(replace(l, {_q(m)}, ''))) // {len(m)}"
GENERIC = ", ".join(f"'{w}'" for w in fx.GENERIC)
LIGHT = "list_filter(list_transform(list_transform(list_transform(regexp_extract_all(lower({0}), '[a-z0-9+#.]+'), lambda x: trim(x, '.')), lambda x: {{'t': x, 'g': CASE WHEN length(x) > 6 AND ends_with(x, 'ing') THEN left(x, -3) ELSE x END}}), lambda x: CASE WHEN length(x.t) <= 6 THEN x.t WHEN ends_with(x.g, 'ies') AND length(x.g) > 4 THEN left(x.g, -3) || 'y' WHEN ends_with(x.g, 'es') THEN left(x.g, -2) WHEN ends_with(x.g, 's') THEN left(x.g, -1) ELSE x.g END), lambda x: x <> '')"
_address = (("address > 0.15", -0.10), ("address > 0.05", -0.05), ("address < 0.03 AND length(t) > 200", 0.05))
_notation = (("notation > 0.20", 0.20), ("notation > 0.05", 0.10))
_refs = (("refs > 0.10", 0.10), ("refs > 0.03", 0.05))
_length = (("sentence <= 0", 0.0), ("sentence >= 32", 0.15), ("sentence >= 24", 0.10), ("sentence <= 12", -0.08), ("sentence <= 16", -0.03))
_terms = (("terms > 0.15", 0.25), ("terms > 0.08", 0.15), ("terms < 0.02", -0.05))
_compound = (("compound > 5.0", 0.25), ("compound > 3.5", 0.15), ("compound > 0 AND compound < 2.0", -0.05))
_names = (("names > 2", 0.10), ("names = 0 AND length(ti) > 20", -0.05))
_tn = (("title_notation > 0.05", 0.10),)
_cited = (("coalesce(citation_count, -1) >= 500", 0.20), ("coalesce(citation_count, -1) >= 100", 0.10), ("coalesce(citation_count, -1) >= 10", 0.05))
_b = chr(92) + "b"
DIFF = f"""d1 AS (SELECT *, concat_ws(' ', {', '.join(f"nullif({CLEAN.format(c)}, '')" for c in ('title', 'abstract', 'summary', 'description'))}) AS t, {CLEAN.format('title')} AS ti FROM src),
d2 AS (SELECT *, lower(t) AS l, lower(ti) AS n, lower(trim(coalesce(publisher, ''))) AS pub, {LIGHT.format('t')} AS lt,
  'x' || array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z]+|[.!?]+'), lambda x: CASE WHEN length(x) >= 3 AND regexp_matches(x, '^[A-Za-z]') AND lower(x) NOT IN ({GENERIC}) THEN 'c' ELSE 'x' END), '') AS runs,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: trim(x) <> '')) AS ns FROM d1),
d3 AS (SELECT *, {_hits(fx.BEGINNER_MARKERS, 'l')} AS begins, {_hits(fx.ADVANCED_MARKERS, 'l')} AS advances, {_forms(df.ACADEMIC_PROSE)} AS academic, {_forms(df.BEGINNER_PROSE)} AS friendly,
  {_rate(' + '.join(_times(m) for m in df.ADDRESS) + " + starts_with(l, 'you ')::INTEGER", 'l')} AS address, {_rate(_found(df.NOTATION, 't'), 't')} AS notation, {_rate(_found(df.REFERENCES, 't'), 't')} AS refs,
  CASE WHEN ns = 0 THEN 0 ELSE len(regexp_extract_all(t, '[^ .!?]+')) / ns::DOUBLE END AS sentence,
  CASE WHEN len(lt) = 0 THEN 0 ELSE len(list_filter(lt, lambda x: regexp_matches(x, '^[a-z]{{8,}}$') AND x NOT IN ({GENERIC}) AND (regexp_matches(x, '^(?:{'|'.join(df.TECHNICAL_HEADS)})') OR regexp_matches(x, '(?:{'|'.join(df.TECHNICAL_ENDS)})$')))) / len(lt)::DOUBLE END AS terms,
  CASE WHEN contains(runs, 'c') THEN length(replace(runs, 'x', '')) / ((length(runs) - length(replace(runs, 'xc', ''))) / 2)::DOUBLE ELSE 0 END AS compound,
  CASE WHEN len(regexp_extract_all(ti, '{df.NAMES}')) > 0 THEN len(regexp_extract_all(ti, '{df.NAMES}')) ELSE len(list_filter(string_split(ti, ' ')[2:], lambda w: regexp_matches(w, '{df.PROPER}'))) END AS names,
  {_rate(_found(df.NOTATION, 'ti'), 'ti')} AS title_notation, {_hits(df.ACADEMIC_PUBLISHERS, 'pub')} > 0 AS university, {_hits(df.SELF_PUBLISHED, 'pub')} > 0 AS selfmade, trim(coalesce(doi, '')) <> '' AS has_doi FROM d2),
d4 AS (SELECT *, CASE WHEN l = '' THEN 0.5 ELSE greatest(0, least(1, 0.5::DOUBLE + greatest(-0.35, -0.05::DOUBLE * begins) + least(0.35, 0.05::DOUBLE * advances) + least(0.20, 0.04::DOUBLE * academic) - least(0.15, 0.03::DOUBLE * friendly) + {_step(*_address)} + {_step(*_notation)} + {_step(*_refs)} + {_step(*_length)})) END::DOUBLE AS treatment,
  CASE WHEN l = '' THEN 0 ELSE (begins > 0)::INTEGER + (advances > 0)::INTEGER + (academic > 0)::INTEGER + (friendly > 0)::INTEGER + {_fired(*_address)} + {_fired(*_notation)} + {_fired(*_refs)} + CASE WHEN sentence > 0 THEN {_fired(*_length[1:])} ELSE 0 END END AS ts,
  CASE WHEN t = '' AND ti = '' THEN 0.4 ELSE greatest(0, least(1, 0.4::DOUBLE + {_step(*_terms)} + {_step(*_compound)} + {_step(*_names)} + {_step(*_tn)})) END::DOUBLE AS topic,
  CASE WHEN t = '' AND ti = '' THEN 0 ELSE {_fired(*_terms)} + {_fired(*_compound)} + {_fired(*_names)} + {_fired(*_tn)} END AS ps,
  greatest(0, least(1, 0.5::DOUBLE + CASE WHEN university THEN 0.2 ELSE 0 END - CASE WHEN selfmade THEN 0.2 ELSE 0 END + {_step(*_cited)} + CASE WHEN has_doi THEN 0.05 ELSE 0 END))::DOUBLE AS meta,
  university::INTEGER + selfmade::INTEGER + {_fired(*_cited)} + has_doi::INTEGER AS ms,
  greatest(-0.15, least(0.15, CASE platform {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in df.PLATFORM_PRIOR.items())} ELSE 0 END + CASE source_type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in df.TYPE_PRIOR.items())} ELSE 0 END))::DOUBLE AS prior,
  {_first(df.STARTS_ADVANCED, '^')} AS starts, {_first(df.ADVANCED_WORDS, _b)} AS word, {_first(df.ADVANCED_QUALIFIERS, _b)} AS qualifier, {_first(df.BEGINNER_TITLES, _b)} AS easy FROM d3),
d5 AS (SELECT *, ts + ps + ms AS signals, greatest(0, least(1, greatest(0, least(1, 0.55::DOUBLE * treatment + 0.35::DOUBLE * topic + 0.10::DOUBLE * meta + prior)) - 0.05::DOUBLE)) AS score FROM d4),
d6 AS (SELECT *, CASE WHEN score < 0.35 THEN CASE WHEN treatment >= 0.55 OR topic >= 0.60 OR academic >= 2 THEN 1 ELSE 0 END WHEN score < 0.65 THEN 1 ELSE 2 END AS rank0 FROM d5),
d7 AS (SELECT *, CASE WHEN starts IS NOT NULL THEN CASE WHEN rank0 < 2 THEN 'starts_advanced' END WHEN word IS NOT NULL AND qualifier IS NOT NULL THEN CASE WHEN rank0 < 2 THEN 'advanced_marker_with_qualifier' END
  WHEN easy IS NOT NULL AND word IS NULL THEN CASE WHEN rank0 > 0 THEN 'beginner_phrase' END WHEN word IS NOT NULL THEN CASE WHEN rank0 < 1 THEN 'advanced_marker' END END AS promotion,
  greatest(0.10, least(0.95, 0.30::DOUBLE + 0.05::DOUBLE * least(signals, 6) + 0.10::DOUBLE * least(1, length(t) / 500.0::DOUBLE) + 0.20::DOUBLE * (1 - abs(treatment - topic)) + CASE WHEN begins + advances > 0 THEN 0.15 ELSE 0 END - CASE WHEN length(t) < 80 THEN 0.15 ELSE 0 END)) AS sure FROM d6),
dn AS (SELECT *, CASE WHEN promotion IS NULL THEN sure ELSE greatest(sure, 0.75) END AS confidence,
  ['beginner', 'intermediate', 'advanced'][1 + CASE promotion WHEN 'starts_advanced' THEN 2 WHEN 'advanced_marker_with_qualifier' THEN 2 WHEN 'beginner_phrase' THEN 0 WHEN 'advanced_marker' THEN 1 ELSE rank0 END] AS level FROM d7)"""


@query("difficulty_class", f"WITH {SOURCES}, {DIFF} SELECT source_id, round(score, 6) AS score, level, promotion, round(confidence, 6) AS confidence FROM dn")
def difficulty_class(spark, sf):
    out = df.classify(sources(spark, sf), "beginner")
    return out.select("source_id", F.round("level_score", 6).alias("score"), "level", "promotion", F.round("level_confidence", 6).alias("confidence"))


@query("difficulty_parts", f"WITH {SOURCES}, {DIFF} SELECT source_id, round(treatment, 6) AS treatment, round(topic, 6) AS topic, round(meta, 6) AS metadata_score, round(prior, 6) AS prior, signals::INTEGER AS signals FROM dn")
def difficulty_parts(spark, sf):
    return df.classify(sources(spark, sf), "beginner").select("source_id", *[F.round(c, 6).alias(c) for c in ("treatment", "topic", "metadata_score", "prior")], "signals")


_guard = lambda trigger: f"WITH {SOURCES}, {DIFF}, a AS (SELECT avg((level = 'advanced')::INTEGER) AS share FROM dn) SELECT source_id, CASE WHEN share > {trigger} AND level = 'advanced' AND round(treatment, 4) < 0.45 THEN 'intermediate' WHEN share > {trigger} AND level = 'intermediate' AND round(treatment, 4) < 0.30 AND round(topic, 4) < 0.50 THEN 'beginner' ELSE level END AS level FROM dn, a"


def _levels(spark, sf):
    """What the guard goes by, without the texts."""
    return df.classify(sources(spark, sf), "beginner").select("source_id", "level", "treatment", "topic")


@query("distribution_guard", _guard(0.5))
def distribution_guard(spark, sf):
    return df.guarded(_levels(spark, sf)).select("source_id", "level")


@query("distribution_guard_strict", _guard(0.02))
def distribution_guard_strict(spark, sf):
    """With a trigger so low that it acts on these records."""
    return df.guarded(_levels(spark, sf), trigger=0.02).select("source_id", "level")


_map = lambda c, d, e: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + f" ELSE {e} END::DOUBLE"
_code = "CASE WHEN coalesce(has_code, false) THEN {} ELSE 0 END::DOUBLE"
FEATURES = {
    "authority": _map("platform", sc.AUTHORITY, _map("source_type", sc.TYPE_AUTHORITY, 0.45)), "type_quality": _map("source_type", sc.TYPE_QUALITY, 0.45),
    "impact": "CASE WHEN citation_count IS NOT NULL THEN CASE WHEN citation_count <= 0 THEN 0.20 ELSE least(1, ln(1 + citation_count) / ln(1001)) END WHEN stars IS NOT NULL THEN least(1, ln(1 + stars) / ln(5001)) WHEN downloads IS NOT NULL THEN least(1, ln(1 + downloads) / ln(100001)) ELSE 0.35 END::DOUBLE",
    "recency": "CASE WHEN coalesce(year, 0) = 0 THEN 0.5 ELSE greatest(0.2, exp(-greatest(0, 2025 - year) / 8.0)) END::DOUBLE",
    "content": f"greatest(0, least(1, least(1, length({CLEAN.format('abstract')}) / 600.0::DOUBLE) + CASE WHEN {CLEAN.format('summary')} <> '' THEN 0.25 ELSE 0 END::DOUBLE + least(0.2, meta_keys / 8.0)::DOUBLE + {_code.format(0.05)}))",
    "support": f"least(1, {_code.format(0.45)} + CASE WHEN url <> '' THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN doi IS NOT NULL OR coalesce(has_pdf, false) THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN coalesce(open_access, false) THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN code_url IS NOT NULL THEN 0.15 ELSE 0 END::DOUBLE)",
    "authors": "CASE WHEN n_authors > 0 THEN least(1, n_authors / 4.0) WHEN source_type IN ('repository', 'model', 'dataset') THEN 0.4 ELSE 0.2 END::DOUBLE",
}
FEAT = f"ft AS (SELECT s.*, {', '.join(f'{v} AS {k}' for k, v in FEATURES.items())}, {FOG.format(chr(39).join(['title || ', '. ', ' || abstract']))} AS grade FROM s)"
EDU = ", ".join(f"'{p}'" for p in sc.EDUCATION)
_caps = lambda x, cap: f"greatest(-{cap}, least({cap}, {x}))::DOUBLE"
ALIGN = _caps(f"CASE WHEN platform IN ({EDU}) THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN grade BETWEEN 8 AND 11 THEN 0.1 WHEN grade >= 14 THEN -0.15 ELSE 0 END::DOUBLE + {_map('difficulty', sc.BEGINNER_LEVELS, 0)} + {_map('source_type', sc.BEGINNER_TYPES, 0)}", 0.3)
_ADVANCED = _caps(f"CASE WHEN grade >= 14 THEN 0.05 WHEN grade < 10 THEN -0.05 ELSE 0 END::DOUBLE + {_map('difficulty', sc.ADVANCED_LEVELS, 0)} + {_map('source_type', sc.ADVANCED_TYPES, 0)}", 0.3)
_MIXED = _caps(f"{_map('difficulty', sc.MIXED_LEVELS, 0)} + {_map('source_type', sc.MIXED_TYPES, 0)}", 0.22)
_SUM = "((" + " + ".join(f"{w}::DOUBLE * {k}" for k, w in sc.WEIGHTS.items()) + f") / {sum(sc.WEIGHTS.values())}::DOUBLE"
_HARD = "(difficulty IS NOT DISTINCT FROM 'advanced' OR grade >= 14)"
TOTAL = f"greatest(0, least(1, {_SUM} + {ALIGN}) * CASE WHEN {_HARD} THEN 0.2 ELSE 1 END::DOUBLE))"
#: Requests by level and goal, and what each is: for alignment, and for the mismatch of levels.
REQUESTS = (("beginner", "", "b", "b"), ("Advanced", "", "a", "a"), ("", "from basics to advanced", "m", ""), ("", "cover the basics", "b", "b"), ("", "the cutting edge", "", "a"), ("", "a primer", "", ""), ("expert", "an introduction", "", ""), ("advanced", "for a beginner", "m", ""))
_request = lambda i: "CASE ordinal % 8 " + " ".join(f"WHEN {n} THEN '{r[i]}'" for n, r in enumerate(REQUESTS)) + " END"
_EACH = f"CASE {_request(2)} WHEN 'b' THEN {ALIGN} WHEN 'a' THEN {_ADVANCED} WHEN 'm' THEN {_MIXED} ELSE 0 END"
_TIMES = f"CASE WHEN {_request(3)} = 'b' AND {_HARD} THEN 0.2 WHEN {_request(3)} = 'a' AND (difficulty IS NOT DISTINCT FROM 'beginner' OR grade < 8) THEN 0.5 ELSE 1 END::DOUBLE"
SCORE_CTE = f"{SCORED}, {FEAT}, sco AS (SELECT *, {ALIGN} AS alignment, {TOTAL} AS score FROM ft), fin AS (SELECT *, greatest(0.05, least(0.98, 0.18::DOUBLE + 0.38::DOUBLE * score + 0.18::DOUBLE * authority + 0.14::DOUBLE * content + 0.10::DOUBLE * least(1, meta_keys / 6.0)::DOUBLE)) AS confidence FROM sco)"


def _full_score(spark, sf, level="'beginner'", goal="''"):
    rows = _scored(spark, sf).withColumns({"grade": sc.reading_grade(), "content": sc.content()})
    rows = rows.withColumn("alignment", sc.alignment(F.expr(level), F.expr(goal), F.col("grade")))
    rows = rows.withColumn("score", sc.total(F.col("relevance"), F.col("alignment"), F.col("content"), F.expr(level), F.expr(goal), F.col("grade")))
    return rows.withColumn("confidence", sc.confidence(F.col("score"), F.col("content")))


@query("request_scores", f"WITH {SCORED}, {FEAT}, al AS (SELECT *, {_EACH} AS alignment FROM ft) SELECT source_id, round(alignment, 6) AS alignment, round(greatest(0, least(1, {_SUM} + alignment) * {_TIMES})), 6) AS score FROM al")
def request_scores(spark, sf):
    """Scores for requests of different levels and goals."""
    return _full_score(spark, sf, _request(0), _request(1)).select("source_id", F.round("alignment", 6).alias("alignment"), F.round("score", 6).alias("score"))


@query("source_score", f"WITH {SCORE_CTE} SELECT source_id, round(alignment, 6) AS alignment, round(score, 6) AS score, round(confidence, 6) AS confidence FROM fin")
def source_score(spark, sf):
    return _full_score(spark, sf).select("source_id", *[F.round(c, 6).alias(c) for c in ("alignment", "score", "confidence")])


@query("score_features", f"WITH {SCORED}, {FEAT} SELECT source_id, {', '.join(f'round({k}, 6) AS {k}' for k in FEATURES)} FROM ft")
def score_features(spark, sf):
    cols = {"authority": sc.authority(), "type_quality": sc.type_quality(), "impact": sc.impact(), "recency": sc.recency(), "content": sc.content(), "support": sc.support(), "authors": sc.authors()}
    return sources(spark, sf).select("source_id", *[F.round(v, 6).alias(k) for k, v in cols.items()])


@query("banded_order", f"WITH {SCORE_CTE} SELECT source_id, CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE 3 END AS band, round(score, 6) AS score, row_number() OVER (ORDER BY band, score DESC, confidence DESC, ordinal) AS rank FROM (SELECT *, CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE 3 END AS band FROM fin) QUALIFY rank <= 40".replace("SELECT source_id, CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE 3 END AS band, round(score, 6) AS score, row_number() OVER (ORDER BY band, score DESC", "SELECT source_id, band, round(score, 6) AS score, row_number() OVER (ORDER BY band, fin2.score DESC").replace("FROM fin) QUALIFY", "FROM fin) fin2 QUALIFY"))
def banded_order(spark, sf):
    band = F.when(F.col("difficulty") == "beginner", 0).when(F.col("difficulty") == "intermediate", 1).when(F.col("difficulty") == "advanced", 2).otherwise(3)
    return sel.banded(_full_score(spark, sf), band, "score", "confidence", 40).select("source_id", "band", F.round("score", 6).alias("score"), "rank")


@query("level_alignment", f"WITH {SCORE_CTE}, t AS (SELECT difficulty, row_number() OVER (ORDER BY score DESC, ordinal) AS k FROM fin QUALIFY k <= 5) SELECT round(sum(greatest(0.5, 1 - 0.1 * (k - 1))::DOUBLE * CASE difficulty WHEN 'beginner' THEN 1.0 WHEN 'intermediate' THEN 0.6 WHEN 'advanced' THEN 0.1 ELSE 0.5 END::DOUBLE) / sum(greatest(0.5, 1 - 0.1 * (k - 1))::DOUBLE), 6) AS alignment FROM t")
def level_alignment(spark, sf):
    top = rel.top_ranked(_full_score(spark, sf), [F.desc("score"), F.asc("ordinal")], 5)
    w = F.greatest(F.lit(0.5), 1 - 0.1 * (F.col("rank") - 1))
    fit = sc.looked_up(F.col("difficulty"), {"beginner": 1.0, "intermediate": 0.6, "advanced": 0.1}, 0.5)
    return top.agg(F.round(F.sum(w * fit) / F.sum(w), 6).alias("alignment"))


@query("platform_cap", f"WITH {SCORED} SELECT source_id, platform FROM s QUALIFY row_number() OVER (PARTITION BY platform ORDER BY relevance DESC, ordinal) <= 3")
def platform_cap(spark, sf):
    return sel.per_group(_scored(spark, sf), "platform", [F.desc("relevance"), F.asc("ordinal")], 3).select("source_id", "platform")


QUOTA = "p AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ordinal) AS g FROM {0}), q AS (SELECT greatest(1, {1} // count(DISTINCT platform)) AS quota FROM {0})"


@query("platform_quota", f"WITH {SOURCES}, {QUOTA.format('src', 30)} SELECT source_id, platform, row_number() OVER (ORDER BY g > quota, ordinal) AS position FROM p, q QUALIFY position <= 30")
def platform_quota(spark, sf):
    return sel.quota_fill(sources(spark, sf), "platform", 30).select("source_id", "platform", "position")


@query("rank_passthrough", f"WITH {SOURCES} SELECT source_id, 0.5::DOUBLE AS score, 0.3::DOUBLE AS confidence, row_number() OVER (ORDER BY ordinal) AS rank FROM src QUALIFY rank <= 20")
def rank_passthrough(spark, sf):
    return rel.top_ranked(sources(spark, sf), [F.asc("ordinal")], 20).select("source_id", F.lit(0.5).alias("score"), F.lit(0.3).alias("confidence"), "rank")


@query("agent_fallback_rank", f"WITH {SCORED}, b AS (SELECT max(relevance) AS best FROM s) SELECT source_id, round(greatest(0.3, least(0.95, 1.15::DOUBLE * relevance)), 6) AS confidence FROM s, b WHERE relevance >= greatest(0.35::DOUBLE * best, 0.05)")
def agent_fallback_rank(spark, sf):
    out = sel.gated(_scored(spark, sf), "relevance", F.greatest(0.35 * F.col("best"), F.lit(0.05)), 3)
    return out.select("source_id", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), 1.15 * F.col("relevance"))), 6).alias("confidence"))
