"""Queries that read what providers and stores hand over: payloads of unlike shapes, nested lists, XML, result links, access logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import fixed as fx, text as tx, url as ul
from ..operators import understanding as un, validation as va
from ..sources import readers, variants
from .analytics import ENTRIES, entries
from .asking import AQ, asked
from .records import CLEAN
from .registry import query
from .understanding import PROFILE, QS, questions
from .views import SOURCES, pick, sources, table

PROVIDERS = tuple(readers.PAYLOADS)
FIELDS = ("title", "url", "year", "abstract", "citation_count", "doi")


def _put(tree: dict, path: str, value: Column) -> None:
    """Puts a value in a tree of names at a path like $.a.b[0].c."""
    steps = [s for s in path.removeprefix("$.").replace("[", ".[").split(".") if s]
    for step in steps[:-1]:
        tree = tree.setdefault(step, {})
    tree[steps[-1]] = value


def _made(tree: dict | Column) -> Column:
    """The tree as structs and arrays; [0] is an array's only element."""
    if not isinstance(tree, dict):
        return tree
    if "[0]" in tree:
        return F.array(_made(tree["[0]"]))
    return F.struct(*[_made(v).alias(k) for k, v in tree.items()])


def payload(provider: str) -> Column:
    """A record in a provider's JSON."""
    tree: dict = {}
    for name, paths in zip(FIELDS, readers.PAYLOADS[provider], strict=True):
        value = F.concat(F.lit("published "), F.col("year").cast("string"), F.lit("-01-01")) if name == "year" else F.left("abstract", F.lit(50)) if name == "abstract" else F.col(name)
        if paths[-1] != "$.none":
            _put(tree, paths[-1], value)
    mains = dict(zip((paths[-1] for paths in readers.PAYLOADS[provider]), FIELDS, strict=True))
    for name, path in variants.METADATA.get(provider, {}).items():
        if path not in mains:
            _put(tree, path, F.expr(_told(provider, name)))
    names = F.split("authors_raw", ";")
    if provider in variants.AUTHORS:
        path, parts, separator, _ = variants.AUTHORS[provider]
        whole = F.transform(names, lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))) if provider == "openalex" else F.transform(names, lambda n: F.struct(F.regexp_extract(n, "^([^ ]*)", 1).alias("given"), F.regexp_extract(n, " (.*)$", 1).alias("family"))) if provider == "crossref" else F.transform(names, lambda n: F.struct(n.alias("name")))
        _put(tree, path, F.col("run_id") if provider == "github" else F.replace("authors_raw", F.lit(";"), F.lit(" ,  ")) if separator == "," else F.array("authors_raw") if separator else names if not parts else whole)
    return F.to_json(_made(tree))


def _told(provider: str, name: str) -> str:
    """What a record's metadata say in both engines."""
    if name == "resource_type":
        return pick(("Publication / Article", "Software", "a Lesson", "Image"), "ordinal % 4")
    return pick(("texts", "movies", "audio"), "ordinal % 3") if name == "mediatype" else f"concat(source_id, ' {name}')"


_mains = {p: dict(zip((paths[-1] for paths in held), FIELDS, strict=True)) for p, held in readers.PAYLOADS.items()}
_shown = {"title": "trim(title)", "url": "url", "citation_count": "CAST(citation_count AS VARCHAR)", "doi": "doi"}
_said = lambda p: " || ".join(f"coalesce(',{n}=' || {_shown[_mains[p][path]] if path in _mains[p] else _told(p, n)}, '')" for n, path in sorted(variants.METADATA.get(p, {}).items())) or "''"
_meta = "CASE platform " + " ".join(f"WHEN '{p}' THEN {_said(p)}" for p in PROVIDERS) + " END"
_names = "CASE WHEN platform = 'github' THEN run_id WHEN platform IN (" + ", ".join(f"'{p}'" for p in variants.AUTHORS) + ") THEN authors_raw ELSE '' END"
_kinds = "CASE platform WHEN 'zenodo' THEN ['research_paper', 'other', 'course', 'dataset'][ordinal % 4 + 1] WHEN 'internet_archive' THEN ['documentation', 'video', 'other'][ordinal % 3 + 1] " + " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in variants.KINDS.items()) + " END"
_has = lambda i: "platform IN (" + ", ".join(f"'{p}'" for p, paths in readers.PAYLOADS.items() if paths[i][-1] != "$.none") + ")"
PAYLOAD_CTE = f"{SOURCES}, p AS (SELECT * REPLACE ({pick(PROVIDERS, f'ordinal % {len(PROVIDERS)}')} AS platform, trim(title) AS title) FROM src)"


@query("provider_payloads", f"WITH {PAYLOAD_CTE} SELECT platform, url, md5(title) AS title_md5, CASE WHEN {_has(2)} THEN year END::INTEGER AS year, CASE WHEN {_has(4)} THEN citation_count END::BIGINT AS citation_count, CASE WHEN {_has(5)} THEN trim(doi) END AS doi, CASE WHEN {_has(3)} THEN nullif(trim(left(text, 50)), '') END AS abstract, {_names} AS authors, {_kinds} AS source_type, {_meta} AS metadata FROM p JOIN documents ON doc_id = ordinal WHERE title <> ''")
def provider_payloads(spark, sf):
    """Records in the JSON of their providers, read back to one form, each payload parsed once."""
    src = sources(spark, sf).withColumn("platform", F.expr(pick(PROVIDERS, f"ordinal % {len(PROVIDERS)}")))
    raw = F.lit(None).cast("string")
    for p in PROVIDERS:
        raw = F.when(F.col("platform") == p, payload(p)).otherwise(raw)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit(","), e["key"], F.lit("="), e["value"])), "")
    out = variants.provider_records(src.select("platform", variants.once(raw).alias("raw")))
    return out.select("platform", "url", F.md5("title").alias("title_md5"), "year", "citation_count", "doi", "abstract", F.array_join("authors", ";").alias("authors"), "source_type", said.alias("metadata"))


ARTICLE = "'<PubmedArticle><PMID Version=\"1\">' || ordinal || '</PMID><ArticleTitle>' || regexp_replace(title, '[<>&]', ' ', 'g') || ' <i>x</i></ArticleTitle>' || CASE WHEN ordinal % 3 = 0 THEN '' ELSE '<Abstract><AbstractText>two  words</AbstractText></Abstract>' END || CASE WHEN year IS NULL THEN '' ELSE '<Year>' || year || '</Year>' END || '<Author><LastName>Lee</LastName></Author><Author><LastName> Xu </LastName></Author></PubmedArticle>'"


@query("pubmed_articles", f"WITH {SOURCES} SELECT ordinal::VARCHAR AS pmid, md5(trim(regexp_replace(regexp_replace(title, '[<>&]', ' ', 'g') || '  x ', '\\s+', ' ', 'g'))) AS title_md5, CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'two words' END AS abstract, year::INTEGER AS year, 'Lee;Xu' AS authors FROM src")
def pubmed_articles(spark, sf):
    raw = F.expr(ARTICLE.replace(", 'g')", ")"))
    out = readers.pubmed(sources(spark, sf).select(F.concat(F.lit("<Set>"), raw, F.lit("</Set>")).alias("raw")))
    return out.select("pmid", F.md5("title").alias("title_md5"), "abstract", "year", F.array_join("authors", ";").alias("authors"))


@query("result_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN '' ELSE '' END AS url FROM pages")
def result_links(spark, sf):
    """Where links of a result page lead: advertisements nowhere, redirects to what they carry, others to themselves."""
    code = F.replace(F.replace(F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("&"), F.lit("%26")), F.lit("#"), F.lit("%23"))
    k = F.col("page_id") % 4
    href = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://duckduckgo.com/l/?kh=1&uddg="), F.replace(code, F.lit("+"), F.lit("%2B")))).when(k == 2, "https://duckduckgo.com/y.js?uddg=x").otherwise("https://html.duckduckgo.com/l/?q=none")
    return table(spark, sf, "pages").select("page_id", ul.resolved(href).alias("url"))


@query("slug_titles", "WITH s AS (SELECT page_id, lower(replace(replace(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '-', ' '), '_', ' ')) AS title FROM pages) SELECT page_id, title FROM s WHERE len(list_intersect(regexp_extract_all(title, '[a-z0-9]+'), ['1', '2', '3', 'page', 'article', 'a', 'index', 'html'])) > 0")
def slug_titles(spark, sf):
    """Titles from the last part of a path, kept where they share a token with the query."""
    wanted = F.array(*map(F.lit, ("1", "2", "3", "page", "article", "a", "index", "html")))
    rows = table(spark, sf, "pages").select("page_id", ul.slug_title(F.col("url")).alias("title"))
    return rows.where(F.size(F.array_intersect(tx.tokens(F.col("title")), wanted)) > 0)


def _nested() -> Column:
    """A record in four forms and places of one JSON document, beside things that are no records; every ninth document is a list, every eleventh is broken."""
    url, k = F.col("url"), F.col("ordinal")
    text = lambda c: c.cast("string")
    a = F.struct(F.col("source_id").alias("id"), F.col("title"), url.alias("link"), F.lit(" ArXiv ").alias("platform"), text(F.col("year")).alias("published_year"), F.lit("Book").alias("type"), F.lit("ADVANCED").alias("level"),
                 F.array(F.lit("Ann"), F.lit(" ann "), F.lit("Bo <b>X</b>")).alias("authors"), F.when(k % 2 == 0, "Yes").otherwise("maybe").alias("has_code"), F.lit("2024-01-02T03:04:05Z").alias("published_at"), F.struct(text(k).alias("n")).alias("metadata"))
    b = F.struct(F.lit("").alias("title"), F.col("title").alias("name"), F.concat(url, F.lit("/b")).alias("href"), F.lit("two  words").alias("snippet"), F.col("citation_count").alias("citations"), F.col("platform").alias("provider"))
    c = F.struct(F.concat(url, F.lit("/c")).alias("uri"), F.lit("odd").alias("platform"), F.lit("talk").alias("kind"), F.lit("hard").alias("difficulty"), (k / 4).alias("score"))
    d = F.struct(F.lit("no url").alias("title"))
    held = F.to_json(F.struct(F.array(a).alias("results"), F.struct(F.struct(F.array(b).alias("papers")).alias("documents")).alias("data"), c.alias("books"), F.array(d).alias("items"), F.array(F.lit("text"), F.lit("7")).alias("courses"), F.array(c).alias("other")))
    return F.when(k % 11 == 0, F.left(held, F.length(held) - 1)).when(k % 9 == 0, F.concat(F.lit("["), held, F.lit(", 5]"))).otherwise(held)


_titled = f"coalesce(nullif({CLEAN.format('title')}, ''), {{}})"
_known = ", ".join(f"'{p}'" for p in va.PLATFORMS)
_made_by = "CASE platform " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in variants.PLATFORM_TYPES.items()) + " ELSE 'other' END"


@query("harvested_records", f"""WITH {SOURCES}, f AS (SELECT * FROM src WHERE ordinal % 11 <> 0) SELECT ordinal, source_id, md5({_titled.format('url')}) AS title_md5, url, 'arxiv' AS platform, 'book' AS source_type, '' AS abstract, year::INTEGER AS year, NULL::BIGINT AS citation_count, 'advanced' AS difficulty, 'Ann;Bo X' AS authors, CASE WHEN ordinal % 2 = 0 THEN true END AS has_code, TIMESTAMP '2024-01-02 03:04:05' AS published_at, NULL::DOUBLE AS score, ordinal::VARCHAR AS n FROM f
UNION ALL SELECT ordinal, url || '/b', md5({_titled.format("url || '/b'")}), url || '/b', CASE WHEN platform IN ({_known}) THEN platform ELSE 'web' END, {_made_by}, 'two words', NULL, citation_count, NULL, '', NULL, NULL, NULL, NULL FROM f
UNION ALL SELECT ordinal, url || '/c', md5(url || '/c'), url || '/c', 'web', 'other', '', NULL, NULL, 'unknown', '', NULL, NULL, ordinal / 4.0::DOUBLE, NULL FROM f""")
def harvested_records(spark, sf):
    """Whole records found in lists and objects under any of nine container names, four levels deep, each document parsed once."""
    rows = sources(spark, sf).select("ordinal", _nested().alias("raw"))
    out = variants.typed(variants.normalized(variants.harvested(rows, "ordinal"), "ordinal"), va.PLATFORMS)
    return out.select("ordinal", "source_id", F.md5("title").alias("title_md5"), "url", "platform", "source_type", "abstract", "year", "citation_count", "difficulty", F.array_join("authors", ";").alias("authors"), "has_code", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "score", F.col("metadata")["n"].alias("n"))


@query("year_and_doi_pickers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2001 WHEN 1 THEN 2002 WHEN 2 THEN 2003 END AS year, CASE doc_id % 3 WHEN 0 THEN '10.1/' || doc_id WHEN 1 THEN 'issn' || doc_id ELSE '' END AS doi FROM documents")
def year_and_doi_pickers(spark, sf):
    """The first year that a record's date parts give, and the first identifier that has a value."""
    k, d = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    dates = F.when(k == 0, '{"published-print": {"date-parts": [[2001, 5]]}, "issued": {"date-parts": [[1990]]}}').when(k == 1, '{"published-online": {"date-parts": [[2002]]}}').when(k == 2, '{"created": {"date-parts": []}, "issued": {"date-parts": [[2003]]}}').otherwise('{"issued": {"date-parts": [[null]]}}')
    j = F.col("doc_id") % 3
    ids = F.when(j == 0, F.concat(F.lit('[{"type": "doi", "id": "10.1/'), d, F.lit('"}, {"type": "issn", "id": "x"}]'))).when(j == 1, F.concat(F.lit('[{"type": "doi", "id": ""}, {"type": "issn", "id": "issn'), d, F.lit('"}]'))).otherwise("[]")
    return table(spark, sf, "documents").select("doc_id", readers.year_of_parts(dates).alias("year"), readers.first_identifier(ids).alias("doi"))


OPERATIONS = ("search_chunks", "hybrid_search", "search", "keyword_search", "", "")
STRATEGIES = ("hybrid_v2", "hybrid_all_runs", "empty_store", "conversation_memory", "no_match", "engine_error", "other_way")


@query("retrieval_paths", f"WITH e AS (SELECT event_id, {pick(OPERATIONS, 'event_id % 6')} AS op, {pick(STRATEGIES, 'event_id % 7')} AS st, event_id % 5 AS tokens, event_id % 4 AS gate, event_id % 2 = 0 AS chunks FROM events) SELECT event_id, CASE WHEN op = 'search_chunks' THEN 'chunk' WHEN op = 'hybrid_search' THEN CASE WHEN NOT chunks AND gate > 0 AND tokens < gate THEN 'parent_gate_skipped' ELSE 'parent' END WHEN op = 'search' THEN 'embedding' WHEN op = 'keyword_search' THEN 'keyword' WHEN st = 'hybrid_v2' THEN 'chunk_or_parent' WHEN st = 'hybrid_all_runs' THEN 'all_runs' WHEN st = 'conversation_memory' THEN 'conversation' ELSE st END AS path FROM e")
def retrieval_paths(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", un.retrieval_path(F.expr(pick(OPERATIONS, "event_id % 6")), F.expr(pick(STRATEGIES, "event_id % 7")), k % 5, k % 4, k % 2 == 0).alias("path"))


LEVEL_TEXTS = ("beginner", "", "beginner to advanced", "mixed")


@query("level_priorities", f"WITH {QS}, {PROFILE}, l AS (SELECT *, {pick(LEVEL_TEXTS, 'item_id % 4')} AS level FROM pr), p AS (SELECT item_id, CASE WHEN lo >= 1 AND hi >= 1 THEN 'beginner,intermediate,advanced' WHEN hi >= 1 AND lo < hi THEN 'advanced' WHEN lo >= 1 AND hi < lo THEN 'beginner' WHEN level IN ('beginner', 'mixed') THEN level WHEN level = 'beginner to advanced' THEN 'beginner,intermediate,advanced' ELSE 'mixed' END AS levels FROM l) SELECT item_id, levels, CASE WHEN starts_with(levels, 'mixed') THEN 'mixed' ELSE string_split(levels, ',')[1] END AS learner FROM p")
def level_priorities(spark, sf):
    """Levels in the order in which they are served, and the learner's."""
    rows = questions(spark, sf).withColumn("level", F.expr(pick(LEVEL_TEXTS, "item_id % 4")))
    rows = rows.withColumn("levels", un.level_priority(F.round(un.level_score(F.col("q"), "beginner"), 6), F.round(un.level_score(F.col("q"), "advanced"), 6), F.col("level")))
    return rows.select("item_id", F.array_join("levels", ",").alias("levels"), F.col("levels")[0].alias("learner"))


_n = lambda marks: "(" + " + ".join(f"contains(lower(q), '{m}')::INTEGER" for m in marks) + ")"


@query("request_kinds", f"WITH {AQ}, n AS (SELECT item_id, q, {_n(fx.BEGINNER_MARKERS)} AS lo, {_n(fx.ADVANCED_MARKERS)} AS hi FROM aq) SELECT item_id, CASE WHEN lo > 0 AND hi > 0 THEN 'mixed' WHEN lo > hi THEN 'beginner' WHEN hi > lo THEN 'advanced' ELSE 'neutral' END AS kind FROM n")
def request_kinds(spark, sf):
    return asked(spark, sf).select("item_id", un.request_kind(F.lower("q")).alias("kind"))


PHRASES = ("machine learning", "vector of the")
NEGATIVE = ("tutorial", "survey", "basics")


@query("off_topic", f"WITH {SOURCES}, t AS (SELECT source_id, lower(title || ' ' || coalesce(summary, '') || ' ' || abstract) AS t FROM src) SELECT source_id, (NOT (contains(t, '{PHRASES[0]}') OR contains(t, '{PHRASES[1]}')) AND contains(t, 'machine')::INTEGER + contains(t, 'vector')::INTEGER < 1) OR contains(t, 'tutorial')::INTEGER + contains(t, 'survey')::INTEGER + contains(t, 'basics')::INTEGER >= 2 AS off_topic FROM t")
def off_topic(spark, sf):
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), "abstract"))
    return sources(spark, sf).select("source_id", un.is_off_topic(text, list(PHRASES), list(NEGATIVE)).alias("off_topic"))


@query("entry_filter", f"WITH {ENTRIES} SELECT category, model, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM en WHERE category IN ('view', 'error') AND model <> '' AND success GROUP BY ALL")
def entry_filter(spark, sf):
    """Ledger entries of some categories that went well."""
    rows = entries(spark, sf).where(F.col("category").isin("view", "error") & (F.col("model") != "") & F.col("success"))
    return rows.groupBy("category", "model").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))


@query("access_counts", "SELECT event_id % 500 AS entry, count(*) AS reads, max(ts) AS last_read FROM events WHERE event_type = 'view' GROUP BY 1")
def access_counts(spark, sf):
    """Reads are appended as events and counted when asked for; no counter is bumped."""
    seen = table(spark, sf, "events").where("event_type = 'view'")
    return seen.groupBy((F.col("event_id") % 500).alias("entry")).agg(F.count("*").alias("reads"), F.max("ts").alias("last_read"))


@query("conversation_export", "SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || length(text), ',' ORDER BY turn, role, length(text))) AS digest FROM conversations GROUP BY 1")
def conversation_export(spark, sf):
    """Conversations as JSON documents, one row each, read back from their JSON."""
    docs = readers.conversation_documents(table(spark, sf, "conversations"))
    back = docs.select("conv_id", F.explode(F.from_json("document", "struct<turns: array<struct<turn: bigint, role: string, text: string>>>")["turns"]).alias("t")).select("conv_id", "t.*")
    line = F.struct("turn", "role", F.length("text").alias("n"), F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("l"))
    return back.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), ",")).alias("digest"))


@query("fallback_summaries", f"WITH {SOURCES} SELECT source_id, left(title, 80) AS title, 'Source from ' || platform AS why FROM src ORDER BY ordinal LIMIT 20")
def fallback_summaries(spark, sf):
    """What stands in for summaries when none were made: the first twenty records (the feature's own limit)."""
    return sources(spark, sf).orderBy("ordinal").limit(20).select("source_id", F.left("title", F.lit(80)).alias("title"), F.concat(F.lit("Source from "), "platform").alias("why"))


USABLE = "p AS (SELECT n_nationkey AS platform, n_nationkey % 3 AS level, n_nationkey % 8 <> 7 AS enabled, n_nationkey % 5 = 0 AS needs_key, n_nationkey % 10 = 0 AS has_key, n_nationkey % 6 = 5 AS cooling FROM nation), u AS (SELECT *, enabled AND (NOT needs_key OR has_key) AND NOT cooling AS usable FROM p)"


@query("platform_usability", f"WITH {USABLE} SELECT platform, usable FROM u")
def platform_usability(spark, sf):
    """Platforms that are enabled, have the key that they need, and aren't cooling down."""
    return _usable(spark, sf).select("platform", "usable")


def _usable(spark, sf):
    k = F.col("n_nationkey")
    usable = (k % 8 != 7) & ((k % 5 != 0) | (k % 10 == 0)) & (k % 6 != 5)
    return table(spark, sf, "nation").select(k.alias("platform"), (k % 3).alias("level"), usable.alias("usable"))


@query("query_routing", f"WITH {USABLE}, q AS (SELECT item_id AS query_id, item_id % 3 AS profile FROM benchmark), c AS (SELECT query_id, platform, profile, CASE WHEN level = profile THEN 0 WHEN level = 0 THEN 1 ELSE 2 END AS prio FROM q, u WHERE usable), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, platform) AS k, count(*) FILTER (prio < 2) OVER (PARTITION BY query_id) AS fitting FROM c) SELECT query_id, platform, prio FROM k WHERE k <= 6 AND (prio < 2 OR k <= greatest(2, fitting))")
def query_routing(spark, sf):
    """Queries meet the usable platforms of the dimension (fixed size): those of their profile, then neutral ones, six at most; others only
    to make up two."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("profile"))
    return un.routed(q, _usable(spark, sf).where("usable"), 6, 2).select("query_id", "platform", "prio")
