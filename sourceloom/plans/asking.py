"""Queries over questions and answers: what is asked, by which tool, in which form, and how far an answer can be trusted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx, text as tx
from ..operators import selection as sel, understanding as un, validation as va
from .records import CLEAN, SCORED, _scored
from .registry import query
from .views import SOURCES, sources, table

ASKED = (
    "What is machine learning, in detail please?", "Explain data structures step by step: a video course or a tutorial", "Which papers and journals study electrodynamics? Give the github code", "Tell me about \"graph neural nets\" briefly",
    "How do transformers work, everything about the model and datasets", "should i use NLP (Natural Language Processing) for docs", "List examples of ML books.", "please", "in one line, what did the sites and topics of 2020 say",
)
KINDS = ("definition", "enumeration", "comparison", "explanation", "mechanism", "decision", "overview", "timeline", "causation")
_case = lambda values: "CASE item_id % {} ".format(len(values)) + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
AQ = f"aq AS (SELECT item_id, {_case(ASKED)} AS q, {_case(KINDS)} AS kind FROM benchmark)"
_marks = lambda marks, text: "(" + " + ".join("contains({}, '{}')::INTEGER".format(text, m.replace("'", "''")) for m in marks) + ")"


def asked(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.expr(_case(ASKED)).alias("q"), F.expr(_case(KINDS)).alias("kind"))


_styles = {k: _marks(v, "lower(q)") for k, v in fx.ANSWER_STYLES.items()}


@query("question_style", f"WITH {AQ}, n AS (SELECT item_id, {', '.join(f'{v} AS {k}_' for k, v in _styles.items())} FROM aq) SELECT item_id, CASE WHEN greatest(short_, detailed_, exhaustive_) = 0 THEN 'standard' WHEN exhaustive_ = greatest(short_, detailed_, exhaustive_) THEN 'exhaustive' WHEN detailed_ = greatest(short_, detailed_, exhaustive_) THEN 'detailed' ELSE 'short' END AS style FROM n")
def question_style(spark, sf):
    return asked(spark, sf).select("item_id", un.answer_style(F.col("q")).alias("style"))


_leaders = " ".join(f"WHEN starts_with(lower(q), '{x}') THEN trim(substr(q, {len(x) + 1}))" for x in sorted(fx.QUESTION_LEADERS, key=len, reverse=True))
_noise = ", ".join(f"t{i + 1} AS (SELECT item_id, q, kind, CASE WHEN ends_with(lower(b), '{x}') THEN rtrim(left(b, -{len(x)})) ELSE b END AS b FROM t{i})" for i, x in enumerate(fx.TRAILING_NOISE))
_stop = ", ".join(f"'{w}'" for w in fx.STOPWORDS)
TOPIC = f"{AQ}, t0 AS (SELECT item_id, q, kind, CASE {_leaders} ELSE q END AS b FROM aq), {_noise}, tw AS (SELECT item_id, q, kind, list_filter(string_split(b, ' '), lambda w: w <> '') AS w FROM t{len(fx.TRAILING_NOISE)}), tk AS (SELECT *, list_filter(w, lambda x: lower(x) NOT IN ({_stop})) AS k FROM tw), tp AS (SELECT item_id, q, kind, coalesce(nullif(regexp_extract(q, '\"([^\"]{{2,80}})\"', 1), ''), array_to_string((CASE WHEN len(k) > 0 THEN k ELSE w END)[1:6], ' ')) AS topic FROM tk)"


@query("question_topic", f"WITH {TOPIC} SELECT item_id, topic FROM tp")
def question_topic(spark, sf):
    return asked(spark, sf).select("item_id", un.primary_topic(F.col("q")).alias("topic"))


_templates = "CASE kind " + " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join("'{}' || topic || '{}'".format(*t.split("{}")) for t in v)) for k, v in fx.SEARCH_TEMPLATES.items()) + " ELSE [] END"


@query("question_searches", f"WITH {TOPIC}, e AS (SELECT item_id, list_filter(list_concat([q], list_transform(regexp_extract_all(q, '[A-Z][A-Z0-9]{{1,7}} \\(([A-Za-z][A-Za-z0-9_ -]{{1,60}})\\)', 1), lambda x: lower(x)), CASE WHEN topic <> '' THEN list_concat([topic], {_templates}) ELSE [] END), lambda x: x <> '') AS l FROM tp) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:6], '|') AS searches FROM e")
def question_searches(spark, sf):
    """A question, the long forms that it gives for its abbreviations, its topic, and what its kind is searched by."""
    long_forms = F.transform(F.regexp_extract_all("q", F.lit(r"[A-Z][A-Z0-9]{1,7} \(([A-Za-z][A-Za-z0-9_ -]{1,60})\)"), 1), F.lower)
    rows = asked(spark, sf).withColumns({"topic": un.primary_topic(F.col("q")), "more": long_forms})
    return rows.select("item_id", F.array_join(un.search_queries(F.col("q"), F.col("topic"), F.col("kind"), F.col("more")), "|").alias("searches"))


_tools = {k: _marks(v, "lower(q)") for k, v in fx.TOOL_WORDS.items()}
_most = f"greatest({', '.join(_tools)})"


@query("tool_choice", f"WITH {AQ}, n AS (SELECT item_id, {', '.join(f'{v} AS {k}' for k, v in _tools.items())} FROM aq) SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 'search_explanation' WHEN {_most} = 0 THEN 'search_academic' {' '.join(f'''WHEN {k} = {_most} THEN '{k}' ''' for k in _tools)} END AS tool FROM n")
def tool_choice(spark, sf):
    level = F.when(F.col("item_id") % 11 == 0, "Beginner to advanced").otherwise("")
    return asked(spark, sf).select("item_id", un.search_tool(F.col("q"), level).alias("tool"))


_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_base = f"CASE item_id % 4 WHEN 0 THEN {_list(fx.LEVEL_FORMATS['beginner'])} WHEN 1 THEN {_list(fx.LEVEL_FORMATS['advanced'])} WHEN 2 THEN {_list(fx.LEVEL_FORMATS['intermediate'])} ELSE {_list(dict.fromkeys(x for v in fx.LEVEL_FORMATS.values() for x in v))} END"
_signals = "[" + ", ".join(f"CASE WHEN contains(lower(q), '{s}') THEN '{f}' END" for s, f in fx.FORMAT_SIGNALS) + "]"
_uniq = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("formats_wanted", f"WITH {AQ}, b AS (SELECT item_id, list_concat({_base}, CASE WHEN item_id % 3 = 0 THEN ['blog'] ELSE [] END) AS b, list_filter({_signals}, lambda x: x IS NOT NULL) AS s FROM aq), c AS (SELECT item_id, {_uniq.format('b')} AS b, {_uniq.format('s')} AS s FROM b) SELECT item_id, array_to_string(list_concat(list_reverse(list_filter(s, lambda x: NOT list_contains(b, x))), b)[1:6], ',') AS formats FROM c")
def formats_wanted(spark, sf):
    k = F.col("item_id") % 4
    of = lambda *names: F.array(*map(F.lit, names))
    levels = F.when(k == 0, of("beginner")).when(k == 1, of("advanced")).when(k == 2, of("intermediate")).otherwise(of("beginner", "advanced"))
    more = F.when(F.col("item_id") % 3 == 0, of("blog")).otherwise(F.array().cast("array<string>"))
    return asked(spark, sf).select("item_id", F.array_join(un.formats(F.col("q"), levels, more), ",").alias("formats"))


_filler = "lower(" + CLEAN.format("q") + ")"
for _pattern in fx.FILLERS:
    _filler = "regexp_replace({}, '{}', ' ', 'g')".format(_filler, _pattern.replace("'", "''"))


@query("without_fillers", f"WITH {AQ} SELECT item_id, trim(regexp_replace({_filler}, '\\s+', ' ', 'g')) AS topic FROM aq")
def without_fillers(spark, sf):
    """Questions without the wording around their topic."""
    out = F.lower(tx.clean(F.col("q")))
    for pattern in fx.FILLERS:
        out = F.regexp_replace(out, pattern, " ")
    return asked(spark, sf).select("item_id", F.trim(F.regexp_replace(out, r"\s+", " ")).alias("topic"))


@query("quoted_and_acronyms", f"WITH {AQ} SELECT item_id, array_to_string(regexp_extract_all(q, '\"([^\"]{{2,80}})\"', 1), '|') AS quoted, array_to_string(list_sort(list_distinct(regexp_extract_all(q, '\\b([A-Z][A-Z0-9]{{1,7}})\\b', 1))), '|') AS acronyms FROM aq")
def quoted_and_acronyms(spark, sf):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("q", F.lit(r"\b([A-Z][A-Z0-9]{1,7})\b"), 1)))
    return asked(spark, sf).select("item_id", F.array_join(F.regexp_extract_all("q", F.lit('"([^"]{2,80})"'), 1), "|").alias("quoted"), F.array_join(found, "|").alias("acronyms"))


@query("short_topics", f"WITH {SOURCES} SELECT source_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(trim(regexp_extract(title, '^([^:(]*)', 1)), ' +--? +.*$', '')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_stop}))[1:3], ' ') AS topic FROM src")
def short_topics(spark, sf):
    return sources(spark, sf).select("source_id", tx.short_topic(F.col("title")).alias("topic"))


ANSWER = "CASE turn % 4 WHEN 0 THEN 'I don`t have enough information. ' WHEN 1 THEN 'The provided passages do not contain this. ' ELSE '' END"


@query("refusals", f"WITH a AS (SELECT conv_id, turn, lower(replace({ANSWER}, '`', chr(39)) || text) AS t FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, {_marks(fx.REFUSALS, 't')} > 0 AS refusal FROM a")
def refusals(spark, sf):
    text = F.concat(F.replace(F.expr(ANSWER), F.lit("`"), F.lit("'")), F.col("text"))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", un.refuses(text).alias("refusal"))


REPLY = "left(text, 40 * (turn::INTEGER % 7)) || CASE turn % 3 WHEN 0 THEN ' 12 platforms and topics in 2020' WHEN 1 THEN ' titles of this run' ELSE '' END"
_dims = "list_filter([" + ", ".join(f"CASE WHEN {_marks(v, 'l')} > 0 THEN '{k}' END" for k, v in fx.CATALOG_WORDS.items()) + "], lambda x: x IS NOT NULL)"
_sub = "CASE WHEN length(trim(r)) >= 200 AND regexp_matches(r, '[0-9]') THEN 1.0 WHEN length(trim(r)) >= 120 AND regexp_matches(r, '[0-9]') THEN 0.85 WHEN length(trim(r)) >= 80 THEN 0.7 WHEN length(trim(r)) >= 40 THEN 0.5 WHEN length(trim(r)) > 0 THEN 0.3 ELSE 0 END::DOUBLE"


@query("catalog_trust", f"WITH r AS (SELECT conv_id, turn, {REPLY} AS r, turn % 2 = 0 AS m FROM conversations), d AS (SELECT *, lower(r) AS l FROM r), c AS (SELECT *, {_dims} AS dims, {_sub} AS sub FROM d), b AS (SELECT *, 0.3::DOUBLE * CASE WHEN m THEN 1.0 ELSE 0.55 END::DOUBLE + 0.25::DOUBLE * 0.6::DOUBLE + 0.15::DOUBLE * (6 / 7.0::DOUBLE) + 0.2::DOUBLE * sub + 0.1::DOUBLE * (len(dims) / 7.0::DOUBLE) AS b FROM c) SELECT conv_id, turn, array_to_string(dims, ',') AS dimensions, round(CASE WHEN trim(r) = '' THEN 0 WHEN m THEN b ELSE b * 0.85::DOUBLE END, 6) AS confidence FROM b")
def catalog_trust(spark, sf):
    reply = F.expr(REPLY.replace("turn::INTEGER", "cast(turn AS int)"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("r"))
    return rows.select("conv_id", "turn", F.array_join(un.cited_dimensions(F.col("r")), ",").alias("dimensions"), F.round(un.catalog_confidence(F.col("r"), F.lit(6 / 7.0), F.lit(0.6), F.col("turn") % 2 == 0), 6).alias("confidence"))


@query("answer_trust", "SELECT conv_id, turn, round(CASE WHEN length(text) = 0 THEN 0 ELSE least(1, 0.35::DOUBLE * (turn % 4) / 5 + 0.45::DOUBLE * CASE WHEN turn % 4 = 0 THEN 0 ELSE 0.5 + turn % 3 * 0.1 END::DOUBLE + 0.20::DOUBLE * least(1, length(text) / 600.0::DOUBLE)) END::DOUBLE, 6) AS confidence FROM conversations")
def answer_trust(spark, sf):
    turn = F.col("turn")
    mean = F.when(turn % 4 != 0, 0.5 + turn % 3 * 0.1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(un.answer_trust(turn % 4, F.lit(5), mean, F.length("text")), 6).alias("confidence"))


DIMENSIONS = {"platform": "platform", "source type": "source_type", "domain": "NULL", "year": "year"}


@query("catalog_escalation", f"WITH {SOURCES}, n AS (SELECT count(*) AS n, count(DISTINCT platform) > 0 AS p, count(DISTINCT source_type) > 0 AS s, count(year) > 0 AS y FROM src) SELECT 'The local corpus contains ' || n || ' documents. The corpus does not currently have information about domain. The corpus does contain information about platform, source type, year.' AS answer, round(least(0.5, 0.35 * (p::INTEGER + s::INTEGER + y::INTEGER + 1) / 7.0::DOUBLE + 0.25 * 0.6::DOUBLE), 4) AS confidence FROM n")
def catalog_escalation(spark, sf):
    """What is said when a dimension that is asked for is in no record, and how sure that is."""
    have = sources(spark, sf).agg(F.count("*").alias("n"), *[F.count(F.lit(None) if c == "NULL" else c).alias(f"_{i}") for i, c in enumerate(DIMENSIONS.values())])
    there = F.concat_ws(", ", *[F.when(F.col(f"_{i}") > 0, F.lit(name)) for i, name in enumerate(DIMENSIONS)])
    rich = (sum((F.col(f"_{i}") > 0).cast("int") for i in range(len(DIMENSIONS))) + 1) / 7.0
    text = F.concat(F.lit("The local corpus contains "), F.col("n").cast("string"), F.lit(" documents. The corpus does not currently have information about domain. The corpus does contain information about "), there, F.lit("."))
    return have.select(text.alias("answer"), F.round(un.escalation_confidence(rich, F.lit(0.6)), 4).alias("confidence"))


@query("record_summaries", f"WITH {SOURCES}, c AS (SELECT *, {CLEAN.format('abstract')} AS a FROM src) SELECT source_id, md5(CASE WHEN a <> '' THEN CASE WHEN length(a) <= 300 THEN a ELSE rtrim(left(a, 297)) || '...' END ELSE title || ' (' || source_type || ' resource).' END) AS summary_md5, 'A ' || source_type || ' from ' || platform || ' relevant to your learning goal.' AS why, (CASE source_type {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in un.MINUTES.items())} ELSE 30 END + CASE WHEN len(regexp_extract_all(a, '[^ \\t\\r\\n]+')) > 300 THEN 15 ELSE 0 END)::INTEGER AS minutes FROM c")
def record_summaries(spark, sf):
    kind = F.col("source_type")
    return sources(spark, sf).select("source_id", F.md5(un.summary_of(F.col("title"), F.col("abstract"), kind)).alias("summary_md5"), un.why_useful(kind, F.col("platform")).alias("why"), un.study_minutes(kind, F.col("abstract")).alias("minutes"))


VOCABULARY = ("the", "ther", "thing", "ention", "lichung", "entre")


@query("near_spellings", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark), v(other) AS (VALUES {', '.join(f'''('{x}')''' for x in VOCABULARY)}) SELECT name, other, levenshtein(name, other)::INTEGER AS d FROM w, v WHERE levenshtein(name, other) <= CASE WHEN length(name) <= 3 THEN 0 WHEN length(name) <= 5 THEN 1 WHEN length(name) <= 8 THEN 2 ELSE 3 END")
def near_spellings(spark, sf):
    """Words within a bounded edit distance of a vocabulary of fixed size, the bound growing with the word's length."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("name")).distinct()
    bound = F.when(F.length("name") <= 3, 0).when(F.length("name") <= 5, 1).when(F.length("name") <= 8, 2).otherwise(3)
    near = [F.struct(F.lit(v).alias("other"), F.levenshtein("name", F.lit(v), 3).alias("d")) for v in VOCABULARY]
    pairs = words.select("name", bound.alias("bound"), F.inline(F.array(*near)))
    return pairs.where((F.col("d") >= 0) & (F.col("d") <= F.col("bound"))).select("name", "other", "d")


KEYS = ("platform", "source_type", "difficulty", "year", "citation_count", "rank", "score", "confidence")


@query("metadata_merge", f"WITH {SOURCES}, m AS (SELECT source_id, map_concat(MAP {{'platform': 'raw', 'note': source_id, 'score': 'old'}}, MAP {{{', '.join(f'''{k!r}: {v}''' for k, v in zip(KEYS, ('platform', 'source_type', 'difficulty', 'year::VARCHAR', 'citation_count::VARCHAR', '(ordinal % 9)::VARCHAR', '(ordinal % 5)::VARCHAR', 'NULL'), strict=True))}}}) AS m FROM src) SELECT source_id, {', '.join(f'm[{k!r}] AS {k}_' for k in KEYS)}, m['note'] AS note, cardinality(m)::INTEGER AS n FROM m")
def metadata_merge(spark, sf):
    """Raw keys under the eight computed ones; a key that both have takes the computed value, also if that is null."""
    raw = F.create_map(F.lit("platform"), F.lit("raw"), F.lit("note"), F.col("source_id"), F.lit("score"), F.lit("old"))
    text = lambda c: c.cast("string")
    own = F.create_map(*[x for k, v in zip(KEYS, (F.col("platform"), F.col("source_type"), F.col("difficulty"), text(F.col("year")), text(F.col("citation_count")), text(F.col("ordinal") % 9), text(F.col("ordinal") % 5), F.lit(None).cast("string")), strict=True) for x in (F.lit(k), v)])
    m = F.map_concat(F.map_filter(raw, lambda k, _: ~k.isin(*KEYS)), own)
    return sources(spark, sf).select("source_id", m.alias("m")).select("source_id", *[F.col("m")[k].alias(f"{k}_") for k in KEYS], F.col("m")["note"].alias("note"), F.size("m").alias("n"))


@query("cited_passages", "WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all('[' || (doc_id % 7) || '] ' || text || ' and [3], [12], [1] [' || (doc_id % 4) || ']', '\\[([0-9]{1,2})\\]', 1), lambda x: x::INTEGER), lambda i: i BETWEEN 1 AND 5) AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM c")
def cited_passages(spark, sf):
    """The passages that a text cites, each once, in the order in which they are cited first."""
    text = F.concat(F.lit("["), (F.col("doc_id") % 7).cast("string"), F.lit("] "), "text", F.lit(" and [3], [12], [1] ["), (F.col("doc_id") % 4).cast("string"), F.lit("]"))
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,2})\]"), 1), lambda x: x.cast("int"))
    kept = F.array_distinct(F.filter(ids, lambda i: i.between(1, 5)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(kept, lambda i: i.cast("string")), ",").alias("cited"))


@query("not_attempted", f"WITH {SOURCES}, a AS (SELECT DISTINCT run_id, platform FROM src WHERE citation_count IS NOT NULL), p(platform) AS (VALUES {', '.join(f'''('{x}')''' for x in va.PLATFORMS)}) SELECT r.run_id AS run_id, p.platform AS platform FROM (SELECT DISTINCT run_id FROM src) r, p WHERE (r.run_id, p.platform) NOT IN (SELECT run_id, platform FROM a)")
def not_attempted(spark, sf):
    """A run's platforms that nothing was asked of yet: the dimension of platforms (fixed size) for each run, without those that were."""
    src = sources(spark, sf)
    tried = src.where("citation_count is not null").select("run_id", "platform").distinct()
    every = src.select("run_id").distinct().withColumn("platform", F.explode(F.array(*map(F.lit, va.PLATFORMS))))
    return every.join(tried, ["run_id", "platform"], "left_anti")


@query("quality_guards", f"WITH {SCORED} SELECT count(*) AS n, count(*) = 0 AS no_sources, count(*) FILTER (difficulty = 'beginner' OR source_type IN ('course', 'book', 'documentation', 'video') OR platform IN ('openstax', 'wikipedia')) = 0 AS no_beginner, count(*) FILTER (relevance >= 0.5) = 0 AS off_topic, count(*) FILTER (relevance >= 0.5) BETWEEN 1 AND greatest(1, floor(count(*) * 0.25)) - 1 AS low_relevance, 0.15 < 0.20 AS low_domain, false AS no_path FROM s")
def quality_guards(spark, sf):
    friendly = (F.col("difficulty") == "beginner") | F.col("source_type").isin("course", "book", "documentation", "video") | F.col("platform").isin("openstax", "wikipedia")
    return un.guards(_scored(spark, sf), friendly, F.col("relevance") >= 0.5, domain_confidence=0.15, has_path=True)


@query("record_checks", f"WITH {SOURCES} SELECT source_id, coalesce(year BETWEEN 0 AND 2100, false) AS year_ok, difficulty IN ('beginner', 'intermediate', 'advanced') AS level_ok, coalesce(citation_count >= 0, false) AS cited_ok, length(title) BETWEEN 3 AND 500 AS title_ok FROM src")
def record_checks(spark, sf):
    """Scalar checks as columns: ranges, closed sets and lengths."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return sources(spark, sf).select("source_id", ok(F.col("year").between(0, 2100)).alias("year_ok"), ok(F.col("difficulty").isin("beginner", "intermediate", "advanced")).alias("level_ok"), ok(F.col("citation_count") >= 0).alias("cited_ok"), ok(F.length("title").between(3, 500)).alias("title_ok"))


@query("level_split_select", f"""WITH {SOURCES}, a AS (SELECT * FROM src WHERE difficulty = 'beginner'), o AS (SELECT * FROM src WHERE difficulty <> 'beginner'),
pa AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ordinal) AS g FROM a), qa AS (SELECT greatest(1, 12 // count(DISTINCT platform)) AS quota FROM a), po AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ordinal) AS g FROM o), qo AS (SELECT greatest(1, 18 // count(DISTINCT platform)) AS quota FROM o),
t AS (SELECT source_id, 'beginner' AS pool FROM (SELECT source_id, row_number() OVER (ORDER BY g > quota, ordinal) AS k FROM pa, qa) WHERE k <= 12 UNION ALL SELECT source_id, 'other' FROM (SELECT source_id, row_number() OVER (ORDER BY g > quota, ordinal) AS k FROM po, qo) WHERE k <= 18),
f AS (SELECT source_id, 'filled' AS pool, row_number() OVER (ORDER BY ordinal) AS k FROM src WHERE source_id NOT IN (SELECT source_id FROM t)) SELECT * FROM t UNION ALL SELECT source_id, pool FROM f WHERE k <= 30 - (SELECT count(*) FROM t)""")
def level_split_select(spark, sf):
    """40 % of 30 from beginners' records, the rest from the others, each by quota; what a pool can't give comes from any."""
    return sel.split_by_level(sources(spark, sf), F.col("difficulty") == "beginner", 30, 0.4).select("source_id", "pool")


@query("level_split_filled", f"""WITH {SOURCES}, a AS (SELECT * FROM src WHERE difficulty = 'beginner' AND ordinal % 100 = 0), t AS (SELECT source_id, 'beginner' AS pool FROM (SELECT source_id, row_number() OVER (ORDER BY ordinal) AS k FROM a) WHERE k <= 12), o AS (SELECT * FROM src WHERE NOT (difficulty = 'beginner' AND ordinal % 100 = 0)),
po AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ordinal) AS g FROM o), qo AS (SELECT greatest(1, 18 // count(DISTINCT platform)) AS quota FROM o), u AS (SELECT * FROM t UNION ALL SELECT source_id, 'other' FROM (SELECT source_id, row_number() OVER (ORDER BY g > quota, ordinal) AS k FROM po, qo) WHERE k <= 18),
f AS (SELECT source_id, 'filled' AS pool, row_number() OVER (ORDER BY ordinal) AS k FROM src WHERE source_id NOT IN (SELECT source_id FROM u)) SELECT * FROM u UNION ALL SELECT source_id, pool FROM f WHERE k <= 30 - (SELECT count(*) FROM u)""")
def level_split_filled(spark, sf):
    """The same where beginners' records are too few."""
    few = (F.col("difficulty") == "beginner") & (F.col("ordinal") % 100 == 0)
    return sel.split_by_level(sources(spark, sf), few, 30, 0.4).select("source_id", "pool")

