"""Queries over texts as questions, over paths, and of functions without SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as fx, fuzzy as fz, text as tx
from ..operators import path as pt, records as rc, relevance as rel, understanding as un
from ..sources import store
from .records import SCORED, _scored
from .registry import query
from .views import SOURCES, sources, table

CLUSTER_LIKENESS = 0.75
TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
MEAN = "(CASE WHEN len(list_filter({0}, lambda t: t NOT IN (" + STOP + "))) > 0 THEN list_filter({0}, lambda t: t NOT IN (" + STOP + ")) ELSE {0} END)"


def questions(spark, sf):
    """Benchmark items in the wording of six kinds of questions."""
    text = F.lit(None).cast("string")
    for i, f in enumerate(FILLERS):
        before, after = f.split("{}")
        text = F.when(F.col("item_id") % 6 == i, F.concat(F.lit(before), "text", F.lit(after))).otherwise(text)
    return table(spark, sf, "benchmark").select("item_id", F.lower(text).alias("q"))


FILLERS = ("how to learn {}", "an introduction to {} from scratch", "advanced theory of {}", "compare {} versus that", "please build a {}", "{}")
QS = "qs AS (SELECT item_id, lower(CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '{f.split('{}')[0]}' || text || '{f.split('{}')[1]}'" for i, f in enumerate(FILLERS)) + " END) AS q FROM benchmark)"
_has = lambda marks: "(" + " OR ".join(f"contains(q, '{m}')" for m in marks) + ")"


@query("question_intent", f"WITH {QS} SELECT item_id, CASE {' '.join(f'''WHEN {_has(m)} THEN '{n}' ''' for n, m in fx.INTENTS.items())} ELSE 'explore' END AS intent FROM qs")
def question_intent(spark, sf):
    return questions(spark, sf).select("item_id", un.intent(F.col("q")).alias("intent"))


_lev = {k: "round(" + " + ".join(f"CASE WHEN contains(q, '{m}') THEN {fx.SIGNAL_WEIGHTS[w]} ELSE 0 END::DOUBLE" for w, v in groups.items() for m in v) + ", 6)" for k, groups in un.LEVELS.items()}
PROFILE = f"lp AS (SELECT item_id, q, {_lev['beginner']} AS lo, {_lev['advanced']} AS hi FROM qs), pr AS (SELECT *, CASE WHEN hi >= 1 AND lo < hi THEN 'advanced' WHEN lo >= 1 AND hi < lo THEN 'beginner' WHEN hi >= 1 AND lo >= 1 THEN 'mixed' WHEN lo > hi * 1.2 AND lo > 0 THEN 'beginner' WHEN hi > lo * 1.2 AND hi > 0 THEN 'advanced' ELSE 'balanced' END AS profile FROM lp)"


@query("level_profile", f"WITH {QS}, {PROFILE} SELECT item_id, round(lo, 4) AS lo, round(hi, 4) AS hi, profile FROM pr")
def level_profile(spark, sf):
    q = F.col("q")
    return questions(spark, sf).select("item_id", F.round(un.level_score(q, "beginner"), 4).alias("lo"), F.round(un.level_score(q, "advanced"), 4).alias("hi"), un.level_profile(q).alias("profile"))


CONCEPT = MEAN.format(TOK.format("regexp_replace(q, '^(please |can you |tell me about |what is |how to )+', '')")) + "[1:6]"


def _templates(profile: str) -> str:
    return "[" + ", ".join(f"'{t.split('{}')[0]}' || c || '{t.split('{}')[1]}'" for t in un.TEMPLATES[profile]) + "]"


@query("query_expansion", f"WITH {QS}, {PROFILE}, cc AS (SELECT item_id, profile, array_to_string({CONCEPT}, ' ') AS c FROM pr), e AS (SELECT item_id, list_concat([c], CASE profile {' '.join(f'''WHEN '{p}' THEN {_templates(p)}''' for p in un.TEMPLATES)} END) AS l FROM cc) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:5], '|') AS queries FROM e")
def query_expansion(spark, sf):
    rows = questions(spark, sf).select("item_id", un.level_profile(F.col("q")).alias("profile"), F.array_join(un.concept(F.col("q")), " ").alias("c"))
    return rows.select("item_id", F.array_join(un.expanded(F.col("c"), F.col("profile")), "|").alias("queries"))


@query("specificity_and_strength", f"WITH {QS}, t AS (SELECT item_id, q, {CONCEPT} AS t FROM qs) SELECT item_id, round(least(0.55, 0.15 * len(t))::DOUBLE + least(0.25, greatest(0, (list_sum(list_transform(t, lambda x: length(x)))::DOUBLE / greatest(1, len(t)) - 4) * 0.08::DOUBLE)) + 0.15::DOUBLE, 6) AS specificity, round(0.7::DOUBLE * least(1, len(t) / 3.0::DOUBLE) + 0.3::DOUBLE * least(1, length(q) / 20.0::DOUBLE), 6) AS strength FROM t")
def specificity_and_strength(spark, sf):
    rows = questions(spark, sf).withColumn("t", un.concept(F.col("q")))
    return rows.select("item_id", F.round(un.specificity(F.col("t")), 6).alias("specificity"), F.round(un.topic_strength(F.size("t"), F.length("q")), 6).alias("strength"))


@query("chunk_gate", f"WITH {QS} SELECT item_id, len({MEAN.format(TOK.format('q'))}) >= greatest(2, least(20, 3 - (len(list_intersect({TOK.format('q')}, {list(fx.INTERROGATIVES)!r})) > 0)::INTEGER)) AS chunks FROM qs")
def chunk_gate(spark, sf):
    return questions(spark, sf).select("item_id", un.chunk_gate(F.col("q")).alias("chunks"))


@query("token_stems", f"WITH x AS (SELECT DISTINCT unnest({TOK.format('text')}) AS token FROM documents), r AS (SELECT token, CASE WHEN length(token) <= 6 THEN token ELSE CASE WHEN ends_with(token, 'ing') THEN left(token, length(token) - 3) ELSE token END END AS t FROM x) SELECT token, CASE WHEN length(token) <= 6 THEN token WHEN ends_with(t, 'ies') AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN ends_with(t, 'es') THEN left(t, length(t) - 2) WHEN ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END AS reduced, CASE WHEN length(token) < 4 THEN token {' '.join(f'''WHEN ends_with(token, '{s}') AND length(token) >= {len(s) + 3} THEN left(token, length(token) - {len(s)})''' for s in tx.STEM_SUFFIXES)} ELSE token END AS stem FROM r")
def token_stems(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).distinct()
    return t.select("token", tx.reduced(F.col("token")).alias("reduced"), tx.stem(F.col("token")).alias("stem"))


@query("ngram_phrases", f"WITH w AS (SELECT item_id, {MEAN.format(TOK.format('text'))} AS w FROM benchmark) SELECT item_id, array_to_string(list_concat({', '.join(f'''CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) ELSE [] END''' for n in (4, 3, 2))})[1:12], '|') AS phrases FROM w")
def ngram_phrases(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", tx.meaningful(tx.tokens(F.col("text"))).alias("w"))
    return w.select("item_id", F.array_join(tx.phrases(F.col("w")), "|").alias("phrases"))


@query("text_gates", f"WITH {SOURCES}, t AS (SELECT source_id, title, abstract, list_filter({TOK.format('abstract')}, lambda x: length(x) >= 3 AND x NOT IN ({STOP})) AS k FROM src) SELECT source_id, CASE {' + '.join(f'''contains(lower(abstract), '{m}')::INTEGER''' for m in fx.CREDIBILITY_MARKERS)} WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.35 END::DOUBLE AS credibility, {' OR '.join([f'''contains(lower(title), '{m}')''' for m in fx.JUNK_TITLE_PARTS] + [f'''ends_with(lower(title), '{m}')''' for m in fx.JUNK_TITLE_SUFFIXES])} AS junk, len(k) >= 3 AND len(list_filter(k, lambda x: length(x) > 5)) = 0 AS incoherent, contains(lower(title), 'the') OR contains(lower(left(abstract, 400)), 'the') OR contains(lower(title), 'para') OR contains(lower(left(abstract, 400)), 'para') AS present, len(regexp_extract_all(abstract, '[^\\x00-\\x7f]')) > 0.1::DOUBLE * length(abstract) AS off_language FROM t")
def text_gates(spark, sf):
    a, t = F.col("abstract"), F.col("title")
    return sources(spark, sf).select("source_id", un.credibility_penalty(F.lower(a)).alias("credibility"), un.is_junk_title(t).alias("junk"), un.is_incoherent(a).alias("incoherent"), un.concept_present(["the", "para"], t, a).alias("present"), un.off_language(a).alias("off_language"))


_rq = ["the", "der", "les"]
HEADTEXT = "regexp_extract(text, '(?s)^([^.!?]*[.!?]?[^.!?]*[.!?]?)', 1)"
_inq = f"lambda x: x IN ({', '.join(map(repr, _rq))})"


@query("relevance_vector", f"WITH t AS (SELECT doc_id, text, {TOK.format('text')} AS t, {TOK.format(HEADTEXT)} AS h FROM documents), d AS (SELECT *, 100.0::DOUBLE * len(list_filter(t, {_inq})) / greatest(1, len(t)) AS d FROM t) SELECT doc_id, round(CASE WHEN instr(text, 'of the') > 0 THEN 1 - 0.3::DOUBLE * (instr(text, 'of the') - 1) / greatest(1, length(text)) ELSE 0 END::DOUBLE, 6) AS position, round(d / (d + 3), 6) AS density, round(CASE WHEN len(list_filter(t, {_inq})) = 0 THEN 0 ELSE least(1, len(list_filter(h, {_inq}))::DOUBLE / len(list_filter(t, {_inq}))) END::DOUBLE, 6) AS head FROM d")
def relevance_vector(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(un.phrase_position(t, "of the"), 6).alias("position"), F.round(un.token_density(tx.tokens(t), _rq), 6).alias("density"), F.round(un.head_share(t, _rq), 6).alias("head"))


@query("reading_and_reason", f"WITH {SOURCES} SELECT source_id, (CASE source_type WHEN 'research_paper' THEN 45 WHEN 'book' THEN 120 WHEN 'course' THEN 90 WHEN 'video' THEN 30 ELSE 20 END + CASE WHEN len(regexp_extract_all(abstract, '[^ \\t\\r\\n]+')) > 300 THEN 15 ELSE 0 END)::INTEGER AS minutes, concat_ws('; ', CASE WHEN citation_count > 500 THEN 'well cited' END, CASE WHEN has_code THEN 'has code' END, CASE WHEN year >= 2020 THEN 'recent' END) AS reason, CASE WHEN length(abstract) < 1024 THEN length(abstract)::VARCHAR || ' B' ELSE round(length(abstract) / 1024.0::DOUBLE, 1)::VARCHAR || ' KB' END AS size_label, round(CASE WHEN stars IS NULL THEN NULL WHEN stars <= 1 THEN stars WHEN stars <= 100 THEN stars / 100.0::DOUBLE ELSE 1 END::DOUBLE, 6) AS unit FROM src")
def reading_and_reason(spark, sf):
    reason = un.selection_reason((F.col("citation_count") > 500, "well cited"), (F.col("has_code"), "has code"), (F.col("year") >= 2020, "recent"))
    unit = F.when(F.col("stars").isNotNull(), un.unit_interval(F.col("stars")))
    return sources(spark, sf).select("source_id", un.reading_minutes(F.col("source_type"), tx.word_count(F.col("abstract"))).alias("minutes"), reason.alias("reason"), un.size_label(F.length("abstract")).alias("size_label"), F.round(unit, 6).alias("unit"))


@query("reflection_decision", "SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'accept' WHEN value / 100 >= 0.6 AND user_id % 10 / 10.0 < 0.8 THEN 'refine' WHEN value / 100 >= 0.4 AND event_id % 4 < 2 THEN 'retry' ELSE 'abort' END AS decision FROM events")
def reflection_decision(spark, sf):
    return table(spark, sf, "events").select("event_id", un.decision(F.col("value") / 100, F.col("user_id") % 10 / 10.0, F.col("event_id") % 4).alias("decision"))


@query("run_outcomes", "SELECT user_id, CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) = 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'purchase') = 0 OR count(*) FILTER (event_type = 'error') > 12 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY 1")
def run_outcomes(spark, sf):
    e = F.col("event_type")
    a = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(e.isin("view", "click")).alias("s"), F.count_if(e == "purchase").alias("r"), F.count_if(e == "error").alias("x"))
    return a.select("user_id", un.run_status(F.col("s"), F.col("r"), F.greatest(F.lit(0), F.col("x") - 12)).alias("status"))


HARD = "CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE CASE WHEN source_type = 'research_paper' THEN 2 ELSE 1 END END"
PATH = f"""{SCORED}, sr AS (SELECT * FROM s UNION ALL SELECT * REPLACE (concat('r', cast((ordinal + 3) % 7 AS VARCHAR)) AS run_id) FROM s WHERE ordinal % 3 = 0), r AS (SELECT run_id, source_id, source_type, {HARD} AS h, difficulty = 'beginner' AS e, difficulty = 'intermediate' AS m, source_type IN ('repository', 'model', 'dataset') OR coalesce(has_code, false) AS p, difficulty = 'advanced' AS a, row_number() OVER (PARTITION BY run_id ORDER BY relevance DESC, ordinal) AS k FROM sr),
f AS (SELECT run_id, bool_or(e) AS he, bool_or(m) AS hm, bool_or(p) AS hp, bool_or(a) AS ha FROM r GROUP BY 1), rf AS (SELECT * FROM r JOIN f USING (run_id)),
s1 AS (SELECT run_id, 1 AS category, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN he THEN 0 ELSE h END, k) AS place, source_id, h FROM rf WHERE e OR NOT he QUALIFY place <= 4),
s2 AS (SELECT * FROM s1 UNION ALL SELECT run_id, 2, row_number() OVER (PARTITION BY run_id ORDER BY k) AS place, source_id, h FROM rf WHERE (m OR (NOT hm AND h <= 1)) AND (run_id, source_id) NOT IN (SELECT (run_id, source_id) FROM s1) QUALIFY place <= 4),
s3 AS (SELECT * FROM s2 UNION ALL SELECT run_id, 3, row_number() OVER (PARTITION BY run_id ORDER BY k) AS place, source_id, h FROM rf WHERE (p OR (NOT hp AND source_type = 'documentation')) AND (run_id, source_id) NOT IN (SELECT (run_id, source_id) FROM s2) QUALIFY place <= 4),
s4 AS (SELECT * FROM s3 UNION ALL SELECT run_id, 4, row_number() OVER (PARTITION BY run_id ORDER BY k) AS place, source_id, h FROM rf WHERE (a OR (NOT ha AND h >= 1)) AND (run_id, source_id) NOT IN (SELECT (run_id, source_id) FROM s3) QUALIFY place <= 4),
n4 AS (SELECT run_id, count(DISTINCT category) AS n FROM s4 GROUP BY 1),
s5 AS (SELECT * FROM s4 UNION ALL SELECT run_id, 4 + ceil(g / 4.0)::INTEGER, (g - 1) % 4 + 1, source_id, h FROM (SELECT rf.run_id, source_id, h, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY rf.run_id ORDER BY k) AS g FROM rf LEFT JOIN n4 ON n4.run_id = rf.run_id WHERE (rf.run_id, source_id) NOT IN (SELECT (run_id, source_id) FROM s4)) WHERE g <= 4 * greatest(0, 3 - n)),
path AS (SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY category) AS step, ['Foundations and Basics', 'Core Concepts', 'Applied Practice', 'Advanced Research', 'Deepen Understanding'][least(category, 5)] AS title, place, source_id, h AS hardness FROM s5 QUALIFY step <= 6)"""
_band = "CASE path.title WHEN 'Foundations and Basics' THEN 0 WHEN 'Advanced Research' THEN 2 ELSE 1 END"
_objective = "CASE path.title " + " ".join(f"WHEN '{t}' THEN '{o}'" for t, o in pt.STEPS) + " END || CASE WHEN step = 1 THEN ' Level: beginner.' ELSE '' END"


def _ranked(spark, sf):
    """Records ranked in their run, a third of them in another run too; scored once and written, without their texts."""
    rows = store.written(_scored(spark, sf).drop("abstract"), "ranked").withColumn("score", F.col("relevance"))
    again = rows.where("ordinal % 3 = 0").withColumn("run_id", F.concat(F.lit("r"), ((F.col("ordinal") + 3) % 7).cast("string")))
    return rows.unionByName(again)


def _path(spark, sf):
    return pt.greedy(_ranked(spark, sf))


@query("path_steps", f"WITH {PATH} SELECT run_id, step, title, place, source_id, hardness FROM path")
def path_steps(spark, sf):
    return _path(spark, sf)


@query("path_aligned", f"WITH {PATH}, m AS (SELECT run_id, step, avg(hardness) AS mean, {_band} AS band FROM path GROUP BY run_id, step, title), o AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY band, mean, step) AS new FROM m) SELECT path.run_id AS run_id, new AS step, title, row_number() OVER (PARTITION BY path.run_id, path.step ORDER BY hardness, place) AS place, source_id, hardness FROM path JOIN o ON o.run_id = path.run_id AND o.step = path.step")
def path_aligned(spark, sf):
    return pt.aligned(_path(spark, sf))


@query("path_resources", f"WITH {PATH} SELECT path.source_id AS source_id, path.run_id AS run_id, step, md5(src.title) AS title_md5, src.platform AS platform, abs(hardness - {_band}) <= 1 AS fits, {_objective} AS objective FROM path JOIN src ON src.source_id = path.source_id")
def path_resources(spark, sf):
    path = pt.out_of_band(_path(spark, sf)).withColumn("objective", pt.annotated(F.col("title"), F.col("step"), "beginner")).drop("title")
    return pt.with_sources(path, sources(spark, sf).select("source_id", "title", "platform")).select("source_id", "run_id", "step", F.md5("title").alias("title_md5"), "platform", "fits", "objective")


_titles = ("Foundations and Basics", "Core Concepts", "Applied Practice", "Advanced Research", "Deepen Understanding", "")
_case_titles = "CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_titles)) + " END"
_fits = """CASE b WHEN 'advanced' THEN difficulty IN ('intermediate', 'advanced') OR source_type = 'research_paper' WHEN 'beginner' THEN difficulty IN ('intermediate', 'beginner') OR platform IN ('wikipedia', 'openstax') OR source_type IN ('documentation', 'course', 'book', 'video')
 ELSE difficulty = 'intermediate' OR source_type IN ('documentation', 'course', 'book') OR platform IN ('wikipedia', 'openstax') END"""
PLANNED = f"""{SCORED}, sr AS (SELECT * FROM s UNION ALL SELECT * REPLACE (concat('r', cast((ordinal + 3) % 7 AS VARCHAR)) AS run_id) FROM s WHERE ordinal % 3 = 0),
u AS (SELECT 'r' || item_id % 7 AS run_id, item_id, coalesce(nullif({_case_titles}, ''), 'An overview of item ' || item_id) AS title, unnest(range(4)) AS j FROM benchmark WHERE item_id % 9 <> 5),
v AS (SELECT run_id, item_id, title, j, 's' || (7 * ((item_id * 3 + j * 5) % 23) + CASE WHEN j = 3 THEN item_id % 5 ELSE item_id % 7 END) AS source_id FROM u),
f AS (SELECT run_id, source_id, min((item_id, j, title)) AS u FROM v GROUP BY ALL),
pl AS (SELECT f.run_id, dense_rank() OVER (PARTITION BY f.run_id ORDER BY u[1]) AS step, u[3] AS title, row_number() OVER (PARTITION BY f.run_id, u[1] ORDER BY u[2]) AS place, f.source_id AS source_id, relevance AS score FROM f JOIN sr ON sr.run_id = f.run_id AND sr.source_id = f.source_id),
wk AS (SELECT run_id, step, min((score, place, source_id, title)) AS w FROM pl GROUP BY ALL),
wb AS (SELECT run_id, step, w[3] AS source_id, CASE WHEN regexp_matches(lower(w[4]), 'advanced|research|expert|deep dive|in.depth') THEN 'advanced' WHEN regexp_matches(lower(w[4]), 'foundation|basic|intro|fundamentals|getting started|primer|overview') THEN 'beginner' WHEN regexp_matches(lower(w[4]), 'core|intermediate|applied|practice|synthesis|application|techniques|methods') THEN 'intermediate' END AS band FROM wk WHERE w[1] < 0.30),
ws AS (SELECT run_id, list({{'step': step, 'source_id': source_id, 'band': band}} ORDER BY step) AS steps FROM wb WHERE band IS NOT NULL GROUP BY run_id),
cd AS (SELECT run_id, list({{'id': source_id, 'fits': list_filter(['advanced', 'beginner', 'intermediate'], lambda b: {_fits})}} ORDER BY relevance DESC, ordinal) AS c FROM sr WHERE relevance >= 0.30 AND (run_id, source_id) NOT IN (SELECT (run_id, source_id) FROM pl) GROUP BY run_id),
go AS (SELECT ws.run_id, 1 AS i, steps, coalesce(c, []) AS c, CAST(NULL AS VARCHAR) AS taken, CAST(NULL AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS source_id FROM ws LEFT JOIN cd ON cd.run_id = ws.run_id
  UNION ALL SELECT run_id, i + 1, steps, list_filter(c, lambda x: x.id IS DISTINCT FROM t), t, steps[i].step, steps[i].source_id FROM (SELECT *, list_filter(c, lambda x: list_contains(x.fits, steps[i].band))[1].id AS t FROM go WHERE i <= len(steps))),
sw AS (SELECT run_id, step, source_id, taken FROM go WHERE taken IS NOT NULL)"""


@query("path_swaps", f"WITH RECURSIVE {PLANNED} SELECT pl.run_id AS run_id, pl.step AS step, title, place, coalesce(taken, pl.source_id) AS source_id, taken IS NOT NULL AS swapped FROM pl LEFT JOIN sw ON sw.run_id = pl.run_id AND sw.step = pl.step AND sw.source_id = pl.source_id")
def path_swaps(spark, sf):
    """Plans as a model writes them, one a run, read, and their weak resources replaced."""
    title = F.element_at(F.array(*map(F.lit, _titles)), (F.col("item_id") % len(_titles) + 1).cast("int"))
    ids = F.transform(F.array(*map(F.lit, range(4))), lambda j: F.concat(F.lit("s"), (7 * ((F.col("item_id") * 3 + j * 5) % 23) + F.when(j == 3, F.col("item_id") % 5).otherwise(F.col("item_id") % 7)).cast("string")))
    objective = F.when(F.col("item_id") % 9 != 5, F.concat(F.lit("An overview of item "), F.col("item_id").cast("string")))
    step = F.struct("item_id", F.when(objective.isNotNull(), title).alias("title"), objective.alias("objective"), ids.alias("resource_ids"))
    plans = table(spark, sf, "benchmark").groupBy(F.concat(F.lit("r"), (F.col("item_id") % 7).cast("string")).alias("run_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(step)).alias("steps"))).alias("plan"))
    ranked = _ranked(spark, sf).withColumn("confidence", F.lit(None).cast("double"))
    return pt.swapped(pt.planned(plans, ranked), ranked).drop("score")


@query("path_reorder", "WITH p AS (SELECT DISTINCT o_custkey % 50 AS run_id, o_orderkey % 5 AS step, CASE (o_orderkey % 5 + o_custkey % 3) % 4 WHEN 0 THEN 'Advanced topics' WHEN 1 THEN 'Getting started' WHEN 2 THEN 'An overview' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Deep dive' ELSE 'Middle part' END END AS title FROM orders), o AS (SELECT run_id, step, min(title) AS title FROM p GROUP BY ALL), b AS (SELECT *, CASE WHEN title IN ('Getting started', 'An overview') THEN 0 WHEN title IN ('Advanced topics', 'Deep dive') THEN 2 ELSE 1 END AS band, title <> 'Middle part' AS sign FROM o), l AS (SELECT *, coalesce(lag(band) OVER (PARTITION BY run_id ORDER BY step) > band, false) AS fell FROM b), g AS (SELECT run_id, bool_and(sign) AND bool_or(fell) AS mv FROM l GROUP BY 1) SELECT l.run_id AS run_id, step, row_number() OVER (PARTITION BY l.run_id ORDER BY CASE WHEN mv THEN band ELSE 0 END, step) AS place FROM l JOIN g ON g.run_id = l.run_id")
def path_reorder(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("run_id"), (F.col("o_orderkey") % 5).alias("step"), "o_custkey", "o_orderkey")
    k = (F.col("o_orderkey") % 5 + F.col("o_custkey") % 3) % 4
    title = F.when(k == 0, "Advanced topics").when(k == 1, "Getting started").when(k == 2, "An overview").otherwise(F.when(F.col("o_custkey") % 2 == 0, "Deep dive").otherwise("Middle part"))
    return pt.reordered(o.withColumn("title", title).groupBy("run_id", "step").agg(F.min("title").alias("title")))


@query("path_state", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cut' WHEN o_orderkey % 3 = 1 THEN 'padded' ELSE 'whole' END AS state FROM orders")
def path_state(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, '{"steps": [{"a": 1}').otherwise('{"steps": [{"a": 1}]}')
    reason = F.when(k == 1, "Selected to ensure the path has enough useful sources.").otherwise("Selected because it fits.")
    return table(spark, sf, "orders").select("o_orderkey", pt.padded_or_cut(reason, text).alias("state"))


@query("path_order_check", "WITH m AS (SELECT o_custkey % 50 AS run_id, (o_orderkey % 5) AS step, avg(o_totalprice / 100000) AS mean FROM orders GROUP BY ALL), d AS (SELECT *, coalesce(lag(mean) OVER (PARTITION BY run_id ORDER BY step) > mean + 0.25, false) AS fell FROM m) SELECT run_id, bool_or(fell) AS misordered, count(*) AS steps FROM d GROUP BY 1")
def path_order_check(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("run_id"), (F.col("o_orderkey") % 5).alias("step"), (F.col("o_totalprice") / 100000).alias("hardness"))
    return pt.misordered(rows)


@query("record_json_normalize", f"WITH {SOURCES}, j AS (SELECT source_id, CASE ordinal % 3 WHEN 0 THEN json_object('title', title, 'year', year::VARCHAR) WHEN 1 THEN json_object('name', title, 'publication_year', 'about ' || coalesce(year::VARCHAR, '?')) ELSE json_object('display_name', title) END AS raw FROM src) SELECT source_id, coalesce(json_extract_string(raw, '$.title'), json_extract_string(raw, '$.name'), json_extract_string(raw, '$.display_name')) AS title, try_cast(coalesce(json_extract_string(raw, '$.year'), nullif(regexp_extract(json_extract_string(raw, '$.publication_year'), '([0-9]{{4}})', 1), '')) AS INTEGER) AS year FROM j")
def record_json_normalize(spark, sf):
    """Records of unlike shape read by the first key that is there, with lenient numbers."""
    t, y = F.col("title"), F.col("year").cast("string")
    m = F.col("ordinal") % 3
    raw = F.when(m == 0, F.to_json(F.struct(t.alias("title"), y.alias("year")))).when(m == 1, F.to_json(F.struct(t.alias("name"), F.concat(F.lit("about "), F.coalesce(y, F.lit("?"))).alias("publication_year")))).otherwise(F.to_json(F.struct(t.alias("display_name"))))
    got = lambda k: F.get_json_object("raw", f"$.{k}")
    year = F.coalesce(got("year"), F.nullif(F.regexp_extract(got("publication_year"), "([0-9]{4})", 1), F.lit("")))
    return sources(spark, sf).select("source_id", raw.alias("raw")).select("source_id", F.coalesce(got("title"), got("name"), got("display_name")).alias("title"), year.try_cast("int").alias("year"))


# Functions that SQL can't express: tests hold them against plain Python.
@query("fuzzy_relevance")
def fuzzy_relevance(spark, sf):
    """Likeness of tokens in title and abstract, and a bonus for a phrase: 0.18 in the title, 0.12 elsewhere."""
    title, abstract = tx.clean(F.col("title")), tx.clean(F.col("abstract"))
    like = fz.overlap_of(["thing", "ention", "lichung"])(tx.tokens(title), tx.tokens(abstract))
    return sources(spark, sf).select("source_id", F.round(F.least(F.lit(1.0), like + un.phrase_bonus(["of the", "the thing"], F.lower(title), F.lower(abstract))), 6).alias("overlap"))


@query("fuzzy_titles_ratio")
def fuzzy_titles_ratio(spark, sf):
    """Pairs of titles by the matching-block ratio, in blocks of two equal first letters (blanks left out)."""
    return rc.fuzzy_titles_by_blocks(sources(spark, sf).select(F.col("ordinal").alias("id"), tx.normal_title(F.col("title")).alias("title")))


@query("normal_urls")
def normal_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", fz.udf_of("sl_url")("url").alias("url"), F.md5(fz.udf_of("sl_clean")("html")).alias("text_md5"))


@query("vector_blobs")
def vector_blobs(spark, sf):
    packed = table(spark, sf, "embeddings").withColumn("blob", fz.udf_of("sl_pack")("embedding"))
    back = packed.withColumn("again", fz.udf_of("sl_unpack")("blob"))
    return back.select("vec_id", F.octet_length("blob").alias("bytes"), (F.col("again") == F.col("embedding")).alias("same"), F.round(rel.cosine(F.col("embedding"), F.col("again")), 6).alias("cosine"))


@query("topic_clusters")
def topic_clusters(spark, sf):
    """Greedy clusters of a conversation's user turns: a turn joins the first cluster whose first turn's tokens are alike enough; turns
    without tokens are in none.  Conversations stream past in turn order, and only their clusters' first tokens are held."""
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)

    def run(frames):
        now, held = None, []
        for f in frames:
            out = []
            for conv, tokens in zip(f["conv_id"], f["t"], strict=True):
                if conv != now:
                    now, held = conv, []
                t = set(tokens)
                k = next((i for i, h in enumerate(held) if len(h & t) >= CLUSTER_LIKENESS * len(h | t)), len(held))
                held += [t] if k == len(held) else []
                out.append(k)
            yield f[["conv_id", "turn"]].assign(cluster=out)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(run, "conv_id long, turn long, cluster long")
