"""Queries of the smaller operators: assembly of texts and maps, ordered unions, gates, evaluations, routing, parsing."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed as fx, fuzzy as fz, text as tx
from ..operators import index as ix, relevance as rel, selection as sel
from ..sources import store
from .analytics import ENTRIES, entries
from .records import NORMAL, SCORED, _scored
from .registry import query
from .understanding import MEAN, QS, TOK, questions
from .views import SOURCES, sources, table


@query("document_text", f"WITH {SOURCES} SELECT source_id, md5(concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), ''), url, platform, source_type, difficulty, year::VARCHAR, 'citations ' || citation_count)) AS text_md5 FROM src")
def document_text(spark, sf):
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = [filled(F.col("title")), filled(F.col("abstract")), "url", "platform", "source_type", "difficulty", F.col("year").cast("string"), F.concat(F.lit("citations "), F.col("citation_count").cast("string"))]
    return sources(spark, sf).select("source_id", F.md5(F.concat_ws(" ", *parts)).alias("text_md5"))


@query("passages", f"WITH {SOURCES} SELECT source_id, md5(CASE WHEN ordinal % 2 = 0 THEN left(abstract, 1200) ELSE left(abstract, 400) END) AS passage_md5, least(1200, length(abstract))::INTEGER AS most FROM src")
def passages(spark, sf):
    """The matched chunk if there is one, else the text's beginning."""
    matched = F.when(F.col("ordinal") % 2 == 0, F.left("abstract", F.lit(1200)))
    return sources(spark, sf).select("source_id", F.md5(F.coalesce(matched, F.left("abstract", F.lit(400)))).alias("passage_md5"), F.least(F.lit(1200), F.length("abstract")).alias("most"))


@query("extractive_answer", f"WITH {SCORED}, t AS (SELECT title, platform, row_number() OVER (ORDER BY relevance DESC, ordinal) AS k FROM s QUALIFY k <= 5) SELECT string_agg('[' || k || '] ' || title || ' (' || platform || ')', chr(10) ORDER BY k) AS answer FROM t")
def extractive_answer(spark, sf):
    top = rel.top_ranked(_scored(spark, sf), [F.desc("relevance"), F.asc("ordinal")], 5)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" ("), "platform", F.lit(")"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))


@query("ordered_union_distinct", f"WITH {SOURCES}, u AS (SELECT source_id, url, title, ordinal FROM src UNION ALL SELECT source_id || 'b', url, title, ordinal + 1000000000 FROM src) SELECT source_id FROM u QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(url, ''), title) ORDER BY ordinal) = 1")
def ordered_union_distinct(spark, sf):
    """First record of each url, or title where there is no url, over the lists in their order."""
    src = sources(spark, sf).select("source_id", "url", "title", "ordinal")
    both = src.unionByName(src.withColumn("source_id", F.concat("source_id", F.lit("b"))).withColumn("ordinal", F.col("ordinal") + 1_000_000_000))
    return both.groupBy(F.coalesce(F.nullif("url", F.lit("")), "title").alias("key")).agg(F.min_by("source_id", "ordinal").alias("source_id")).select("source_id")


@query("result_dedupe", f"WITH {SCORED} SELECT url, round(max(relevance), 6) AS relevance, min(ordinal) AS first_place FROM s GROUP BY url")
def result_dedupe(spark, sf):
    return _scored(spark, sf).groupBy("url").agg(F.round(F.max("relevance"), 6).alias("relevance"), F.min("ordinal").alias("first_place"))


@query("duplicate_report", f"WITH {SOURCES}, n AS (SELECT source_id, count(*) OVER (PARTITION BY url ORDER BY ordinal ROWS UNBOUNDED PRECEDING) > 1 AS seen_url, count(*) OVER (PARTITION BY {NORMAL.format('title')} ORDER BY ordinal ROWS UNBOUNDED PRECEDING) > 1 AS seen_title FROM src) SELECT source_id, seen_url, seen_title FROM n WHERE seen_url OR seen_title")
def duplicate_report(spark, sf):
    """Records whose url or title came before; the first of each is an aggregate joined back, so that a key that most records share is
    split by the join."""
    src = sources(spark, sf).select("source_id", "ordinal", "url", tx.normal_title(F.col("title")).alias("t"))
    first = lambda c: src.groupBy(c).agg(F.min("ordinal").alias(f"first_{c}")).hint("merge")
    both = src.join(first("url"), "url").join(first("t"), "t")
    return both.select("source_id", (F.col("ordinal") > F.col("first_url")).alias("seen_url"), (F.col("ordinal") > F.col("first_t")).alias("seen_title")).where("seen_url or seen_title")


@query("relevant_records", f"WITH {SOURCES} SELECT source_id, contains(lower(title), 'of the') OR contains(lower(abstract), 'of the') OR len(list_intersect(['thing', 'lichung', 'ention', 'entre'], {TOK.format('abstract')})) * 3 >= 4 AS relevant FROM src")
def relevant_records(spark, sf):
    toks = F.array(*map(F.lit, ("thing", "lichung", "ention", "entre")))
    hit = F.lower("title").contains("of the") | F.lower("abstract").contains("of the") | (F.size(F.array_intersect(toks, tx.tokens(F.col("abstract")))) * 3 >= 4)
    return sources(spark, sf).select("source_id", hit.alias("relevant"))


@query("two_key_summaries", f"WITH {SOURCES}, sm AS (SELECT source_id AS k, 'by id' AS s FROM src WHERE difficulty = 'beginner'), tm AS (SELECT title AS k, min('by title ' || source_id) AS s FROM src WHERE platform = 'openalex' GROUP BY 1) SELECT source_id, coalesce(sm.s, tm.s) AS summary FROM src LEFT JOIN sm ON sm.k = source_id LEFT JOIN tm ON tm.k = title")
def two_key_summaries(spark, sf):
    """Matched by id or by title: two equi-joins, not one join on an OR."""
    src = sources(spark, sf)
    by_id = src.where("difficulty = 'beginner'").select("source_id", F.lit("by id").alias("a"))
    by_title = src.where("platform = 'openalex'").groupBy("title").agg(F.min(F.concat(F.lit("by title "), "source_id")).alias("b"))
    return src.join(by_id, "source_id", "left").join(by_title, "title", "left").select("source_id", F.coalesce("a", "b").alias("summary"))


@query("acronym_long_forms", "WITH a AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+ [a-z]+ [a-z]+)[,.]', 1)) AS f FROM documents), k AS (SELECT upper(regexp_replace(regexp_replace(f, '([A-Za-z])[a-z]*', '\\1', 'g'), ' ', '', 'g')) AS acronym, f, count(*) AS n FROM a GROUP BY ALL) SELECT acronym, arg_max(f, {'n': n, 'f': f}) AS long_form, max(n) AS n FROM k GROUP BY 1")
def acronym_long_forms(spark, sf):
    f = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ [a-z]+ [a-z]+)[,.]"), 1)).alias("f"))
    letters = F.upper(F.regexp_replace(F.regexp_replace("f", "([A-Za-z])[a-z]*", "$1"), " ", ""))
    k = f.groupBy(letters.alias("acronym"), "f").agg(F.count("*").alias("n"))
    return k.groupBy("acronym").agg(F.max_by("f", F.struct("n", "f")).alias("long_form"), F.max("n").alias("n"))


@query("evaluation_scores", f"WITH {SCORED}, a AS (SELECT run_id, least(1, count(*) / 20.0)::DOUBLE AS completeness, avg(relevance) AS relevance, count(DISTINCT platform) / least(count(*), 12)::DOUBLE AS diversity, avg((difficulty = 'beginner')::INTEGER) AS fit, avg((citation_count IS NOT NULL)::INTEGER) AS evidence FROM s GROUP BY 1) SELECT run_id, round(0.25 * completeness + 0.3 * relevance + 0.15 * diversity + 0.15 * fit + 0.15 * evidence, 6) AS composite FROM a")
def evaluation_scores(spark, sf):
    a = _scored(spark, sf).groupBy("run_id").agg(F.least(F.lit(1.0), F.count("*") / 20.0).alias("completeness"), F.avg("relevance").alias("relevance"), (F.countDistinct("platform") / F.least(F.count("*"), F.lit(12))).alias("diversity"), F.avg((F.col("difficulty") == "beginner").cast("int")).alias("fit"), F.avg(F.col("citation_count").isNotNull().cast("int")).alias("evidence"))
    return a.select("run_id", F.round(0.25 * F.col("completeness") + 0.3 * F.col("relevance") + 0.15 * F.col("diversity") + 0.15 * F.col("fit") + 0.15 * F.col("evidence"), 6).alias("composite"))


@query("answer_confidence", f"WITH {SCORED}, t AS (SELECT * FROM s ORDER BY relevance DESC, ordinal LIMIT 10) SELECT round(max(c) / 10.0::DOUBLE, 6) AS coherence, (SELECT round(avg(relevance), 6) FROM t) AS mean_relevance, (SELECT round(count(DISTINCT url) / count(*)::DOUBLE, 6) FROM t) AS citation_diversity, (SELECT round(avg(least(1, length(abstract) / 600.0::DOUBLE)), 6) FROM t) AS length_match, (SELECT round(avg((len(list_intersect(['the', 'of'], regexp_extract_all(lower(title), '[a-z0-9]+'))) / 2.0)::DOUBLE), 6) FROM t) AS title_overlap FROM (SELECT platform, count(*) AS c FROM t GROUP BY 1)")
def answer_confidence(spark, sf):
    top = rel.top_ranked(_scored(spark, sf), [F.desc("relevance"), F.asc("ordinal")], 10)
    main = top.groupBy("platform").agg(F.count("*").alias("c")).agg(F.round(F.max("c") / 10.0, 6).alias("coherence"))
    return main.crossJoin(top.agg(F.round(F.avg("relevance"), 6).alias("mean_relevance"), F.round(F.countDistinct("url") / F.count("*"), 6).alias("citation_diversity"), F.round(F.avg(F.least(F.lit(1.0), F.length("abstract") / 600.0)), 6).alias("length_match"), F.round(F.avg(tx.query_overlap(F.array(F.lit("the"), F.lit("of")), tx.tokens(F.col("title")))), 6).alias("title_overlap")))


STOP = ", ".join(f"'{w}'" for w in fx.STOPWORDS)


@query("search_expressions", f"WITH {QS}, t AS (SELECT item_id, list_filter({TOK.format('q')}, lambda t: t NOT IN ({STOP}) AND NOT regexp_matches(t, '^[0-9]+$')) AS t FROM qs) SELECT item_id, array_to_string(list_transform(list_filter(t, lambda x, i: list_position(t, x) = i)[1:12], lambda x: '\"' || x || '\"'), ' OR ') AS expr FROM t")
def search_expressions(spark, sf):
    t = F.filter(tx.tokens(F.col("q")), lambda x: ~x.isin(*fx.STOPWORDS) & ~x.rlike("^[0-9]+$"))
    return questions(spark, sf).select("item_id", F.array_join(F.transform(F.slice(F.array_distinct(t), 1, 12), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("expr"))


@query("abbreviations", f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM benchmark) SELECT token, length(token) <= 5 AND (regexp_matches(token, '^[A-Z]{{2,5}}$') OR NOT regexp_matches(lower(token), '[aeiouy]')) AS abbreviation FROM t")
def abbreviations(spark, sf):
    t = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("token")).distinct()
    return t.select("token", ((F.length("token") <= 5) & (F.col("token").rlike("^[A-Z]{2,5}$") | ~F.lower("token").rlike("[aeiouy]"))).alias("abbreviation"))


DATES = ("2020-01-02", "2020/03/04", "05 Jun 2021", "2019", "not a date", "2022-07-08T09:10:11")


@query("lenient_dates", f"WITH d AS (SELECT doc_id, CASE doc_id % 6 {' '.join(f'''WHEN {i} THEN '{x}' ''' for i, x in enumerate(DATES))} END AS s FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1577923200 WHEN 1 THEN 1583280000 WHEN 2 THEN 1622851200 WHEN 3 THEN 1546300800 WHEN 5 THEN 1657271411 END::BIGINT AS epoch FROM d")
def lenient_dates(spark, sf):
    """Dates in any of several forms, UTC; null where none fits."""
    s = F.lit(None).cast("string")
    for i, x in enumerate(DATES):
        s = F.when(F.col("doc_id") % 6 == i, x).otherwise(s)
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "yyyy"]
    when = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])
    return table(spark, sf, "documents").select("doc_id", F.unix_seconds(when.cast("timestamp")).alias("epoch"))


@query("clean_weights", "SELECT event_id, event_type AS key, CASE WHEN value / 50 > 1 THEN 1 WHEN value < 0 THEN 0 ELSE round(value / 50, 6) END::DOUBLE AS weight FROM events")
def clean_weights(spark, sf):
    """A map with snake-case keys and values within 0 and 1."""
    m = F.create_map(F.concat(F.lit(" "), F.upper("event_type")), F.col("value") / 50)
    out = F.transform_values(F.transform_keys(m, lambda k, _: F.regexp_replace(F.lower(F.trim(k)), "[^a-z0-9]+", "_")), lambda _, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(v, 6))))
    return table(spark, sf, "events").select("event_id", F.explode(out).alias("key", "weight"))


@query("masked_keys", "SELECT c_custkey, left(c_name, 4) || '***' || right(c_name, 2) AS masked FROM customer")
def masked_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.left("c_name", F.lit(4)), F.lit("***"), F.right("c_name", F.lit(2))).alias("masked"))


@query("stable_ids", f"WITH {SOURCES} SELECT source_id, sha256('{{\"platform\":\"' || platform || '\",\"title\":\"' || regexp_replace(title, '[^A-Za-z ]', '', 'g') || '\"}}') AS hash, left(sha256(run_id || '|' || source_id || '|' || url), 32) AS doc_hash FROM src")
def stable_ids(spark, sf):
    title = F.regexp_replace("title", "[^A-Za-z ]", "")
    return sources(spark, sf).select("source_id", F.sha2(F.to_json(F.struct("platform", title.alias("title"))), 256).alias("hash"), F.left(F.sha2(F.concat_ws("|", "run_id", "source_id", "url"), 256), F.lit(32)).alias("doc_hash"))


@query("kept_words", f"WITH {QS}, t AS (SELECT item_id, string_split(q, ' ') AS w FROM qs) SELECT item_id, array_to_string(list_filter(w, lambda x: x NOT IN ('beginner', 'advanced', 'scratch', 'learn', 'please')), ' ') AS stripped, array_to_string(list_filter(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')), lambda x: true)[1:3], '|') AS windows FROM t")
def kept_words(spark, sf):
    """Level words go unless the user typed others; and focused windows of three words."""
    w = F.split("q", " ")
    left = F.filter(w, lambda x: ~x.isin("beginner", "advanced", "scratch", "learn", "please"))
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    return questions(spark, sf).select("item_id", F.array_join(left, " ").alias("stripped"), F.array_join(F.slice(F.when(F.size(w) >= 3, runs).otherwise(F.array().cast("array<string>")), 1, 3), "|").alias("windows"))


@query("platform_order", "SELECT s_suppkey AS platform, row_number() OVER (ORDER BY CASE s_nationkey % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, s_suppkey) AS place FROM supplier")
def platform_order(spark, sf):
    """Platforms of a dimension, those of the wanted level first, else as they are listed."""
    k = F.col("s_nationkey") % 3
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(k == 1, 0).when(k == 0, 1).otherwise(2).alias("class"))
    return ix.numbered(rows, store.new_folder(spark, "places"), "class", "s_suppkey").select(F.col("s_suppkey").alias("platform"), "place")


@query("category_fallback", "WITH t AS (SELECT n_nationkey AS platform, n_regionkey AS category, row_number() OVER (ORDER BY (n_regionkey + 3) % 5, n_nationkey) AS place FROM nation) SELECT platform, category, place FROM t WHERE place <= 9")
def category_fallback(spark, sf):
    n = table(spark, sf, "nation").withColumn("o", (F.col("n_regionkey") + 3) % 5)
    return rel.top_ranked(n, [F.asc("o"), F.asc("n_nationkey")], 9, "place").select(F.col("n_nationkey").alias("platform"), F.col("n_regionkey").alias("category"), "place")


@query("embedding_coverage", "WITH c AS (SELECT doc_id % 8 AS grp, count(*) AS n, count(vec_id) AS have FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1) SELECT grp, round(have / n::DOUBLE, 6) AS share, have / n::DOUBLE >= 0.8 AS use_stored FROM c")
def embedding_coverage(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("have")), "doc_id", "left")
    c = rows.groupBy((F.col("doc_id") % 8).alias("grp")).agg((F.count("have") / F.count("*")).alias("share"))
    return c.select("grp", F.round("share", 6).alias("share"), (F.col("share") >= 0.8).alias("use_stored"))


@query("payload_ranking", f"WITH {SOURCES}, p AS (SELECT run_id, 's' || (ordinal * 7 % 900) AS id, (ordinal % 11)::INTEGER AS given, ordinal % 100 / 100.0::DOUBLE AS score, ordinal * 2 AS o FROM src UNION ALL SELECT run_id, 's' || (ordinal * 3 % 700), (ordinal % 5)::INTEGER, 0.5::DOUBLE, ordinal * 2 + 1 FROM src), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY o) = 1) SELECT f.run_id AS run_id, id, row_number() OVER (PARTITION BY f.run_id ORDER BY given, f.score DESC, o) AS rank FROM f JOIN src ON src.source_id = f.id")
def payload_ranking(spark, sf):
    """Models' lists of (id, rank, score) joined to known records; the first of a run's repeated ids counts."""
    src = sources(spark, sf)
    item = lambda id_, given, score, o: F.struct(F.concat(F.lit("s"), id_.cast("string")).alias("id"), given.cast("int").alias("given"), score.alias("score"), o.alias("o"))
    k = F.col("ordinal")
    raw = F.to_json(F.array(item(k * 7 % 900, k % 11, k % 100 / 100.0, k * 2), item(k * 3 % 700, k % 5, F.lit(0.5), k * 2 + 1)))
    rows = src.select("run_id", F.explode(F.from_json(raw, "array<struct<id string, given int, score double, o long>>")).alias("x")).select("run_id", "x.*")
    first = rows.groupBy("run_id", "id").agg(F.min(F.struct("o", "given", "score")).alias("x")).select("run_id", "id", "x.*")
    known = first.join(src.select(F.col("source_id").alias("id")), "id", "left_semi")
    ordered = known.select("run_id", "id", "given", (-F.col("score")).alias("less"), "o")
    return ix.numbered(ordered, store.new_folder(spark, "ranking"), "given", "less", "o", group="run_id").select("run_id", "id", F.col("place").alias("rank"))


@query("low_votes_merge", f"WITH {SCORED}, v AS (SELECT source_id, (ordinal % 10) / 10.0::DOUBLE AS score FROM s WHERE difficulty = 'beginner'), ok AS (SELECT * FROM v WHERE score >= 0.15) SELECT source_id, round(score, 6) AS score, 'vote' AS origin FROM ok UNION ALL SELECT source_id, round(relevance, 6), 'heuristic' FROM s WHERE source_id NOT IN (SELECT source_id FROM v)")
def low_votes_merge(spark, sf):
    """Weak votes go; records that the model saw don't come back by their heuristic score."""
    s = _scored(spark, sf)
    v = s.where("difficulty = 'beginner'").select("source_id", ((F.col("ordinal") % 10) / 10.0).alias("score"))
    rest = s.join(v.select("source_id"), "source_id", "left_anti").select("source_id", F.round("relevance", 6).alias("score"), F.lit("heuristic").alias("origin"))
    return v.where("score >= 0.15").select("source_id", F.round("score", 6).alias("score"), F.lit("vote").alias("origin")).unionByName(rest)


@query("preferences_map", "SELECT user_id, event_type AS key, max(event_id) AS value FROM events GROUP BY ALL")
def preferences_map(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("key", "value"))


@query("memory_context", f"WITH t AS (SELECT conv_id, turn, role, text, len(list_intersect(['the', 'of', 'and', 'thing'], regexp_extract_all(lower(text), '[a-z0-9]+'))) / 4.0::DOUBLE AS sim FROM conversations), b AS (SELECT * FROM t WHERE sim >= 0.3), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY sim DESC, turn) AS k FROM b) SELECT conv_id, md5(left(string_agg(role || ': ' || text, ' | ' ORDER BY role, sim DESC, turn), 2000)) AS context_md5, count(*) AS entries FROM k WHERE k <= 4 GROUP BY 1")
def memory_context(spark, sf):
    """Entries of the three stores (here: roles) that are like the question, the best four of each, in one text."""
    q = F.array(*map(F.lit, ("the", "of", "and", "thing")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", tx.query_overlap(q, tx.tokens(F.col("text"))).alias("sim")).where("sim >= 0.3")
    few = rows.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.desc("sim"), "turn"))).where("k <= 4")
    line = F.struct("role", (-F.col("sim")).alias("s"), "turn", F.concat("role", F.lit(": "), "text").alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), " | ")
    return few.groupBy("conv_id").agg(F.md5(F.left(joined, F.lit(2000))).alias("context_md5"), F.count("*").alias("entries"))


@query("ledger_totals", f"WITH {ENTRIES}, e AS (SELECT category, CASE WHEN tokens > 20 THEN tokens END AS total, tokens // 2 AS prompt, tokens % 7 AS completion FROM en) SELECT category, sum(coalesce(total, prompt + completion))::BIGINT AS tokens FROM e GROUP BY 1")
def ledger_totals(spark, sf):
    en = entries(spark, sf)
    total = F.when(F.col("tokens") > 20, F.col("tokens"))
    return en.groupBy("category").agg(F.sum(F.coalesce(total, F.floor(F.col("tokens") / 2) + F.col("tokens") % 7)).alias("tokens"))


@query("budget_state", f"WITH {ENTRIES}, s AS (SELECT user_id, category, sum(tokens)::BIGINT AS spent FROM en GROUP BY ALL) SELECT user_id, category, greatest(0, 1500 - spent)::BIGINT AS remaining, spent <= 1500 AS within FROM s")
def budget_state(spark, sf):
    s = entries(spark, sf).groupBy("user_id", "category").agg(F.sum("tokens").alias("spent"))
    return s.select("user_id", "category", F.greatest(F.lit(0), 1500 - F.col("spent")).cast("long").alias("remaining"), (F.col("spent") <= 1500).alias("within"))


@query("replan", "WITH r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')), n AS (SELECT o_custkey, count(*) AS n FROM r GROUP BY 1) SELECT r.o_orderkey AS step, greatest(500, 9000 // n)::BIGINT AS budget FROM r JOIN n USING (o_custkey)")
def replan(spark, sf):
    """Steps that are neither done nor failed share what is left."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    r = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")
    n = r.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return r.join(n, "o_custkey").select(F.col("o_orderkey").alias("step"), F.greatest(F.lit(500), F.floor(9000 / F.col("n"))).cast("long").alias("budget"))


@query("latency_summary", "SELECT event_type, round(avg(value), 4) AS mean_latency, round(max(value), 4) AS max_latency, count(*) FILTER (value > 50) AS slow, round(quantile_cont(value, 0.5), 4) AS median FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_latency"), F.round(F.max("value"), 4).alias("max_latency"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.percentile("value", 0.5), 4).alias("median"))


@query("run_quality", "WITH a AS (SELECT user_id, bool_or(event_type = 'view')::INTEGER AS v, bool_or(event_type = 'click')::INTEGER AS c, bool_or(event_type = 'purchase')::INTEGER AS p, bool_or(event_type = 'signup')::INTEGER AS s, (NOT bool_or(event_type = 'error'))::INTEGER AS e FROM events GROUP BY 1) SELECT user_id, round((0.25 * v + 0.25 * c + 0.2 * p + 0.2 * s + 0.1 * e)::DOUBLE, 6) AS quality FROM a")
def run_quality(spark, sf):
    any_ = lambda t: F.bool_or(F.col("event_type") == t).cast("int")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(0.25 * any_("view") + 0.25 * any_("click") + 0.2 * any_("purchase") + 0.2 * any_("signup") + 0.1 * (1 - any_("error")), 6).alias("quality"))


@query("html_links_valid", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(*) FILTER (starts_with(href, '/')) AS inside FROM l GROUP BY 1")
def html_links_valid(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("href").startswith("/")).alias("inside"))


@query("catalog_answer", f"WITH {SOURCES}, t AS (SELECT platform, count(*) AS n FROM src GROUP BY 1 ORDER BY n DESC, platform LIMIT 3) SELECT 'Indexed: ' || string_agg(platform || ' (' || n || ')', ', ' ORDER BY n DESC, platform) AS answer FROM t")
def catalog_answer(spark, sf):
    n = sources(spark, sf).groupBy("platform").agg(F.count("*").alias("n"))
    top = rel.top_ranked(n, [F.desc("n"), F.asc("platform")], 3)
    return top.agg(F.concat(F.lit("Indexed: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("platform", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("l")))), lambda x: x["l"]), ", ")).alias("answer"))


@query("fuzzy_gate")
def fuzzy_gate(spark, sf):
    """Titles with a token that matches one of the query's, by stems, beginnings or likeness."""
    toks = sources(spark, sf).select("source_id", F.explode(tx.tokens(F.col("title"))).alias("t")).distinct()
    words = toks.select("t").distinct().withColumn("hit", fz.udf_of("sl_tokens_match")(F.lit("thention"), "t")).where("hit")
    return toks.join(words, "t", "left_semi").select("source_id").distinct()


@query("proximity_scores")
def proximity_scores(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(fz.proximity_of(["thing", "ention"])(tx.tokens(F.col("text"))), 6).alias("proximity"))


@query("repaired_payloads")
def repaired_payloads(spark, sf):
    raw = F.concat(F.lit('```json\n{"title": "'), F.regexp_replace("title", '["\\\\]', ""), F.lit('", "year": 20'))
    return sources(spark, sf).select("source_id", fz.udf_of("sl_json")(raw).alias("json"))
