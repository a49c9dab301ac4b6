"""Queries over catalogs, runs, ledgers, conversations and tools of the agent, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed as fx, text as tx
from ..operators import analytics as an, records as rc, relevance as rel, selection as sel, understanding as un
from ..streaming import windows as sw
from .registry import query
from .views import SOURCES, sources, table

DIMENSIONS = ["platform", "source_type", "difficulty", "year", "run_id"]
CATALOG = f"{SOURCES}, cat AS ({' UNION ALL '.join(f'''SELECT '{d}' AS dimension, coalesce(nullif(trim({d}::VARCHAR), ''), 'unknown') AS value, count(*) AS n FROM src GROUP BY 2''' for d in DIMENSIONS)} UNION ALL SELECT 'all', 'all', count(*) FROM src)"


@query("catalog_snapshot", f"WITH {CATALOG} SELECT dimension, value, n FROM cat")
def catalog_snapshot(spark, sf):
    return an.catalog(sources(spark, sf), DIMENSIONS)


@query("catalog_topn", f"WITH {CATALOG} SELECT dimension, value, n, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM cat QUALIFY rank <= 5")
def catalog_topn(spark, sf):
    return an.top_of_each(an.catalog(sources(spark, sf), DIMENSIONS), "dimension", 5, F.desc("n"), F.asc("value"))


@query("catalog_confidence", f"WITH {SOURCES}, a AS (SELECT count(*) AS n, count(DISTINCT platform) AS p, count(DISTINCT source_type) AS t, count(DISTINCT year) AS y, count(DISTINCT difficulty) AS d FROM src) SELECT n, round((least(1, n / 50.0) * 0.4 + (p > 1)::INTEGER * 0.2 + (t > 1)::INTEGER * 0.2 + (y > 1)::INTEGER * 0.1 + (d > 1)::INTEGER * 0.1)::DOUBLE, 6) AS richness FROM a")
def catalog_confidence(spark, sf):
    a = sources(spark, sf).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c[0] + "_") for c in ("platform", "source_type", "year", "difficulty")])
    many = lambda c: (F.col(c) > 1).cast("int")
    return a.select("n", F.round(F.least(F.lit(1.0), F.col("n") / 50.0) * 0.4 + many("p_") * 0.2 + many("s_") * 0.2 + many("y_") * 0.1 + many("d_") * 0.1, 6).alias("richness"))


@query("report_distribution", f"WITH {SOURCES}, c AS (SELECT platform, source_type, count(*) AS n FROM src GROUP BY CUBE (platform, source_type)) SELECT platform, source_type, n, round(n::DOUBLE / max(n) OVER (), 6) AS share FROM c")
def report_distribution(spark, sf):
    return an.with_share(sources(spark, sf).cube("platform", "source_type").agg(F.count("*").alias("n")), "n", F.max("n"))


@query("funnel", "WITH f AS (SELECT 'orders' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority LIKE '1-%' UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R') SELECT stage, n, round(n::DOUBLE / (SELECT max(n) FROM f), 6) AS share FROM f")
def funnel(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = orders.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderpriority").startswith("1-")).alias("urgent"))
    b = lines.agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = a.unpivot([], ["orders", "urgent"], "stage", "n").unionByName(b.unpivot([], ["lines", "returned"], "stage", "n"))
    return an.with_share(rows, "n", F.max("n"))


@query("run_stats", "SELECT o_orderstatus AS status, count(*) AS runs, round(sum(o_totalprice), 2) AS total, round(avg(CASE WHEN o_totalprice > 1000 THEN o_totalprice END), 4) AS mean_known, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1")
def run_stats(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg(F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))), 4).alias("mean_known"), F.countDistinct("o_custkey").alias("owners"))


ENTRIES = "en AS (SELECT event_id, ts, user_id, event_type AS category, concat('m', cast(cast(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR)) AS model, cast(floor(value) AS BIGINT) AS tokens, value AS latency, event_type <> 'error' AS success FROM events)"


def entries(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    return ev.select("event_id", "ts", "user_id", F.col("event_type").alias("category"), F.concat(F.lit("m"), k.cast("string")).alias("model"), F.floor("value").cast("long").alias("tokens"), F.col("value").alias("latency"), (F.col("event_type") != "error").alias("success"))


@query("token_report", f"WITH {ENTRIES} SELECT model, category, sum(tokens)::BIGINT AS tokens, count(*) AS calls, round(avg(latency), 4) AS mean_latency FROM en WHERE tokens > 0 GROUP BY GROUPING SETS ((model), (category), ())")
def token_report(spark, sf):
    return an.usage(entries(spark, sf))


@query("running_budget", f"WITH {ENTRIES}, r AS (SELECT event_id, user_id, sum(tokens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM en) SELECT event_id, user_id, spent, least(spent, 800)::BIGINT AS capped, CASE WHEN spent >= 760 THEN 'critical' WHEN spent >= 640 THEN 'warning' ELSE 'ok' END AS level FROM r")
def running_budget(spark, sf):
    return an.running_budget(entries(spark, sf), 800).select("event_id", "user_id", "spent", F.col("capped").cast("long").alias("capped"), "level")


OUTCOME = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' ELSE 'ok' END"


@query("failure_islands", f"WITH o AS (SELECT *, {OUTCOME} AS outcome FROM events), i AS (SELECT user_id, outcome, sum((outcome = 'ok')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o WHERE outcome <> 'empty'), g AS (SELECT user_id, island, count(*) AS failures FROM i WHERE outcome = 'failed' GROUP BY ALL) SELECT user_id, island::BIGINT AS island, failures, CASE WHEN failures >= 4 THEN 1800 WHEN failures = 3 THEN 1200 WHEN failures = 2 THEN 600 ELSE 300 END AS cooldown FROM g")
def failure_islands(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("ok")
    return an.failure_runs(table(spark, sf, "events").withColumn("outcome", outcome))


@query("platform_outcomes", f"SELECT user_id % 20 AS platform, count(*) AS attempted, count(*) FILTER ({OUTCOME} = 'ok') AS with_data, count(*) FILTER ({OUTCOME} = 'empty') AS empty, count(*) FILTER ({OUTCOME} = 'failed') AS failed FROM events GROUP BY 1")
def platform_outcomes(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("platform")).agg(F.count("*").alias("attempted"), F.count_if(~e.isin("error", "view")).alias("with_data"), F.count_if(e == "view").alias("empty"), F.count_if(e == "error").alias("failed"))


@query("strategy_best", f"WITH {ENTRIES} SELECT model AS strategy, count(*) AS uses, round(avg(latency / 100), 4) AS mean_quality, floor(avg(tokens))::BIGINT AS mean_tokens, round(coalesce(max(latency / 100) FILTER (success), 0), 4) AS best_quality, round(avg(success::INTEGER), 6) AS success_rate FROM en GROUP BY 1")
def strategy_best(spark, sf):
    return an.strategies(entries(spark, sf).withColumn("strategy", F.col("model")).withColumn("quality", F.col("latency") / 100))


@query("subtopics_tfidf", f"WITH {SOURCES}, x AS (SELECT ordinal, unnest(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) >= 4)) AS term FROM src), t AS (SELECT term, count(*) AS tf, count(DISTINCT ordinal) AS df FROM x GROUP BY 1) SELECT term, tf, df, round(tf * ln(((SELECT count(*) FROM src) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)), 6) AS weight FROM t ORDER BY tf * ln(((SELECT count(*) FROM src) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) DESC, term LIMIT 50")
def subtopics_tfidf(spark, sf):
    return an.term_weights(sources(spark, sf)).orderBy(F.desc("weight"), "term").limit(50).withColumn("weight", F.round("weight", 6))


@query("related_terms", f"WITH {SOURCES}, t AS (SELECT list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM src), x AS (SELECT unnest(t) AS term FROM t WHERE list_contains(t, 'the')) SELECT term, count(*) AS docs FROM x WHERE term <> 'the' GROUP BY 1")
def related_terms(spark, sf):
    return an.related_terms(sources(spark, sf), "the")


@query("acronyms", "WITH a AS (SELECT unnest(regexp_extract_all(text, '[^A-Z]([A-Z]{2,6})[^A-Za-z]', 1)) AS acronym FROM documents) SELECT acronym, count(*) AS n FROM a GROUP BY 1")
def acronyms(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^A-Z]([A-Z]{2,6})[^A-Za-z]"), 1)).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("n"))


VOTES = "vo AS (SELECT o_custkey % 200 AS task, o_orderkey AS voter, [{'id': 'a' || (o_orderkey % 2), 'score': 0.5 + (o_orderkey % 3) / 10}, {'id': 'b' || (o_custkey % 3), 'score': 0.25}] AS items FROM orders)"


def votes(spark, sf):
    o = table(spark, sf, "orders")
    first = F.struct(F.concat(F.lit("a"), (F.col("o_orderkey") % 2).cast("string")).alias("id"), (0.5 + (F.col("o_orderkey") % 3) / 10).alias("score"))
    second = F.struct(F.concat(F.lit("b"), (F.col("o_custkey") % 3).cast("string")).alias("id"), F.lit(0.25).alias("score"))
    return o.select((F.col("o_custkey") % 200).alias("task"), F.col("o_orderkey").alias("voter"), F.array(first, second).alias("items"))


@query("vote_consensus", f"""WITH {VOTES}, p AS (SELECT task, sha256(array_to_string(list_transform(items, lambda x: x.id || ':' || printf('%.2f', x.score::DOUBLE)), '|')) AS strict, sha256(array_to_string(list_transform(items, lambda x: x.id), '|')) AS loose FROM vo),
n AS (SELECT task, count(*) AS n FROM p GROUP BY 1), s AS (SELECT task, strict, count(*) AS k FROM p GROUP BY task, strict QUALIFY row_number() OVER (PARTITION BY task ORDER BY k DESC, strict DESC) = 1), l AS (SELECT task, loose, count(*) AS k FROM p GROUP BY task, loose QUALIFY row_number() OVER (PARTITION BY task ORDER BY k DESC, loose DESC) = 1)
SELECT n.task AS task, CASE WHEN s.k >= 2 AND s.k / n >= 0.5 THEN 'strict' WHEN l.k >= 2 AND l.k / n >= 0.5 THEN 'loose' ELSE 'disagreement' END AS mode, CASE WHEN s.k >= 2 AND s.k / n >= 0.5 THEN strict WHEN l.k >= 2 AND l.k / n >= 0.5 THEN loose END AS print,
CASE WHEN s.k >= 2 AND s.k / n >= 0.5 THEN s.k WHEN l.k >= 2 AND l.k / n >= 0.5 THEN l.k ELSE 0 END::BIGINT AS n_votes FROM n JOIN s USING (task) JOIN l USING (task)""")
def vote_consensus(spark, sf):
    return sel.majority(votes(spark, sf)).withColumn("n_votes", F.col("n_votes").cast("long"))


@query("vote_fallback", "SELECT o_custkey AS task, arg_max(o_orderkey, {'w': o_totalprice, 'p': -(o_orderkey % 4), 'n': length(o_orderpriority), 'k': o_orderkey}) AS voter FROM orders GROUP BY 1")
def vote_fallback(spark, sf):
    by = F.struct("o_totalprice", -(F.col("o_orderkey") % 4), F.length("o_orderpriority"), "o_orderkey")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.max_by("o_orderkey", by).alias("voter"))


@query("votes_then_heuristics", "WITH v AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT l_orderkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1) SELECT id, round(score, 2) AS score, 'vote' AS origin FROM v UNION ALL SELECT id, round(score, 2), 'heuristic' FROM h WHERE id NOT IN (SELECT id FROM v)")
def votes_then_heuristics(spark, sf):
    v = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("score"))
    h = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.max("l_extendedprice"), 2).alias("score"))
    return v.withColumn("origin", F.lit("vote")).unionByName(h.join(v, "id", "left_anti").withColumn("origin", F.lit("heuristic")))


BUDGETS = "w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <= 2 THEN 1.5 ELSE 1.0 END::DOUBLE * greatest(0.5, least(2.0, (s_acctbal + 1000) / 3000.0))::DOUBLE AS weight FROM supplier), a AS (SELECT s_suppkey, weight, greatest(500, floor(weight / (SELECT sum(weight) FROM w) * {0})::BIGINT)::BIGINT AS budget FROM w), o AS (SELECT sum(budget) AS s, count(*) AS n FROM a)"


@query("budget_allocation", f"WITH {BUDGETS.format(850_000)} SELECT s_suppkey, CASE WHEN s > 850000 THEN greatest(500, budget - (s - 850000)::BIGINT // n) ELSE budget END::BIGINT AS budget FROM a, o")
def budget_allocation(spark, sf):
    """Shares by priority and size, with a reserve and a least; what that is too much is taken off all alike."""
    return an.allocated(_tasks(spark, sf), "weight", 1_000_000, "s_suppkey").select("s_suppkey", "budget")


@query("budget_overflow", f"WITH {BUDGETS.format(4250)} SELECT s_suppkey, CASE WHEN s > 4250 THEN greatest(500, budget - (s - 4250)::BIGINT // n) ELSE budget END::BIGINT AS budget FROM a, o")
def budget_overflow(spark, sf):
    """A total so small that the least of all is more than it."""
    return an.allocated(_tasks(spark, sf), "weight", 5_000, "s_suppkey").select("s_suppkey", "budget")


def _tasks(spark, sf):
    weight = F.when(F.col("s_suppkey") % 5 <= 2, 1.5).otherwise(1.0) * F.greatest(F.lit(0.5), F.least(F.lit(2.0), (F.col("s_acctbal") + 1000) / 3000.0))
    return table(spark, sf, "supplier").select("s_suppkey", weight.alias("weight"))


@query("recent_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_turns(spark, sf):
    return sel.per_group(table(spark, sf, "conversations"), "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("last_user_topic", "SELECT conv_id, arg_max(text, turn) AS topic, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_topic(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.max_by("text", "turn").alias("topic"), F.max("turn").alias("turn"))


@query("conversation_listing", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def conversation_listing(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"))


@query("memory_search", "SELECT conv_id, turn, length(text)::INTEGER AS chars FROM conversations WHERE text ILIKE '%er th%' AND role <> 'system' AND length(text) >= 100")
def memory_search(spark, sf):
    return table(spark, sf, "conversations").where(F.col("text").ilike("%er th%") & (F.col("role") != "system") & (F.length("text") >= 100)).select("conv_id", "turn", F.length("text").alias("chars"))


_ask = ["the", "of", "and", "thing"]


@query("episode_similarity", f"WITH s AS (SELECT conv_id, turn, len(list_intersect({_ask!r}, regexp_extract_all(lower(text), '[a-z0-9]+')))::DOUBLE / {len(_ask)} AS sim FROM conversations) SELECT conv_id, turn, round(sim, 6) AS sim FROM s WHERE sim >= 0.3 ORDER BY s.sim DESC, conv_id, turn LIMIT 25")
def episode_similarity(spark, sf):
    q = F.array(*map(F.lit, _ask))
    s = table(spark, sf, "conversations").select("conv_id", "turn", tx.query_overlap(q, tx.tokens(F.col("text"))).alias("sim"))
    return s.where("sim >= 0.3").orderBy(F.desc("sim"), "conv_id", "turn").limit(25).withColumn("sim", F.round("sim", 6))


@query("turn_jaccard", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2) SELECT conv_id, turn, round(len(list_intersect(x, y))::DOUBLE / greatest(1, len(list_distinct(list_concat(x, y)))), 6) AS jaccard FROM p")
def turn_jaccard(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("t"))
    two = F.lag(F.struct("turn", "t"), 2).over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("p", two).where("p.turn = turn - 2").select("conv_id", "turn", F.round(tx.jaccard(F.col("t"), F.col("p.t")), 6).alias("jaccard"))


ASKED = "CASE turn % 5 WHEN 0 THEN 'What have I asked so far? ' WHEN 1 THEN 'Remind me, we discussed and covered my study earlier: ' WHEN 2 THEN 'I asked: ' ELSE '' END"
_n = lambda marks, text: "(" + " + ".join("contains({}, '{}')::INTEGER".format(text, m.replace("'", "''")) for m in marks) + ")"


@query("conversation_route", f"WITH q AS (SELECT conv_id, turn, lower({ASKED} || text) AS t FROM conversations WHERE role = 'user'), c AS (SELECT *, {_n(fx.STRONG_MARKERS, 't')} AS strong, {_n(fx.SELF_REFERENCES, 't')} AS self, {_n(fx.SESSION_VERBS, 't')} AS verbs, {_n(fx.PRONOUNS, chr(39) + ' ' + chr(39) + ' || t || ' + chr(39) + ' ' + chr(39))} AS pronouns, length(t) < 60 AS has_topic FROM q) SELECT conv_id, turn, CASE WHEN strong > 0 OR (NOT has_topic AND self + verbs + pronouns >= 2) OR (NOT has_topic AND verbs >= 1 AND pronouns >= 1) OR (self >= 2 AND verbs >= 1) OR (turn > 0 AND NOT has_topic AND self + verbs + pronouns >= 3) THEN 'conversation' ELSE 'corpus' END AS route FROM c")
def conversation_route(spark, sf):
    """Whether a question is about the talk itself or about the corpus."""
    turn = F.col("turn") % 5
    text = F.concat(F.when(turn == 0, "What have I asked so far? ").when(turn == 1, "Remind me, we discussed and covered my study earlier: ").when(turn == 2, "I asked: ").otherwise(""), "text")
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower(text).alias("t"))
    return rows.select("conv_id", "turn", un.route(F.col("t"), F.length("t") < 60, F.col("turn")).alias("route"))


@query("retention_trim", "WITH k AS (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT user_id, count(*) AS kept FROM events WHERE event_id IN (SELECT event_id FROM k) GROUP BY 1")
def retention_trim(spark, sf):
    ev = table(spark, sf, "events")
    kept = ev.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")
    return ev.join(kept, "event_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("kept"))


@query("latest_wins_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins_upsert(spark, sf):
    return rc.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("replace_chunks", "SELECT doc_id, 'new' AS origin FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def replace_chunks(spark, sf):
    """Rows of replaced parents go by an anti join, the new ones are added."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    new = docs.where("lang = 'de'").select("doc_id")
    return docs.join(new, "doc_id", "left_anti").select("doc_id", F.lit("old").alias("origin")).unionByName(new.withColumn("origin", F.lit("new")))


@query("runs_with_sources", "SELECT o.o_orderkey AS run, o_orderstatus AS status, count(l_orderkey) AS sources, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def runs_with_sources(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("sources"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    return orders.join(lines, "run", "left").select("run", "status", F.coalesce("sources", F.lit(0).cast("long")).alias("sources"), F.coalesce(F.array_join(F.transform("p", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


@query("runs_newest", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def runs_newest(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_custkey")


@query("fetch_by_ids", "SELECT doc_id, length(text)::INTEGER AS chars FROM documents WHERE doc_id IN (SELECT vec_id * 3 FROM embeddings WHERE label = 1)")
def fetch_by_ids(spark, sf):
    ids = table(spark, sf, "embeddings").where("label = 1").select((F.col("vec_id") * 3).alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.length("text").alias("chars"))


@query("redact_secrets", "WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' api_key = ABCDEF0123456789' WHEN 1 THEN ' Bearer abcdefghijklmnop1234' WHEN 2 THEN ' sk-ABCDEFGH12345' ELSE '' END AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(bearer\\s+)[A-Za-z0-9_\\-\\.=+/]{16,}', '\\1***', 'g'), '(?i)((api[_-]?key|token|secret|password|authorization)\\s*[:=]\\s*)[''\"]?[A-Za-z0-9_\\-\\.=+/]{8,}[''\"]?', '\\1***', 'g'), '(?i)(nvapi-|gsk_|sk-|AIza)[A-Za-z0-9_\\-]{8,}', '***', 'g')) AS redacted_md5 FROM d")
def redact_secrets(spark, sf):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k == 0, " api_key = ABCDEF0123456789").when(k == 1, " Bearer abcdefghijklmnop1234").when(k == 2, " sk-ABCDEFGH12345").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.redacted(t)).alias("redacted_md5"))


@query("windows_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows_tumbling(spark, sf):
    return sw.tumbling(table(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("windows_sliding", "WITH w AS (SELECT user_id, ts, unnest(range(0, 6)) AS k FROM events) SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start, count(*) AS n FROM w GROUP BY ALL")
def windows_sliding(spark, sf):
    return sw.sliding(table(spark, sf, "events"), "60 minutes", "10 minutes")


@query("event_sessions", "WITH f AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INTEGER AS g FROM events), s AS (SELECT *, sum(coalesce(g, 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f) SELECT user_id, session::BIGINT AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS events FROM s GROUP BY ALL")
def event_sessions(spark, sf):
    return an.sessions(table(spark, sf, "events"), 1800)


@query("ledger_distinct", f"WITH {ENTRIES}, twice AS (SELECT * FROM en UNION ALL SELECT * FROM en) SELECT category, count(DISTINCT event_id) AS entries, (SELECT sum(tokens) FROM en e2 WHERE e2.category = twice.category)::BIGINT AS tokens FROM twice GROUP BY category")
def ledger_distinct(spark, sf):
    """A ledger that was appended again and again, read without its repeats."""
    en = entries(spark, sf)
    return en.unionByName(en).dropDuplicates(["event_id"]).groupBy("category").agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"))


@query("request_limit", "SELECT s_suppkey, greatest(3, least(10, ceil(s_suppkey * 1.0 / (s_suppkey % 9 + 1))))::BIGINT AS per_platform FROM supplier")
def request_limit(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.greatest(F.lit(3), F.least(F.lit(10), F.ceil(F.col("s_suppkey") / (F.col("s_suppkey") % 9 + 1)))).cast("long").alias("per_platform"))


@query("fallback_platforms", "WITH RECURSIVE hop AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS depth FROM nation UNION ALL SELECT start, (node * 2 + 1) % 25, depth + 1 FROM hop WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM hop GROUP BY ALL")
def fallback_platforms(spark, sf):
    """Breadth-first expansion over fallback links of a small dimension, by a recursive common table expression."""
    table(spark, sf, "nation").createOrReplaceTempView("_nation")
    return spark.sql("WITH RECURSIVE hop(start, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM _nation UNION ALL SELECT start, (node * 2 + 1) % 25, depth + 1 FROM hop WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM hop GROUP BY start, node")


@query("mean_relevance_gate", "WITH d AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS d FROM embeddings), m AS (SELECT label, avg(d) AS mean FROM d GROUP BY 1) SELECT vec_id, d.label AS label FROM d JOIN m ON m.label = d.label WHERE d >= mean")
def mean_relevance_gate(spark, sf):
    """Of each group the rows that reach its mean; the means are one row a group."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", rel.dot(F.col("embedding"), F.col("embedding")).alias("d"))
    means = rows.groupBy("label").agg(F.avg("d").alias("mean"))
    return rows.join(F.broadcast(means), "label").where("d >= mean").select("vec_id", "label")


@query("budget_rebalance", "WITH b AS (SELECT s_suppkey, 1000 + s_suppkey % 7 * 100 AS budget, s_suppkey % 4 = 0 AS done, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 9 * 50 ELSE 0 END AS unused FROM supplier) SELECT s_suppkey, (budget + CASE WHEN done THEN 0 ELSE (SELECT sum(unused) FROM b)::BIGINT // (SELECT count(*) FROM b WHERE NOT done) END)::BIGINT AS budget FROM b")
def budget_rebalance(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", (1000 + k % 7 * 100).alias("budget"), (k % 4 == 0).alias("done"), F.when(k % 4 == 0, k % 9 * 50).otherwise(0).alias("unused"))
    return an.rebalanced(rows).select("s_suppkey", "budget")


@query("table_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_counts(spark, sf):
    counts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("events", "orders", "conversations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("catalog_span", f"WITH {SOURCES}, n AS (SELECT * FROM src ORDER BY published DESC NULLS LAST, ordinal LIMIT 25) SELECT min(published)::BIGINT AS earliest, max(published)::BIGINT AS latest, count(*) AS total, (SELECT string_agg(source_id, ',' ORDER BY published DESC NULLS LAST, ordinal) FROM n) AS newest FROM src")
def catalog_span(spark, sf):
    """The catalog's range of dates and its newest titles."""
    src = sources(spark, sf)
    new = rel.top_ranked(src, [F.desc_nulls_last("published"), F.asc("ordinal")], 25).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda x: x["source_id"]), ",").alias("newest"))
    return src.agg(F.min("published").alias("earliest"), F.max("published").alias("latest"), F.count("*").alias("total")).crossJoin(new)


@query("best_vote", "WITH v AS (SELECT o_custkey AS task, o_orderkey AS voter, (o_orderkey % 100) / 100.0::DOUBLE AS fit FROM orders), b AS (SELECT task, max(fit) AS best, arg_max(voter, {'f': fit, 'v': -voter}) AS voter FROM v GROUP BY 1) SELECT task, CASE WHEN best > 0.5 + 0.10 THEN voter END AS voter FROM b")
def best_vote(spark, sf):
    """The vote that fits the level best takes the place of the final one if it fits better by more than 0.10."""
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("voter"), ((F.col("o_orderkey") % 100) / 100.0).alias("fit"), F.lit(0.5).alias("final"))
    return sel.better_vote(v).select("task", "voter")
