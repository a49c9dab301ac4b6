"""URL verdicts from rules and, where no rule fits, from trust that spreads over links between hosts.

Native DataFrame operations only.  Rules come first: of those that fit a url's host and path, the longest decides.  A host's seeds
are its pages that the rules allow (trust) and block (distrust), each kind as a share of all such pages.  Links of the pages'
HTML to other hosts are host edges, weighted by number.  Trust follows the edges, each host giving it on in proportion to its
links out; distrust goes against them, each host giving it to those that link to it.  Both are personalised PageRank, in
steps until what is still to be given on is under ``tolerance`` of all seeds and no new host is reached; a host without edges keeps
its seed, and what it would give on is lost.  A page without a rule is blocked if its host's distrust is above ``ratio`` times its
trust, and else allowed, also when it has no host.

Only (host, host, number of links) is shuffled, summed before the shuffle, so a host with a third of all pages is a row a task.
The hosts' scores are broadcast to the pages if they are few (a counted number), and else joined by merge, where adaptive
execution splits a host with very many pages.

Cases: a null url or one without "://" has empty host and path, which no rule fits; null html has no links; repeated rows count
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import keep, remove

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, RATIO = 0.85, 1.0
TOLERANCE, KEEP_EVERY = 1e-9, 5
BROADCAST_HOSTS = 100_000
LINK = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: numbers of links from pages of one host to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust from seeds (host, kind, seed): the sum of (1 - damping) * seed after any number of damped steps."""
    spark = edges.sparkSession
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("host"), "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("host"), "links")
    )
    total = both.groupBy("kind", "giver").agg(F.sum("links").alias("all_links"))
    moves, moves_path = keep(both.join(total, ["kind", "giver"]).select("kind", "giver", "host", (damping * F.col("links") / F.col("all_links")).alias("part")), "moves")
    own = ((1 - damping) * F.col("seed")).cast("double")
    rank, path = keep(seeds.select("kind", "host", own.alias("step"), own.alias("seed")), "ranks")
    hosts, more = rank.count(), not moves.isEmpty()
    while more:
        last = path
        for _ in range(KEEP_EVERY):
            given = moves.join(rank.select("kind", F.col("host").alias("giver"), "step"), ["kind", "giver"]).select("kind", "host", (F.col("part") * F.col("step")).alias("step"))
            rows = given.withColumn("seed", F.col("step")).unionByName(rank.select("kind", "host", F.lit(0.0).alias("step"), "seed"))
            rank = rows.groupBy("kind", "host").agg(F.sum("step").alias("step"), F.sum("seed").alias("seed"))
        rank, path = keep(rank, "ranks")
        remove(spark, last)
        now = rank.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("step")).first()
        # a step gives on at most damping times what it got, so all later ones at most damping / (1 - damping) of it
        more, hosts = now.hosts > hosts or now.step * damping / (1 - damping) > tolerance, now.hosts
    remove(spark, moves_path)
    return rank.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("seed"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("seed"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust, host_distrust for every page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    mine = ruled.where("by_rule is not null").groupBy("host", "by_rule").agg(F.count("*").alias("n"))
    sums = mine.groupBy("by_rule").agg(F.sum("n").alias("total"))
    seeds = mine.join(sums, "by_rule").select(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("n") / F.col("total")).alias("seed"))
    scores, _ = keep(spread(host_edges(pages), seeds, tolerance, damping), "hosts")
    few = scores.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    doubted = F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0))
    return ruled.join(F.broadcast(scores) if few else scores.hint("merge"), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(doubted, "block").otherwise("allow")).alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("host_trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("host_distrust"))


def judge_sql(rules=RULES, damping: float = DAMPING, ratio: float = RATIO) -> str:
    """DuckDB SQL for judge() over the view pages; a host's share is given on until it is under 1e-30."""
    whens, verdicts = [], []
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        whens.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{says}'")
    return f"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
ruled AS (SELECT page_id, html, host, path, CASE {' '.join(whens)} END AS rule, CASE {' '.join(verdicts)} END AS by_rule FROM parts),
mine AS (SELECT host, by_rule, count(*) AS n FROM ruled WHERE by_rule IS NOT NULL GROUP BY ALL),
seeds AS MATERIALIZED (SELECT CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
  n::DOUBLE / sum(n) OVER (PARTITION BY by_rule) AS seed FROM mine),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1, 'i')), '{UPPER}', '{LOWER}') AS dst FROM ruled),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src AS giver, dst AS host, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
moves AS MATERIALIZED (SELECT kind, giver, host, links::DOUBLE / sum(links) OVER (PARTITION BY kind, giver) AS part FROM both_ways),
flow AS (SELECT kind, host, (1 - CAST({damping} AS DOUBLE)) * seed AS seed FROM seeds
  UNION ALL SELECT kind, host, seed FROM (
    SELECT m.kind, m.host, sum(CAST({damping} AS DOUBLE) * m.part * f.seed) AS seed FROM flow f JOIN moves m ON m.kind = f.kind AND m.giver = f.host GROUP BY m.kind, m.host) WHERE seed > 1e-30),
scores AS (SELECT host, coalesce(sum(seed) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(seed) FILTER (kind = 'distrust'), 0) AS distrust FROM flow GROUP BY host)
SELECT page_id, ruled.host AS host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > CAST({ratio} AS DOUBLE) * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0.0::DOUBLE), 6) AS host_trust, round(coalesce(distrust, 0.0::DOUBLE), 6) AS host_distrust
FROM ruled LEFT JOIN scores ON scores.host = ruled.host"""
