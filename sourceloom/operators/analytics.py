"""Roll-ups over catalogs, runs, ledgers, platforms and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx


def catalog(sources: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n: all group-bys and the total as grouping sets, unknown values named before they are grouped."""
    rows = sources.select(*[F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit("unknown")).alias(d) for d in dimensions])
    sets = rows.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(F.count("*").alias("n"), F.grouping_id(*dimensions).alias("which"))
    # a set's number has a bit for each column that it leaves out
    full = (1 << len(dimensions)) - 1
    of = lambda i: full - (1 << (len(dimensions) - 1 - i))
    name, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dimensions):
        name, value = F.when(F.col("which") == of(i), F.lit(d)).otherwise(name), F.when(F.col("which") == of(i), F.col(d)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def top_of_each(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def with_share(df: DataFrame, count: str, of: Column) -> DataFrame:
    """Adds each row's share of an aggregate over all rows, by a one-row join."""
    total = df.agg(of.alias("_t"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col(count) / F.col("_t"), 6)).drop("_t")


def usage(entries: DataFrame) -> DataFrame:
    """Token sums by model, by category and in all: one grouping-sets aggregate.  Totals of 0 or less are ignored."""
    rows = entries.where("tokens > 0")
    return rows.groupingSets([["model"], ["category"], []], "model", "category").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("calls"), F.round(F.avg("latency"), 4).alias("mean_latency"))


def running_budget(entries: DataFrame, cap: int, partition: str = "user_id") -> DataFrame:
    """Running spend of each owner in time order, the part under the cap, and a warning level at 80 and 95 percent."""
    w = W.partitionBy(partition).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum("tokens").over(w)
    return entries.withColumn("spent", spent).withColumn("capped", F.least("spent", F.lit(cap))).withColumn("level", F.when(F.col("spent") >= 0.95 * cap, "critical").when(F.col("spent") >= 0.8 * cap, "warning").otherwise("ok"))


def failure_runs(outcomes: DataFrame, key: str = "user_id") -> DataFrame:
    """Lengths of unbroken failures (gaps and islands) and the cooldown seconds they earn: 300, 600, 1200, 1800.  Empty outcomes
    neither break a run nor lengthen it."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    rows = outcomes.where("outcome <> 'empty'").withColumn("good", (F.col("outcome") == "ok").cast("int"))
    rows = rows.withColumn("island", F.sum("good").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.where("outcome = 'failed'").groupBy(key, "island").agg(F.count("*").alias("failures"))
    return runs.withColumn("cooldown", F.when(F.col("failures") >= 4, 1800).when(F.col("failures") == 3, 1200).when(F.col("failures") == 2, 600).otherwise(300))


def strategies(events: DataFrame) -> DataFrame:
    """Per strategy: uses, mean quality, whole mean tokens, best quality of successes, success rate."""
    return events.groupBy("strategy").agg(
        F.count("*").alias("uses"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.floor(F.avg("tokens")).cast("long").alias("mean_tokens"),
        F.round(F.coalesce(F.max(F.when(F.col("success"), F.col("quality"))), F.lit(0.0)), 4).alias("best_quality"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"),
    )


def term_weights(docs: DataFrame, title: str = "title", shortest: int = 4) -> DataFrame:
    """tf * idf of title tokens: term, tf, df, weight."""
    rows = docs.select("ordinal", F.explode(F.filter(tx.tokens(F.col(title)), lambda t: F.length(t) >= shortest)).alias("term"))
    terms = rows.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("ordinal").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return terms.crossJoin(F.broadcast(n)).withColumn("weight", F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))).drop("n")


def related_terms(docs: DataFrame, topic: str, title: str = "title") -> DataFrame:
    """Terms of the titles that have the topic, by number of documents."""
    toks = docs.select(tx.tokens(F.col(title)).alias("t")).where(F.array_contains("t", topic))
    return toks.select(F.explode(F.array_distinct("t")).alias("term")).where(F.col("term") != topic).groupBy("term").agg(F.count("*").alias("docs"))


def allocated(items: DataFrame, weight: str, total: int, key: str, reserve: float = 0.15, least: int = 500) -> DataFrame:
    """Whole-number shares of a total after a reserve, by weight, none under the least; where that is more than there is, all give up an
    equal part of what is too much, but not below the least."""
    share = total - int(total * reserve)
    s = items.agg(F.sum(weight).alias("_s"))
    rows = items.crossJoin(F.broadcast(s)).select(key, weight, F.greatest(F.lit(least).cast("long"), F.floor(F.col(weight) / F.col("_s") * share).cast("long")).alias("budget"))
    over = rows.agg((F.sum("budget") - share).alias("_over"), F.count("*").alias("_n"))
    cut = F.greatest(F.lit(least).cast("long"), F.col("budget") - F.floor(F.col("_over") / F.col("_n")))
    return rows.crossJoin(F.broadcast(over)).withColumn("budget", F.when(F.col("_over") > 0, cut).otherwise(F.col("budget")).cast("long")).drop("_over", "_n")


def rebalanced(budgets: DataFrame) -> DataFrame:
    """budgets (budget, done, unused): what finished tasks left over goes to the others in equal parts."""
    free = budgets.agg(F.sum(F.when(F.col("done"), F.col("unused")).otherwise(0)).alias("_free"), F.count_if(~F.col("done")).alias("_left"))
    more = F.when(~F.col("done") & (F.col("_left") > 0), F.floor(F.col("_free") / F.col("_left"))).otherwise(0)
    return budgets.crossJoin(F.broadcast(free)).withColumn("budget", (F.col("budget") + more).cast("long")).drop("_free", "_left")


def sessions(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """Sessions of events with gaps under the given seconds: key, session start, end and events."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.withColumn("fresh", (F.coalesce(micros(F.col("ts")) - micros(F.lag("ts").over(w)), F.lit(1 << 60)) >= gap_seconds * 1_000_000).cast("int"))
    rows = rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"))
