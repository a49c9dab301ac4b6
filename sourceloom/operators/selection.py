"""Gates with rescue, quotas, bands and votes over scored records (ordinal breaks ties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best_of(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.max(score).alias("best"))


def gated(df: DataFrame, score: str, floor: Column, at_least: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows at or above the floor (an expression of the column best); if under at_least rows pass, the best of the others fill up.

    What passes are the top rows, so the result is the rows above the floor or among the first at_least.  One top-k gives both the
    best score and the last of those rows, and no window runs over all rows.  Adds ``rescued``."""
    place = F.struct(F.col(score).alias("s"), (-F.col(ordinal)).alias("o"))
    top = df.orderBy(F.desc(score), ordinal).limit(at_least).agg(F.max(score).alias("best"), F.min(place).alias("_last"))
    rows = df.crossJoin(F.broadcast(top)).withColumn("rescued", F.col(score) < floor)
    return rows.where(~F.col("rescued") | (place >= F.col("_last"))).drop("best", "_last")


def first_of_each(df: DataFrame, group: str, order: list[Column], n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each group, first of each of its parts and then of what those give, so that a group that holds most rows
    is not one task's work."""
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    few = salted.withColumn("_g", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))).where(F.col("_g") <= n)
    return few.drop("_part").withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_g") <= n).drop("_g")


def retention_ratio(n_tokens: int, ratio: float = 0.65) -> float:
    """The share of the best relevance that a record must reach: the more tokens a query has, the less."""
    return min(ratio, 0.20 if n_tokens >= 5 else 0.25 if n_tokens == 4 else 0.30 if n_tokens == 3 else 0.35)


def relevance_floor(n_tokens: int, least: float = 0.05) -> Column:
    return F.greatest(F.col("best") * retention_ratio(n_tokens), F.lit(least))


def head_share(title: Column, tokens: list[str], share: float = 0.7) -> Column:
    """The share of the tokens that the first words of a title have: 70 % of them, two at least."""
    words = F.filter(F.split(F.trim(F.lower(title)), " +"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, F.greatest(F.lit(2), F.floor(F.size(words) * share).cast("int"))), " ")
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(sum((head.contains(t).cast("int") for t in tokens), F.lit(0)) / max(1, len(tokens)))


def on_topic(matched: Column, title: Column, tokens: list[str], least: int = 1, coverage: float = 0.05, head: float = 0.25) -> Column:
    """Whether a record has enough of the query's tokens, and its title's beginning a quarter of them."""
    return ((matched >= least) | (matched / max(1, len(tokens)) >= coverage)) & (head_share(title, tokens) >= head)


def passing(df: DataFrame, passes: Column, at_least: int, *order: Column) -> DataFrame:
    """The rows that pass; if under at_least do, the first of the others in an order fill up.  Adds ``rescued``."""
    rows = df.withColumn("rescued", ~F.coalesce(passes, F.lit(False)))
    n = rows.agg(F.count_if(~F.col("rescued")).alias("_n"))
    spare = rows.where("rescued").orderBy(*order).limit(at_least).withColumn("_k", F.row_number().over(W.orderBy(*order)))
    return rows.where("not rescued").unionByName(spare.crossJoin(F.broadcast(n)).where(F.col("_n") + F.col("_k") <= at_least).drop("_n", "_k"))


def beginner_rescue(kept: DataFrame, dropped: DataFrame, is_beginner: Column, ratio: float = 0.55, least: float = 0.15, most: int = 3) -> DataFrame:
    """kept with up to ``most`` of the dropped beginners' records (score, confidence, relevance) if it has none: those of enough relevance,
    their score raised to a share of the best."""
    state = kept.agg(F.max("score").alias("_best"), F.coalesce(F.bool_or(is_beginner), F.lit(False)).alias("_has"))
    wanted = dropped.where(is_beginner & (F.col("relevance") >= least)).crossJoin(F.broadcast(state)).where(~F.col("_has") & (F.col("_best") > 0))
    raised = wanted.withColumn("score", F.greatest("score", F.col("_best") * ratio)).drop("_best", "_has")
    return kept.unionByName(raised.orderBy(F.desc("score"), F.desc("confidence"), "ordinal").limit(most))


def per_group(df: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    return df.withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_g") <= cap).drop("_g")


def quota_fill(df: DataFrame, group: str, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """floor(limit / groups) a group first, in input order, then the rest in input order, up to the limit; with its position."""
    quota = df.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.count_distinct(group)))).alias("quota"))
    # rows beyond the limit in their group can't be taken
    near = per_group(df, group, [F.asc(ordinal)], limit).withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(ordinal)))
    placed = near.crossJoin(F.broadcast(quota)).withColumn("_over", F.col("_g") > F.col("quota")).drop("_g", "quota")
    top = placed.orderBy("_over", ordinal).limit(limit)
    return top.withColumn("position", F.row_number().over(W.orderBy("_over", ordinal)).cast("long")).drop("_over")


def banded(df: DataFrame, band: Column, score: str, confidence: str, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """The first rows by band, score and confidence, numbered."""
    order = [F.asc("band"), F.desc(score), F.desc(confidence), F.asc(ordinal)]
    return df.withColumn("band", band).orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def majority(votes: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """votes (task, voter, items: array of (id, score)) -> task, mode, print, n_votes: strict if enough voters agree on ids and
    scores to two places in order, else loose if they agree on ids, else disagreement."""
    prints = votes.select("task", F.sha2(F.array_join(F.transform("items", lambda x: F.concat(x["id"], F.lit(":"), F.format_number(x["score"], 2))), "|"), 256).alias("strict"), F.sha2(F.array_join(F.transform("items", lambda x: x["id"]), "|"), 256).alias("loose"))
    n = prints.groupBy("task").agg(F.count("*").alias("n"))

    def best(kind: str) -> DataFrame:
        return prints.groupBy("task", kind).agg(F.count("*").alias("k")).groupBy("task").agg(F.max(F.struct("k", F.col(kind).alias("print"))).alias(f"best_{kind}"))

    rows = n.join(best("strict"), "task").join(best("loose"), "task")
    enough = lambda c: (F.col(f"best_{c}.k") >= least) & (F.col(f"best_{c}.k") / F.col("n") >= share)
    return rows.select("task", F.when(enough("strict"), "strict").when(enough("loose"), "loose").otherwise("disagreement").alias("mode"), F.when(enough("strict"), F.col("best_strict.print")).when(enough("loose"), F.col("best_loose.print")).alias("print"), F.when(enough("strict"), F.col("best_strict.k")).when(enough("loose"), F.col("best_loose.k")).otherwise(F.lit(0)).alias("n_votes"))


def better_vote(votes: DataFrame, by: float = 0.10) -> DataFrame:
    """votes (task, voter, fit, final) -> task, voter: the vote of the best fit, the first voter's of equal ones, if it is over the final
    one's by more than ``by``; else null."""
    best = votes.groupBy("task").agg(F.max(F.struct("fit", (-F.col("voter")).alias("v"))).alias("b"), F.max("final").alias("final"))
    return best.select("task", F.when(F.col("b.fit") > F.col("final") + by, -F.col("b.v")).alias("voter"))


def split_by_level(df: DataFrame, first: Column, limit: int, share: float, group: str = "platform", ordinal: str = "ordinal") -> DataFrame:
    """A share of the limit from the rows that are ``first``, the rest from the others, each by quota_fill; if a pool has too few, rows that
    were not taken fill up in input order.  Adds ``pool``."""
    n = round(limit * share)
    a = quota_fill(df.where(first), group, n, ordinal).drop("position").withColumn("pool", F.lit("beginner"))
    b = quota_fill(df.where(~F.coalesce(first, F.lit(False))), group, limit - n, ordinal).drop("position").withColumn("pool", F.lit("other"))
    taken = a.unionByName(b)
    spare = df.orderBy(ordinal).limit(2 * limit).join(F.broadcast(taken.select(ordinal)), ordinal, "left_anti").withColumn("pool", F.lit("filled"))
    spare = spare.withColumn("_k", F.row_number().over(W.orderBy(ordinal))).crossJoin(F.broadcast(taken.agg(F.count("*").alias("_n"))))
    return taken.unionByName(spare.where(F.col("_k") <= limit - F.col("_n")).drop("_k", "_n"))
