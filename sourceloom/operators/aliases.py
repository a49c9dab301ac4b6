"""Texts against a dictionary of aliases, as a hash join of word n-grams.

A dictionary is a DataFrame (alias, domain, and where order matters priority), loaded by ``readers.dimension`` or derived from data.  A text's runs of the lengths (in words) that aliases have
become rows (place, gram), and an equi-join finds the aliases among them, so neither the plan nor its expressions depend on how many aliases there are.  The dictionary is broadcast
if it is small (a counted number), else both sides are shuffled by gram, and adaptive execution splits a gram that very many texts have.

Aliases and texts are compared as words of a-z, 0-9, + and #, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..sources import store

BROADCAST_ALIASES = 200_000
WORTH_SEVERAL, WORTH_SHORT, WORTH_WORD, WORTH_CONCEPT, WORTH_KEYWORD = 0.48, 0.30, 0.38, 0.22, 0.10
INTENT_DOMAINS = ("education", "general")


def plain(text: Column) -> Column:
    return tx.ascii_words(text, "a-z0-9+#")


def dictionary(aliases: DataFrame) -> DataFrame:
    """alias (plain), domain, n_words, each alias once: the domain with the smallest name where several claim it."""
    rows = aliases.select(plain(F.col("alias")).alias("alias"), "domain").where("alias <> ''")
    return rows.groupBy("alias").agg(F.min("domain").alias("domain")).withColumn("n_words", F.size(F.split("alias", " ")))


def runs(words: Column, n: int) -> Column:
    """A list's runs of n words, each as one string: those of one word less, each with the word after it."""
    out = words
    for i in range(1, n):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(words) - i, F.lit(0))), F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return out


def grams(words: Column, sizes: list[int]) -> Column:
    """Structs (place, gram) of a list's runs of the given lengths."""
    return F.concat(*[F.transform(runs(words, n), lambda x, i: F.struct(i.alias("place"), x.alias("gram"))) for n in sizes])


def _known(aliases: DataFrame) -> tuple[DataFrame, list[int]]:
    """The dictionary, to be broadcast if it is small, and the lengths of its aliases (as many rows as lengths)."""
    known = dictionary(aliases)
    few = known.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    return F.broadcast(known) if few else known, sorted(r.n_words for r in known.select("n_words").distinct().collect()) or [1]


def hits(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, alias, domain, n_words and place (words before it) of every occurrence of an alias in a text."""
    known, sizes = _known(aliases)
    words = F.split(plain(F.col(text)), " ")
    found = texts.select(F.col(key).alias("_key"), F.explode(tx.let(words, lambda w: grams(w, sizes))).alias("_at"))
    return found.select("_key", "_at.place", F.col("_at.gram").alias("alias")).join(known, "alias").select(F.col("_key").alias(key), "alias", "domain", "n_words", "place")


def aliases_in(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, alias, domain and n_words of every alias in a text, each once: repeats go before there are rows."""
    known, sizes = _known(aliases)
    words = F.split(plain(F.col(text)), " ")
    found = texts.select(F.col(key).alias("_key"), F.explode(tx.let(words, lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in sizes])))).alias("alias"))
    return found.join(known, "alias").select(F.col("_key").alias(key), "alias", "domain", "n_words")


def scores(found: DataFrame, texts: DataFrame, key: str, concept: Column, keywords: Column) -> DataFrame:
    """key, domain, score (0.98 at most) from hits: 0.48 for an alias of several words, 0.30 for up to three letters, else 0.38; more if the concept or a keyword holds it."""
    once = found.groupBy(key, "domain", "alias").agg(F.max("n_words").alias("n_words"))
    asked = texts.select(key, F.lower(concept).alias("_concept"), F.transform(keywords, F.lower).alias("_keywords"))
    alias = F.col("alias")
    worth = F.when(F.col("n_words") > 1, WORTH_SEVERAL).when(F.length(alias) <= 3, WORTH_SHORT).otherwise(WORTH_WORD)
    more = F.when(F.contains("_concept", alias), WORTH_CONCEPT).otherwise(0.0) + F.when(F.exists("_keywords", lambda k: F.contains(k, alias)), WORTH_KEYWORD).otherwise(0.0)
    return once.join(asked, key).groupBy(key, "domain").agg(F.least(F.lit(0.98), F.round(F.sum(worth + more), 6)).alias("score"))


def detected(scored: DataFrame, key: str, priorities: DataFrame, least: float = 0.25, most: int = 4) -> DataFrame:
    """key and domains, a list of (domain, confidence): those scored enough, the best first (then by priority and name), without the ones that say only what for; at most ``most``.

    Texts without any are not there."""
    rows = scored.where((F.col("score") >= least) & ~F.col("domain").isin(*INTENT_DOMAINS)).join(F.broadcast(priorities.select("domain", "priority")), "domain", "left")
    item = F.struct((-F.col("score")).alias("s"), F.coalesce("priority", F.lit(100)).alias("p"), F.col("domain").alias("d"))
    listed = rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("_l"))  # a row a domain
    return listed.select(key, F.transform("_l", lambda x: F.struct(x["d"].alias("domain"), F.round(-x["s"], 4).alias("confidence"))).alias("domains"))


def tagged(texts: DataFrame, key: str, text: str, title: Column, aliases: DataFrame, priorities: DataFrame) -> DataFrame:
    """key, domain, topic of every text: by its longest alias of three letters or more (of equals the first by name), else what is detected, else general; the topic is the alias or from the title.

    Texts are searched once, and what is found is written."""
    found = store.written(aliases_in(texts, key, text, aliases), "hits")
    longest = F.min(F.when(F.length("alias") >= 3, F.struct((-F.length("alias")).alias("n"), "alias", "domain")))
    first = found.groupBy(key).agg(longest.alias("hit")).where("hit IS NOT NULL")
    others = found.join(first, key, "left_anti")
    seen = detected(scores(others, texts, key, title, F.array().cast("array<string>")), key, priorities)
    rows = texts.select(key, tx.short_topic(title).alias("_topic")).join(first, key, "left").join(seen, key, "left")
    return rows.select(key, F.coalesce("hit.domain", F.get("domains", F.lit(0))["domain"], F.lit("general")).alias("domain"), F.coalesce("hit.alias", "_topic").alias("topic"))


def resolved(rows: DataFrame, key: str, names: Column, aliases: DataFrame) -> DataFrame:
    """key and domains, each once, in the order of the first name (whole, not a part of it) that stands for it."""
    known = dictionary(aliases)
    few = known.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    each = rows.select(key, F.posexplode(names).alias("_place", "_name")).select(key, "_place", plain(F.col("_name")).alias("alias"))
    first = each.join(F.broadcast(known) if few else known, "alias").groupBy(key, "domain").agg(F.min("_place").alias("_place"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "domain"))), lambda x: x["domain"]).alias("domains"))
