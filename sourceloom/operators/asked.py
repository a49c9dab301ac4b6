"""Query tables: each row a question as it was typed, with what a model takes it to be about, made into what the search needs.

All parts are expressions over the row's arrays; only whether two tokens match by stem, beginning or likeness comes from a small Arrow helper, which
is asked for the few tokens of a query.  A service that handles one query at a time takes the one row (``one``)."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions import fixed as fx, fuzzy as fz, text as tx
from .validation import comparable

MARKS = ",.!?;:\"'()[]{}"
RUN = "[A-Za-z0-9+#.]+"


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _match_flags(tokens: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([[any(fz.kept_match(t, o) for o in os) for t in ts] for ts, os in zip(tokens, others, strict=True)], dtype=object)


def match_flags(tokens: str, others: str) -> Column:
    """For each token whether it matches one of the others.  Not said to be deterministic, so that it is not moved into the lambdas that use it."""
    return _match_flags.asNondeterministic()(tokens, others)


def _texts(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _where(items: Column, flags: Column, wanted: bool) -> Column:
    return F.filter(items, lambda _, i: F.get(flags, i) == F.lit(wanted))


def topic_wording(text: Column) -> Column:
    """A question lower-cased, without the wording around its topic."""
    out = F.lower(tx.clean(text))
    for pattern in fx.FILLERS:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _is_level(word: Column) -> Column:
    return F.btrim(word, F.lit(MARKS)).isin(*fx.LEVEL_WORDS)


def without_level(words: Column) -> Column:
    return comparable(F.array_join(F.filter(words, lambda w: ~_is_level(w)), " "))


def level_words(words: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words, _is_level), lambda w: F.btrim(w, F.lit(MARKS))))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def protected(text: Column, generic: Iterable[str] = fx.GENERIC) -> Column:
    """Tokens of two to eight characters that stay as they are: in capitals, with digits or signs, or of five at most and not generic."""
    short = F.filter(runs(tx.clean(text)), lambda t: F.length(t).between(2, 8))
    stays = lambda t: ((t == F.upper(t)) & (t != F.lower(t))) | t.rlike("[0-9+#.]") | ((F.length(t) <= 5) & ~F.lower(t).isin(*generic))
    return F.array_distinct(F.transform(F.filter(short, stays), F.lower))


def concept_tokens(text: Column, generic: Iterable[str] = fx.GENERIC) -> Column:
    """Distinct tokens that carry meaning: protected ones, and those of three letters or more that are not generic; else all of two or more."""
    every = F.array_distinct(tx.light_tokens(tx.clean(text)))
    core = tx.let(protected(text, generic), lambda kept: F.filter(every, lambda t: F.array_contains(kept, t) | ((F.length(t) > 2) & ~t.isin(*generic))))
    return tx.let(core, lambda c: F.when(F.size(c) > 0, c).otherwise(F.filter(every, lambda t: F.length(t) >= 2)))


def meaningful_runs(words: Column, generic: Iterable[str]) -> Column:
    """Distinct words that are not generic; a word that forms compounds stays where one that means something is its neighbour."""
    means = lambda w: F.coalesce((F.length(w) >= 2) & ~w.isin(*generic), F.lit(False))
    compound = lambda w, i: (F.length(w) >= 2) & w.isin(*fx.COMPOUND_WORDS) & (means(F.get(words, i - 1)) | means(F.get(words, i + 1)))
    return F.array_distinct(F.filter(words, lambda w, i: means(w) | compound(w, i)))


def abbreviations(tokens: Column, text: Column) -> Column:
    """Those of two to five characters that the text has in capitals, or that are letters without a vowel, or two to four letters with one."""
    capitals = F.transform(F.filter(runs(text), lambda w: (w == F.upper(w)) & (w != F.lower(w))), F.lower)
    looks = lambda t: t.rlike("^[b-df-hj-np-tv-xz]+$") | t.rlike("^(?=[a-z]{2,4}$)[b-df-hj-np-tv-xz]*[aeiouy][b-df-hj-np-tv-xz]*$")
    return tx.let(capitals, lambda c: F.filter(tokens, lambda t: F.length(t).between(2, 5) & ~t.rlike("^[0-9]+$") & (F.array_contains(c, t) | looks(t))))


def by_length(tokens: Column) -> Column:
    return F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def specificity(tokens: Column) -> Column:
    """How much tokens narrow a search, by their number and mean length."""
    n = F.size(tokens)
    mean = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t)) / n
    value = F.least(F.lit(1.0), F.least(F.lit(0.55), 0.15 * n) + F.least(F.lit(0.25), F.greatest(F.lit(0.0), (mean - 4.0) * 0.08)) + F.when(n > 1, 0.15).otherwise(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(value)


def _of_map(key: Column, values: dict[str, tuple[str, ...]]) -> Column:
    out = _texts(())
    for name, items in values.items():
        out = F.when(key == name, _texts(items)).otherwise(out)
    return out


FIELDS = ("query", "phrase", "tokens", "fingerprint", "level_words", "typed", "abbreviations", "qualifiers", "added", "source_types", "level", "intent", "origin", "specificity", "specific", "concept")


def profiled(queries: DataFrame, key: str, text: str, generic: Iterable[str] = fx.GENERIC) -> DataFrame:
    """``key`` and FIELDS of each query.  The table may have ``concept``, ``level``, ``intent`` (strings) and ``preserve`` (strings that must stay) besides the text."""
    generic = tuple(generic)
    asked = lambda name, none: F.coalesce(F.col(name), none) if name in queries.columns else none
    one_of = lambda name, known: tx.let(F.lower(F.trim(asked(name, F.lit("")))), lambda v: F.when(v.isin(*known), v).otherwise(""))
    said = F.array_distinct(F.filter(F.transform(asked("preserve", _texts(())), lambda p: F.trim(p)), lambda p: p != ""))
    rows = queries.select(F.col(key), tx.clean(F.col(text)).alias("query"), asked("concept", F.lit("")).alias("_about"), one_of("level", fx.LEVEL_TYPES).alias("level"), one_of("intent", fx.INTENT_TYPES).alias("intent"), said.alias("_keep"))
    rows = rows.withColumns({"_own": F.split(topic_wording(F.col("query")), " "), "_taken": F.split(topic_wording(F.when(F.col("_about") != "", F.col("_about")).otherwise(F.col("query"))), " ")})
    rest = without_level(F.col("_taken"))
    says = lambda r: F.exists(tx.light_tokens(r), lambda t: ~t.isin(*generic) & (F.length(t) >= 3))
    typed = F.array_distinct(F.filter(F.transform(runs(without_level(F.col("_own"))), F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*fx.LEVEL_WORDS, *generic)))
    rows = rows.withColumns({"phrase": tx.let(rest, lambda r: F.when(says(r), r).otherwise("")), "level_words": level_words(F.col("_taken")), "typed": typed})
    rows = rows.withColumns({"_runs": F.transform(runs(F.col("phrase")), F.lower), "abbreviations": abbreviations(F.col("typed"), F.col("query"))})
    rows = rows.withColumn("_all", meaningful_runs(F.col("_runs"), generic))
    # a model may add one token to those that were typed
    limit = (F.size("typed") > 0) & (F.size("abbreviations") == 0) & (F.size("_all") > F.size("typed") + 1)
    rows = rows.withColumn("_mine", match_flags("_all", "typed"))
    cut = tx.let(F.slice(_where(F.col("_all"), F.col("_mine"), False), 2, 1_000_000), lambda more: F.filter("_all", lambda t: ~F.array_contains(more, t)))
    rows = rows.withColumn("_some", F.when(limit, tx.let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(F.col("_all")))).otherwise(F.col("_all"))).withColumn("_low", F.transform("_keep", F.lower))
    rows = rows.withColumn("_there", match_flags("_low", "_some"))
    rows = rows.withColumn("tokens", F.when(F.size("_some") > 0, F.concat("_some", _where(F.col("_low"), F.col("_there"), False))).otherwise(F.col("_some")))
    rows = rows.withColumn("_kept", match_flags("tokens", "_low"))
    rows = rows.withColumns({"qualifiers": _where(F.col("tokens"), F.col("_kept"), True), "fingerprint": by_length(F.col("tokens")), "added": F.filter("tokens", lambda t: ~F.array_contains("typed", t))})
    by_typed = (F.size("typed") > 0) & (F.size("abbreviations") == 0)
    rows = rows.withColumn("specificity", specificity(F.when(by_typed, F.col("typed")).otherwise(F.col("tokens"))))
    low = F.lower("query")
    more = (F.size("qualifiers") > 0) | (F.size("abbreviations") > 0) | ((F.size("typed") > 0) & (F.size("tokens") > F.size("typed")))
    nothing = F.when((F.size("_keep") > 0) & (F.col("_about") == "") & (low == ""), "qualified").otherwise("unknown")
    origin = F.when(F.size("tokens") == 0, nothing).when(more, "qualified").when(low == "", "unknown").when(F.forall("tokens", lambda t: F.contains(low, t)), "fixed").otherwise("qualified")
    types = F.array_distinct(F.concat(_of_map(F.col("intent"), fx.INTENT_TYPES), _of_map(F.col("level"), fx.LEVEL_TYPES)))
    rows = rows.withColumns({"origin": origin, "specific": F.col("specificity") >= 0.30, "source_types": tx.let(types, lambda t: F.when(F.size(t) > 0, t).otherwise(_texts(fx.DEFAULT_TYPES))), "concept": concept_tokens(F.col("query"), generic)})
    return rows.select(key, *FIELDS)


def one(spark: SparkSession, query: str, concept: str = "", level: str = "", intent: str = "", preserve: Iterable[str] = (), generic: Iterable[str] = fx.GENERIC) -> Row:
    """The profile of a single query."""
    rows = spark.createDataFrame([(0, query, concept, level, intent, list(preserve))], "k int, q string, concept string, level string, intent string, preserve array<string>")
    return profiled(rows, "k", "q", generic).first()
