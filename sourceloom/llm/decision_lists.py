"""Quality rules learned as a decision list from labelled documents.

Native DataFrame operations only.  A text's statistics are counts of words, characters, symbols, repeated lines and repeated passages (``STATISTICS``),
and from them whole numbers a reader can judge, mostly parts in a thousand (``MEASURES``).  A list of rules is learned by sequential covering over labelled
documents, two thirds of which grow rules while one third prunes them:

* A rule starts without conditions.  Each step adds the threshold condition with the largest gain, p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))), where p and n
  are the bad and clean growing documents it still covers; thresholds are quantiles of the growing documents.
* The rule is cut back to the prefix with the largest (p - n) / (p + n) on the pruning documents, the shorter of equals.
* It joins the list if it covers ``min_cover`` bad pruning documents and is right for ``precision`` of those it covers, in either part.  The documents it covers go,
  and the next is grown from the rest.  The first rule that does not suffice ends the list.

The list is one ordered conditional expression: the first rule that fits rejects a document, and what none fits is kept.  One more statistic is learned: ``n_marked``
counts the words that labelled bad documents have and clean ones hardly do (a log-likelihood ratio of at least ``MARKED_LEAST`` and at most ``MAX_MARKED`` words).

All documents are measured, each by itself, without a shuffle; a text's words are held as one array.  Labelled documents are bounded by ``max_labelled``, those
whose words are compared by ``max_word_docs``, in the order of hashes of their ids.  Only counts by measure and threshold come to the driver.

Cases: a null text has no words, lines or symbols; texts under 50 words or with over half of their words in repeated passages fail the base and are rejected without a rule;
null labels do not count; a document with several labels is bad if one of them says so; without bad or clean labelled documents there are no rules; null doc_ids are measured, never
labelled; each row is judged by itself, also where ids repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import keep, remove

MAX_LABELLED, MAX_WORD_DOCS = 200_000, 20_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 24
PRECISION, MIN_COVER = 0.95, 3
MAX_MARKED, MARKED_LEAST, MARKED_DOCS = 64, 40.0, 5
LEAST_WORDS, MOST_REPEATED = 50, 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_digits", "n_distinct", "n_marked")
BLANK = r"[ \t-\r]"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeated_words(w: Column, window: int = 3) -> Column:
    """How many words lie in a window of words that the text has at least twice.

    Windows are sorted by hash, those with an equal neighbour are repeated, and their places, sorted, cover up to ``window`` words each."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(window)]).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, j: F.coalesce(F.least(F.lit(window), F.get(p, j + 1) - i), F.lit(window))), F.lit(0), lambda n, x: n + x)

    return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(F.sort_array(hashed), lambda s: let(places(s), covered)))


def _fewer(text: Column, characters: str) -> Column:
    """How many characters of an ASCII class a text has."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{characters}]+", ""))


def marked_pattern(marked: list[str]) -> str:
    return r"(?<!\p{L})(?:" + "|".join(map(re.escape, marked)) + r")(?!\p{L})"


def measured(docs: DataFrame, marked: list[str] = ()) -> DataFrame:
    """doc_id and STATISTICS of every document, as long."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    hits = F.regexp_count(F.lower("t"), F.lit(marked_pattern(marked))) if marked else F.lit(0)
    counted = let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    own = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.select("doc_id", text.alias("t")).select(
        "doc_id", counted.alias("w"), own.alias("l"), _fewer(F.col("t"), "#*$%&|<>").alias("n_symbols"), _fewer(F.col("t"), "A-Z").alias("n_upper"), _fewer(F.col("t"), ".!?").alias("n_stops"), _fewer(F.col("t"), "0-9").alias("n_digits"), hits.alias("n_marked")
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_stops", "n_digits", "n_marked")
    return out.select("doc_id", *[F.col(s).cast("long") for s in STATISTICS])


def _share(part: str, whole: str, times: int = 1000) -> str:
    return f"CASE WHEN {whole} > 0 THEN {times} * {part} DIV {whole} ELSE 0 END"


#: What rules may ask, as whole numbers (SQL expressions of STATISTICS).
MEASURES = {
    "words": "n_words",
    "letters a word, in hundredths": _share("word_chars", "n_words", 100),
    "symbols in 1000 words": _share("n_symbols", "n_words"),
    "repeated lines in 1000": _share("n_dup_lines", "n_lines"),
    "repeated words in 1000": _share("n_repeat_words", "n_words"),
    "distinct words in 1000": _share("n_distinct", "n_words"),
    "words a line, in tenths": _share("n_words", "n_lines", 10),
    "capitals in 1000 characters": _share("n_upper", "word_chars"),
    "stops in 1000 words": _share("n_stops", "n_words"),
    "digits in 1000 characters": _share("n_digits", "word_chars"),
    "marked words": "n_marked",
}


@dataclass(frozen=True, order=True)
class Condition:
    """A measure that is at least, or under, a threshold."""

    measure: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def fits(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def named(rule: Rule) -> str:
    return " and ".join(map(str, rule))


def decided(rules: list[Rule]) -> Column:
    """The first rule that fits, as text; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(fits(rule), F.lit(named(rule))).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _known(labels: DataFrame, most: int) -> DataFrame:
    """id and bad (0 or 1) of at most so many labelled documents, a documented bound."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most)


def marked_words(docs: DataFrame, labels: DataFrame, max_word_docs: int = MAX_WORD_DOCS, most: int = MAX_MARKED, least: float = MARKED_LEAST) -> list[str]:
    """Words (runs of letters, lower-cased) typical of bad documents, the most typical first.

    A word counts once for each word that it follows in bad and in clean documents, so a passage that is copied many times counts as one; and these must
    first come in at least ``MARKED_DOCS`` documents (told apart by 64 classes of their ids), so one odd document marks no words.
    """
    known = _known(labels, max_word_docs)
    own = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    runs = own.select("id", "bad", F.array_remove(F.split(F.lower("text"), r"\P{L}+"), "").alias("runs"))
    each = runs.select("id", "bad", F.explode(F.transform("runs", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("runs", i - 1)).alias("before")))).alias("x"))
    places = each.groupBy("x.word", "x.before").agg(F.max("bad").alias("p"), F.max(1 - F.col("bad")).alias("n"), F.min("id").alias("first"))
    counts, path = keep(places.groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.size(F.collect_set(F.pmod(F.xxhash64("first"), F.lit(64)))).alias("docs")), "words-of-labelled")
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    all_p, all_n = counts.agg(F.sum("p"), F.sum("n")).first()
    if not all_p or not all_n:
        return []
    rate = all_p / (all_p + all_n)
    ratio = 2 * (F.when(p > 0, p * F.log(p / ((p + n) * rate))).otherwise(0.0) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - rate)))).otherwise(0.0))
    typical = counts.withColumn("ratio", ratio).where((F.col("ratio") >= least) & (p / (p + n) >= PRECISION) & (F.col("docs") >= MARKED_DOCS))
    found = [r.word for r in typical.orderBy(F.col("ratio").desc(), "word").limit(most).collect()]
    remove(docs.sparkSession, path)
    return found


def _thresholds(grown: DataFrame) -> dict[str, list[int]]:
    """Some whole numbers for each measure: quantiles of bad and of clean growing documents, and the numbers after them."""
    at = F.array(*[F.lit(i / THRESHOLDS) for i in range(1, THRESHOLDS)])
    found = grown.groupBy("bad").agg(*[F.percentile(F.expr(m), at).alias(f"m{i}") for i, m in enumerate(MEASURES.values())]).collect()
    return {m: sorted({n for r in found for q in r[f"m{i}"] for n in (ceil(q), floor(q) + 1)}) for i, m in enumerate(MEASURES)}


def _reached(thresholds: list[int], value: Column) -> Column:
    """How many thresholds a value is at least."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds or [0])), lambda t: t <= value))


def _best_condition(rows: DataFrame, thresholds: dict[str, list[int]]) -> tuple[float, Condition | None, int, int]:
    """Gain, condition, and the bad and clean rows it leaves, of the condition with the largest gain; the first of equals."""
    slots = [F.struct(F.lit(i).alias("m"), _reached(thresholds[m], F.expr(x)).alias("slot")) for i, (m, x) in enumerate(MEASURES.items())]
    counts = rows.select("bad", F.explode(F.array(*slots)).alias("s")).groupBy("s.m", "s.slot").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for i, m in enumerate(MEASURES):
        mine = {r.slot: (r.p, r.n) for r in counts if r.m == i}
        all_p, all_n = (sum(x[j] for x in mine.values()) for j in (0, 1))
        below_p = below_n = 0
        for slot, t in enumerate(thresholds[m]):
            below_p, below_n = below_p + mine.get(slot, (0, 0))[0], below_n + mine.get(slot, (0, 0))[1]
            for at_least, p, n in ((True, all_p - below_p, all_n - below_n), (False, below_p, below_n)):
                if p and p + n < all_p + all_n:
                    gain = p * (log2(p / (p + n)) - log2(all_p / (all_p + all_n)))
                    if gain > best[0] + 1e-9:
                        best = gain, Condition(m, at_least, t), p, n
    return best


def grow(rows: DataFrame, thresholds: dict[str, list[int]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        _, condition, _, n = _best_condition(rows.where(fits(rule)), thresholds)
        if condition is None:
            break
        rule += (condition,)
        if not n:
            break
    return rule


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, dict[bool, tuple[int, int]]]:
    """The best prefix of a rule by the rows kept for pruning, and the bad and clean rows it covers there (False) and among the others (True)."""
    prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
    sums = [F.coalesce(F.sum(F.when(fits(r), x)), F.lit(0)).alias(f"{k}{i}") for i, r in enumerate(prefixes) for k, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
    found = {r.growing: r for r in rows.groupBy("growing").agg(*sums).collect()}
    cover = lambda side, i: (found[side][f"p{i}"], found[side][f"n{i}"]) if side in found else (0, 0)
    worth = lambda i: (p - n) / (p + n) if (pn := cover(False, i)) and (p := pn[0]) + (n := pn[1]) else -1.0
    best = max(range(len(prefixes)), key=lambda i: (worth(i), -i))
    return prefixes[best], {side: cover(side, best) for side in (False, True)}


def learned(rows: DataFrame, precision: float = PRECISION, min_cover: int = MIN_COVER, max_rules: int = MAX_RULES) -> list[Rule]:
    """The rules for rows of STATISTICS with ``bad`` (0 or 1) and ``growing`` (whether the row grows rules or prunes them)."""
    rules: list[Rule] = []
    thresholds = _thresholds(rows.where("growing"))
    while len(rules) < max_rules and thresholds:
        left = rows.where(decided(rules).isNull())
        rule = grow(left.where("growing"), thresholds)
        if not rule:
            break
        rule, cover = prune(left, rule)
        if cover[False][0] < min_cover or any(p < precision * (p + n) for p, n in cover.values()):
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_word_docs: int = MAX_WORD_DOCS, precision: float = PRECISION) -> DataFrame:
    """doc_id, STATISTICS, base_failed, rule (that rejects; null if none) and kept of every document."""
    spark = docs.sparkSession
    known, known_path = keep(_known(labels, max_labelled), "labelled")
    stats, _ = keep(measured(docs, marked_words(docs, labels, max_word_docs)), "statistics")
    growing = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0
    own = stats.where(~base_failed()).join(F.broadcast(known), F.col("doc_id") == F.col("id")).select(*STATISTICS, "bad", growing.alias("growing"))
    rows, rows_path = keep(own.repartition(4), "labelled-statistics")  # at most max_labelled rows
    rules = learned(rows, precision)
    remove(spark, known_path, rows_path)
    rule = F.when(~base_failed(), decided(rules))
    return stats.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), rule.alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
