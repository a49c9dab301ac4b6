"""Query understanding, gates on text and run-level judgements, as columns over tables of queries or records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed as fx, text as tx

LEVELS = {"beginner": fx.BEGINNER_SIGNALS, "advanced": fx.ADVANCED_SIGNALS}


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def intent(text: Column) -> Column:
    out = F.lit("explore")
    for name, marks in reversed(fx.INTENTS.items()):
        out = F.when(contains_any(text, marks), name).otherwise(out)
    return out


def level_score(text: Column, level: str) -> Column:
    """Sum of the weights of all signals in the text, as substrings."""
    return sum((F.when(text.contains(m), fx.SIGNAL_WEIGHTS[k]).otherwise(0.0) for k, marks in LEVELS[level].items() for m in marks), F.lit(0.0))


def level_profile(text: Column) -> Column:
    low, high = F.round(level_score(text, "beginner"), 6), F.round(level_score(text, "advanced"), 6)
    return (
        F.when((high >= 1) & (low < high), "advanced").when((low >= 1) & (high < low), "beginner").when((high >= 1) & (low >= 1), "mixed")
        .when((low > high * 1.2) & (low > 0), "beginner").when((high > low * 1.2) & (high > 0), "advanced").otherwise("balanced")
    )


def specificity(tokens: Column) -> Column:
    """min(0.55, 0.15 n) + min(0.25, (mean length - 4) * 0.08, at least 0) + 0.15."""
    n = F.size(tokens)
    mean = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t)) / F.greatest(n, F.lit(1))
    return F.least(F.lit(0.55), 0.15 * n) + F.least(F.lit(0.25), F.greatest(F.lit(0.0), (mean - 4) * 0.08)) + 0.15


def topic_strength(n: Column, chars: Column) -> Column:
    return 0.7 * F.least(F.lit(1.0), n / 3) + 0.3 * F.least(F.lit(1.0), chars / 20)


def concept(text: Column, words: int = 6) -> Column:
    """The first meaningful tokens of a question, without filler phrases."""
    bare = F.regexp_replace(F.lower(text), "^(please |can you |tell me about |what is |how to )+", "")
    return F.slice(tx.meaningful(tx.tokens(bare)), 1, words)


TEMPLATES = {"beginner": ("introduction to {}", "{} for beginners", "{} basics"), "balanced": ("{}", "{} tutorial", "{} guide"), "advanced": ("{} survey", "advanced {}", "{} research"), "mixed": ("{} from basics", "{} guide", "{} survey")}


def expanded(concept_text: Column, profile: Column, cap: int = 5) -> Column:
    """The profile's templates filled with a concept, distinct without regard to case, at most cap."""
    fill = lambda ts: F.array(*[F.concat(F.lit(t.split("{}")[0]), concept_text, F.lit(t.split("{}")[1])) for t in ts])
    out = fill(TEMPLATES["balanced"])
    for name, ts in TEMPLATES.items():
        out = F.when(profile == name, fill(ts)).otherwise(out)
    return F.slice(tx.distinct_ignoring_case(F.concat(F.array(concept_text), out)), 1, cap)


def chunk_gate(question: Column, gate: int = 3) -> Column:
    """Whether a question has enough tokens for chunk search; questions with a question word need one fewer."""
    toks = tx.tokens(question)
    asks = F.size(F.array_intersect(toks, F.array(*map(F.lit, fx.INTERROGATIVES)))) > 0
    return F.size(tx.meaningful(toks)) >= F.greatest(F.lit(2), F.least(F.lit(20), F.lit(gate) - asks.cast("int")))


def credibility_penalty(text: Column) -> Column:
    hits = sum((text.contains(m).cast("int") for m in fx.CREDIBILITY_MARKERS), F.lit(0))
    return F.when(hits == 0, 1.0).when(hits == 1, 0.75).when(hits == 2, 0.5).otherwise(0.35)


def is_junk_title(title: Column) -> Column:
    low = F.lower(F.trim(title))
    out = contains_any(low, fx.JUNK_TITLE_PARTS)
    for end in fx.JUNK_TITLE_SUFFIXES:
        out = out | low.endswith(end)
    return out


def is_incoherent(text: Column) -> Column:
    """Three or more content tokens of which none is over five letters."""
    toks = F.filter(tx.tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*tx.STOPWORDS))
    return (F.size(toks) >= 3) & ~F.exists(toks, lambda t: F.length(t) > 5)


def concept_present(tokens: list[str], title: Column, abstract: Column) -> Column:
    out, near = F.lit(False), F.lower(F.substring(abstract, 1, 400))
    for t in tokens:
        out = out | F.lower(title).contains(t) | near.contains(t)
    return out


def unit_interval(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 100, x / 100).otherwise(1.0)


def phrase_position(text: Column, phrase: str, base: float = 1.0) -> Column:
    at = F.instr(text, phrase)
    return F.when(at > 0, base * (1 - 0.3 * (at - 1) / F.greatest(F.length(text), F.lit(1)))).otherwise(0.0)


def token_density(tokens: Column, query: list[str]) -> Column:
    """d / (d + 3) with d the hits in a hundred words."""
    hits = F.size(F.filter(tokens, lambda t: t.isin(*query)))
    d = 100.0 * hits / F.greatest(F.size(tokens), F.lit(1))
    return d / (d + 3)


def head_share(text: Column, query: list[str]) -> Column:
    """The share of a text's query tokens that fall in its first two sentences."""
    head = F.regexp_extract(text, r"(?s)^([^.!?]*[.!?]?[^.!?]*[.!?]?)", 1)
    n = lambda c: F.size(F.filter(tx.tokens(c), lambda t: t.isin(*query)))
    return F.when(n(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), n(head) / n(text)))


def off_language(text: Column) -> Column:
    """Share of letters outside ASCII over a tenth."""
    return F.regexp_count(text, F.lit(r"[^\x00-\x7f]")) > 0.1 * F.length(text)


def reading_minutes(source_type: Column, words: Column) -> Column:
    base = F.when(source_type == "research_paper", 45).when(source_type == "book", 120).when(source_type == "course", 90).when(source_type == "video", 30).otherwise(20)
    return base + F.when(words > 300, 15).otherwise(0)


def selection_reason(*parts: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in parts])


def size_label(n: Column) -> Column:
    in_unit = lambda size, unit: F.concat(F.round(n / size, 1).cast("string"), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, in_unit(1024.0, " KB")).otherwise(in_unit(1048576.0, " MB"))


def decision(score: Column, spent: Column, retries: Column) -> Column:
    return F.when(score >= 0.80, "accept").when((score >= 0.60) & (spent < 0.8), "refine").when((score >= 0.40) & (retries < 2), "retry").otherwise("abort")


def run_status(sources: Column, ranked: Column, errors: Column) -> Column:
    return F.when(sources == 0, "failed").when((ranked == 0) | (errors > 0), "partial").otherwise("success")


def guards(ranked: DataFrame, friendly: Column, relevant: Column, domain_confidence: float, has_path: bool) -> DataFrame:
    """One row of what is wrong with a run: no records, none for beginners, none or under a quarter on the topic, an uncertain domain, no path."""
    hits = F.count_if(relevant)
    return ranked.agg(
        F.count("*").alias("n"), (F.count("*") == 0).alias("no_sources"), (F.count_if(friendly) == 0).alias("no_beginner"), (hits == 0).alias("off_topic"),
        ((hits > 0) & (hits < F.greatest(F.lit(1), F.floor(F.count("*") * 0.25)))).alias("low_relevance"), F.lit(domain_confidence < 0.20).alias("low_domain"), F.lit(not has_path).alias("no_path"),
    )



def marks_in(text: Column, marks: tuple[str, ...]) -> Column:
    """How many of some marks a text has."""
    return sum((text.contains(m).cast("int") for m in marks), F.lit(0))


def route(text: Column, has_topic: Column, turns_before: Column) -> Column:
    """conversation or corpus, for a lower-cased question."""
    own, verbs, people = marks_in(text, fx.SELF_REFERENCES), marks_in(text, fx.SESSION_VERBS), marks_in(F.concat(F.lit(" "), text, F.lit(" ")), fx.PRONOUNS)
    signals = own + verbs + people
    talk = (marks_in(text, fx.STRONG_MARKERS) > 0) | (~has_topic & (signals >= 2)) | (~has_topic & (verbs >= 1) & (people >= 1)) | ((own >= 2) & (verbs >= 1)) | ((turns_before > 0) & ~has_topic & (signals >= 3))
    return F.when(talk, "conversation").otherwise("corpus")


def refuses(text: Column) -> Column:
    low = F.lower(tx.clean(text))
    out = F.lit(False)
    for phrase in fx.REFUSALS:
        out = out | low.contains(phrase)
    return out


def search_tool(text: Column, level: Column) -> Column:
    """The tool that most words of a question ask for, the first of equal ones; beginners get explanations, and no words the academic one."""
    low = F.lower(text)
    counts = {tool: marks_in(low, words) for tool, words in fx.TOOL_WORDS.items()}
    most = F.greatest(*counts.values())
    best = F.lit("search_academic")
    for tool in reversed(counts):
        best = F.when(counts[tool] == most, F.lit(tool)).otherwise(best)
    return F.when(F.lower(level).contains("beginner"), "search_explanation").when(most == 0, "search_academic").otherwise(best)


def formats(text: Column, levels: Column, domain_formats: Column) -> Column:
    """Kinds of material for a question: by its level (all levels' where there is not just one), by its first domains, and, put before them one
    by one, by its words; the first six."""
    low = F.lower(text)
    of = {k: F.array(*map(F.lit, v)) for k, v in fx.LEVEL_FORMATS.items()}
    one = F.when(F.size(levels) == 1, levels[0])
    base = F.when(one == "beginner", of["beginner"]).when(one == "advanced", of["advanced"]).when(one == "intermediate", of["intermediate"]).otherwise(F.concat(of["beginner"], of["intermediate"], of["advanced"]))
    listed = F.array_distinct(F.concat(base, domain_formats))
    named = F.array_compact(F.array(*[F.when(low.contains(s), F.lit(f)) for s, f in fx.FORMAT_SIGNALS]))
    new = F.reverse(F.array_except(F.array_distinct(named), listed))
    return F.slice(F.concat(new, listed), 1, fx.MAX_FORMATS)


def answer_style(text: Column) -> Column:
    """short, detailed or exhaustive by the most marks, the later of equal ones; else standard."""
    low = F.lower(text)
    counts = {k: marks_in(low, v) for k, v in fx.ANSWER_STYLES.items()}
    most = F.greatest(*counts.values())
    out = F.lit("standard")
    for style, n in counts.items():
        out = F.when((n == most) & (n > 0), F.lit(style)).otherwise(out)
    return out


def primary_topic(text: Column, most: int = 6) -> Column:
    """What a question is about: what it quotes, else its words without leaders, trailing noise and stopwords, the first few."""
    clean = tx.clean(text)
    quoted = F.coalesce(F.nullif(F.regexp_extract(clean, '"([^"]{2,80})"', 1), F.lit("")))
    body = clean
    for leader in sorted(fx.QUESTION_LEADERS, key=len):  # the longest is tried first
        body = F.when(F.lower(clean).startswith(leader), F.trim(F.substring(clean, F.lit(len(leader) + 1), F.length(clean)))).otherwise(body)

    def without(noise: str):
        return lambda b: F.when(F.lower(b).endswith(noise), F.rtrim(F.left(b, F.length(b) - len(noise)))).otherwise(b)

    for noise in fx.TRAILING_NOISE:
        body = tx.let(body, without(noise))
    words = F.filter(F.split(body, " "), lambda w: w != "")
    kept = lambda ws: F.filter(ws, lambda w: ~F.lower(w).isin(*fx.STOPWORDS))
    named = tx.let(words, lambda ws: F.array_join(F.slice(F.when(F.size(kept(ws)) > 0, kept(ws)).otherwise(ws), 1, most), " "))
    return F.coalesce(quoted, named)


def search_queries(question: Column, topic: Column, kind: Column, more: Column, most: int = 6) -> Column:
    """The question, long forms of its abbreviations (more), its topic, and what its kind is searched by, each once whatever its case."""
    empty = F.array().cast("array<string>")
    by_kind = empty
    for name, templates in fx.SEARCH_TEMPLATES.items():
        by_kind = F.when(kind == name, F.array(*[F.concat(F.lit(t.split("{}")[0]), topic, F.lit(t.split("{}")[1])) for t in templates])).otherwise(by_kind)
    every = F.concat(F.array(question), more, F.when(F.length(topic) > 0, F.concat(F.array(topic), by_kind)).otherwise(empty))
    return F.slice(tx.distinct_ignoring_case(F.filter(every, lambda q: q != "")), 1, most)


def substance(text: Column) -> Column:
    """How much an answer says, by its length and whether it has a number."""
    n, number = F.length(F.trim(F.coalesce(text, F.lit("")))), text.rlike("[0-9]")
    return F.when((n >= 200) & number, 1.0).when((n >= 120) & number, 0.85).when(n >= 80, 0.7).when(n >= 40, 0.5).when(n > 0, 0.3).otherwise(0.0)


def cited_dimensions(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(marks_in(low, words) > 0, F.lit(name)) for name, words in fx.CATALOG_WORDS.items()]))


def catalog_confidence(text: Column, richness: Column, classifier: Column, by_model: Column) -> Column:
    """How far an answer about the catalog can be trusted."""
    share = F.size(cited_dimensions(text)) / len(fx.CATALOG_WORDS)
    parts = {"llm_used": F.when(by_model, 1.0).otherwise(0.55), "classifier_confidence": classifier, "snapshot_richness": richness, "answer_substance": substance(text), "dimension_coverage": share}
    blend = sum((fx.CATALOG_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(by_model, blend).otherwise(blend * 0.85))))


def answer_trust(cited: Column, passages: Column, mean_score: Column, chars: Column) -> Column:
    """0.35 of the passages cited, 0.45 of their mean score, 0.20 of the answer's length up to 600."""
    return F.when((passages <= 0) | (chars <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.35 * cited / passages + 0.45 * F.coalesce(mean_score, F.lit(0.0)) + 0.20 * F.least(F.lit(1.0), chars / 600.0)))


def escalation_confidence(richness: Column, classifier: Column) -> Column:
    return F.least(F.lit(0.5), 0.35 * richness + 0.25 * classifier)


# Minutes by kind.
MINUTES = {"research_paper": 90, "repository": 120, "course": 180, "video": 45, "documentation": 30, "dataset": 60, "model": 60, "blog": 20}


def summary_of(title: Column, abstract: Column, kind: Column) -> Column:
    """A record's summary without a model: its abstract's beginning, else its title and kind."""
    text = tx.clean(abstract)
    return F.when(text != "", tx.truncated(text, 300)).otherwise(F.concat(title, F.lit(" ("), kind, F.lit(" resource).")))


def why_useful(kind: Column, platform: Column) -> Column:
    return F.concat(F.lit("A "), kind, F.lit(" from "), platform, F.lit(" relevant to your learning goal."))


def study_minutes(kind: Column, abstract: Column) -> Column:
    base = F.lit(30)
    for name, value in MINUTES.items():
        base = F.when(kind == name, F.lit(value)).otherwise(base)
    return base + F.when(tx.word_count(tx.clean(abstract)) > 300, 15).otherwise(0)


def phrase_bonus(phrases: list[str], title: Column, text: Column) -> Column:
    """0.18 if the title has one of the first ten phrases, else 0.12 if the text has one."""
    in_title, inside = F.lit(False), F.lit(False)
    for p in phrases[:10]:
        in_title, inside = in_title | title.contains(p), inside | text.contains(p)
    return F.when(in_title, 0.18).when(inside, 0.12).otherwise(0.0)


def retrieval_path(operation: Column, strategy: Column, tokens: Column, gate: Column, chunks: Column) -> Column:
    """A name for the way in which an answer's passages were found."""
    skipped = ~chunks & (gate > 0) & (tokens < gate)
    by_operation = F.when(operation == "search_chunks", "chunk").when(operation == "hybrid_search", F.when(skipped, "parent_gate_skipped").otherwise("parent")).when(operation == "search", "embedding").when(operation == "keyword_search", "keyword")
    names = {"hybrid_v2": "chunk_or_parent", "hybrid_all_runs": "all_runs", "conversation_memory": "conversation", "no_match_after_rerank": "no_match"}
    by_strategy = F.coalesce(F.nullif(strategy, F.lit("")), F.lit("unknown"))
    for old, new in names.items():
        by_strategy = F.when(strategy == old, F.lit(new)).otherwise(by_strategy)
    return F.coalesce(by_operation, by_strategy)


def level_priority(begins: Column, advances: Column, level: Column) -> Column:
    """Levels in the order in which they are served, by the weights of a question's signs and then by the level that was given."""
    of = lambda *names: F.array(*map(F.lit, names))
    every = of("beginner", "intermediate", "advanced")
    low = F.lower(F.trim(level))
    ranged = low.contains("to") & low.contains("beginner") & low.contains("advance")
    return F.when((begins >= 1) & (advances >= 1), every).when((advances >= 1) & (begins < advances), of("advanced")).when((begins >= 1) & (advances < begins), of("beginner")).when(low.isin("beginner", "intermediate", "advanced", "mixed"), F.array(low)).when(ranged, every).otherwise(of("mixed"))


def request_kind(text: Column) -> Column:
    low, high = marks_in(text, fx.BEGINNER_MARKERS), marks_in(text, fx.ADVANCED_MARKERS)
    return F.when((low > 0) & (high > 0), "mixed").when(low > high, "beginner").when(high > low, "advanced").otherwise("neutral")


def is_off_topic(text: Column, phrases: list[str], negative: list[str], generic=fx.GENERIC) -> Column:
    """No phrase and fewer than half of the phrases' meaningful words, or two or more marks of other subjects."""
    words = sorted({w for p in phrases for w in p.split() if len(w) > 2 and w not in generic})
    found = contains_any(text, tuple(phrases))
    few = (marks_in(text, tuple(words)) < max(1, len(words) // 2)) if words else F.lit(False)
    return (~found & few if phrases else F.lit(False)) | (marks_in(text, tuple(negative)) >= 2)


def routed(queries: DataFrame, platforms: DataFrame, most: int, least: int) -> DataFrame:
    """queries (query_id, profile) with platforms (platform, level) of a dimension: matching ones, then neutral ones (level 0), up to ``most``;
    others only as far as there are fewer than ``least``."""
    prio = F.when(F.col("level") == F.col("profile"), 0).when(F.col("level") == 0, 1).otherwise(2)
    rows = queries.crossJoin(F.broadcast(platforms)).withColumn("prio", prio)
    by = W.partitionBy("query_id")
    rows = rows.withColumns({"k": F.row_number().over(by.orderBy("prio", "platform")), "fitting": F.count_if(F.col("prio") < 2).over(by)})
    return rows.where((F.col("k") <= most) & ((F.col("prio") < 2) | (F.col("k") <= F.greatest(F.lit(least), F.col("fitting")))))
