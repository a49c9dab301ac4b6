"""How difficult a record is: treatment, topic, metadata and a prior, with checks, promotion by title and a confidence.

All rules are built-in expressions.  Texts are read by patterns whose word ends are those of ASCII words, so that other engines can say
the same.  Every measure is a column before it is used, so a text is searched once for each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as fx, text as tx
from ..sources import store

#: Where an ASCII word begins or ends, in Java's patterns (its own \\b takes all letters).
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Forms of academic prose, of prose for beginners, of notation and of references.
ACADEMIC_PROSE = (
    r"\bwe\s+(?:prove|show|demonstrate|establish|derive|present|propose|introduce|construct|analyse|analyze)\b",
    r"\b(?:suppose|assume)\s+that\b",
    r"\blet\s+[a-z]\s+be\b",
    r"\bin\s+this\s+(?:paper|section|chapter|study|article|work)\b",
    r"\bour\s+(?:results|approach|method|framework|model|analysis|contribution)\b",
    r"\bas\s+shown\s+in\b",
    r"\bit\s+(?:follows|can\s+be\s+shown)\b",
    r"\b(?:furthermore|moreover|consequently|nonetheless)\b",
    r"\b(?:theorem|lemma|proposition|corollary)\s+\d+\b",
    r"\bq\.?e\.?d\.?\b",
)
BEGINNER_PROSE = (
    r"\byou\s+(?:will|can|might|should|need)\b",
    r"\bwe'?ll\b",
    r"\blet'?s\b",
    r"\btry\s+(?:this|the\s+following)\b",
    r"\bin\s+this\s+(?:tutorial|guide|lesson)\b",
    r"\bwe\s+will\s+learn\b",
    r"\byour\s+(?:first|own)\b",
    r"\bgetting\s+started\b",
)
NOTATION = (
    r"[∈∀∃⊂⊆⊇∪∩∧∨¬⇒⇔→←↔∑∏∫∂∇ℏαβγδεζηθικλμνξπρστυφχψω]",
    r"\\(?:frac|sum|int|partial|alpha|beta|gamma|delta|sigma|omega|theta|lambda|infty|cdot|times|le|ge|ne|approx|equiv|to|rightarrow|leftarrow|mathbb|mathcal|mathrm|ldots|cdots|nabla|langle|rangle|sqrt)",
    r"\b[A-Za-z][_^]\{?[A-Za-z0-9]+\}?",
)
REFERENCES = (
    r"\[\d+(?:[\s,\-]+\d+)*\]",
    r"\(\s*[A-Z][a-z]+\s+(?:et\s+al\.?\s+)?\d{4}\s*\)",
    r"arXiv:\s*\d+\.\d+",
    r"(?i)\bdoi:\s*10\.[^ ]+",
    r"https?://doi\.org/10\.[^ ]+",
    r"\b(?:Figure|Fig\.|Table|Eq\.|Equation|Section|Chapter|Appendix|Theorem)\s+\d+",
)
ADDRESS = (" you ", " your ", " yours ", "you're", "you'll", "you've")
TECHNICAL_ENDS = ("tion", "sion", "ment", "ance", "ence", "ity", "ism", "ology", "graphy", "nomy", "metry", "esis", "itic", "ical", "emia", "pathy", "plasty", "phagy", "morphism", "hedron", "tope", "thesis", "stasis", "genesis", "kinesis", "lysis", "ptosis")
TECHNICAL_HEADS = (
    "hydro", "electro", "thermo", "photo", "bio", "neuro", "psycho", "physio", "chemo", "astro", "geo", "morpho", "phono", "chromato", "spectro", "cyto", "histo", "hemo", "haemo", "cardio", "pulmo",
    "nephro", "hepato", "onco", "pharma", "immuno", "micro", "macro", "nano", "pico", "femto", "iso", "poly", "mono", "di", "tri", "tetra", "penta", "hexa", "hepta", "octa",
)
NAMES = r"\b[A-Z][a-z]{2,}(?: +[A-Z][a-z]{2,})+\b"
PROPER = r"^[A-Z][a-z]{3,}(?:[^A-Za-z0-9_]|$)"
SELF_PUBLISHED = ("blogspot", "medium.com", "substack", "wordpress", "self-published", "self published", "kindle direct", "createspace")
ACADEMIC_PUBLISHERS = (
    "university press", "university of", "academic press", "springer", "elsevier", "wiley", "cambridge university", "oxford university", "mit press", "princeton university", "crc press",
    "sage publications", "taylor & francis", "taylor and francis", "kluwer", "mcgraw-hill", "mcgraw hill", "pearson education", "cengage learning", "palgrave", "routledge", "world scientific", "ieee",
    "acm press", "de gruyter", "john wiley",
)
PLATFORM_PRIOR = {
    "arxiv": 0.12, "semantic_scholar": 0.10, "openalex": 0.08, "pubmed": 0.12, "europe_pmc": 0.10, "crossref": 0.10, "doaj": 0.05, "core": 0.10, "zenodo": 0.02, "wikipedia": -0.05, "wikibooks": -0.05,
    "wikiversity": -0.05, "openstax": -0.05, "mit_ocw": -0.03, "libretexts": -0.05, "open_library": -0.03, "internet_archive": -0.03, "huggingface": 0.05,
}
TYPE_PRIOR = {"research_paper": 0.05, "proceedings_article": 0.05, "book": -0.03, "textbook": -0.03, "documentation": -0.03, "course": -0.03, "video": -0.05, "model": 0.03, "dataset": 0.03}
STARTS_ADVANCED = ("advanced", "graduate", "postgraduate")
ADVANCED_QUALIFIERS = ("mechanism", "mechanisms", "reaction", "reactions", "synthesis", "syntheses", "structure", "structures", "theory", "analysis", "applications")
ADVANCED_WORDS = ("advanced", "advance", "advances", "advancement", "advancements")
BEGINNER_TITLES = ("introduction to", "intro to", "for beginners", "fundamentals of", "basics of", "getting started", "from scratch", "step by step", "beginner's guide", "made easy", "basics", "basic", "fundamentals", "introductory")


@dataclass(frozen=True)
class Settings:
    treatment: float = 0.55
    topic: float = 0.35
    metadata: float = 0.10
    prior_cap: float = 0.15
    beginner_below: float = 0.35
    advanced_from: float = 0.65
    neutral: dict = field(default_factory=lambda: {"treatment": 0.50, "topic": 0.40, "metadata": 0.50})
    generic: tuple[str, ...] = fx.GENERIC


#: Before what follows no ASCII word goes on.
BEFORE = "(?<![A-Za-z0-9_]{})"


def java(pattern: str) -> str:
    """A pattern in Java's form.  A looked-behind edge at its beginning would be tried at every character, so the words that it begins
    with are matched first and their edge is looked at where they are; a class of signs beyond ASCII first compares the range of them."""
    flags, body = re.match(r"(\(\?i\))?(.*)", pattern).groups(default="")
    if not pattern.isascii() and re.fullmatch(r"\[[^\\\[\]^-]+\]", pattern):
        codes = sorted(map(ord, pattern[1:-1]))
        low = [c for c in codes if c < 0x100]
        return "[" + "".join(f"\\x{{{c:x}}}" for c in low) + f"\\x{{{codes[len(low)]:x}}}-\\x{{{codes[-1]:x}}}&&{pattern}]"
    head = re.match(r"\\b(?:\(\?:([A-Za-z.|\\]+)\)|(\[[^\]]+\]\[[^\]]+\])|([A-Za-z]+))(?![?*+{])", body)
    if head:
        words, classes, word = head.groups()
        first = "(?:" + "|".join(w + BEFORE.format(w) for w in words.split("|")) + ")" if words else (classes or word) + BEFORE.format(classes or word)
        body = first + body[head.end() :]
    return flags + body.replace(r"\b", EDGE)


def found(text: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.size(F.regexp_extract_all(text, F.lit(java(pattern)), 0))


def per_thousand(hits: Column, text: Column) -> Column:
    return hits / (F.greatest(F.lit(1), F.length(text)) / 1000.0)


def stepped(value: Column, *steps: tuple[Column, float]) -> tuple[Column, Column]:
    """The first step whose condition holds: what it adds, and that a signal fired."""
    add, fired = F.lit(0.0), F.lit(0)
    for holds, amount in reversed(steps):
        add, fired = F.when(holds, F.lit(amount)).otherwise(add), F.when(holds, F.lit(1)).otherwise(fired)
    return add, fired


def limited(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def record_text() -> Column:
    """Title, abstract, summary and description, cleaned, in a row."""
    return F.concat_ws(" ", *[F.nullif(tx.clean(F.col(c)), F.lit("")) for c in ("title", "abstract", "summary", "description")])


def _measures(settings: Settings) -> dict[str, Column]:
    """Measures of the columns _text, _low (lower-cased) and _title (cleaned)."""
    text, low, title = F.col("_text"), F.col("_low"), F.col("_title")
    hits = lambda marks: sum((low.contains(m).cast("int") for m in marks), F.lit(0))
    forms = lambda patterns: sum((low.rlike(java(p)).cast("int") for p in patterns), F.lit(0))
    times = lambda mark: ((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    addressed = sum((times(m) for m in ADDRESS), low.startswith("you ").cast("int"))
    notation = lambda c: sum((found(c, p) for p in NOTATION), F.lit(0))
    plain = tx.light_tokens(text)
    technical = lambda p: F.filter(p, lambda t: t.rlike("^[a-z]{8,}$") & ~t.isin(*settings.generic) & (t.rlike(f"^(?:{'|'.join(TECHNICAL_HEADS)})") | t.rlike(f"(?:{'|'.join(TECHNICAL_ENDS)})$")))
    kinds = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[.!?]+"), 0), lambda t: F.when((F.length(t) >= 3) & t.rlike("^[A-Za-z]") & ~F.lower(t).isin(*settings.generic), "c").otherwise("x"))
    runs = tx.let(F.concat(F.lit("x"), F.array_join(kinds, "")), lambda s: F.struct(F.length(F.replace(s, F.lit("x"), F.lit(""))).alias("words"), ((F.length(s) - F.length(F.replace(s, F.lit("xc"), F.lit("")))) / 2).alias("runs")))
    parts = F.split(title, " ")
    proper = F.size(F.filter(parts, lambda w, i: (i > 0) & w.rlike(PROPER)))
    names = found(title, NAMES)
    publisher = F.lower(F.trim(F.coalesce("publisher", F.lit(""))))
    held = lambda marks: sum((publisher.contains(m).cast("int") for m in marks), F.lit(0)) > 0
    return {
        "_begin": hits(fx.BEGINNER_MARKERS), "_advance": hits(fx.ADVANCED_MARKERS), "_academic": forms(ACADEMIC_PROSE), "_friendly": forms(BEGINNER_PROSE),
        "_address": per_thousand(F.when(low.contains("you"), addressed).otherwise(0), low), "_notation": per_thousand(notation(text), text), "_refs": per_thousand(sum((found(text, p) for p in REFERENCES), F.lit(0)), text),
        "_sentence": tx.sentence_length(text), "_plain": tx.let(plain, lambda p: F.struct(F.size(p).alias("n"), F.size(technical(p)).alias("terms"))),
        "_compound": tx.let(runs, lambda r: F.when(r["runs"] > 0, r["words"] / r["runs"]).otherwise(0.0)), "_names": F.when(names > 0, names).otherwise(proper),
        "_title_notation": per_thousand(notation(title), title), "_university": held(ACADEMIC_PUBLISHERS), "_selfmade": held(SELF_PUBLISHED),
    }


def _treatment(neutral: float) -> tuple[Column, Column]:
    c = F.col
    begin, b = F.greatest(F.lit(-0.35), -0.05 * c("_begin")), (c("_begin") > 0).cast("int")
    advance, a = F.least(F.lit(0.35), 0.05 * c("_advance")), (c("_advance") > 0).cast("int")
    academic, p = F.least(F.lit(0.20), 0.04 * c("_academic")), (c("_academic") > 0).cast("int")
    friendly, f = -F.least(F.lit(0.15), 0.03 * c("_friendly")), (c("_friendly") > 0).cast("int")
    address, s = stepped(c("_address"), (c("_address") > 0.15, -0.10), (c("_address") > 0.05, -0.05), ((c("_address") < 0.03) & (F.length("_text") > 200), 0.05))
    notation, n = stepped(c("_notation"), (c("_notation") > 0.20, 0.20), (c("_notation") > 0.05, 0.10))
    refs, r = stepped(c("_refs"), (c("_refs") > 0.10, 0.10), (c("_refs") > 0.03, 0.05))
    length, m = stepped(c("_sentence"), (c("_sentence") <= 0, 0.0), (c("_sentence") >= 32, 0.15), (c("_sentence") >= 24, 0.10), (c("_sentence") <= 12, -0.08), (c("_sentence") <= 16, -0.03))
    m = F.when(c("_sentence") <= 0, 0).otherwise(m)
    score = limited(neutral + begin + advance + academic + friendly + address + notation + refs + length)
    empty = c("_low") == ""
    return F.when(empty, F.lit(neutral)).otherwise(score), F.when(empty, 0).otherwise(b + a + p + f + s + n + r + m)


def _topic(neutral: float) -> tuple[Column, Column]:
    c = F.col
    share = F.when(c("_technical") > 0, c("_terms") / c("_technical")).otherwise(0.0)
    terms, t = stepped(share, (share > 0.15, 0.25), (share > 0.08, 0.15), (share < 0.02, -0.05))
    compound, k = stepped(c("_compound"), (c("_compound") > 5.0, 0.25), (c("_compound") > 3.5, 0.15), ((c("_compound") > 0) & (c("_compound") < 2.0), -0.05))
    names, n = stepped(c("_names"), (c("_names") > 2, 0.10), ((c("_names") == 0) & (F.length("_title") > 20), -0.05))
    notation, x = stepped(c("_title_notation"), (c("_title_notation") > 0.05, 0.10))
    empty = (c("_text") == "") & (c("_title") == "")
    return F.when(empty, F.lit(neutral)).otherwise(limited(neutral + terms + compound + names + notation)), F.when(empty, 0).otherwise(t + k + n + x)


def _metadata(neutral: float) -> tuple[Column, Column]:
    cited = F.coalesce("citation_count", F.lit(-1))
    high, h = stepped(cited, (cited >= 500, 0.20), (cited >= 100, 0.10), (cited >= 10, 0.05))
    doi = F.trim(F.coalesce("doi", F.lit(""))) != ""
    score = neutral + F.when(F.col("_university"), 0.20).otherwise(0.0) - F.when(F.col("_selfmade"), 0.20).otherwise(0.0) + high + F.when(doi, 0.05).otherwise(0.0)
    return limited(score), F.col("_university").cast("int") + F.col("_selfmade").cast("int") + h + doi.cast("int")


def looked_up(key: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def level_bias(level: str) -> float:
    low = level.lower()
    begins, advances = "beginner" in low, "advance" in low
    return -0.05 if begins and not advances else 0.05 if advances and not begins else 0.0


def _first(title: Column, words: tuple[str, ...], begins: bool = False) -> Column:
    """The first of some words that a title has, or begins with; null if none."""
    head = "^" if begins else EDGE
    return F.coalesce(*[F.when(title.rlike(head + w.replace(".", "\\.") + EDGE), F.lit(w)) for w in words])


def classify(sources: DataFrame, level: str = "", settings: Settings | None = None) -> DataFrame:
    """sources with level_score, treatment, topic, metadata_score, prior, signals, level, promotion (the rule by which the title decided,
    or null) and level_confidence."""
    s, c = settings or Settings(), F.col
    rows = sources.withColumns({"_text": record_text(), "_title": tx.clean(c("title"))}).withColumn("_low", F.lower("_text"))
    rows = rows.withColumns(_measures(s)).withColumns({"_technical": c("_plain.n"), "_terms": c("_plain.terms")})
    (treatment, t_signals), (topic, p_signals), (meta, m_signals) = _treatment(s.neutral["treatment"]), _topic(s.neutral["topic"]), _metadata(s.neutral["metadata"])
    prior = limited(looked_up(c("platform"), PLATFORM_PRIOR) + looked_up(c("source_type"), TYPE_PRIOR), -s.prior_cap, s.prior_cap)
    rows = rows.withColumns({"treatment": treatment, "topic": topic, "metadata_score": meta, "prior": prior, "signals": t_signals + p_signals + m_signals, "_name": F.lower("_title")})
    score = limited(limited(s.treatment * c("treatment") + s.topic * c("topic") + s.metadata * c("metadata_score") + c("prior")) + level_bias(level))
    rows = rows.withColumns({"level_score": score, "_starts": _first(c("_name"), STARTS_ADVANCED, True), "_word": _first(c("_name"), ADVANCED_WORDS), "_qualifier": _first(c("_name"), ADVANCED_QUALIFIERS), "_easy": _first(c("_name"), BEGINNER_TITLES)})
    raw = F.when(c("level_score") < s.beginner_below, 0).when(c("level_score") < s.advanced_from, 1).otherwise(2)
    strict = "mixed" in level.lower() or "advanced" in level.lower()
    doubted = (c("treatment") >= 0.55) | (c("topic") >= 0.60) | (c("_academic") >= 2) | (F.lit(strict) & (c("treatment") >= 0.50))
    rows = rows.withColumn("_rank", F.when((raw == 0) & doubted, 1).otherwise(raw))
    both = c("_word").isNotNull() & c("_qualifier").isNotNull()
    easy = c("_easy").isNotNull() & c("_word").isNull()
    rule = (
        F.when(c("_starts").isNotNull(), F.when(c("_rank") < 2, "starts_advanced"))
        .when(both, F.when(c("_rank") < 2, "advanced_marker_with_qualifier"))
        .when(easy, F.when(c("_rank") > 0, "beginner_phrase"))
        .when(c("_word").isNotNull(), F.when(c("_rank") < 1, "advanced_marker"))
    )
    rows = rows.withColumn("promotion", rule)
    rank = F.when(c("promotion").isin("starts_advanced", "advanced_marker_with_qualifier"), 2).when(c("promotion") == "beginner_phrase", 0).when(c("promotion") == "advanced_marker", 1).otherwise(c("_rank"))
    sure = (
        0.30 + 0.05 * F.least(c("signals"), F.lit(6)) + 0.10 * F.least(F.lit(1.0), F.length("_text") / 500.0) + 0.20 * (1 - F.abs(c("treatment") - c("topic")))
        + F.when((c("_begin") + c("_advance")) > 0, 0.15).otherwise(0.0) - F.when(F.length("_text") < 80, 0.15).otherwise(0.0)
    )
    sure = limited(sure, 0.10, 0.95)
    rows = rows.withColumns({"level": F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), rank + 1), "level_confidence": F.when(c("promotion").isNotNull(), F.greatest(sure, F.lit(0.75))).otherwise(sure)})
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def guarded(classified: DataFrame, trigger: float = 0.50, least_advanced: float = 0.45, least_intermediate: float = 0.30, least_topic: float = 0.50) -> DataFrame:
    """For learners: where more than ``trigger`` of the records are advanced, advanced ones of low treatment become intermediate and
    intermediate ones of low treatment and topic become beginner.

    The share comes from all records and goes back to each, so what is classified is written down and its texts are searched once."""
    classified = store.written(classified, "levels")
    share = classified.agg(F.avg((F.col("level") == "advanced").cast("int")).alias("_share"))
    low = F.round("treatment", 4)
    demoted = F.when((F.col("level") == "advanced") & (low < least_advanced), "intermediate").when((F.col("level") == "intermediate") & (low < least_intermediate) & (F.round("topic", 4) < least_topic), "beginner")
    rows = classified.crossJoin(F.broadcast(share))
    return rows.withColumn("level", F.when(F.col("_share") > trigger, F.coalesce(demoted, "level")).otherwise(F.col("level"))).drop("_share")
