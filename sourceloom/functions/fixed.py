"""Word lists and markers whose content decides results.  Stated as they are, in natural order."""

from __future__ import annotations

STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being", "what", "how", "why", "when", "where", "which", "who", "whom", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "do", "does", "did", "doing", "have", "has",
    "had", "having", "can", "could", "should", "would", "may", "might", "must", "will", "shall", "not", "no", "yes", "about", "into", "over", "under", "between", "from", "as", "at", "by", "if",
    "then", "than", "too", "very", "just", "also", "tell", "tells", "telling", "told", "show", "shows", "showing", "showed", "shown", "give", "gives", "giving", "gave", "given", "know", "knows",
    "knowing", "knew", "known", "explain", "explains", "explaining", "explained", "describe", "describes", "describing", "described", "detail", "details", "detailed", "detailing", "please", "kindly",
    "need", "needs", "needed", "needing", "want", "wants", "wanted", "wanting", "like", "likes", "liked", "liking", "get", "gets", "getting", "got", "gotten", "make", "makes", "making", "made",
    "take", "takes", "taking", "took", "taken", "say", "says", "saying", "said", "let", "lets", "letting", "specifically", "particularly", "actually",
)

# Words of teaching and searching that name no subject (a parameter wherever they are used).  Those with regular forms are stated once, under their ending.
GENERIC_WORDS = (
    "about", "above", "across", "after", "again", "all", "also", "and", "any", "anything", "are", "around", "available", "back", "because", "been", "before", "begin", "being", "best", "better", "between", "blog", "both",
    "brief", "but", "can", "clear", "complete", "comprehensive", "could", "deep", "different", "documentation", "does", "doing", "done", "download", "each", "easy", "either", "end", "enough", "entire", "even", "ever", "every",
    "explanation", "few", "find", "first", "free", "from", "general", "good", "great", "had", "has", "have", "help", "here", "high", "how", "however", "including", "info", "information", "inside", "instead", "into", "intro",
    "introduction", "its", "just", "keep", "know", "knowledge", "large", "last", "latest", "like", "list", "little", "lot", "low", "made", "main", "making", "many", "may", "might", "more", "most", "much", "must", "new", "next",
    "nor", "not", "now", "number", "off", "one", "online", "only", "onto", "open", "out", "outline", "over", "overview", "own", "people", "per", "place", "please", "possible", "practical", "practice", "put", "really", "recent",
    "related", "right", "run", "same", "search", "see", "set", "several", "shall", "should", "simple", "simply", "since", "small", "so", "some", "something", "soon", "still", "stuff", "such", "take", "tell", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "think", "this", "those", "through", "tips", "together", "too", "top", "toward", "try", "two", "upon", "using", "various", "very", "via", "was", "watch", "well", "were",
    "what", "when", "where", "which", "while", "who", "why", "will", "with", "within", "without", "world", "would", "write", "yet", "you", "your", "youtube",
)
GENERIC_FORMS = {
    "s": ("article", "basic", "beginner", "book", "case", "come", "concept", "course", "cover", "detail", "example", "explain", "get", "guide", "idea", "include", "learn", "level", "make", "mean", "need", "other", "part", "provide", "show", "source", "step", "thing", "time", "topic", "trick", "tutorial", "type", "use", "video", "want", "way", "word", "work", "year"),
    "ed": ("cover", "detail", "explain", "learn", "need", "start", "want"),
    "d": ("base", "name", "use"),
    "ing": ("follow", "learn", "look", "mean", "start", "understand", "work"),
    "n": ("give",), "es": ("teach",), "ly": ("full", "quick"), "ful": ("use",),
}


def with_forms(words: tuple[str, ...], forms: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The words, those under an ending, and these with it, in the order of the alphabet."""
    return tuple(sorted({*words, *(w for ws in forms.values() for w in ws), *(w + end for end, ws in forms.items() for w in ws)}))


GENERIC = with_forms(GENERIC_WORDS, GENERIC_FORMS)

STEM_SUFFIXES = ("ness", "ment", "tion", "sion", "ing", "ity", "ies", "es", "s")

INTERROGATIVES = ("what", "which", "who", "whom", "whose", "when", "where", "why", "how", "whats", "hows", "whys")

# What a question wants: the first group with a marker in the text; else explore.
INTENTS = {
    "research": ("literature review", "systematic review", "meta-analysis", "state of the art", "state-of-the-art", "survey of", "review of the", "review paper"),
    "troubleshoot": ("not working", "does not work", "broken", "debug", "error", "issue with", "fix my", "troubleshoot"),
    "compare": ("compare", "difference between", " versus ", " vs ", " vs. ", "better than"),
    "implement": ("implement", "build a", "build an", "write a", "write an", "code a", "develop a", "develop an", "create a", "create an"),
    "learn": ("learn", "study", "understand", "explain", "teach me", "tutorial", "lesson", "walk me through", "introduction to", "from basics", "from scratch", "step by step"),
}

# Signals of a wanted level, by strength.
SIGNAL_WEIGHTS = {"strong": 1.0, "medium": 0.6, "weak": 0.3}
BEGINNER_SIGNALS = {
    "strong": ("for beginners", "for absolute beginners", "for complete beginners", "for total beginners", "from scratch", "no prior", "no experience", "no experience needed", "no prior experience", "beginner", "beginners", "introduction to", "intro to", "step by step", "from zero", "from zero to hero", "zero to hero", "complete beginner", "absolute beginner", "total beginner", "start from zero"),
    "medium": ("basics", "basic", "fundamentals", "fundamental", "introduction", "intro", "introductory", "getting started", "tutorial", "tutorials", "primer", "quickstart", "quick start", "for dummies", "made easy", "from the ground up", "the hard way", "hand-holding", "kid friendly", "for newcomers", "for novices"),
    "weak": ("course", "courses", "textbook", "textbooks", "guide", "guides", "learn", "learning", "study", "studying", "overview", "explained", "simple", "easy", "self study"),
}
ADVANCED_SIGNALS = {
    "strong": ("mathematical foundations", "theoretical foundations", "principles of", "theory of", "foundations of", "graduate-level", "research-level", "axiomatic", "proof-based", "advanced treatment"),
    "medium": ("advanced", "deep dive", "deep-dive", "in depth", "in-depth", "rigorous", "rigour", "rigor", "formal treatment", "formal", "comprehensive understanding", "thorough understanding", "exhaustive", "in-depth treatment", "state of the art", "state-of-the-art", "cutting edge", "cutting-edge"),
    "weak": ("research", "graduate", "latest", "novel", "survey", "surveys", "benchmark", "benchmarks", "architecture", "architectures", "implementation", "implementations", "optimization", "frontier", "specialized", "specialised", "expert", "experts", "deeply understand", "deeply", "mathematical", "theoretical", "proofs", "proof", "theorem"),
}

# Difficulty markers of titles and abstracts.
BEGINNER_MARKERS = ("introduction to", "introduction", "introductory", "beginners", "beginner", "basics", "basic", "fundamentals", "getting started", "from scratch", "step by step", "for beginners", "no prior", "made easy", "for dummies", "tutorial", "primer", "quickstart", "quick start", "textbook", "self-study")
ADVANCED_MARKERS = ("advanced", "graduate", "postgraduate", "specialized", "specialised", "state of the art", "state-of-the-art", "cutting edge", "cutting-edge", "monograph", "theorem", "lemma", "corollary", "proposition", "rigorous", "formal treatment", "assumes familiarity", "assumes background", "for researchers", "for experts", "research monograph", "survey of", "comprehensive treatment")

JUNK_TITLE_SUFFIXES = ("/references", "/reference", "/bibliography", "/further reading", "/further-reading", "/see also", "/see-also", "/external links", "/external-links", "/glossary", "/index", " (disambiguation)", " (disambiguation page)")
JUNK_TITLE_PARTS = ("list of references", "bibliography of", "references for", "citation list")

CREDIBILITY_MARKERS = ("artificial soul", "conscious identity", "consciousness upload", "collective human experience", "quantum mind", "quantum consciousness", "universal love", "universal consciousness", "the pinnacle", "pinnacle of", "transcendent", "first prototype of", "novel epistemological", "epistemological framework for", "soul of", "mystical", "metaphysical framework for")

COOLDOWNS = (300, 600, 1200, 1800)

# Token matching: least shared prefix, least one-sided prefix and the length of the shorter that allows it, least inner part,
# least length for fuzzy comparison, its length difference for anagrams, and its ratio.
MIN_PREFIX, MIN_ONE_SIDED, SHORT_TOKEN, MIN_PART, MIN_FUZZY, FUZZY_SPREAD, FUZZY_RATIO = 5, 4, 6, 5, 5, 2, 0.80

# Words of level, and generic words that form compounds.
LEVEL_WORDS = (
    "beginner", "beginners", "basic", "basics", "fundamental", "fundamentals", "intro", "introduction", "introductory", "advanced", "advance", "advances", "advancement", "advancements", "expert",
    "intermediate", "mixed", "easy", "simple", "complete", "comprehensive", "quick", "fast", "slow", "crash", "from", "scratch", "step", "steps", "starter", "starting", "start", "for", "no", "prior",
    "to", "and", "beyond", "up",
)
COMPOUND_WORDS = (
    "learning", "learnings", "network", "networks", "networking", "model", "models", "modeling", "modelling", "system", "systems", "theory", "theories", "method", "methods", "methodology",
    "methodologies", "analysis", "analyses", "design", "designs", "designing", "engineering", "engineer", "engineers", "science", "sciences", "scientific", "study", "studies", "studying", "process",
    "processes", "processing", "data", "structure", "structures", "structural", "control", "controls", "controlling", "mining", "vision", "language", "languages", "search", "searching", "retrieval",
    "retrieving", "recommendation", "recommendations", "recommender", "recognition", "detection", "detecting", "prediction", "predictions", "predicting", "classification", "classifications",
    "classifying", "regression", "clustering", "cluster", "clusters", "optimization", "optimisation", "training", "inference", "generation", "generating", "translation", "translating", "constitution",
    "constitutional", "framework", "frameworks", "law", "laws", "legal", "policy", "policies", "governance", "government", "governments", "parliament", "parliaments", "court", "courts", "rights",
    "right", "treaty", "treaties", "agreement", "agreements", "protocol", "protocols",
)

# Wording around a topic.
FILLERS = (
    r"\b(?:i|i'm|im|we|we're)\s+(?:need|want|would like|require|am looking for|am searching for)\b",
    r"\b(?:please|kindly|can you|could you|would you|help|me|us)\b",
    r"\b(?:need|needs|want|wants|require|requires|show|give|tell|explain|provide|find|search|search for|look for|looking for)\b",
    r"\b(?:detailed|details|detail|comprehensive|complete|in[- ]depth|deep)\b",
    r"\b(?:fully|completely|totally|best|top|latest|greatest|ultimate|perfect|ideal)\b",
    r"\b(?:the\s+)?(?:life|world|story|tale|idea|notion|concept|essence)\s+of\b",
    r"\b(?:about|on|of|for|regarding|related to|related)\b",
    r"\b(?:what|which|who|whom|whose|when|where|why|how)\b",
    r"\b(?:is|are|was|were|do|does|did|to|from|with|without|in|at|by|as|be|been|being)\b",
    r"\b(?:and|or|but|nor|so|yet|also|than|not|into|onto|upon|per|via)\b",
    r"\b(?:a|an|the)\b",
)

# Kinds of records by what a question wants and by its level.
INTENT_TYPES = {
    "learn": ("course", "book", "documentation", "video"), "research": ("research_paper", "dataset", "repository"), "implement": ("repository", "model", "documentation"),
    "compare": ("research_paper", "documentation"), "troubleshoot": ("documentation", "repository"), "explore": ("documentation", "research_paper", "book"),
}
LEVEL_TYPES = {
    "beginner": ("course", "book", "documentation", "video"), "intermediate": ("course", "book", "documentation", "repository"), "advanced": ("research_paper", "repository", "documentation"),
    "mixed": ("documentation", "course", "research_paper"), "balanced": ("documentation", "course", "research_paper"),
}
DEFAULT_TYPES = ("documentation", "course", "research_paper")

# Signs of a question about the talk itself, and of an answer that refuses.
STRONG_MARKERS = ("what have i", "what did i", "what was i", "what were we", "what have we", "what did we", "remind me what", "recap what", "summarize what i", "history of this", "history of our", "this conversation", "our conversation")
SELF_REFERENCES = ("i have", "i've", "i did", "i asked", "we discussed", "we talked", "so far", "recently", "previously", "earlier", "before this", "my studies", "my study", "this session", "this chat", "our chat", "our session", "up to now", "until now")
SESSION_VERBS = ("studying", "asked", "mentioned", "told you", "discussed", "talked about", "covered", "explored", "learned", "reviewed")
PRONOUNS = (" i ", " i've ", " my ", " we ", " our ", " me ", " i,", " i.", " i?", " me,", " me.", " me?")
REFUSALS = (
    "provided passages do not contain", "passages do not contain information", "passages do not contain enough", "provided context does not contain", "provided documents do not contain", "provided sources do not contain",
    "retrieved passages do not contain", "retrieved documents do not contain", "indexed sources do not contain", "does not contain information explaining", "do not contain information explaining", "does not contain enough information",
    "do not contain enough information", "not enough information in the provided", "not enough information in the retrieved", "insufficient information in the provided", "insufficient information in the retrieved",
    "cannot be answered from the provided", "cannot answer based on the provided", "unable to answer based on the provided", "unable to answer from the provided", "i do not have enough information", "i don't have enough information",
    "there is not enough information", "the sources do not provide", "no relevant information was found",
)

# What a question's words ask of a tool, and the tool for it.
TOOL_WORDS = {
    "search_academic": ("paper", "research", "study", "journal", "publication", "peer-reviewed", "academic"), "search_books": ("book", "textbook", "textbooks", "reading", "chapters"),
    "search_courses": ("course", "courses", "tutorial", "tutorials", "lecture", "video", "class", "lesson"), "search_code_models": ("code", "implementation", "repository", "github", "model", "dataset", "library", "package"),
    "search_explanation": ("basic", "basics", "beginner", "introduction", "what is", "definition", "overview", "explained", "explain"),
}

# Kinds of material: by level, and by words of the question, in order.
LEVEL_FORMATS = {"beginner": ("course", "book", "documentation", "video", "research_paper"), "intermediate": ("documentation", "course", "book", "research_paper", "repository"), "advanced": ("research_paper", "repository", "model", "dataset", "documentation")}
FORMAT_SIGNALS = (
    ("course", "course"), ("courses", "course"), ("tutorial", "course"), ("tutorials", "course"), ("lecture", "video"), ("lectures", "video"), ("video", "video"), ("videos", "video"), ("youtube", "video"), ("textbook", "book"),
    ("textbooks", "book"), ("book", "book"), ("books", "book"), ("documentation", "documentation"), ("docs", "documentation"), ("guide", "documentation"), ("guides", "documentation"), ("wiki", "documentation"), ("wikipedia", "documentation"),
    ("paper", "research_paper"), ("papers", "research_paper"), ("research", "research_paper"), ("study", "research_paper"), ("studies", "research_paper"), ("journal", "research_paper"), ("article", "research_paper"), ("articles", "research_paper"),
    ("code", "repository"), ("implementation", "repository"), ("github", "repository"), ("repository", "repository"), ("model", "model"), ("models", "model"), ("dataset", "dataset"), ("datasets", "dataset"),
)
MAX_FORMATS = 6

# How long an answer should be, what leads and trails a question, and what is searched for beside it.
ANSWER_STYLES = {
    "short": ("briefly", "in one line", "in one sentence", "one line answer", "one sentence answer", "short answer", "short explanation", "quick answer", "quick summary", "tldr", "tl;dr", "in a nutshell", "just the gist", "keep it short", "keep it brief", "concise answer", "summarize quickly"),
    "detailed": ("very detailed", "in detail", "in depth", "in-depth", "explain fully", "explain in detail", "explain thoroughly", "step by step", "walk me through", "walk through", "walk-through", "comprehensive explanation", "comprehensive answer", "detailed explanation", "detailed answer", "thorough explanation", "thorough answer", "thoroughly explain", "full explanation", "full answer", "deep dive", "deep-dive", "elaborate on"),
    "exhaustive": ("exhaustive", "exhaustively", "everything about", "everything on", "complete guide", "complete explanation", "in every detail", "nothing left out", "all aspects", "cover everything", "as much detail as possible", "maximum detail", "most detailed", "the most detail"),
}
QUESTION_LEADERS = ("what is", "what are", "who is", "who are", "how does", "how do", "how can", "how is", "how are", "how to", "why does", "why do", "why is", "why are", "when did", "when was", "when is", "where is", "where are", "explain", "describe", "define", "definition of", "meaning of", "tell me about", "tell me", "talk about", "give me", "list", "examples of", "example of", "should i", "can you", "could you", "please")
TRAILING_NOISE = ("?", "!", ".", ",", ":", ";", " please", " thanks", " thank you")
SEARCH_TEMPLATES = {
    "definition": ("{} definition", "what is {}", "{} overview"), "comparison": ("{} vs", "{} comparison", "difference between {}"), "mechanism": ("how does {} work", "{} mechanism", "{} architecture"), "causation": ("why {}", "causes of {}", "{} reasons"),
    "enumeration": ("{} examples", "types of {}", "{} list"), "timeline": ("{} history", "{} origins", "history of {}"), "decision": ("{} pros and cons", "{} trade-offs", "should i use {}"), "explanation": ("{} explained", "{} overview", "introduction to {}"),
    "overview": ("{} overview", "{} introduction", "{} explained"),
}

# A catalog's dimensions, the words that name them, and what an answer's confidence is made of.
CATALOG_WORDS = {
    "platform": ("platform", "platforms", "site", "sites"), "source_type": ("source type", "source types", "type of source", "types of sources", "format", "formats"), "domain": ("domain", "domains", "field", "fields", "subject area", "subject areas"),
    "topic": ("topic", "topics", "subject", "subjects"), "year": ("year", "years", "date", "dates", "publication"), "run": ("run", "runs", "session", "sessions", "indexing run"), "title": ("title", "titles"),
}
CATALOG_WEIGHTS = {"llm_used": 0.3, "classifier_confidence": 0.25, "snapshot_richness": 0.15, "answer_substance": 0.2, "dimension_coverage": 0.1}
