"""Records in JSON of any shape, as VARIANT: a document is parsed once, and all its parts are read from what that gave."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .readers import CONTAINERS, PAYLOADS

# The keys under which a record's fields may be, the first with a value counts; kinds by platform; and the names that are known.
KEYS = {
    "title": ("title", "name", "heading", "document_title"), "url": ("url", "link", "source_url", "uri", "href", "landing_page_url", "pdf_url"),
    "abstract": ("abstract", "snippet", "content", "description", "summary", "text", "preview", "body"), "platform": ("platform", "source_platform", "provider"), "source_type": ("source_type", "type", "kind"),
    "source_id": ("source_id", "id", "doc_id", "paper_id", "node_id"), "year": ("year", "published_year", "publication_year"), "citation_count": ("citation_count", "citations", "reference_count"), "difficulty": ("difficulty", "level"),
}
PLATFORM_TYPES = {
    "arxiv": "research_paper", "semantic_scholar": "research_paper", "openalex": "research_paper", "core": "research_paper", "pubmed": "research_paper", "europe_pmc": "research_paper", "doaj": "research_paper", "crossref": "research_paper",
    "github": "repository", "huggingface": "model", "wikipedia": "documentation", "open_library": "book", "internet_archive": "book", "wikibooks": "book", "openstax": "book", "mit_ocw": "course", "libretexts": "course", "wikiversity": "course",
    "jina": "documentation",
}
TYPES = ("research_paper", "course", "book", "documentation", "repository", "model", "dataset", "video", "blog", "other")
LEVELS = ("beginner", "intermediate", "advanced", "unknown")
YES, NO = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


def _get(item: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", kind)


def first_value(item: Column, keys: Iterable[str]) -> Column:
    """The first of some keys that has a value, as cleaned text; empty if none has."""
    return tx.clean(F.coalesce(*[F.nullif(_get(item, k, "string"), F.lit("")) for k in keys]))


def elements(value: Column) -> Column:
    """A list's elements, or the one value; none for null."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(listed.isNotNull(), listed).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<variant>"))


def _children(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x: F.flatten(F.array(*[elements(_get(x, c, "variant")) for c in CONTAINERS]))))


def once(value: Column) -> Column:
    """A value that is worked out once a row: an exploded array of one, which the optimizer neither repeats where it is used nor looks through."""
    return F.explode(F.array(value))


def harvested(rows: DataFrame, key: str, raw: str = "raw", depth: int = 4) -> DataFrame:
    """(key, item): every value of rows' JSON that may be a record: the document or its list's elements, and what lies under the container names, ``depth`` levels down.

    One scan and one parse: each level's items are an array beside that of the level above.  What is no JSON gives nothing."""
    levels = rows.select(key, elements(F.try_parse_json(raw)).alias("_0"))
    for i in range(depth):
        levels = levels.select(key, once(F.struct(*[f"_{j}" for j in range(i + 1)], _children(F.col(f"_{i}")).alias(f"_{i + 1}"))).alias("l")).select(key, "l.*")
    return levels.select(key, F.explode(F.concat(*[F.col(f"_{i}") for i in range(depth + 1)])).alias("item"))


def normalized(items: DataFrame, key: str, platform_default: str = "") -> DataFrame:
    """Items as records of one shape, by the first key that has a value; an item without a url is no record.  The title falls back to the url, the id to it as well, the
    platform to the one given or web, the kind to its platform's."""
    found = items.select(key, "item", *[first_value(F.col("item"), keys).alias(name) for name, keys in KEYS.items()]).where("url <> ''")
    platform = F.coalesce(F.nullif(F.lower("platform"), F.lit("")), F.lit(platform_default.lower() or "web"))
    rows = found.withColumn("platform", platform)
    kind = F.lit("other")
    for name, value in PLATFORM_TYPES.items():
        kind = F.when(F.col("platform") == name, value).otherwise(kind)
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return rows.select(
        key, "item", blank("source_id", F.col("url")).alias("source_id"), blank("title", F.col("url")).alias("title"), "url", "platform", F.coalesce(F.nullif(F.lower("source_type"), F.lit("")), kind).alias("source_type"), "abstract",
        F.col("year").try_cast("int").alias("year"), F.col("citation_count").try_cast("long").alias("citation_count"), F.nullif(F.lower("difficulty"), F.lit("")).alias("difficulty"), _get(F.col("item"), "metadata", "map<string,string>").alias("metadata"),
    )


def lenient_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def typed(records: DataFrame, platforms: Iterable[str]) -> DataFrame:
    """Records of normalized() with the types of the model: unknown platforms are web, unknown kinds other, unknown levels unknown; authors each once
    whatever their case; dates, numbers and truth values that can't be read are null."""
    item = F.col("item")
    names = F.filter(F.transform(F.coalesce(_get(item, "authors", "array<string>"), F.array().cast("array<string>")), lambda n: tx.clean(n)), lambda n: n != "")
    one_of = lambda c, known, other: F.when(F.col(c).isin(*known), F.col(c)).otherwise(other)
    return records.withColumns({
        "platform": one_of("platform", tuple(platforms), "web"), "source_type": one_of("source_type", TYPES, "other"), "difficulty": F.when(F.col("difficulty").isNotNull(), one_of("difficulty", LEVELS, "unknown")),
        "authors": tx.distinct_ignoring_case(names), "published_at": F.try_to_timestamp(F.nullif(F.trim(_get(item, "published_at", "string")), F.lit(""))), "has_code": lenient_bool(_get(item, "has_code", "string")),
        "score": _get(item, "score", "double"), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
    }).drop("item")


# Where a provider's JSON has a record's authors (a list or a text, and of a list's objects the names that make one; a separator where one text holds several; the most that are
# taken), its kind, and its metadata.
AUTHORS = {
    "openalex": ("$.authorships", ("$.author.display_name",), None, None), "semantic_scholar": ("$.authors", ("$.name",), None, None), "crossref": ("$.author", ("$.given", "$.family"), None, 10), "europe_pmc": ("$.authorString", (), ",", 10),
    "doaj": ("$.bibjson.author", ("$.name",), None, 10), "core": ("$.authors", ("$.name",), None, None), "zenodo": ("$.metadata.creators", ("$.name",), None, 10), "open_library": ("$.author_name", (), None, 10), "internet_archive": ("$.creator", (), ";", 10),
    "github": ("$.owner.login", (), None, None),
}
KINDS = {
    "openalex": "research_paper", "semantic_scholar": "research_paper", "crossref": "research_paper", "europe_pmc": "research_paper", "doaj": "research_paper", "core": "research_paper", "wikipedia": "documentation", "wikibooks": "documentation", "wikiversity": "documentation",
    "open_library": "documentation", "github": "repository", "huggingface": "model", "tavily": "blog", "exa": "blog", "serper": "blog", "serpapi": "blog", "jina": "documentation", "mit_ocw": "course",
}
METADATA = {
    "openalex": {"openalex_id": "$.id", "doi": "$.doi"}, "semantic_scholar": {"paper_id": "$.paperId", "venue": "$.venue"}, "crossref": {"doi": "$.DOI", "container_title": "$.container-title[0]", "type": "$.type"},
    "europe_pmc": {"europe_pmc_id": "$.id", "doi": "$.doi", "source": "$.source", "is_open_access": "$.isOpenAccess"}, "doaj": {"doaj_id": "$.id", "journal": "$.bibjson.journal.title"}, "core": {"core_id": "$.id"},
    "zenodo": {"zenodo_id": "$.id", "doi": "$.doi", "resource_type": "$.metadata.resource_type.title"}, "wikipedia": {"page_id": "$.id", "description": "$.description"}, "wikibooks": {"page_id": "$.id", "description": "$.description"},
    "wikiversity": {"page_id": "$.id", "description": "$.description"}, "open_library": {"openlibrary_key": "$.key", "ebook_access": "$.ebook_access"}, "internet_archive": {"identifier": "$.identifier", "mediatype": "$.mediatype"},
    "github": {"stars": "$.stargazers_count", "language": "$.language", "fork": "$.fork", "archived": "$.archived"}, "huggingface": {"model_id": "$.id", "author": "$.author", "pipeline_tag": "$.pipeline_tag", "downloads": "$.downloads", "likes": "$.likes"},
    "tavily": {"raw_score": "$.score"}, "exa": {"exa_score": "$.score"}, "serper": {"position": "$.position"}, "serpapi": {"position": "$.position"},
}


def _at(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def authors_of(item: Column, platform: str) -> Column:
    """Names, cleaned and none of them empty, of a provider's record."""
    none = F.array().cast("array<string>")
    if platform not in AUTHORS:
        return none
    path, names, separator, most = AUTHORS[platform]
    listed = _at(item, path, "array<variant>")
    text = lambda x: F.concat_ws(" ", *[_at(x, n) for n in names]) if names else _at(x, "$")
    # an object has the names, anything else is one
    one = lambda x: F.coalesce(F.nullif(text(x), F.lit("")), F.when(_at(x, "$", "map<string,variant>").isNull(), _at(x, "$")))
    found = F.coalesce(F.transform(listed, one), F.when(_at(item, path).isNotNull(), F.array(_at(item, path))), none)
    if separator:
        found = F.flatten(F.transform(F.filter(found, lambda t: t.isNotNull()), lambda t: F.split(t, separator)))
    clean = F.filter(F.transform(found, lambda t: tx.clean(t)), lambda t: t != "")
    return F.slice(clean, 1, most) if most else clean


def kind_of(item: Column, platform: str) -> Column:
    if platform == "zenodo":
        said = F.lower(F.coalesce(_at(item, "$.metadata.resource_type.title"), _at(item, "$.metadata.resource_type"), F.lit("")))
        return F.when(said.contains("publication"), "research_paper").when(said.contains("software"), "other").when(said.contains("lesson") | said.contains("learning"), "course").otherwise("dataset")
    if platform == "internet_archive":
        said = F.lower(F.trim(_at(item, "$.mediatype")))
        return F.when(said == "texts", "documentation").when(said == "movies", "video").otherwise("other")
    return F.lit(KINDS[platform])


def metadata_of(item: Column, platform: str) -> Column:
    """What a provider says besides, as text; keys without a value are left out."""
    pairs = [v for name, path in METADATA.get(platform, {}).items() for v in (F.lit(name), _at(item, path))]
    return F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda _, v: v.isNotNull())


def provider_records(payloads: DataFrame, *keys: str) -> DataFrame:
    """(platform, raw JSON, and keys to keep) as whole records: title, url, year, abstract, citation_count, doi, authors, source_type and metadata; of a field's paths the first that has a
    value counts.  Each payload is parsed once, and only its own provider's paths are tried.  A row whose platform is not known, or that has no title or url, is left out."""
    fields = ("title", "url", "year", "abstract", "citation_count", "doi")
    item = F.col("item")
    first = lambda paths: F.coalesce(*[F.nullif(F.trim(_at(item, p)), F.lit("")) for p in paths])
    of = lambda p: F.struct(*[first(paths).alias(n) for n, paths in zip(fields, PAYLOADS[p], strict=True)], authors_of(item, p).alias("authors"), kind_of(item, p).alias("source_type"), metadata_of(item, p).alias("metadata"))
    known = payloads.select(*keys, F.lower("platform").alias("platform"), "raw").where(F.col("platform").isin(*PAYLOADS))
    rows = known.select(*keys, "platform", once(F.try_parse_json("raw")).alias("item"))
    found = rows.select(*keys, "platform", once(F.coalesce(*[F.when(F.col("platform") == p, of(p)) for p in PAYLOADS])).alias("r")).select(*keys, "platform", "r.*").where("title IS NOT NULL AND url IS NOT NULL")
    year = F.nullif(F.regexp_extract("year", "([12][0-9]{3})", 1), F.lit("")).try_cast("int")
    return found.withColumns({"year": year, "citation_count": F.col("citation_count").try_cast("long")})
