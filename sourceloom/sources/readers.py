"""Readers of the stores that a run leaves behind, with schemas given, and mappers of provider payloads to one record form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

EPISODE = T.StructType([T.StructField("episode_id", T.StringType()), T.StructField("task_type", T.StringType()), T.StructField("strategy", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("tokens_used", T.LongType()), T.StructField("tokens_by_category", T.MapType(T.StringType(), T.LongType())), T.StructField("created_at", T.TimestampType())])
LEDGER = T.StructType([T.StructField("entry_id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("tokens_used", T.LongType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("success", T.BooleanType()), T.StructField("created_at", T.TimestampType())])
TRACE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event", T.StringType()), T.StructField("payload", T.StringType())])


def episodes(spark: SparkSession, path: str, newest: int = 500) -> DataFrame:
    """Episodes of JSON lines, bad lines skipped, the newest kept (a feature of the store)."""
    rows = spark.read.schema(EPISODE).option("mode", "DROPMALFORMED").json(path).where("episode_id is not null")
    return rows.orderBy(F.desc_nulls_last("created_at"), "episode_id").limit(newest)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries, repeats of an id dropped; a missing total is prompt plus completion."""
    rows = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("entry_id is not null").dropDuplicates(["entry_id"])
    parts = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return rows.withColumn("tokens_used", F.coalesce(F.nullif(F.col("tokens_used"), F.lit(0)), parts))


def run_reports(spark: SparkSession, path: str, newest: int = 100) -> DataFrame:
    """JSON reports of the newest files: one row per source, the newest report's of each source_id."""
    meta = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("request_id string, sources array<struct<source_id string, title string, url string>>").json(path)
    rows = meta.select("request_id", "sources", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"))
    latest = rows.orderBy(F.desc("modified"), F.desc("file")).limit(newest)
    flat = latest.select("request_id", "modified", "file", F.explode("sources").alias("s")).select("request_id", "modified", "file", "s.*")
    w = W.partitionBy("source_id").orderBy(F.desc("modified"), F.desc("file"))
    return flat.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "file")


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of trace lines, open keys kept as text."""
    lines = spark.readStream.text(folder)
    got = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(F.try_to_timestamp(got("ts")).alias("ts"), got("event").alias("event"), F.col("value").alias("payload")).where("event is not null")


def inverted_text(index: Column) -> Column:
    """A map of word -> positions as text in order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


# Where each provider's JSON has a record's title, url, year, abstract, citations and identifier; the first path that has a
# value counts.
PAYLOADS = {
    "openalex": (("$.display_name",), ("$.id",), ("$.publication_year",), ("$.abstract",), ("$.cited_by_count",), ("$.doi",)),
    "semantic_scholar": (("$.title",), ("$.url",), ("$.year",), ("$.abstract",), ("$.citationCount",), ("$.externalIds.DOI",)),
    "crossref": (("$.title[0]",), ("$.URL",), ("$['published-print']['date-parts'][0][0]", "$['published-online']['date-parts'][0][0]", "$.created['date-parts'][0][0]", "$.issued.date-parts[0][0]",), ("$.abstract",), ("$.is-referenced-by-count",), ("$.DOI",)),
    "europe_pmc": (("$.title",), ("$.fullTextUrlList.fullTextUrl[0].url",), ("$.pubYear",), ("$.abstractText",), ("$.citedByCount",), ("$.doi",)),
    "doaj": (("$.bibjson.title",), ("$.bibjson.link[0].url",), ("$.bibjson.year",), ("$.bibjson.abstract",), ("$.none",), ("$.bibjson.identifier[1].id", "$.bibjson.identifier[0].id",)),
    "core": (("$.title",), ("$.downloadUrl",), ("$.yearPublished",), ("$.abstract",), ("$.citationCount",), ("$.doi",)),
    "zenodo": (("$.metadata.title",), ("$.links.html",), ("$.metadata.publication_date",), ("$.metadata.description",), ("$.none",), ("$.doi",)),
    "wikipedia": (("$.title",), ("$.content_urls.desktop.page",), ("$.none",), ("$.extract",), ("$.none",), ("$.none",)),
    "open_library": (("$.title",), ("$.key",), ("$.first_publish_year",), ("$.first_sentence",), ("$.none",), ("$.none",)),
    "internet_archive": (("$.title",), ("$.identifier",), ("$.year",), ("$.description",), ("$.downloads",), ("$.none",)),
    "github": (("$.full_name",), ("$.html_url",), ("$.created_at",), ("$.description",), ("$.stargazers_count",), ("$.none",)),
    "huggingface": (("$.id",), ("$.url",), ("$.lastModified",), ("$.description",), ("$.downloads",), ("$.none",)),
    "tavily": (("$.title",), ("$.url",), ("$.published_date",), ("$.content",), ("$.none",), ("$.none",)),
    "exa": (("$.title",), ("$.url",), ("$.publishedDate",), ("$.text",), ("$.none",), ("$.none",)),
    "serper": (("$.title",), ("$.link",), ("$.date",), ("$.snippet",), ("$.none",), ("$.none",)),
    "serpapi": (("$.title",), ("$.link",), ("$.date",), ("$.snippet",), ("$.none",), ("$.none",)),
    "jina": (("$.title",), ("$.url",), ("$.date",), ("$.description",), ("$.none",), ("$.none",)),
    "wikibooks": (("$.title",), ("$.content_urls.desktop.page",), ("$.timestamp",), ("$.snippet",), ("$.none",), ("$.none",)),
    "wikiversity": (("$.title",), ("$.content_urls.desktop.page",), ("$.timestamp",), ("$.snippet",), ("$.none",), ("$.none",)),
    "mit_ocw": (("$.title",), ("$.url",), ("$.year",), ("$.description",), ("$.none",), ("$.none",)),
}
CONTAINERS = ("sources", "results", "items", "data", "documents", "papers", "repositories", "books", "courses")


def records(payloads: DataFrame) -> DataFrame:
    """(platform, raw JSON) rows as records: platform, title, url, year, abstract, citation_count, doi.

    The paths are a dimension of a row a platform, joined by broadcast.  A row whose platform is not known, or that has no title or url, is
    left out."""
    names = ("title", "url", "year", "abstract", "citation_count", "doi")
    paths = payloads.sparkSession.createDataFrame([(p, *map(list, held)) for p, held in PAYLOADS.items()], "platform string, " + ", ".join(f"{n} array<string>" for n in names))
    rows = payloads.select("platform", "raw").join(F.broadcast(paths), "platform")
    found = lambda n: F.get(F.filter(F.transform(n, lambda p: F.nullif(F.trim(F.call_function("get_json_object", F.col("raw"), p)), F.lit(""))), lambda v: v.isNotNull()), F.lit(0))
    rows = rows.select("platform", *[found(n).alias(n) for n in names]).where("title is not null and url is not null")
    year = F.nullif(F.regexp_extract("year", "([12][0-9]{3})", 1), F.lit("")).try_cast("int")
    return rows.select("platform", "title", "url", year.alias("year"), "abstract", F.col("citation_count").try_cast("long").alias("citation_count"), "doi")


def year_of_parts(raw: Column) -> Column:
    """The first year of a record's date parts: printed, online, created, issued."""
    return F.coalesce(*[F.get_json_object(raw, f"$['{k}']['date-parts'][0][0]").try_cast("int") for k in ("published-print", "published-online", "created", "issued")])


def first_identifier(raw: Column) -> Column:
    """The first identifier of a list of (type, id) that has a value; empty if there is none."""
    ids = F.transform(F.from_json(raw, "array<struct<type: string, id: string>>"), lambda x: F.trim(F.coalesce(x["id"], F.lit(""))))
    return F.coalesce(F.get(F.filter(ids, lambda x: x != ""), F.lit(0)), F.lit(""))


def pubmed(sets: DataFrame) -> DataFrame:
    """Articles of XML sets (raw): pmid, title, abstract (1,500 characters at most), year, journal and authors' last names."""
    part = lambda tag: F.regexp_extract("a", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    names = F.filter(F.transform(F.regexp_extract_all("a", F.lit("(?s)<LastName>(.*?)</LastName>"), 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = sets.select(F.explode(F.regexp_extract_all("raw", F.lit("(?s)<PubmedArticle>(.*?)</PubmedArticle>"), 1)).alias("a"))
    rows = rows.withColumn("pmid", F.regexp_extract("a", "<PMID[^>]*>([0-9]+)</PMID>", 1)).where("pmid <> ''")
    year = F.nullif(F.regexp_extract("a", "<Year>([0-9]{4})</Year>", 1), F.lit("")).cast("int")
    return rows.select("pmid", plain(part("ArticleTitle")).alias("title"), F.left(plain(part("Abstract")), F.lit(1500)).alias("abstract"), year.alias("year"), plain(part("Title")).alias("journal"), names.alias("authors"))


def legacy_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an old JSON store, a list or an object with one, those without an id given one from run, record, title and url."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    listed = F.when(F.left(F.trim("raw"), F.lit(1)) == "[", F.col("raw")).otherwise(F.get_json_object("raw", "$.documents"))
    rows = raw.select(F.inline(F.from_json(listed, "array<struct<doc_id: string, run_id: string, source_id: string, title: string, url: string, text: string>>")))
    made = F.left(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("run_id", "source_id", "title", "url")]), 256), F.lit(32))
    return rows.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), made))


def memories(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a memory store, a JSON object from key to value."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "entry"))


def conversation_documents(turns: DataFrame) -> DataFrame:
    """conv_id and a JSON document of its turns in order (a conversation is one document, as its export is)."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(listed.alias("turns"))).alias("document"))


def dimension(spark: SparkSession, text: str) -> DataFrame:
    """domain, alias, platform, place of a YAML or JSON mapping of domains, each with aliases and platforms.  YAML needs its library."""
    import json

    try:
        import yaml
    except ImportError:
        yaml = None
    held = yaml.safe_load(text) if yaml else json.loads(text)
    rows = [(d, a, None, None) for d, c in held.items() for a in c.get("aliases", [])] + [(d, None, p, i) for d, c in held.items() for i, p in enumerate(c.get("platforms", []))]
    return spark.createDataFrame(rows, "domain string, alias string, platform string, place int")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Atom feeds by Spark's XML reader: id, title, summary, published, authors, doi, and the links to the page and the PDF."""
    schema = "id string, title string, summary string, published string, author array<struct<name: string>>, link array<struct<_href: string, _type: string, _title: string, _rel: string, _VALUE: string>>, doi string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    first = lambda holds: F.get(F.transform(F.filter("link", holds), lambda x: x["_href"]), F.lit(0))
    pdf = first(lambda x: (x["_type"] == "application/pdf") | (x["_title"] == "pdf"))
    return rows.select("id", "title", "summary", "published", F.transform("author", lambda a: a["name"]).alias("authors"), "doi", F.coalesce(first(lambda x: x["_rel"] == "alternate"), first(lambda x: x["_href"].isNotNull())).alias("url"), pdf.alias("pdf_url"))
