"""Source records derived from the documents table by fixed rules, in Spark and as SQL, so that both see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import spread

PLATFORMS = ("arxiv", "openalex", "github", "wikipedia", "web", "pubmed", "openstax", "crossref", "huggingface", "core", "doaj", "somewhere_else")
TYPES = ("research_paper", "course", "book", "documentation", "repository", "model", "dataset", "video", "blog", "other")
LEVELS = ("beginner", "intermediate", "advanced", "unknown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


def pick(values: tuple, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Wording that the invented prose lacks, so that markers, notation, references and forms of address occur.
PHRASES = (
    "In this paper we prove that, furthermore, it follows from Theorem 3 and the results of [1, 2].", "You will learn the basics step by step. Let`s try this! Your first program is easy.",
    "Introduction to machine learning for beginners, a tutorial from scratch.", "Let x be a vector. Suppose that x_1 = ~alpha + y^2, see arXiv:2301.00001 and doi:10.1000/5.",
    "Advanced graduate survey of electrodynamics, thermodynamics and neurophysiology; rigorous.", "State of the art results (Smith et al. 2020), Figure 4.", "You you will you need you your own you you.",
    "Hydrodynamic instabilities and chromatographic classification of polymorphisms in psychological generalization.",
)
SUMMARY = "replace(replace(CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PHRASES)) + " END, '`', chr(39)), '~', chr(92))"
TITLE_HEADS = ("Introduction to ", "Advanced ", "Advances in the theory of ", "Basics of ", "Graduate Course on ", "Recent advancements and ", "Why Ada Lovelace met Alan Turing: ", "This paper has been withdrawn ")
TITLE_HEAD = "CASE doc_id % 40 " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(TITLE_HEADS)) + " ELSE '' END"

#: Expressions that both engines read alike.
SHARED = {
    "ordinal": "doc_id",
    "source_id": "concat('s', cast(doc_id AS varchar(20)))",
    "platform": pick(PLATFORMS, "doc_id % 12"),
    "source_type": pick(TYPES, "doc_id % 10"),
    "difficulty": pick(LEVELS, "doc_id % 4"),
    "year": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 1995 + doc_id % 31 END",
    "citation_count": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 37) % 1500 END",
    "stars": "CASE WHEN doc_id % 5 = 0 THEN (doc_id * 91) % 9000 END",
    "has_code": "CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "n_authors": "doc_id % 4",
    "meta_keys": "doc_id % 9",
    "doi": "CASE WHEN doc_id % 35 = 0 THEN '10.48550/arXiv.2301.00001' WHEN doc_id % 33 = 0 THEN 'not a doi' WHEN doc_id % 6 = 0 THEN concat('https://doi.org/10.1000/', cast(doc_id % 400 AS varchar(20))) WHEN doc_id % 38 = 0 THEN concat('DOI:10.2000/X', cast(doc_id % 60 AS varchar(20))) END",
    "external_doi": "CASE WHEN doc_id % 21 = 0 THEN concat('10.3000/', cast(doc_id % 90 AS varchar(20))) END",
    "external_arxiv": "CASE WHEN doc_id % 17 = 0 THEN concat('2302.', lpad(cast(doc_id % 300 AS varchar(20)), 5, '0')) END",
    "meta_id": "CASE WHEN doc_id % 43 = 0 THEN concat('hep-th/99', lpad(cast(doc_id % 80 AS varchar(20)), 5, '0')) WHEN doc_id % 47 = 0 THEN concat('W', cast(doc_id AS varchar(20))) END",
    "arxiv_raw": "CASE WHEN doc_id % 8 = 0 THEN concat('arXiv:2301.', lpad(cast(doc_id % 300 AS varchar(20)), 5, '0'), 'v2') END",
    "url": "CASE WHEN doc_id % 59 = 0 THEN 'ftp://files.example.org/a' WHEN doc_id % 31 = 0 THEN concat('https://arxiv.org/abs/2105.', lpad(cast(doc_id % 200 AS varchar(20)), 5, '0'), 'v1') WHEN doc_id % 37 = 0 THEN concat('https://doi.org/10.5555/', cast(doc_id % 90 AS varchar(20))) ELSE concat('https://www.example.org/', source, '/', cast(doc_id % 700 AS varchar(20))) END",
    "authors_raw": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'BO CHEN;Ann Lee' ELSE 'Bo Chen;ann LEE;Di Xu' END",
    "summary": SUMMARY,
    "description": "CASE WHEN doc_id % 9 = 0 THEN 'A <b>short</b> course on data structures' END",
    "publisher": "CASE doc_id % 10 WHEN 1 THEN 'Springer Nature' WHEN 2 THEN 'medium.com' WHEN 3 THEN 'University Press on Substack' END",
    "downloads": "CASE WHEN doc_id % 7 = 3 THEN doc_id * 13 % 30000 END",
    "has_pdf": "doc_id % 5 = 2",
    "open_access": "doc_id % 7 = 1",
    "code_url": "CASE WHEN doc_id % 8 = 5 THEN 'https://code.example.org/x' END",
    "published": "CASE WHEN doc_id % 11 < 6 THEN 1500000000 + doc_id * 3600 END",
    "run_id": "concat('r', cast(doc_id % 7 AS varchar(20)))",
    "abstract": "text",
}
TITLE = r"^[^.!?\n|]*"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = [F.expr(e.replace("varchar(20)", "string")).alias(n) for n, e in SHARED.items()]
    return docs.select(*made, F.trim(F.concat(F.expr(TITLE_HEAD), F.regexp_extract("text", TITLE, 0))).alias("title"))


SOURCES = "src AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SHARED.items()) + f", trim(concat({TITLE_HEAD}, regexp_extract(text, '{TITLE}'))) AS title FROM documents)"
