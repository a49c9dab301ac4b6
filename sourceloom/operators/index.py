"""Stored postings: built once, kept up to date by segments, merged now and then, read by term or by stem.

An index is a folder of segments.  A segment has postings (term, doc_id, tf, doc_len), dealt into folders by the term's hash and sorted by
term, so a search reads the parts and row groups of its terms alone; its distinct terms with their stems, dealt by the stem; lengths (doc_id, doc_len); and the ids that it
replaces or deletes in earlier segments.  Writing a segment reads the documents in it and nothing else.

Which segments there are is said by the newest commit (generation and segments), so a segment is seen whole or not at all.  ``compact`` writes the live rows of all segments as the one segment
of a new generation and commits that; searches that began before go on with the old one, whose files stay until ``vacuum``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import porter, text as tx
from ..sources import store
from . import relevance as rel

PARTS = 32
_held: dict[tuple, str] = {}


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _state(spark: SparkSession, folder: str) -> tuple[int, int, list[int]]:
    """Number of the newest commit, its generation and segments."""
    number, said = store.current(spark, folder)
    generation, _, segments = said.partition(";")
    return number, int(generation), [int(s) for s in segments.split(",")]


def _said(generation: int, segments: list[int]) -> str:
    return f"{generation};{','.join(map(str, segments))}"


def _write_postings(rows: DataFrame, home: str, number: int) -> None:
    """Postings and the stems of their terms."""
    spark, at = rows.sparkSession, f"{home}/postings/segment={number}"
    dealt = rows.withColumn("part", part_of(F.col("term")))
    dealt.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(at)
    terms = spark.read.schema("term string").parquet(at).select("term").distinct().withColumn("stem", porter.stem(F.col("term"))).withColumn("part", part_of(F.col("stem")))
    terms.repartition("part").sortWithinPartitions("part", "stem").write.mode("overwrite").partitionBy("part").parquet(f"{home}/terms/segment={number}")


def _write_segment(docs: DataFrame, home: str, number: int, gone: DataFrame | None) -> None:
    _write_postings(rel.postings(docs), home, number)
    docs.select("doc_id", tx.blank_count(tx.ascii_words(F.col("text"))).alias("doc_len")).write.mode("overwrite").parquet(f"{home}/lengths/segment={number}")
    none = docs.select("doc_id").where(F.lit(False))
    (none if gone is None else gone.select("doc_id").distinct()).write.mode("overwrite").parquet(f"{home}/gone/segment={number}")


def build(docs: DataFrame, folder: str) -> str:
    """An index of docs (doc_id, text; an id once)."""
    _write_segment(docs, f"{folder}/generation=0", 0, None)
    store.commit(docs.sparkSession, folder, _said(0, [0]), None)
    return folder


def upsert(spark: SparkSession, folder: str, docs: DataFrame, deleted: DataFrame | None = None) -> None:
    """Puts docs in the index in place of those with their ids, and takes deleted ids (doc_id) out."""
    commit, generation, segments = _state(spark, folder)
    number = segments[-1] + 1
    ids = docs.select("doc_id")
    _write_segment(docs, f"{folder}/generation={generation}", number, ids if deleted is None else ids.unionByName(deleted.select("doc_id")))
    store.commit(spark, folder, _said(generation, [*segments, number]), commit)


def compact(spark: SparkSession, folder: str) -> None:
    """Merges all segments into one, without the rows that later ones replaced or deleted.  The documents are not read."""
    commit, generation, _ = state = _state(spark, folder)
    home = f"{folder}/generation={generation + 1}"
    _write_postings(_live(spark, folder, "postings", state).select("term", "doc_id", "doc_len", "tf"), home, 0)
    lengths = _live(spark, folder, "lengths", state).select("doc_id", "doc_len")
    lengths.write.mode("overwrite").parquet(f"{home}/lengths/segment=0")
    lengths.select("doc_id").where(F.lit(False)).write.mode("overwrite").parquet(f"{home}/gone/segment=0")
    store.commit(spark, folder, _said(generation + 1, [0]), commit)


def vacuum(spark: SparkSession, folder: str) -> None:
    """Removes the files of generations before the newest, when no search reads them any more."""
    _, generation, _ = _state(spark, folder)
    p, fs = store.file_system(spark, folder)
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("generation=") and int(name.removeprefix("generation=")) < generation:
            fs.delete(f.getPath(), True)


def _rows(spark: SparkSession, folder: str, kind: str, state: tuple[int, int, list[int]]) -> DataFrame:
    _, generation, segments = state
    home = f"{folder}/generation={generation}/{kind}"
    return spark.read.option("basePath", home).parquet(*[f"{home}/segment={s}" for s in segments])


def _live(spark: SparkSession, folder: str, kind: str, state: tuple[int, int, list[int]]) -> DataFrame:
    """A kind's rows without those that a later segment replaces or deletes; an equi-join on the id, and none for one segment."""
    rows = _rows(spark, folder, kind, state)
    if len(state[2]) == 1:
        return rows
    gone = _rows(spark, folder, "gone", state).groupBy("doc_id").agg(F.max("segment").alias("until"))
    return rows.join(gone, "doc_id", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")


def corpus(spark: SparkSession, folder: str, state: tuple | None = None) -> DataFrame:
    """One row: n_docs and avg_len."""
    return _live(spark, folder, "lengths", state or _state(spark, folder)).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def _parts(spark: SparkSession, words: list[str]) -> list[int]:
    return [r.p for r in spark.createDataFrame([(t,) for t in words], "t string").select(part_of(F.col("t")).alias("p")).distinct().collect()]


def _forms(spark: SparkSession, folder: str, words: list[str], state: tuple, most: int) -> dict[str, str]:
    """The index's terms that share a stem with one of some words, and their stems.  The stem of a word has few forms; more than ``most`` are an error."""
    stems = sorted({r.s for r in spark.createDataFrame([(t,) for t in words], "t string").select(porter.stem(F.lower("t")).alias("s")).collect()})
    found = _rows(spark, folder, "terms", state).where(F.col("part").isin(*_parts(spark, stems)) & F.col("stem").isin(*stems)).select("term", "stem").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms share the stems of {words}")
    return {r.term: r.stem for r in found}


def search(spark: SparkSession, folder: str, terms: list[str], stemmed: bool = False, most_forms: int = 100_000) -> DataFrame:
    """doc_id, bm25 and relevance of every document with one of the terms; ``stemmed``: with a form of one."""
    state = _state(spark, folder)
    forms = _forms(spark, folder, terms, state, most_forms) if stemmed else {t: t for t in terms}
    wanted = sorted(set(forms.values())) if stemmed else list(dict.fromkeys(terms))
    names = spark.createDataFrame(list(forms.items()), "term string, word string")
    rows = _live(spark, folder, "postings", state).where(F.col("part").isin(*(_parts(spark, list(forms)) if forms else [-1]))).join(F.broadcast(names), "term")
    if stemmed:
        rows = rows.groupBy("word", "doc_id", "doc_len").agg(F.sum("tf").alias("tf"))
    else:
        rows = rows.where(F.col("term").isin(*terms))
    df = rows.groupBy("word").agg(F.count("*").alias("df")).withColumn("i", F.array_position(F.array(*map(F.lit, wanted)).cast("array<string>"), F.col("word")))  # a row a word
    scored = rows.join(F.broadcast(df), "word").crossJoin(F.broadcast(corpus(spark, folder, state)))
    weight = rel.idf(F.col("n_docs"), F.col("df")) * rel.saturated(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    # added up in the order of the words, at most as many as there are, so that equal documents have equal scores
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("i", weight.alias("w")))), F.lit(0.0), lambda s, x: s + x["w"])
    total = scored.groupBy("doc_id").agg(added.alias("bm25"), F.first("n_docs").alias("n"))
    return total.select("doc_id", "bm25", (F.col("bm25") / (F.col("bm25") + rel.squash(F.col("n")))).alias("relevance"))


def held(spark: SparkSession, path: str) -> str:
    """The session's index of the documents table at a path, built when it is first asked for or when the table's files have changed."""
    key = (spark.sparkContext.applicationId, path, store.state_of(spark, path))
    if key not in _held:
        _held[key] = build(store.spread(spark.read.parquet(path).select("doc_id", "text"), "doc_id"), store.new_folder(spark, "index"))
    return _held[key]


def rank_squash(score: Column) -> Column:
    """A search engine's own rank, of either sign, as |r| / (|r| + 5)."""
    return F.abs(score) / (F.abs(score) + 5.0)


def best_per_parent(chunks: DataFrame, score: Column) -> DataFrame:
    """Each parent's best chunk (doc_id, chunk_index), earlier ones first."""
    best = chunks.withColumn("s", score).groupBy("doc_id").agg(F.max(F.struct("s", (-F.col("chunk_index")).alias("i"))).alias("b"))
    return best.select("doc_id", (-F.col("b.i")).alias("chunk_index"), F.col("b.s").alias("score"))


def letters(text: Column) -> Column:
    """A text's counts of the letters a to z, as a vector without a model."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return tx.let(low, lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]))


def numbered(rows: DataFrame, folder: str, *order: str, group: str | None = None) -> DataFrame:
    """rows with ``place``, their number from 1 in an order, within each group if there is one, without one task for all: the rows are
    written in ranges, each range is numbered by itself, and each begins after those before it."""
    spark = rows.sparkSession
    keys = [*([group] if group else []), *order]
    rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(folder)
    by = ["_range", *([group] if group else [])]
    sizes = kept.groupBy(*by).agg(F.count("*").alias("_n"))  # a row a range and group
    before = F.coalesce(F.sum("_n").over((W.partitionBy(group) if group else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = kept.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return local.join(F.broadcast(sizes.withColumn("_before", before).drop("_n")), by).withColumn("place", (F.col("_before") + F.col("_k")).cast("long")).drop("_range", "_k", "_before")
