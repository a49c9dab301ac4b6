"""Vectors of records and of their chunks, and a store of both.

Texts go through an embedder in Arrow batches; an item that it can't embed has no vector, and no other item suffers.  A record and its chunks are embedded in one
pass, told apart by their place, and written as the two tables of one version, which one commit makes readable, so no reader sees documents of one state and chunks of
another.  The embedder given here needs no model: it hashes tokens."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import store
from . import relevance as rel

DIMS, MAX_CHUNKS, PARENT = 64, 30, -1
Embedder = Callable[[list[str]], list[np.ndarray | None]]


@lru_cache(maxsize=1 << 18)
def _place(token: str) -> tuple[int, int]:
    h = int(hashlib.md5(token.encode()).hexdigest()[:4], 16)
    return h % DIMS, 1 if h // 4096 % 2 else -1


def hashed(texts: list[str]) -> list[np.ndarray | None]:
    """Signed counts of tokens (runs of a-z and 0-9, lower-cased) in DIMS places, of unit length; None where nothing is left."""
    out: list[np.ndarray | None] = []
    for text in texts:
        v = np.zeros(DIMS)
        for token in "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in text.lower()).split():
            at, sign = _place(token)
            v[at] += sign
        size = np.sqrt(v @ v)
        out.append(v / size if size else None)
    return out


def one_by_one(embedder: Embedder, texts: list[str | None]) -> list[np.ndarray | None]:
    """A batch's vectors; if the batch fails, each text by itself, and None for those that fail alone."""
    wanted = [t for t in texts if t]
    try:
        got = iter(embedder(wanted))
        return [next(got) if t else None for t in texts]
    except Exception:  # whatever a model throws
        if len(wanted) <= 1:
            return [None] * len(texts)
        return [v for t in texts for v in one_by_one(embedder, [t])]


def _run(embedder: Embedder, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, batch_rows):
                part = batch.slice(i, batch_rows)
                vectors = one_by_one(embedder, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float64()))], names=[*part.schema.names, "vector"])

    return run


def embedded(items: DataFrame, embedder: Embedder = hashed, batch_rows: int = 256) -> DataFrame:
    """Items (with text) with their vector, null where the embedder gave none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(_run(embedder, batch_rows), f"{fields}, vector array<double>")


def with_chunks(records: DataFrame, chunk_words: int = 160, most: int = MAX_CHUNKS, embedder: Embedder = hashed) -> DataFrame:
    """doc_id, place (-1 for the record, else the chunk's number), text and vector of records (doc_id, text) and of their first ``most`` chunks (a limit of the feature)."""
    chunks = rel.chunked(records, chunk_words).where(F.col("chunk_index") < most).select("doc_id", F.col("chunk_index").cast("int").alias("place"), F.col("chunk_text").alias("text"))
    return embedded(records.select("doc_id", F.lit(PARENT).alias("place"), "text").unionByName(chunks), embedder)


def regrouped(items: DataFrame) -> DataFrame:
    """doc_id, the record's vector and the list of its chunks' vectors in order, empty where one failed."""
    chunk = F.when(F.col("place") >= 0, F.struct("place", F.coalesce("vector", F.array().cast("array<double>")).alias("v")))
    sides = items.groupBy("doc_id").agg(F.max(F.when(F.col("place") == PARENT, F.struct("vector"))).alias("p"), F.array_sort(F.collect_list(chunk)).alias("c"))
    return sides.select("doc_id", F.col("p.vector").alias("vector"), F.transform("c", lambda x: x["v"]).alias("chunk_vectors"))


def add(records: DataFrame, folder: str, embedder: Embedder = hashed, chunk_words: int = 160, most: int = MAX_CHUNKS) -> str:
    """Writes records and chunks with their vectors as the newest version of a folder, and tells how: ``chunked``, ``parent`` if there are no chunks or no record
    could be embedded (then records alone, for search by words), or ``empty``, which changes nothing."""
    spark, version = records.sparkSession, f"version-{uuid.uuid4().hex}"
    if records.isEmpty():
        return "empty"
    before, home = store.current(spark, folder), f"{folder}/{version}"
    items = with_chunks(records, chunk_words, most, embedder)
    items.write.parquet(f"{home}/items")
    items = spark.read.schema(items.schema).parquet(f"{home}/items")
    got = items.agg(F.count_if((F.col("place") == PARENT) & F.col("vector").isNotNull()).alias("parents"), F.count_if(F.col("place") >= 0).alias("chunks")).first()
    mode = "chunked" if got.parents and got.chunks else "parent"
    store.commit(spark, folder, f"{version};{mode}", before and before[0])
    return mode


def documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The newest version's documents and chunks; in mode ``parent`` there are no chunks."""
    version, _, mode = store.current(spark, folder)[1].partition(";")
    items = spark.read.parquet(f"{folder}/{version}/items")
    chunks = items.where((F.col("place") >= 0) & F.lit(mode == "chunked"))
    return items.where(F.col("place") == PARENT).drop("place"), chunks.withColumnRenamed("place", "chunk_index")


def chunk_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, chunk_index and the cosine of each chunk with its document; both must have a vector."""
    docs, chunks = documents(spark, folder)
    both = chunks.select("doc_id", "chunk_index", "vector").where("vector is not null").join(docs.select("doc_id", F.col("vector").alias("whole")).where("whole is not null"), "doc_id")
    return both.select("doc_id", "chunk_index", F.aggregate(F.zip_with("vector", "whole", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("cosine"))
