"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes what the one before kept, written as Parquet and read again.  All but the last return the columns of
documents; the last returns the pieces of the packed sequences with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curve_packing, decontaminate, importance, simhash_dedup
from .scratch import keep, passing, remove
from .tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws."""
    return importance.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return simhash_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids along the Hilbert curve."""
    return curve_packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pack", packed)]

#: Hashes of hashed n-grams, XXH64 fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages' documents.  A stage's own tables go when its result is written, and that when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with passing(spark) as made:
            docs, path = keep(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
