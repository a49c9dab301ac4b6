"""Token ids of a corpus written as plane files in ascending doc_id order, and read back.

Documents are dealt by ranges of doc_id, sorted within each range and written one file a partition, tokenized as they are
written; a manifest has each file's first global position.  A task that runs again writes under another name first and then
renames, so a lost executor leaves no half file.

Cases: null text is empty and holds only the end id; null doc_ids come first and stay null; rows with equal doc_ids are ordered
by a hash of their texts, then by text, so that an id with very many rows is dealt over several files; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .plane_files import BLOCK_IDS, Reader, Writer
from .scratch import new_path, open_fs
from .tokens import Encoder


def _write(folder: str, tokenizer: str, end_id: int, mode: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = open_fs(folder)
        encoder, end = Encoder.of(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        name = f"part-{task.partitionId():08d}"
        draft = f"{root}/.{name}-{task.taskAttemptId()}"
        writer = out = None
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(draft)
                    writer = Writer(out, block_ids, mode)
                writer.add(doc, np.frombuffer(encoder.encode(text.as_py()) + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, f"{root}/{name}.planes")
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [f"{name}.planes"], "ids": pa.array([writer.total], pa.int64()), "docs": pa.array([len(writer.docs) // 3], pa.int64())})

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, mode: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write files to a shared folder; returns the manifest: part, file, ids, docs, base (ids in all files before).

    The manifest has one row per file and is held by the driver.
    """
    spark = docs.sparkSession
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    files = sorted(rows.mapInArrow(_write(folder, tokenizer, end_id, mode, block_ids), "part int, file string, ids long, docs long").collect())
    base, out = 0, []
    for f in files:
        out.append((f.part, f.file, f.ids, f.docs, base))
        base += f.ids
    return spark.createDataFrame(out, "part int, file string, ids long, docs long, base long").repartition(max(1, len(out)), "part")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as source:
                    docs, starts, ids, size = [], [], [], 0
                    for doc, start, got in Reader(source).documents():
                        docs.append(doc)
                        starts.append(base + start)
                        ids.append(got.astype("<u4").tobytes())
                        size += len(ids[-1])
                        if size > 1 << 23:
                            yield _batch(docs, starts, ids)
                            docs, starts, ids, size = [], [], [], 0
                    yield _batch(docs, starts, ids)

    return run


def _batch(docs: list, starts: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), from the files."""
    return manifest.mapInArrow(_read(folder), "doc_id long, start long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Written to the shared folder and read back."""
    folder = new_path(spark, "planes")
    return read_ids(write_ids(docs, folder, tokenizer, end_id), folder)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
