"""A folder that the driver and all executors share, for tables that outlive a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Where it is unset and all of Spark runs in this process, a temporary folder; else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sourceloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/sourceloom/{label}-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as a table of the shared folder, so that what is read more than once is worked out once."""
    folder = new_folder(rows.sparkSession, label)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores (a single row group, say), dealt out to all of them, as work on
    texts takes much longer than sending them.  Tables of more parts, all large ones, stay as they are and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: their names, sizes and times."""
    p, fs = file_system(spark, path)
    status = fs.getFileStatus(p)
    files = [status] if status.isFile() else fs.listStatus(p)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


_COMMITS = "_commits"


def commits(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Numbers and contents of a folder's commits, the newest first; one that is being written is not there yet."""
    p, fs = file_system(spark, f"{folder}/{_COMMITS}")
    names = sorted((f.getPath().getName() for f in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
    out = []
    for name in names:
        stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith("\n"):
            out.append((int(name), text[:-1]))
    return out


def current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The newest commit: what readers of the folder see."""
    return next(iter(commits(spark, folder)), None)


def commit(spark: SparkSession, folder: str, content: str, after: int | None) -> int:
    """Makes a content (one line) the folder's newest, in one step: a file of the next number, which nobody else can have made.  ``after`` is the commit that it
    follows; if another came meanwhile this is an error, and what was prepared may be prepared again."""
    number = 1 if after is None else after + 1
    p, fs = file_system(spark, f"{folder}/{_COMMITS}/{number:09d}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(f"{content}\n".encode()))
    finally:
        out.close()
    return number
