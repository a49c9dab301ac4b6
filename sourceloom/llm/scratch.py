"""Intermediate tables and files in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset and all of Spark runs in this process, as in tests, a
temporary folder of this machine is made and set; on a cluster its absence is an error.  Tables are removed as soon as nothing can
read them any more (``remove``, ``passing``), those that a returned DataFrame still reads when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="sourceloom-")
        spark.sparkContext.setCheckpointDir(place)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return place


def _jvm_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_open: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Paths made inside are removed at the end, but for those taken out of the list."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        remove(spark, *made)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; it goes when the JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sourceloom/{label}-{uuid.uuid4().hex}"
    p, fs = _jvm_path(spark, path)
    fs.deleteOnExit(p)
    for made in _open:
        made.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _jvm_path(spark, path)
        fs.delete(p, True)


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, so that their lineage ends there; and the path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path, for Python code on driver or executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
