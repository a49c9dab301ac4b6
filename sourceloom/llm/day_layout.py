"""Files of rows by day, and their overwriting by rows that arrive late.

A layout keeps the latest-arrived row of each id and cuts each day, sorted by time and id, into Parquet files of ``per_file`` rows, the last
perhaps of fewer.  Late rows make some days dirty: those where a row that is new stands, and those where that id's former row stood.
Only dirty days are read and written again; all other files stay as they are.

The latest rows come from one aggregation by id, which sums up before its shuffle, so an id with a third of all rows is a row a task.
The rows that come to a dirty day and the ids that go from it meet by day, sorted by Spark.  A task takes them day by day into a DuckDB of its
own, on disk and with bounded memory: it reads the day's old files, leaves out the ids that go (anti-join), adds the rows that come, sorts
externally, numbers the rows and writes every slice of ``per_file`` rows as a file.  A day's work is one task's, as the day's order is
one; nothing else is, and nothing but names of files (one a file) comes to the driver.

Files are written under draft names that no other attempt has, so a task may run again; what was written is itself kept as a table
before anything is moved.  Then the drafts are moved to their places, and only then the files that they replace are removed, so an interrupted move can be
done again from that table.  DuckDB spills below the shared folder where that is mounted as files, else to the task's own folder, and clears up.

Cases: a null time belongs to day -1; a null arrival is late and yields to any other; of equal arrivals the row whose columns are the larger, in their
order, stays; null ids are one id, which comes first in its day; copies of a row count once; an empty table has no files; a day that loses all its rows loses all its
files; columns may have any names, and all are written, in their order.
"""

from __future__ import annotations

import hashlib
import math
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType

from .scratch import _jvm_path, keep, new_path, open_fs, remove, shared_dir

DAY_MICROS = 86_400_000_000
DUCKDB_MEMORY, BATCH_ROWS = "256MB", 50_000
FILES = "day long, file_no long, n_rows long, draft string, path string"


@dataclass(frozen=True)
class Layout:
    """Names of the columns that decide, and how many rows a file has."""

    id_col: str = "sale_id"
    time_col: str = "sold_at"
    arrival_col: str = "arrived_at"
    per_file: int = 1_000_000


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970, in UTC, of a timestamp with or without a zone."""
    name = f"`{column}`"
    if isinstance(rows.schema[column].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_micros(F.col(name))


def day_of(rows: DataFrame, column: str) -> Column:
    """Whole days since 1970; null is -1."""
    m = micros(rows, column)
    return F.coalesce(((m - F.pmod(m, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("long"), F.lit(-1).cast("long"))


def latest(rows: DataFrame, cutoff: str, layout: Layout) -> DataFrame:
    """A row an id: ``start`` and ``start_day`` of the latest of its rows that arrived before the cutoff (UTC), ``final`` and ``final_day``
    of the latest of all, both null where there is none, and ``late``, whether the latter is a late one."""
    names = rows.columns
    arrived = micros(rows, layout.arrival_col)
    limit = F.lit(int(np.datetime64(cutoff, "us").astype(np.int64)))
    # in maxima nulls are the smallest
    whole = F.struct(arrived.alias("arrived"), day_of(rows, layout.time_col).alias("day"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    one = rows.select(F.col(f"`{layout.id_col}`").alias("id"), (F.coalesce(arrived < limit, F.lit(False))).alias("early"), whole.alias("row"))
    found = one.groupBy("id").agg(F.max(F.when(F.col("early"), F.col("row"))).alias("start"), F.max("row").alias("final"))
    return found.select("start", "final", F.coalesce(F.col("final.arrived") >= limit, F.lit(True)).alias("late"))


class _Day:
    """One day's rows in a DuckDB on disk."""

    def __init__(self, day: int, schema: pa.Schema, id_at: int, time_at: int, spill: str):
        self.day, self.schema, self.id, self.time = day, schema, f"c{id_at}", f"c{time_at}"
        self.folder = f"{spill}/{uuid.uuid4().hex}"
        os.makedirs(self.folder)
        self.con = duckdb.connect(f"{self.folder}/day.duckdb", config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": f"{self.folder}/tmp"})
        self.local = pa.schema([pa.field(f"c{i}", pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for i, f in enumerate(schema)])
        self.con.register("none_yet", self.local.empty_table())
        self.con.execute("CREATE TABLE incoming AS SELECT * FROM none_yet")
        self.con.execute(f"CREATE TABLE outgoing AS SELECT {self.id} AS id FROM none_yet")

    def add(self, kind: np.ndarray, rows: pa.RecordBatch) -> None:
        """Rows that come (1) and ids that go (0)."""
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(rows.columns, schema=self.schema)]).rename_columns(self.local.names).cast(self.local)
        come, go = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
        self.con.register("come", come)
        self.con.register("go", go)
        self.con.execute("INSERT INTO incoming SELECT * FROM come")
        self.con.execute(f"INSERT INTO outgoing SELECT {self.id} FROM go")

    def _old(self, fs: pafs.FileSystem, files: list[str]) -> Iterator[pa.RecordBatch]:
        for path in files:
            with fs.open_input_file(path) as source:
                for b in pq.ParquetFile(source).iter_batches(BATCH_ROWS):
                    yield from pa.Table.from_batches([b]).rename_columns(self.local.names).cast(self.local).to_batches()

    def write(self, fs: pafs.FileSystem, old: list[str], drafts: str, per_file: int) -> Iterator[tuple[int, int, str]]:
        """The day's files, as number, rows and draft path."""
        self.con.register("old", pa.RecordBatchReader.from_batches(self.local, self._old(fs, old)))
        self.con.execute(f"""CREATE TABLE placed AS SELECT row_number() OVER () - 1 AS place, * FROM (
            SELECT * FROM (SELECT * FROM old ANTI JOIN outgoing ON old.{self.id} IS NOT DISTINCT FROM outgoing.id UNION ALL SELECT * FROM incoming)
            ORDER BY {self.time} NULLS FIRST, {self.id} NULLS FIRST)""")
        rows = self.con.execute("SELECT count(*) FROM placed").fetchall()[0][0]
        for no in range(-(-rows // per_file)):
            path = f"{drafts}/{uuid.uuid4().hex}"
            found = self.con.sql(f"SELECT * EXCLUDE place FROM placed WHERE place >= {no * per_file} AND place < {(no + 1) * per_file} ORDER BY place")
            with fs.open_output_stream(path) as out, pq.ParquetWriter(out, self.schema, compression="zstd") as to:
                for b in found.to_arrow_reader(BATCH_ROWS):
                    to.write_table(pa.Table.from_batches([b]).cast(self.local).rename_columns(self.schema.names).cast(self.schema))
            yield no, min(per_file, rows - no * per_file), path

    def close(self) -> None:
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _data_files(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))


@contextmanager
def _spill(place: str | None) -> Iterator[str]:
    if place is None:
        with tempfile.TemporaryDirectory() as folder:
            yield folder
    else:
        yield place


def _rewriter(names: list[str], schema: pa.Schema, layout: Layout, folder: str, drafts: str, generation: str, spill: str | None):
    """Rows (day, kind, columns) sorted by day become draft files; a day that has none left gives a row without a file."""
    at = names.index(layout.id_col), names.index(layout.time_col)

    def done(work: _Day, fs: pafs.FileSystem, root: str, to: str) -> Iterator[tuple]:
        try:
            home = f"{root}/day_{work.day}"
            files = list(work.write(fs, _data_files(fs, home), to, layout.per_file))
            yield from [(work.day, no, n, os.path.basename(draft), f"day_{work.day}/{generation}-{no:06d}.parquet") for no, n, draft in files] or [(work.day, None, 0, None, None)]
        finally:
            work.close()

    def rows(batches: Iterator[pa.RecordBatch], place: str) -> Iterator[tuple]:
        (fs, root), (_, to) = open_fs(folder), open_fs(drafts)
        fs.create_dir(to, recursive=True)
        work = None
        try:
            for b in batches:
                days = b.column(0).to_numpy()
                ends = [*(np.flatnonzero(np.diff(days)) + 1), len(days)] if len(days) else []
                for begin, end in zip([0, *ends], ends):
                    if work is None or work.day != int(days[begin]):
                        if work is not None:
                            yield from done(work, fs, root, to)
                        work = _Day(int(days[begin]), schema, *at, place)
                    part = b.slice(begin, end - begin)
                    work.add(part.column(1).to_numpy(), pa.RecordBatch.from_arrays(part.columns[2:], names=[f"c{i}" for i in range(len(names))]))
            if work is not None:
                yield from done(work, fs, root, to)
        finally:
            if work is not None:
                work.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _spill(spill) as place:
            kind = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("draft", pa.string()), ("path", pa.string())])
            for r in rows(batches, place):
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True))], schema=kind)

    return run


def _moved_to_places(spark: SparkSession, folder: str, drafts: str, files: list) -> None:
    """Drafts go to their places, then what else lies in their days' folders goes.  May be done again at any point."""
    for r in files:
        if r.draft is not None:
            draft, fs = _jvm_path(spark, f"{drafts}/{r.draft}")
            place, _ = _jvm_path(spark, f"{folder}/{r.path}")
            if fs.exists(draft):
                fs.mkdirs(place.getParent())
                if not fs.rename(draft, place):
                    raise OSError(f"could not move {draft} to {place}")
    mine = {r.path for r in files if r.path}
    for day in sorted({r.day for r in files}):
        home, fs = _jvm_path(spark, f"{folder}/day_{day}")
        for status in fs.listStatus(home) if fs.exists(home) else []:
            if f"day_{day}/{status.getPath().getName()}" not in mine:
                fs.delete(status.getPath(), False)
        if fs.exists(home) and not len(fs.listStatus(home)):
            fs.delete(home, False)
    remove(spark, drafts)


def rewrite_days(changes: DataFrame, row_schema: StructType, folder: str, layout: Layout, generation: str) -> list:
    """Applies changes (day, kind: 1 a row that comes, 0 an id that goes, row) to a folder; the files written, as day, file_no, n_rows and path.

    There is a row a file, and one with a null path for each day that has no rows any more."""
    spark = changes.sparkSession
    names = row_schema.fieldNames()
    local = shared_dir(spark).startswith(("file:", "/"))
    spill = new_path(spark, "spill") if local else None
    drafts = new_path(spark, "drafts")
    if spill:
        fs, place = open_fs(spill)
        fs.create_dir(place, recursive=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = changes.select("day", "kind", *[F.col(f"row.c{i}") for i in range(len(names))]).repartition(tasks, "day").sortWithinPartitions("day")
    schema = to_arrow_schema(StructType([StructField(f.name, f.dataType, True) for f in row_schema.fields]))
    written, path = keep(sorted_.mapInArrow(_rewriter(names, schema, layout, folder, drafts, generation, place if spill else None), FILES), "day-files")
    files = written.collect()  # a row a file
    _moved_to_places(spark, folder, drafts, files)
    remove(spark, path, *([spill] if spill else []))
    return files


def start_and_overwrite(rows: DataFrame, folder: str, cutoff: str, layout: Layout) -> DataFrame:
    """Writes the layout of the rows that arrived before the cutoff, then overwrites what the others make dirty.  Gives the files that stand in the end:
    day, file_no, path and whether they were ``rewritten``."""
    spark = rows.sparkSession
    found, path = keep(latest(rows, cutoff, layout), "latest")
    came = lambda which: [F.col(f"{which}.day").alias("day"), F.lit(1).alias("kind"), F.col(which).alias("row")]
    first = rewrite_days(found.where("start is not null").select(*came("start")), rows.schema, folder, layout, "first")
    late = found.where("late")
    gone = late.where("start is not null").select(F.col("start.day").alias("day"), F.lit(0).alias("kind"), F.col("start").alias("row"))
    second = rewrite_days(late.select(*came("final")).unionByName(gone), rows.schema, folder, layout, "late")
    remove(spark, path)
    dirty = {r.day for r in second}
    stand = [(r, False) for r in first if r.day not in dirty] + [(r, True) for r in second]
    files = [(r.day, r.file_no, f"{folder}/{r.path}", again) for r, again in stand if r.path]
    return spark.createDataFrame(files, StructType([StructField("day", LongType()), StructField("file_no", LongType()), *StructType.fromDDL("path string, rewritten boolean").fields]))


def plain_path(path: str) -> str:
    """A path of mounted files without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _digests(layout: Layout, value_col: str):
    def micros_of(column: pa.ChunkedArray) -> list:
        return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_pylist()

    def text(v) -> str:
        return "" if v is None else str(v)

    def one(path: str) -> dict:
        fs, at = open_fs(path)
        n = cents = crc = 0
        ids = hashlib.sha256()
        with fs.open_input_file(at) as source:
            file = pq.ParquetFile(source)
            names = file.schema_arrow.names
            for b in file.iter_batches(BATCH_ROWS, columns=list(dict.fromkeys((layout.id_col, layout.time_col, layout.arrival_col, value_col)))):
                keys = b.column(layout.id_col).to_pylist()
                ids.update((("," if n else "") + ",".join(map(text, keys))).encode())
                n += len(keys)
                cents += sum(math.floor(100 * v + 0.5) for v in b.column(value_col).to_pylist() if v is not None and math.isfinite(v))
                for key, sold, arrived in zip(keys, micros_of(b.column(layout.time_col)), micros_of(b.column(layout.arrival_col)), strict=True):
                    crc += zlib.crc32(f"{text(key)}:{text(sold)}:{text(arrived)}".encode())
        return {"n_rows": n, "cents": cents, "rows_crc": crc, "columns": ",".join(names), "ids_sha256": ids.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([r | {"path": plain_path(r["path"])} | one(r["path"])], schema=KINDS)

    return run


KINDS = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("rewritten", pa.bool_()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("columns", pa.string()), ("ids_sha256", pa.string())])


def file_digests(files: DataFrame, layout: Layout, value_col: str = "total") -> DataFrame:
    """What the files hold, each read from its start to its end: rows, cents, checksum of rows, columns and digest of ids; non-finite values count as 0."""
    dealt = files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return dealt.mapInArrow(_digests(layout, value_col), "day long, file_no long, path string, rewritten boolean, n_rows long, cents long, rows_crc long, columns string, ids_sha256 string")


def with_copies(sales: DataFrame) -> DataFrame:
    """Rows whose hash of the id is divisible by 3 on days divisible by 10 come a second time, corrected and later."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    due = (h % 3 == 0) & (day_of(sales, "sold_at") % 10 == 0) & F.col("sold_at").isNotNull()
    days = lambda n: F.make_dt_interval(n.cast("int"))
    changed = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    return sales.unionByName(sales.where(due).select(*[(changed[c].cast(sales.schema[c].dataType) if c in changed else F.col(f"`{c}`")).alias(c) for c in sales.columns]))


def overwritten(sales: DataFrame, cutoff: str = "2024-03-01T00:00:00", files: int = 900) -> DataFrame:
    """The files of a table of sales after its late rows, in a new folder that stays."""
    spark = sales.sparkSession
    layout = Layout(per_file=1 + sales.count() // files)
    folder = f"{shared_dir(spark).rstrip('/')}/sourceloom-days-{uuid.uuid4().hex}"
    return file_digests(start_and_overwrite(with_copies(sales), folder, cutoff, layout), layout)
