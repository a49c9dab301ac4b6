"""Writers with the stores' update rules, over plain Parquet: overwrite by run, latest wins, replace by parent, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.records import latest
from . import store


def save_runs(rows: DataFrame, path: str, run: str = "request_id") -> None:
    """Replaces the partitions of the runs that are written and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, key: list[str], *order: Column) -> DataFrame:
    """An append-only store with its last row of each key; columns added later are null in older rows."""
    return latest(spark.read.option("mergeSchema", True).parquet(path), key, *order)


def replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The old rows of parents that have no new rows, and the new rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def retained(rows: DataFrame, children: DataFrame, key: str, most: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The newest rows up to a number (a feature of the store), and the children that belong to them."""
    kept = rows.orderBy(*order).limit(most)
    return kept, children.join(kept.select(key), key, "left_semi")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A report of the first rows as a Markdown table."""
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n" for r in rows.limit(most).collect())


def html(rows: DataFrame, title: str, most: int = 200) -> str:
    from html import escape

    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<h1>{escape(title)}</h1><table>{cells('th', rows.columns)}" + "".join(cells("td", r) for r in rows.limit(most).collect()) + "</table>"


def in_batches(stream: DataFrame, path: str, checkpoint: str):
    """A stream appended to a table, each batch once by its id."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cleared(spark: SparkSession, path: str) -> None:
    """A table with its columns and without its rows."""
    old = spark.read.parquet(path)
    empty = spark.createDataFrame([], old.schema)
    empty.write.mode("overwrite").parquet(path)


def publish(rows: DataFrame, folder: str, keep: int = 2) -> None:
    """Rows as the newest version of a table: written to a folder of their own, and then, in one step, what readers see (``published``).  A crash at any point
    leaves the version before.  The last ``keep`` versions stay, for readers that are at work."""
    spark, version = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    before = store.current(spark, folder)
    rows.write.parquet(f"{folder}/{version}")
    store.commit(spark, folder, version, before and before[0])
    for _, old in store.commits(spark, folder)[keep:]:
        p, fs = store.file_system(spark, f"{folder}/{old}")
        fs.delete(p, True)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a table."""
    version = store.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"nothing has been published in {folder}")
    return spark.read.parquet(f"{folder}/{version[1]}")


def safe_name(text: Column, most: int = 80) -> Column:
    """A file name from any text."""
    out = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(out == "", "untitled").otherwise(F.left(out, F.lit(most)))


def usage_report(entries: DataFrame, path: str) -> None:
    """Totals of a ledger by model, by category and in all, as JSON lines."""
    from ..operators.analytics import usage

    usage(entries).write.mode("overwrite").json(path)


def agent_run(rows: DataFrame, steps: DataFrame, path: str, run: str = "agent_id") -> None:
    """A run's row with its steps in order, in the run's partition."""
    listed = steps.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("step", *[x for x in steps.columns if x not in (run, "step")])]))).alias("steps"))
    save_runs(rows.join(listed, run, "left"), path, run)


def add_records(records: DataFrame, folder: str, chunk_words: int = 160) -> None:
    """Records (doc_id, text and others) to a store of documents and of their chunks; a document without words has none."""
    from ..operators.relevance import chunked

    append(records, f"{folder}/documents")
    append(chunked(records, chunk_words), f"{folder}/chunks")
