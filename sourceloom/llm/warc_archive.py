"""WARC archives without repeated payloads, and the resolving of their revisit records.

Payloads are never shuffled to find copies: headers (digest, page, place) are.  Of the pages with one SHA-256 digest and at least
``least_bytes``, the one with the smallest page_id is written as a response and the others as revisit records, which have headers of
their own, name the response they revisit by record id, target and date, and have no payload.  Each partition writes its own
archive files, each record a gzip member, under draft names that are renamed when complete, so a task can run again.

``resolve`` reads archives back, joins revisit records to the responses they revisit, wherever in the archives
those are, and gives every record its payload.  ``merge`` reads archives that may repeat payloads among each other, and
writes them as one without repeats, with new headers; a revisit whose response is in none of them stays one.  Both take archives of others too: records without a page_id are
told apart by their record ids, HTTP heads are kept as they are, digests may be labelled in any way, and a revisit finds its response by the record id that it names, else by target and
date, else by the digest as it is labelled, else by SHA-256.  For that, headers meet, with one response kept for each key before they do; payloads are joined once, by place.
Archives have a gzip member a record.

Digests that occur more than once are joined to the pages; they are broadcast only if they are few (a counted number), and
else joined by shuffle, where adaptive execution splits a digest with very many pages.

Cases: null html is an empty payload; null urls have no target header; urls stay as they are but for line breaks, which are
percent-encoded; a record's id follows from its page_id and digest, and for rows that repeat both also from its place in the
input, so that no id is used twice; pages with equal page_id and payload are each a response or revisit by their page_id, so rows that repeat the
smallest page_id are all responses; a null page_id revisits the smallest known page_id, and is a response if there is none; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import keep, new_path, open_fs, remove

LEAST_BYTES, FILE_BYTES, BROADCAST_ROWS = 100, 1 << 28, 100_000
SPACE = uuid.UUID("6f4f2a3e-6c0d-5a39-9a64-0b6a4d2f3c11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d"


def record_id(page_id: int | None, digest: str, place: int | None, before: str | None = None) -> str:
    """``place`` is None unless other rows have the same page and payload; ``before`` is the id that a record without a page had in another archive."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{before or page_id} {digest} {place}')}>"


def _target(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """One record from page_id, before (its id elsewhere), url, date, http (its head), payload, n (its bytes), digest, label (of a digest that is no SHA-256), place, revisit, and of the
    response that is revisited, if it is known, first_page, first_before, first_place, first_url and first_date."""
    block = (HTTP % row["n"] if row["http"] is None else row["http"]) + b"\r\n\r\n" + (b"" if row["revisit"] else row["payload"])
    own = record_id(row["page_id"], row["digest"], row["place"], row["before"])
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {row['date']}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + _target(row["url"]))
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    lines += [f"WARC-Payload-Digest: {row['label'] or 'sha256:' + row['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if row["revisit"]:
        lines.append(f"WARC-Profile: {PROFILE}")
        if row["first_page"] is not None or row["first_before"] is not None:
            lines += [f"WARC-Refers-To: {record_id(row['first_page'], row['digest'], row['first_place'], row['first_before'])}", f"WARC-Refers-To-Date: {row['first_date']}"]
            lines += [] if row["first_page"] is None else [f"X-Refers-To-Page: {row['first_page']}"]
            lines += [] if row["first_url"] is None else ["WARC-Refers-To-Target-URI: " + _target(row["first_url"])]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each whole."""
    unzip, out, data = zlib.decompressobj(31), [], source.read(size)
    while data:
        out.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(out)
            data, unzip, out = unzip.unused_data, zlib.decompressobj(31), []
            data = data or source.read(size)
        else:
            data = source.read(size)
    if out:
        raise ValueError("the archive's last record is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, their names in lower case, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs = (line.partition(":") for line in lines[1:])
    headers = {name.strip().lower(): value.strip(" \t") for name, _, value in pairs}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    return headers, rest[:size]


def _write(folder: str, file_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, draft, name, n = TaskContext.get(), 0, None, "", "", 0
        fs, root = open_fs(folder)
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                fs.move(draft, f"{root}/{name}")
                done.append((name, n))
                out, number = None, number + 1

        for batch in batches:
            columns = [batch.column(c) if c in ("payload", "http") else batch.column(c).to_pylist() for c in batch.schema.names]
            for values in zip(*columns, strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():08d}-{number:04d}.warc.gz"
                    draft, n = f"{root}/.{name}-{task.taskAttemptId()}", 0
                    out = fs.open_output_stream(draft)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                row["payload"], row["http"] = row["payload"].as_py(), row["http"].as_py()
                out.write(press.compress(record(row)) + press.flush())
                n += 1
                if out.tell() >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["file", "records"])

    return run


def _few(table: DataFrame) -> DataFrame:
    """For a join: broadcast if it has at most BROADCAST_ROWS rows, else joined by merge."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def _write_records(rows: DataFrame, folder: str, least_bytes: int, file_bytes: int, level: int) -> DataFrame:
    """From page_id, before, url, date, http, payload, n, digest, label and gone (a revisit without payload) to archives; file and records, one row per file."""
    spark = rows.sparkSession
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    headers = rows.select("page_id", "before", "digest", "place", "url", "date", "n", "gone")
    own = ["page_id", "before", "digest"]
    pairs = headers.groupBy(*own).agg(F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.when(~F.col("gone"), F.struct("place", "url", "date"))).alias("head"))
    pairs, pairs_path = keep(pairs, "pairs")
    # pages before records that only their ids tell apart; with the place only where a pair of page and payload repeats
    first = F.struct(F.col("page_id").isNull().alias("other"), "page_id", "before", F.when(F.col("times") > 1, F.col("head.place")).alias("place"), F.col("head.url").alias("url"), F.col("head.date").alias("date"), "n")
    named = F.col("page_id").isNotNull() | F.col("before").isNotNull()
    copied = pairs.groupBy("digest").agg(F.sum("times").alias("times"), F.min(F.when(named & F.col("head").isNotNull(), first)).alias("first")).where("times > 1")
    copied = copied.select("digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("before", "place", "url", "date")], F.col("first.page_id").alias("first_page"), F.col("first").isNotNull().alias("has_first"))
    copied, copied_path = keep(copied, "copied")
    repeated, repeated_path = keep(pairs.where("times > 1").select(F.col("page_id").alias("_page"), F.col("before").alias("_before"), F.col("digest").alias("_digest")), "repeated")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("before").eqNullSafe(F.col("_before")) & (F.col("digest") == F.col("_digest"))
    joined = rows.join(_few(copied), "digest", "left").join(_few(repeated), same, "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("before").eqNullSafe(F.col("first_before"))
    later = F.coalesce("has_first", F.lit(False)) & (F.col("n") >= least_bytes) & ~is_first
    todo = joined.select("page_id", "before", "url", "date", "http", "payload", "n", "digest", "label", F.when(F.col("_digest").isNotNull(), F.col("place")).alias("place"), (F.col("gone") | later).alias("revisit"), "first_page", "first_before", "first_place", "first_url", "first_date")
    files, _ = keep(todo.mapInArrow(_write(folder, file_bytes, level), "file string, records long"), "archives")
    remove(spark, pairs_path, copied_path, repeated_path)
    return files


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, level: int = 4, date: str | None = None) -> DataFrame:
    """Archives of pages (page_id, url, html) in a shared folder; returns file and records, one row per file.  ``date`` is the time of
    capture in the form 2024-01-31T00:00:00Z, now if it is not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.lit(date).alias("date"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"").cast("binary")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), F.lit(False).alias("gone"), F.lit(None).cast("binary").alias("http"), *[F.lit(None).cast("string").alias(c) for c in ("before", "label")])
    return _write_records(rows, folder, least_bytes, file_bytes, level)


COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "url": pa.string(), "date": pa.string(), "record_id": pa.string(), "http": pa.binary(), "label": pa.string(), "refers_id": pa.string(), "refers_uri": pa.string(), "refers_date": pa.string()}
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url string, date string, record_id string, http binary, label string, refers_id string, refers_uri string, refers_date string"


def _fields(raw: bytes, file: str) -> tuple | None:
    """A record's columns; None if it is no response or revisit."""
    headers, block = parse(raw)
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    label, page, refers = headers.get("warc-payload-digest"), headers.get("x-page-id"), headers.get("x-refers-to-page")
    digest = label.removeprefix("sha256:") if label and re.fullmatch("sha256:[0-9a-f]{64}", label) else None
    n = int(told[1]) if told else None
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if digest not in (None, own) or (page is not None and n != len(payload)):
            raise ValueError(f"a payload of {file} isn't what its header says")
        n, digest = len(payload), own
    else:
        digest = digest or label
    text = [headers.get(k) for k in ("warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date")]
    return None if page is None else int(page), n, digest, kind, None if refers is None else int(refers), None if kind == "revisit" else payload, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-record-id"), http, label, *text


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{file}", compression=None) as source:
                    rows, size = [], 0
                    for raw in members(source):
                        row = _fields(raw, file)
                        if row is None:
                            continue
                        rows.append(row)
                        size += len(raw)
                        if size > 1 << 22 or len(rows) >= 10_000:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    return run


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-256 in hex; of a revisit what its header has), record_type, refers_to, payload (null for revisits), url, date, record_id, http (its head), label
    (the digest as it is written) and what a revisit refers to, of all responses and revisits; a response whose payload does not fit its SHA-256 is an error."""
    spread = files.repartition(max(1, min(files.count(), 100_000)), "file")
    return spread.mapInArrow(_read(folder), READ)


def _keys(of: dict[str, list[str]]) -> Column:
    """An array of (rank, key) for the keys that a record has: kinds by name, each the columns whose values make it."""
    made = [F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{name} "), *[F.col(c) if n == 0 else F.concat(F.lit(" "), F.col(c)) for n, c in enumerate(columns)]).alias("key")) for i, (name, columns) in enumerate(of.items())]
    return F.filter(F.array(*made), lambda x: x["key"].isNotNull())


def revisited(records: DataFrame) -> DataFrame:
    """place (of a revisit), and target, digest and n of the response that it revisits.  ``records`` are those of read_archives with their ``place``; revisits whose response is not among
    them are not there.  Of responses with one key the one of the smallest page_id, then record id, is the key's."""
    thin = records.select("place", "record_type", "page_id", "record_id", "url", "date", "payload_digest", "payload_bytes", F.lower("label").alias("label"), "refers_id", "refers_uri", "refers_date")
    given = thin.where("record_type = 'response'").withColumn("k", F.explode(_keys({"id": ["record_id"], "at": ["url", "date"], "label": ["label"], "digest": ["payload_digest"]})))
    one = given.groupBy("k.key").agg(F.min(F.struct(F.col("page_id").isNull().alias("other"), "page_id", "record_id", "place", "payload_digest", "payload_bytes")).alias("r"))
    asked = thin.where("record_type = 'revisit'").withColumn("k", F.explode(_keys({"id": ["refers_id"], "at": ["refers_uri", "refers_date"], "label": ["label"], "digest": ["payload_digest"]})))
    found = asked.select("place", "k.rank", "k.key").join(one, "key").groupBy("place").agg(F.min(F.struct("rank", F.col("r.place").alias("target"), F.col("r.payload_digest").alias("digest"), F.col("r.payload_bytes").alias("n"))).alias("f"))
    return found.select("place", "f.target", "f.digest", "f.n")


def _placed(files: DataFrame, folder: str) -> tuple[DataFrame, str]:
    return keep(read_archives(files, folder).withColumn("place", F.monotonically_increasing_id()), "records")


def resolve(files: DataFrame, folder: str) -> DataFrame:
    """read_archives with the payload of every record: a revisit has that of the response it revisits, in whatever file it is; null if there is none."""
    records, _ = _placed(files, folder)
    targets, _ = keep(revisited(records).select("place", "target"), "revisited")
    wanted = targets.select(F.col("target").alias("place")).distinct()
    given = records.join(wanted, "place", "left_semi").select(F.col("place").alias("target"), F.col("payload").alias("given"))
    joined = records.join(targets, "place", "left").join(given.hint("merge"), "target", "left")
    return joined.select(*[F.coalesce("payload", "given").alias("payload") if c == "payload" else c for c in COLUMNS])


def merge(files: DataFrame, folder: str, out: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Archives without repeats, with new headers and the HTTP heads that were there, of archives that may repeat payloads and hold revisits; file and records, one row per file."""
    records, path = _placed(files, folder)
    targets, targets_path = keep(revisited(records).withColumnRenamed("n", "target_n"), "revisited")
    gone = F.col("record_type") == "revisit"
    digest = F.coalesce(F.when(gone, F.col("digest")), "payload_digest", F.concat(F.lit("unknown "), "record_id"))
    rows = records.join(targets, "place", "left").select(
        "page_id", F.when(F.col("page_id").isNull(), F.col("record_id")).alias("before"), "url", "date", "http", "payload", F.coalesce(F.when(gone, F.col("target_n")), "payload_bytes", F.lit(0)).cast("long").alias("n"), digest.alias("digest"),
        F.when(gone & F.col("target").isNull() & ~F.coalesce(F.col("payload_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.col("label")).alias("label"), gone.alias("gone"),
    )
    done = _write_records(rows, out, least_bytes, file_bytes, level)
    remove(records.sparkSession, path, targets_path)
    return done


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Written to the shared folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_page FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {LEAST_BYTES} AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_BYTES} AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM f"""
