"""Quality selection by importance resampling.

Two generative models of passages are fitted: the target model to labelled clean documents, the raw model to all documents.
Both give an n-gram the share it has among the hashed n-grams of its kind (words, word pairs, runs of five bytes inside words;
``1 << BITS`` buckets a kind).  A passage of ``WINDOW`` words has as log ratio S the sum over its n-grams of
log((target + SMOOTH) / (expected + SMOOTH)), ``expected`` being the count a bucket would have if the target were like the raw text.
A raw document is modelled as target text in which, with probability ``FOREIGN``, one passage at a place that is not known comes
from the raw model.  So the log ratio of a document under the two models is

    log importance = -log((1 - FOREIGN) + FOREIGN * mean over its passages of exp(-S)),

about 0 for text like the target's, and far below it where even one passage is not like the target's.  Standard Gumbel noise, a
function of the document's id and text, is added, and the k documents with the largest sums are drawn, which is a draw without
replacement in proportion to the importance; ties at the last key are all drawn.  ``k`` is a parameter.  Where it is not given it is
the number of documents that rejection sampling with the same weights would be expected to accept, sum(min(1, w / W)), with W the
weight that a share ``UNUSUAL`` of the labelled clean documents not used for fitting has at most.

The labelled documents are bounded by ``max_labelled``, those with the smallest hashes of their ids; all counts and scores cover
all documents.  Cases: texts without words, null or empty, have log importance 0; null labels do not count; a document with
several labels counts as bad if one of them is bad; without clean labels all log importances are 0 and k is the number of rows;
null doc_ids are scored but never labelled; every row is drawn or not by its own key, also where ids repeat or are null, and rows
equal in id and text share one; very long texts are read in parts of a megabyte; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .scratch import keep, remove
from .wordhash import Words, in_chunks, overlapping, shingles, utf8

BITS, RUN, WINDOW, SMOOTH, FOREIGN = 19, 5, 5, 2.0, 0.25
MAX_LABELLED, UNUSUAL = 200_000, 0.005
KINDS = 3
LOG_IMPORTANCE, KEY, MARK = "importance_log", "importance_key", "importance_mark"


def _grams(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, buckets and the word each begins in."""
    h, owner = w.hashes(), w.owner()
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    kinds = (h, np.arange(len(h))), (shingles(h, 2)[inside], inside), w.runs(RUN)
    return [((value >> np.uint64(64 - BITS)).astype(np.int64), at) for value, at in kinds]


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple[bytes, bool, tuple]]]:
    """Chunks of (part of a text, whether it is the text's last, the row); a text of several parts is alone in its chunks."""
    for chunk in in_chunks(rows, lambda r: len(r[0])):
        if len(chunk) == 1:
            yield from ([(part, last, chunk[0])] for part, last in overlapping(chunk[0][0], WINDOW))
        else:
            yield [(bytes(r[0]), True, r) for r in chunk]


def _counted(w: Words, part: list[tuple]) -> np.ndarray | slice:
    """The words that count here: in a part that is not the text's last, not those that come again."""
    return slice(None) if part[0][1] else slice(0, len(w.start) - WINDOW)


def tally(rows: Iterator[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by kind and bucket over all texts, and over those marked as the target's."""
    raw, target = (np.zeros((KINDS, 1 << BITS), dtype=np.int64) for _ in range(2))
    for part in _parts(rows):
        w = Words([text for text, _, _ in part])
        mine = np.repeat([bool(row[1]) for _, _, row in part], np.diff(w.first))
        counts = np.zeros(len(w.start), dtype=bool)
        counts[_counted(w, part)] = True
        for kind, (bucket, word) in enumerate(_grams(w)):
            raw[kind] += np.bincount(bucket[counts[word]], minlength=1 << BITS)
            if mine.any():
                target[kind] += np.bincount(bucket[counts[word] & mine[word]], minlength=1 << BITS)
    return raw, target


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = tally((utf8(t), f) for b in batches for t, f in zip(b.column("text"), b.column("fit").to_pylist(), strict=True))
    raw, target = raw.ravel(), target.ravel()
    full = np.flatnonzero(raw)
    for i in range(0, len(full), 100_000):
        b = full[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(raw[b]), pa.array(target[b])], names=["bucket", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed target model to the raw model by kind and bucket."""
    expected = raw * (target.sum(1) / np.maximum(1, raw.sum(1)))[:, None]
    return np.log((target + SMOOTH) / (expected + SMOOTH)).astype(np.float32)


def log_importances(rows: Iterator[tuple], ratios: np.ndarray) -> Iterator[float]:
    """Each text's log importance, in the order of the rows."""
    held = [0.0, 0]  # of a text of several parts: sum of exp(-S) and number of passages
    for part in _parts(rows):
        w = Words([text for text, _, _ in part])
        n = len(w.start)
        per = np.zeros(n)
        for kind, (bucket, word) in enumerate(_grams(w)):
            per += np.bincount(word, ratios[kind][bucket].astype(np.float64), n)
        sums, at, owner = np.concatenate(([0.0], np.cumsum(per))), np.arange(n), w.owner()
        end = w.first[1:][owner]
        whole = (at + WINDOW <= end) | (at == w.first[:-1][owner])  # a shorter text is one passage
        if not part[0][1] or held[1]:
            whole = at + WINDOW <= end
        whole[np.arange(n)[_counted(w, part)].size :] = False
        s = (sums[np.minimum(at + WINDOW, end)] - sums[at])[whole]
        total = np.bincount(owner[whole], np.exp(np.minimum(-s, 500.0)), w.texts) + held[0]
        count = np.bincount(owner[whole], minlength=w.texts) + held[1]
        if not part[0][1]:
            held = [float(total[0]), int(count[0])]
            continue
        held = [0.0, 0]
        yield from np.where(count > 0, -np.log((1 - FOREIGN) + FOREIGN * total / np.maximum(count, 1)), 0.0).tolist()


def gumbel(doc_id: int | None, text: bytes | memoryview) -> float:
    """Standard Gumbel noise fixed by id and text."""
    u = ((xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(str(doc_id).encode(), 3)) >> 11) + 0.5) / (1 << 53)
    return float(-np.log(-np.log(u)))


def _measure(ratios, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = [utf8(t) for t in batch.column("text")], batch.column("doc_id").to_pylist()
            weight = np.fromiter(log_importances(zip(texts), ratios.value), dtype=np.float64, count=len(texts))
            noise = np.fromiter(map(gumbel, docs, texts), dtype=np.float64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*map(batch.column, out), pa.array(weight), pa.array(weight + noise)], names=[*out, LOG_IMPORTANCE, KEY])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of finite doubles, exactly: 65,536 ranges are counted, then those of the range it is in."""
    if k <= 0:
        return None
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low != high:
        step = (high - low) / 65_536
        slot = F.least(F.lit(65_535), F.floor((F.col(column) - low) / step)) if step > 0 else F.lit(0)
        rows = df.where(F.col(column).between(low, high)).groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.s):
            if k <= r.n:
                low, high = r.lo, r.hi
                break
            k -= r.n
    return low


def _labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """_id and mark of the labelled documents that are used: 1 if clean, plus 2 in the third that fits no model."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # a documented bound on labelled rows
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    return known.select(F.col("doc_id").alias("_id"), (1 - F.col("bad") + F.when(part == 0, 2).otherwise(0)).cast("int").alias(MARK))


def _scored(docs: DataFrame, out: list[str], labels: DataFrame, max_labelled: int) -> DataFrame:
    """The columns ``out`` of every document with its mark, log importance and key, as a written table."""
    spark = docs.sparkSession
    known, known_path = keep(_labelled(labels, max_labelled), "labelled")
    marked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(("doc_id", "text", *out))]).join(F.broadcast(known), docs["doc_id"] == F.col("_id"), "left").drop("_id")
    fit = F.coalesce(F.col(MARK) == 1, F.lit(False)).alias("fit")
    sums = marked.select("text", fit).mapInArrow(_tally, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    table = np.zeros((2, KINDS << BITS), dtype=np.int64)  # a fixed number of buckets
    table[:, sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    del sums
    shared = spark.sparkContext.broadcast(log_ratios(*table.reshape(2, KINDS, -1)))
    out = [*out, MARK]
    schema = StructType([marked.schema[c] for c in out]).add(LOG_IMPORTANCE, "double").add(KEY, "double")
    scored, _ = keep(marked.mapInArrow(_measure(shared, out), schema), "importance")
    remove(spark, known_path)
    return scored


def expected_acceptances(scored: DataFrame, unusual: float = UNUSUAL) -> int:
    """The number of documents that rejection sampling would accept on average; see above."""
    seen = scored.where(F.col(MARK) == 3).select(LOG_IMPORTANCE).toArrow()[LOG_IMPORTANCE].to_numpy()  # at most max_labelled rows
    if not len(seen):
        return scored.count()
    least = float(np.quantile(seen, unusual))
    taken = scored.agg(F.sum(F.exp(F.least(F.lit(0.0), F.col(LOG_IMPORTANCE) - least)))).first()[0]
    return round(taken or 0)


def _drawn(docs: DataFrame, out: list[str], labels: DataFrame, k: int | None, max_labelled: int) -> DataFrame:
    scored = _scored(docs, out, labels, max_labelled)
    last = kth_largest(scored, KEY, min(expected_acceptances(scored) if k is None else k, scored.count()))
    return scored.where(F.lit(False) if last is None else F.col(KEY) >= F.lit(last))


def importance(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, log_importance and key (with noise) of every document."""
    scored = _scored(docs, ["doc_id"], labels, max_labelled)
    return scored.select("doc_id", F.col(LOG_IMPORTANCE).alias("log_importance"), F.col(KEY).alias("key"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, log_importance and key of the documents drawn."""
    drawn = _drawn(docs, ["doc_id"], labels, k, max_labelled)
    return drawn.select("doc_id", F.col(LOG_IMPORTANCE).alias("log_importance"), F.col(KEY).alias("key"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents drawn, with all their columns, of whatever names, and nothing else; no row is joined back, so each row has its own decision."""
    inner = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    drawn = _drawn(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]), inner, labels, k, max_labelled)
    return drawn.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])
