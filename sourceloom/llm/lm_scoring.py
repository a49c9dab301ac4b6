"""Scoring texts by a probabilistic suffix tree that is learnt from part of the corpus, beside a unigram score.

Documents are taken in blocks of texts.  A block asks about its distinct grams (a context of up to ``depth`` bytes and the symbol after it)
and its distinct words, with their counts in training texts, packed as one row for each part of the tree or of the
dictionary.  A part sums the counts of all blocks, builds its piece of the tree, or of the dictionary with the words themselves as
keys, and answers each block's row in its order: log10 P of each gram, or the corpus's count of each word.  A block's answers meet its
texts again, which are then scored.  So a gram or a word is sent once for each block that has it, the tree and the dictionary are
spread over the cluster and grow with the corpus, and only counts of single bytes after single bytes and two sums reach the driver.

Cases: null text is empty and has one token, its end; a null doc_id counts as the empty string for the split (training);
repeated rows count as often as they occur; a very long text is read and sent in pieces of a megabyte that end with a word; an
empty table gives no rows; other columns are not read.  If no text is for training, N and V are 0 and the tree has only its
uniform root.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import suffix_tree as st
from .scratch import keep, remove
from .wordhash import CHUNK, Words, pieces, utf8

BLOCK_BYTES, MERGE_CODES, WORD_PARTS = 1 << 23, 1 << 20, 512
HELD_OUT_OF, HELD_OUT = 7, 2
GRAMS, WORDS, TEXTS, TOP = range(4)
ROW = {"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "data": pa.binary(), "counts": pa.binary(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "open": pa.bool_()}
ROW_TYPE = "block long, kind int, part int, data binary, counts binary, docs array<long>, sizes array<long>, open boolean"
ANSWER = {"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "data": pa.binary(), "total": pa.int64(), "distinct": pa.int64(), "ends": pa.list_(pa.int32())}
ANSWER_TYPE = "block long, kind int, part int, data binary, total long, distinct long, ends array<int>"
OUT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
OUT_TYPE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END_WORD = b""  # no word is empty
NO_VALUE = (1 << 24) - 1
Counts = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def _merge(some: list[Counts]) -> Counts:
    """Sums of counts by code; codes ascending."""
    code, back = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([n for _, n in some]), len(code)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """An array's bytes by plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_logs(values: np.ndarray) -> bytes:
    """Values of log10 P, 0 down to -16 or NaN, in steps of 2**-20, three bytes each."""
    steps = np.where(np.isnan(values), NO_VALUE, np.rint(np.minimum(np.nan_to_num(-values, nan=0.0) * (1 << 20), NO_VALUE - 1))).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes())


def unpack_logs(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(3, -1).astype(np.uint32)
    steps = planes[0] | planes[1] << 8 | planes[2] << 16
    return np.where(steps == NO_VALUE, np.float32(np.nan), (steps * np.float64(-(2.0**-20))).astype(np.float32))


def ascending(codes: np.ndarray) -> np.ndarray:
    """The distinct ones in order, by sorting, which is faster here than numpy's hashing."""
    codes = np.sort(codes)
    return codes[np.concatenate((np.ones(min(1, len(codes)), dtype=bool), codes[1:] != codes[:-1]))]


def _rows(types: dict[str, pa.DataType], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], names=list(types))


def press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _spans(part: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of one value begin and end."""
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), dtype=bool), part[1:] != part[:-1]))).tolist()
    return list(zip(cut, [*cut[1:], len(part)], strict=False))


def _by_part(code: np.ndarray) -> Counts:
    """The order of sorted grams by part of the tree, then gram; and the parts in that order."""
    part = st.bucket_of(code)
    order = np.argsort(part, kind="stable")
    return order, part[order]


class Texts:
    """Some texts, or a piece of one, in normal form: words with one blank between them, texts with END between them.

    ``head``: for a piece that continues a text, the symbols before it; ``open``: the last text goes on in the next piece."""

    def __init__(self, docs: list, texts: list[bytes], head: bytes = b"", is_open: bool = False):
        self.docs, self.head, self.open = docs, head, is_open
        self.sizes = [len(t) for t in texts]
        self.data = b"\n".join(texts)

    @classmethod
    def of(cls, row: dict, head: bytes) -> Texts:
        out = cls(row["docs"], [], head, row["open"])
        out.sizes, out.data = row["sizes"], zstandard.ZstdDecompressor().decompress(row["data"])
        return out

    def codes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of all symbols, and the text of each."""
        stream = np.frombuffer((self.head or b"\n") + self.data + (b"" if self.open else b"\n"), dtype=np.uint8)
        stream = np.where(stream == 0, np.uint8(1), stream)
        size = np.array(self.sizes, dtype=np.int64) + 1
        size[-1] -= self.open
        return st.gram_codes(stream, depth)[max(len(self.head), 1) - 1 :], np.repeat(np.arange(len(size)), size)

    def tail(self, depth: int) -> bytes:
        """What the next piece has as its head."""
        return ((self.head or b"\n") + self.data)[-depth:] if self.open else b""

    def tokens(self) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words without the ends: all of them, one of each kind, each one's kind, and its text."""
        w = Words([self.data])
        _, one, kind = w.kinds()
        begin = np.cumsum([0, *(n + 1 for n in self.sizes[:-1])])
        first = np.searchsorted(w.start, begin)
        return w, one, kind, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.start))))


class Vocabulary:
    """The distinct words of a block, from those of its parts, in an order that follows from the texts: by part of the dictionary and hash.

    ``data`` and ``bounds`` give the words' bytes, ``part`` their parts, and ``place`` where each word that was added stands."""

    def __init__(self, added: list[bytes]):
        w = Words([b"".join(added)])
        hashes, one, kind = w.kinds()
        part = (hashes % np.uint64(WORD_PARTS)).astype(np.int64)
        order = np.lexsort((hashes, part))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.part, self.place = part[order], place[kind]
        self.data, self.bounds = w.joined(one[order])


def _normal(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Texts]:
    """The corpus in parts of about a megabyte, a long text's pieces each on their own."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for doc, scalar in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = utf8(scalar)
            if held and held + len(text) > CHUNK:
                yield Texts(docs, texts)
                docs, texts, held = [], [], 0
            if len(text) <= CHUNK:
                docs.append(doc)
                texts.append(b" ".join(bytes(text).lower().split()))
                held += len(text) + 1
                continue
            before, head = None, b""
            for piece in pieces(text):
                now = b" ".join(piece.lower().split())
                if not now:
                    continue
                if before is not None:
                    part = Texts([doc], [before], head, True)
                    yield part
                    head, now = part.tail(depth), b" " + now
                before = now
            yield Texts([doc], [before or b""], head)
    if docs:
        yield Texts(docs, texts)


def _blocks(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        rows: list[dict] = []
        grams: list[Counts] = []
        words: list[bytes] = []
        counts: list[np.ndarray] = []
        training = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            tag = {"block": task << 32 | number}
            number += 1
            yield _rows(ROW, [{**r, **tag} for r in rows])
            known = Vocabulary(words)
            n = np.bincount(known.place, np.concatenate(counts), len(known.part)).astype(np.uint32)
            asked = [{**tag, "kind": WORDS, "part": int(known.part[a]), "data": press(known.data[known.bounds[a] : known.bounds[b] - 1]), "counts": pack(n[a:b])} for a, b in _spans(known.part)]
            yield _rows(ROW, [*asked, {**tag, "kind": WORDS, "part": WORD_PARTS, "data": press(END_WORD), "counts": pack(np.array([training], dtype=np.uint32))}])
            code, n = _merge(grams)
            pair, back = np.unique(st.low(code, 1), return_inverse=True)
            yield _rows(ROW, [{**tag, "kind": TOP, "data": pack(pair), "counts": pack(np.bincount(back, n, len(pair)).astype(np.int64))}])
            order, part = _by_part(code)
            code, n = code[order], n[order].astype(np.uint32)
            yield _rows(ROW, [{**tag, "kind": GRAMS, "part": int(part[a]), "data": pack(code[a:b]), "counts": pack(n[a:b])} for a, b in _spans(part)])
            for x in (rows, grams, words, counts):
                x.clear()

        for texts in _normal(batches, depth):
            rows.append({"kind": TEXTS, "part": len(rows), "data": press(texts.data), "docs": texts.docs, "sizes": texts.sizes, "open": texts.open})
            out = np.array([held_out(d) for d in texts.docs])
            training += int((~out[: len(out) - texts.open]).sum())
            code, owner = texts.codes(depth)
            for held_back in (False, True):  # held-out texts' grams and words count 0
                mine = code[out[owner] == held_back] if out.any() else code if not held_back else code[:0]
                if len(mine):
                    some, n = np.unique(mine, return_counts=True)
                    grams.append((some, np.zeros_like(n) if held_back else n))
            w, one, kind, owner = texts.tokens()
            words.append(w.joined(one)[0])
            counts.append(np.bincount(kind, ~out[owner], len(one)).astype(np.int64))
            if len(grams) > 8:
                grams[:] = [_merge(grams)]
            held += len(texts.data)
            if held > BLOCK_BYTES and not texts.open:
                yield from block()
                held = training = 0
        if rows:
            yield from block()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for codes, times in zip(batch.column("data"), batch.column("counts"), strict=True):
            n[unpack(codes.as_py(), "<u8").astype(np.int64)] += unpack(times.as_py(), "<i8")
    code = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n[code])], names=["code", "n"])


def _gram_answers(part: int, asked: list[tuple], up: st.Top, least: int, depth: int) -> Iterator[dict]:
    """log10 P of each block's grams (NaN where no context of two bytes or more is retained); then, without a block, the number of
    retained contexts and the last bytes of them."""
    some: list[Counts] = []
    fresh = 0
    for _, codes, times in asked:
        some.append((unpack(codes, "<u8"), unpack(times, "<u4").astype(np.int64)))
        fresh += len(some[-1][0])
        if fresh > max(MERGE_CODES, len(some[0][0])):  # merged as they come
            some, fresh = [_merge(some)], 0
    code, n = _merge(some)
    del some
    value, contexts = st.part(code, n, up, least, depth)
    ends = np.flatnonzero(np.bincount((code[~np.isnan(value)] >> np.uint64(8) & np.uint64(255)).astype(np.int64))).tolist()
    for block, codes, _ in asked:
        yield {"block": block, "kind": GRAMS, "part": part, "data": pack_logs(value[np.searchsorted(code, unpack(codes, "<u8"))])}
    yield {"kind": GRAMS, "part": part, "total": contexts, "ends": ends}


def _word_answers(part: int, asked: list[tuple]) -> Iterator[dict]:
    """The corpus's count of each block's words; then, without a block, the sum of the counts and the number of those over 0."""
    counts: dict[bytes, int] = {}
    words_of = lambda data: zstandard.ZstdDecompressor().decompress(data).split(b"\n")
    for _, data, times in asked:
        for w, n in zip(words_of(data), unpack(times, "<u4").tolist(), strict=True):
            counts[w] = counts.get(w, 0) + n
    for block, data, _ in asked:
        yield {"block": block, "kind": WORDS, "part": part, "data": pack(np.fromiter(map(counts.__getitem__, words_of(data)), dtype=np.int64))}
    yield {"kind": WORDS, "part": part, "total": sum(counts.values()), "distinct": sum(n > 0 for n in counts.values())}


def _answers(model, depth: int):
    """Rows come by kind and part; what a part holds at a time is its blocks' packed rows and its own piece of the tree or dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, least = model.value
        now: tuple | None = None
        asked: list[tuple] = []

        def answer() -> Iterator[pa.RecordBatch]:
            kind, part = now
            rows, size = [], 0
            for row in _gram_answers(part, asked, up, least, depth) if kind == GRAMS else _word_answers(part, asked):
                rows.append(row)
                size += len(row.get("data", b""))
                if size > CHUNK:
                    yield _rows(ANSWER, rows)
                    rows, size = [], 0
            yield _rows(ANSWER, rows)
            asked.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for block, kind, part, data, times in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part", "data", "counts")), strict=True):
                if (kind, part) != now:
                    if asked:
                        yield from answer()
                    now = (kind, part)
                asked.append((block, data, times))
        if asked:
            yield from answer()

    return run


def learn(blocks: DataFrame, depth: int, least_share: float) -> DataFrame:
    """The answers to all blocks, as a written table, with a row without a block for each part's sums."""
    spark = blocks.sparkSession
    pairs = blocks.where(F.col("kind") == TOP).select("data", "counts").mapInArrow(_pairs, "code long, n long")
    rows = pairs.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 65,536 at most
    up, least = st.top(rows["code"].to_numpy(), rows["n"].to_numpy(), least_share)
    model = spark.sparkContext.broadcast((up, least))
    asked = blocks.where(F.col("kind").isin(GRAMS, WORDS)).select("block", "kind", "part", "data", "counts")
    answers, _ = keep(asked.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_answers(model, depth), ANSWER_TYPE), "answers")
    answers.top = up
    return answers


def _finish(depth: int, model):
    """Scores of each block's texts, from its answers (in the order of its grams and words) and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct, first = model.value
        now = None
        held: dict[int, list] = {GRAMS: [], WORDS: [], TEXTS: []}

        def texts() -> Iterator[Texts]:
            head = b""
            for row in held[TEXTS]:
                yield (some := Texts.of(row, head))
                head = some.tail(depth)

        def block() -> Iterator[pa.RecordBatch]:
            code, fresh, size, added = np.zeros(0, dtype=np.uint64), [], 0, []
            for some in texts():
                fresh.append(ascending(some.codes(depth)[0]))
                size += len(fresh[-1])
                if size > MERGE_CODES:
                    code, fresh, size = ascending(np.concatenate((code, *fresh))), [], 0
                w, one, *_ = some.tokens()
                added.append(w.joined(one)[0])
            code = ascending(np.concatenate((code, *fresh)))
            value = np.empty(len(code), dtype=np.float32)
            value[_by_part(code)[0]] = np.concatenate([unpack_logs(d) for d in held[GRAMS]])
            bare = np.isnan(value)
            value[bare] = first[st.low(code[bare], 1).astype(np.int64)]
            counts = np.concatenate([unpack(d, "<i8") for d in held[WORDS]])  # the end's is the last
            place, at = Vocabulary(added).place, 0
            weight, known = np.log10((counts + 1) / (total + distinct + 1)), counts > 0
            open_sums = np.zeros(4)  # of a text that goes on: tokens, known ones, base score, score
            for some in texts():
                codes, owner = some.codes(depth)
                order, n = np.argsort(codes), len(some.docs)
                codes, owner = codes[order], owner[order]
                new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                logs = np.repeat(value[np.searchsorted(code, codes[new])], np.diff(np.append(new, len(codes))))
                _, one, kind, whose = some.tokens()
                slot = place[at : at + len(one)][kind]
                at += len(one)
                ends = np.ones(n)
                ends[n - some.open :] = 0
                sums = np.stack([np.bincount(whose, minlength=n) + ends, np.bincount(whose, known[slot], n) + ends * known[-1], np.bincount(whose, weight[slot], n) + ends * weight[-1], np.bincount(owner, logs, n)], 1)
                sums[0] += open_sums
                open_sums = sums[-1] if some.open else np.zeros(4)
                done = n - some.open
                if done:
                    made = [some.docs[:done], [held_out(d) for d in some.docs[:done]], sums[:done, 0].astype(np.int64), sums[:done, 1].astype(np.int64), np.full(done, total), sums[:done, 2], sums[:done, 3]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, OUT.values(), strict=True)], names=list(OUT))
            for x in held.values():
                x.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if held[TEXTS]:
                        yield from block()
                    now = row["block"]
                held[row["kind"]].append(row if row["kind"] == TEXTS else row["data"])
        if held[TEXTS]:
            yield from block()

    return run


def score(docs: DataFrame, depth: int = st.DEPTH, least_share: float = st.LEAST_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    blocks, blocks_path = keep(docs.select("doc_id", "text").mapInArrow(_blocks(depth), ROW_TYPE), "blocks")
    answers = learn(blocks, depth, least_share)
    sums = answers.where("block is null")
    total, distinct = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    longer = np.zeros(256, dtype=bool)
    longer[[r.end for r in sums.select(F.explode("ends").alias("end")).distinct().collect()]] = True  # 256 at most
    model = spark.sparkContext.broadcast((total, distinct, answers.top.values(longer).astype(np.float32)))
    texts = blocks.where(F.col("kind") == TEXTS).select("block", "kind", "part", "data", "docs", "sizes", "open")
    whole = answers.where("block is not null").select("block", "kind", "part", "data").unionByName(texts, allowMissingColumns=True)
    scored, _ = keep(whole.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(_finish(depth, model), OUT_TYPE), "scores")
    remove(spark, blocks_path)
    return scored
