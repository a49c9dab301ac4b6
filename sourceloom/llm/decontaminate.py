"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's number of words slide over a document's words.  A window's fingerprint has bit b
set where over half of its 5-word shingles' hashes have it.  Items are held in a multi-index: the 64 bits are cut in blocks, and
an item is listed under every value of a block that differs from its own in at most radius // blocks bits.  If two fingerprints
differ in at most ``radius`` bits, some block differs in at most radius // blocks, so looking a window's blocks up finds every
item within the radius.  Those candidates are verified: the weighted Jaccard similarity of the two multisets of shingles, a
shingle weighing as often as it occurs, must be at least ``threshold``.  It is taken of the shingles' hashes first, where it can't be
less than of the shingles themselves, and then of the shingles, as words.

With ``short``, a document of fewer words than an item is its own one window, if its number of shingles can still reach the threshold.  It is
looked up and verified like any other window.

Only windows that hold a shingle of some item of their size are fingerprinted: any other window has similarity 0.  Items of
fewer than five words have one shingle of all their words.  The benchmark is a query set: it is taken in blocks of at most
``block_words`` words, each of which passes over all documents.

Cases: null and empty texts have no windows; items without words match nothing; repeated items and rows are each reported; null
ids stay null; empty tables give no rows; a very long text is read in parts of about a megabyte that overlap by as many words as a
window can have; columns other than the ids and texts are kept by ``clean`` and else not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordhash import CHUNK, Words, in_chunks, overlapping, shingles, utf8

SHINGLE, THRESHOLD, RADIUS, BLOCKS, BLOCK_WORDS = 5, 0.8, 20, 8, 1_000_000
FILTER_BITS = 22


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of set bits: row i has those of the first i hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=out[1:])
    return out


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` shingle hashes."""
    sums = bit_sums(hashes)
    over = 2 * (sums[size:] - sums[:-size]) > size
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


@dataclass
class Items:
    """The items of one number of words."""

    words: int
    shingle: int
    ids: list = field(default_factory=list)
    bags: list = field(default_factory=list)
    plain: list = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    every: np.ndarray | None = None

    @property
    def size(self) -> int:
        return self.words - self.shingle + 1

    def index(self, radius: int, blocks: int) -> None:
        self.prints = np.array([int(window_prints(h, self.size)[0]) for h in self.bags], dtype=np.uint64)
        width = 64 // blocks
        near = np.flatnonzero(np.bitwise_count(np.arange(1 << width, dtype=np.uint64)) <= radius // blocks).astype(np.uint64)
        for b in range(blocks):
            own = self.prints >> np.uint64(width * b) & np.uint64((1 << width) - 1)
            value = (own[:, None] ^ near[None, :]).ravel().astype(np.int64)
            item = np.repeat(np.arange(len(own)), len(near))
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << width) + 1)), item[order]))

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, by looking every block up."""
        width, found = 64 // len(self.tables), []
        for b, (first, item) in enumerate(self.tables):
            value = (prints >> np.uint64(width * b) & np.uint64((1 << width) - 1)).astype(np.int64)
            count = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), count)
            at = np.repeat(first[value] - (np.cumsum(count) - count), count) + np.arange(len(window))
            near = item[at]
            ok = np.bitwise_count(prints[window] ^ self.prints[near]) <= radius
            found.append(window[ok] * len(self.ids) + near[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)


def similarity(mine: Counter, other: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, other[s]) for s, n in mine.items() if s in other)
    return both / (mine.total() + other.total() - both)


def bag(words: list[bytes], k: int) -> Counter:
    """The multiset of the k-word shingles of some words, as words."""
    return Counter(zip(*(words[i:] for i in range(k)), strict=False))


@dataclass
class Benchmark:
    """Items by number of words, and the shingles of all of them by shingle length."""

    groups: list[Items]
    shingle_sets: dict[int, tuple[np.ndarray, np.ndarray]]
    radius: int
    threshold: float
    short: bool

    @property
    def overlap(self) -> int:
        """The words that parts of a text share: one less than the longest item has."""
        return max((g.words for g in self.groups), default=1) - 1


def benchmark_index(items: list[tuple], radius: int = RADIUS, blocks: int = BLOCKS, threshold: float = THRESHOLD, short: bool = False) -> Benchmark:
    groups: dict[int, Items] = {}
    for item_id, text in items:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = Words([b" ".join(words)]).hashes()
        if len(h):
            k = min(SHINGLE, len(h))
            group = groups.setdefault(len(h), Items(len(h), k))
            group.ids.append(item_id)
            group.bags.append(shingles(h, k))
            group.plain.append(bag(words, k))
    sets = defaultdict(list)
    for g in groups.values():
        g.index(radius, blocks)
        sets[g.shingle] += g.bags
        g.counts = [Counter(b.tolist()) for b in g.bags]
        g.every = np.unique(np.concatenate(g.bags))
    tables = {}
    for k, bags in sets.items():
        every = np.unique(np.concatenate(bags))
        mask = np.zeros(1 << FILTER_BITS, dtype=bool)
        mask[every >> np.uint64(64 - FILTER_BITS)] = True
        tables[k] = (mask, every)
    return Benchmark(list(groups.values()), tables, radius, threshold, short)


def _holds(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def matches(words_at, hashes: np.ndarray, bench: Benchmark, hits: dict[int, np.ndarray], runs: dict[int, np.ndarray], whole: bool) -> list[tuple]:
    """(item_id, similarity, first word, words) of the best window for every item that a document, or part of one, holds.

    ``runs`` has its shingle hashes by shingle length, ``hits`` the places of those that some item has; ``words_at`` gives words from a
    place on."""
    out = []
    for g in bench.groups:
        at = hits.get(g.shingle)
        if at is None or len(at) == 0:
            continue
        run = runs[g.shingle]
        size = min(g.size, len(run))  # a shorter document is one window
        if len(hashes) < g.words and not (whole and bench.short and size + 1e-9 >= bench.threshold * g.size):
            continue
        at = at[_holds(g.every, run[at])]
        if len(at) == 0:
            continue
        last = len(run) - size
        low, high = np.maximum(at - size + 1, 0), np.minimum(at, last)
        cuts = np.flatnonzero(low[1:] > high[:-1] + 1) + 1  # window starts in runs without gaps
        for a, b in zip(low[np.concatenate(([0], cuts))], high[np.concatenate((cuts - 1, [len(at) - 1]))], strict=True):
            if a > b:
                continue
            window, item = g.candidates(window_prints(run[a : b + size], size), bench.radius)
            best: dict[int, tuple[float, int]] = {}
            for w, i in zip((window + a).tolist(), item.tolist(), strict=True):
                least = max(bench.threshold, best.get(i, (0.0, 0))[0])
                if similarity(Counter(run[w : w + size].tolist()), g.counts[i]) < least:
                    continue
                s = similarity(bag(words_at(w, size + g.shingle - 1), g.shingle), g.plain[i])
                if s >= bench.threshold and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (s, w)
            out += [(g.ids[i], s, w, min(g.words, len(hashes))) for i, (s, w) in best.items()]
    return out


def _scan(texts: list[bytes], bench: Benchmark, whole: bool) -> tuple[list[list[tuple]], int]:
    """Each text's matches, and the number of words of all."""
    words = Words(texts)
    hashes, out = words.hashes(), [[] for _ in texts]
    if not len(hashes):
        return out, 0
    places, all_runs = {}, {}
    owner = words.owner()
    for k, (mask, every) in bench.shingle_sets.items():
        run = shingles(hashes, k)
        if len(run) == 0:
            continue
        at = np.flatnonzero(mask[run >> np.uint64(64 - FILTER_BITS)])
        at = at[_holds(every, run[at])]
        at = at[owner[at] == owner[at + k - 1]]
        places[k], all_runs[k] = at, run
    some = np.unique(np.concatenate([owner[at] for at in places.values()])) if places else []
    for d in some:
        a, b = int(words.first[d]), int(words.first[d + 1])
        hits = {k: at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a for k, at in places.items()}
        runs = {k: run[a : max(a, b - k + 1)] for k, run in all_runs.items()}
        words_at = lambda w, n, a=a: words.buf[words.start[a + w] : words.end[a + w + n - 1]].tobytes().split()
        out[d] = matches(words_at, hashes[a:b], bench, hits, runs, whole)
    return out, len(hashes)


def scan(texts: list[bytes | memoryview], bench: Benchmark, size: int = CHUNK) -> list[list[tuple]]:
    """Each text's matches, for each item the best; a text longer than ``size`` is alone."""
    if len(texts) > 1 or len(texts[0]) <= size:
        found = _scan([bytes(t) for t in texts], bench, True)[0]
    else:
        found, base = [[]], 0
        for k, (part, last) in enumerate(overlapping(texts[0], bench.overlap, size)):
            rows, n = _scan([part], bench, last and not k)
            found[0] += [(i, s, w + base, m) for i, s, w, m in rows[0]]
            base += n - bench.overlap
    out = []
    for rows in found:
        top: dict = {}
        for row in rows:
            if row[0] not in top or (-row[1], row[2]) < (-top[row[0]][1], top[row[0]][2]):
                top[row[0]] = row
        out.append(list(top.values()))
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The query set, in parts of at most about block_words words."""
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0))).first()[0]
    n = int(total // block_words) + 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").collect()]


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_words: int = BLOCK_WORDS, short: bool = False) -> DataFrame:
    """doc_id, item_id, similarity, start_word, words: for each document and item the best window that reaches the threshold."""
    spark, out = docs.sparkSession, None
    for part in _blocks(items, block_words):
        held = spark.sparkContext.broadcast(benchmark_index(part, radius, BLOCKS, threshold, short))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            rows = ((d.as_py(), utf8(t)) for b in batches for d, t in zip(b.column("doc_id"), b.column("text"), strict=True))
            for chunk in in_chunks(rows, lambda r: len(r[1])):
                found = [(d, *m) for (d, _), ms in zip(chunk, scan([t for _, t in chunk], held.value), strict=True) for m in ms]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "words"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, words long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_words: int = BLOCK_WORDS, short: bool = False) -> DataFrame:
    """The documents that hold no item, with all their columns and in one pass for each block of items."""
    spark, schema = docs.sparkSession, docs.schema
    for part in _blocks(items, block_words):
        held = spark.sparkContext.broadcast(benchmark_index(part, radius, BLOCKS, threshold, short))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                free: list[bool] = []
                for chunk in in_chunks(((utf8(t),) for t in batch.column("text")), lambda r: len(r[0])):
                    free += [not m for m in scan([t for (t,) in chunk], held.value)]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
