"""Near-duplicates by SimHash and tiled exact comparison.

Texts get fingerprints of one or more 64-bit lanes.  Distinct fingerprints are dealt into tiles; pairs of tiles that cannot hold
a link are skipped, and the fingerprints of the others are compared exactly, by numpy exclusive-or and bit counts.  Tiles of
more than ``tile_rows`` fingerprints are cut into parts, the home side of a part is all that a task holds, and the visiting side
streams past it, so many pairs at a time that memory doesn't depend on how many of them link.  Of the links of a part only those
are sent on that join two trees of its fingerprints, so a dense group costs a link or two a member.

``near_duplicates`` has one lane over ``k``-word shingles with repeats, and links at ``radius`` or fewer differing bits.  Its tiles go by the
bit counts of the fingerprint's four 16-bit words.  If x and y differ in d bits, the bit counts of their words differ by at most d
in sum, so a pair of tiles whose counts differ by more than the radius is skipped.

``one_of_each`` is for similarity: ``LANES`` lanes over the set of five-word shingles estimate the angle between two sets,
and with their sizes a and b its overlap cos * sqrt(a * b) and its Jaccard similarity; texts link where that is ``threshold`` or more, ``SLACK``
standard errors of the estimate being given away so that similar pairs are not missed.  Bit counts can't tell apart fingerprints at so wide a
radius (their counts always differ by less), but the sets' sizes can: a similarity of t needs sizes within a factor t.  So tiles go by
classes of size, the logarithm to the base 1 / t, and all but neighbouring classes are skipped.

Cases: null text counts as empty; texts without words link with each other; fewer words than a shingle has are one shingle; equal
fingerprints are compared once however many rows have them; rows with a null doc_id get a component, whose id is the smallest
doc_id that is not null, or null where there is none; an empty table gives an empty result; very long texts are read in parts of a
megabyte; columns other than doc_id and text are kept by ``one_of_each`` and else not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import keep, remove
from .wordhash import CHUNK, pieces, utf8

SHINGLE, RADIUS, TILE_ROWS = 3, 2, 8192
WORDS = 4
NEAR_SHINGLE, THRESHOLD, LANES, SLACK, NEAR_TILE_ROWS = 5, 0.8, 16, 1.0, 8192
FIRST_LANE = 26  # pairs whose first lanes differ in more bits aren't looked at further
PAIRS = 1 << 18  # compared at a time
LANE_KEYS = np.random.default_rng(20).integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
TIES = np.unpackbits((LANE_KEYS >> np.uint64(1)).astype("<u8").view(np.uint8), bitorder="little")  # about half of the bits go up where counts are even


def shingle_hashes(text: bytes | memoryview, k: int, size: int = CHUNK) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of a text, A-Z lower-cased, words joined by blanks, part by part."""
    digest, held, some = xxhash.xxh64_intdigest, [], False
    for piece in pieces(text, size):
        words = held + piece.lower().split()
        if len(words) >= k:
            runs = zip(*(words[i:] for i in range(k)), strict=False)
            yield np.fromiter((digest(s, 42) for s in map(b" ".join, runs)), dtype=np.uint64)
            words, some = words[len(words) - k + 1 :], True
        held = words
    if held and not some:
        yield np.array([digest(b" ".join(held), 42)], dtype=np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many rows of hashes (n rows of lanes of 64 bits) have each bit."""
    width = hashes.shape[1] * 64
    count = np.zeros(width, dtype=np.int64)
    rows = 255 * max(1, 8192 // width)  # 255 bits add up within a byte
    for i in range(0, len(hashes), rows):
        bits = np.unpackbits(hashes[i : i + rows].view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return count


def fingerprint(text: str | bytes | memoryview | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of a text: bit set where over half of its shingles' hashes have it, repeats included; 0 without words."""
    text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    count, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, k):
        count, n = count + _set_bits(hashes[:, None]), n + len(hashes)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(utf8(t), k) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def set_print(text: bytes | memoryview, k: int = NEAR_SHINGLE) -> tuple[bytes, int, np.ndarray]:
    """A digest of the text's words, the number of its distinct shingles, and a fingerprint of LANES lanes over them."""
    words, found = xxhash.xxh3_128(), []
    for n, piece in enumerate(pieces(text)):
        words.update((b" " if n else b"") + b" ".join(piece.lower().split()))
    for hashes in shingle_hashes(text, k):
        found.append(np.unique(hashes))
    every = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, dtype=np.uint64)
    count = np.zeros(64 * LANES, dtype=np.int64)
    for i in range(0, len(every), CHUNK >> 8):
        h = every[i : i + (CHUNK >> 8), None] * LANE_KEYS[None, :]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        count += _set_bits(h)
    lanes = np.packbits(count * 2 + TIES > len(every), bitorder="little").view("<u8")
    return words.digest(), len(every), lanes


def _set_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [set_print(utf8(t)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2].astype("<u8").tobytes() for f in found], pa.binary())], names=["row_id", "doc_id", "words", "size", "lanes"])


class Within:
    """Links of one lane: at most ``radius`` differing bits."""

    def __init__(self, radius: int):
        self.first, self.radius = radius, radius

    def agree(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        return None


class Similar:
    """Links of sets of m and n shingles whose estimated Jaccard similarity is ``threshold`` or more."""

    def __init__(self, threshold: float):
        self.first, self.threshold = FIRST_LANE, threshold

    def agree(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        low, high = np.minimum(m, n), np.maximum(m, n)
        overlap = self.threshold / (1 + self.threshold) * (m + n)
        share = np.arccos(np.minimum(1.0, overlap / np.sqrt(np.maximum(1.0, m * n)))) / math.pi
        most = 64 * LANES * (share + SLACK * np.sqrt(share * (1 - share) / (64 * LANES)))
        return (low >= self.threshold * high) & (np.bitwise_count(a ^ b).sum(axis=1) <= most)


class Part:
    """The fingerprints at home in one part of a tile, their trees, and the links found."""

    def __init__(self, test):
        self.test = test
        self.id, self.size = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.lanes = np.zeros((0, 1), dtype=np.uint64)
        self.up = np.zeros(0, dtype=np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def trees(self) -> np.ndarray:
        while not (self.up == (above := self.up[self.up])).all():
            self.up = above
        return self.up

    def settle(self, ids: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> None:
        """More fingerprints come to live here; they visit those that do already, and each other."""
        old = len(self.id)
        self.id, self.size = np.concatenate((self.id, ids)), np.concatenate((self.size, size))
        self.lanes = np.concatenate((self.lanes, lanes)) if old else lanes
        self.up = np.concatenate((self.up, np.arange(old, len(self.id))))
        self.visit(ids, size, lanes, np.arange(old, len(self.id)))

    def visit(self, ids: np.ndarray, size: np.ndarray, lanes: np.ndarray, own: np.ndarray | None = None) -> None:
        """Finds the links of some fingerprints with those at home; ``own``: their places here, each being compared with earlier ones only."""
        if not len(self.id):
            return
        first = np.ascontiguousarray(self.lanes[:, 0])
        step = max(1, PAIRS // len(self.id))
        for i in range(0, len(ids), step):
            near = np.bitwise_count(lanes[i : i + step, 0][:, None] ^ first[None, :]) <= self.test.first
            if own is not None:
                near &= np.arange(len(first))[None, :] < own[i : i + step, None]
            v, h = np.nonzero(near)
            if not len(v):
                continue
            v += i
            sure = self.test.agree(lanes[v], self.lanes[h], size[v], self.size[h]) if self.test.agree is not None else None
            if sure is not None:
                v, h = v[sure], h[sure]
            if len(v):
                self.join(v, h, ids, own)

    def join(self, v: np.ndarray, h: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> None:
        """One link for each visitor and tree that it touches; a visitor joins the trees that it touches."""
        tree = self.trees()[h]
        if own is not None:
            other = tree != self.up[own[v]]
            v, h, tree = v[other], h[other], tree[other]
        _, at = np.unique(v * len(self.id) + tree, return_index=True)
        v, h = v[at], h[at]
        if own is not None:
            keep_link = np.zeros(len(v), dtype=bool)
            for n, (a, b) in enumerate(zip(own[v].tolist(), h.tolist(), strict=True)):
                a, b = self.root(a), self.root(b)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
                    keep_link[n] = True
            v, h = v[keep_link], h[keep_link]
        else:
            for n in np.flatnonzero(v[1:] == v[:-1]).tolist():
                a, b = self.root(h[n]), self.root(h[n + 1])
                self.up[max(a, b)] = min(a, b)
        self.links.append((ids[v], self.id[h]))


def _compare(test, lanes: int):
    """Links (a, b) of each part's rows, which come with those at home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*part.links, strict=True)) if part.links else (np.zeros(0, dtype=np.int64),) * 2
            part.links = []
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            tile, guest, ids, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "guest", "id", "size"))
            data = np.frombuffer(b"".join(batch.column("lanes").to_pylist()), dtype="<u8").reshape(-1, lanes) if lanes > 1 else ids.view(np.uint64)[:, None]
            cut = np.flatnonzero((tile[1:] != tile[:-1]) | (guest[1:] != guest[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(tile)], strict=True):
                if a == b:
                    continue
                if tile[a] != now:
                    if part:
                        yield out()
                    now, part = tile[a], Part(test)
                (part.visit if guest[a] else part.settle)(ids[a:b], size[a:b].astype(np.float64), data[a:b])
        if part:
            yield out()

    return run


def _links(nodes: DataFrame, cell, moves: list, test, lanes: int, tile_rows: int) -> DataFrame:
    """Links (a, b) between the ids of nodes (id, size, lanes; c: the array of small integers that deals them into tiles).

    ``cell`` numbers such an array, and a node also visits the tiles at ``moves`` from its own, one of each pair of opposite moves."""
    spark = nodes.sparkSession
    # a row a tile: at most 17**4 bit counts, or a few hundred sizes, whatever the input's size
    parts, parts_path = keep(nodes.groupBy(cell(F.col("c")).alias("cell")).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")), "cells")
    own = nodes.withColumn("cell", cell(F.col("c"))).join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tile = (F.col("cell") * F.lit(1 << 24).cast("long") + F.col("part")).alias("tile")
    data = ["id", "size", *(["lanes"] if lanes > 1 else [])]
    at_home = own.select(tile, F.lit(0).alias("guest"), *data)
    later = own.where("part > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"), *data)
    away = F.array(*[F.array(*map(F.lit, d)) for d in moves]) if moves else F.expr("cast(array() as array<array<int>>)")
    there = nodes.select(F.explode(F.transform(away, lambda d: F.zip_with("c", d, lambda x, y: x + y))).alias("c"), *data)
    there = there.where(F.forall("c", lambda x: x >= 0)).withColumn("cell", cell(F.col("c"))).join(F.broadcast(parts), "cell")
    there = there.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *data)
    rows = at_home.unionByName(later.unionByName(there).select(tile, F.lit(1).alias("guest"), *data))
    rows = rows.repartition("tile").sortWithinPartitions("tile", "guest")
    links, _ = keep(rows.mapInArrow(_compare(test, lanes), "a long, b long"), "links")
    remove(spark, parts_path)
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), component_id (smallest doc_id reachable over links)."""
    spark = docs.sparkSession
    prints, _ = keep(docs.select("doc_id", "text").mapInArrow(_fingerprints(k), "doc_id long, fp long"), "prints")
    groups, groups_path = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * w).bitwiseAND(F.lit(0xFFFF))).cast("int") for w in range(WORDS)]
    nodes = groups.select(F.col("fp").alias("id"), F.lit(0).alias("size"), F.array(*counts).alias("c"))
    number = lambda c: c[0] * 8000 + c[1] * 400 + c[2] * 20 + c[3]
    near = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius]
    edges = _links(nodes, number, [d for d in near if d > (0,) * WORDS], Within(radius), 1, tile_rows)
    roots, root_paths = connected_components(edges)
    found = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels, _ = keep(found.join(lowest, "root").select("fp", "component_id"), "labels")
    remove(spark, groups_path, *root_paths)
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tile_rows: int = NEAR_TILE_ROWS) -> DataFrame:
    """One row of docs for each group of near duplicates: that of the smallest doc_id, null last, and of such rows the first."""
    spark, id_column = docs.sparkSession, next(n for n in ("near_row_id" + "_" * i for i in range(len(docs.columns) + 1)) if n not in map(str.lower, docs.columns))
    rows, _ = keep(docs.withColumn(id_column, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(id_column).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, prints_path = keep(texts.mapInArrow(_set_prints, "row_id long, doc_id long, words binary, size int, lanes binary"), "prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")).alias("head")
    groups = prints.groupBy("words").agg(head, F.first("size").alias("size"), F.first("lanes").alias("lanes"))
    groups, groups_path = keep(groups.select("head", "size", "lanes"), "groups")
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / threshold)).cast("int")
    nodes = groups.select(F.col("head.row_id").alias("id"), "size", "lanes", F.array(level).alias("c"))
    edges = _links(nodes, lambda c: c[0], [(1,)], Similar(threshold), LANES, tile_rows)
    roots, root_paths = connected_components(edges)
    found = groups.join(roots.withColumnRenamed("node", "row"), F.col("head.row_id") == F.col("row"), "left")
    kept = found.groupBy(F.coalesce("root", "head.row_id").alias("root")).agg(F.min("head").alias("head")).select(F.col("head.row_id").alias(id_column))
    kept, _ = keep(kept, "heads")
    remove(spark, prints_path, groups_path, *root_paths)
    return rows.join(kept, id_column, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
