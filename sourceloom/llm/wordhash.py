"""Words of whole texts and their hashes, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased, on the UTF-8 form.  A word's hash takes its
bytes eight at a time, little-endian, each put through a bijective mixer together with the hash so far; the length comes first.
So words of up to eight bytes of one length never share a hash, and longer ones do with the chance of a random 64-bit function.
Words of more than ``LONG`` bytes are hashed by XXH3 one by one.

Texts come in chunks of about a megabyte.  A longer text comes in pieces cut at blanks (``pieces``), so what a worker holds
beside the text itself doesn't grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEED, ODD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
LONG, CHUNK = 128, 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts: byte bounds in one buffer, hashes, and each text's first word (len(texts) + 1 bounds)."""

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        padded = LOWER[np.frombuffer(b" ".join(texts) + b"         ", dtype=np.uint8)]
        buf = self.buf = padded[:-8]
        self.eight = np.ndarray((len(buf),), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
        blank = SPACE[buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(buf) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)
        self.first[-1] = len(self.start)

    def hashes(self) -> np.ndarray:
        """A hash for each word."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * ODD + SEED)
        live, at, left = np.arange(len(size)), self.start, size
        while len(live):
            out[live] = mix(out[live] ^ (self.eight[at] & KEEP[np.minimum(left, 8)])) * ODD
            more = left > 8
            if not more.all():
                live, at, left = live[more], at[more], left[more]
            if len(live) and size[live].max() > LONG:
                for i in live[size[live] > LONG].tolist():
                    out[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), 1)
                short = size[live] <= LONG
                live, at, left = live[short], at[short], left[short]
            at, left = at + 8, left - 8
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words numbered a and b are equal, byte by byte."""
        size = self.end - self.start
        out = size[a] == size[b]
        live, at, by, left = np.flatnonzero(out), self.start[a][out], self.start[b][out], size[a][out]
        while len(live):
            out[live] = (self.eight[at] ^ self.eight[by]) & KEEP[np.minimum(left, 8)] == 0
            more = (left > 8) & out[live]
            live, at, by, left = live[more], at[more], by[more], left[more]
            if len(live) and left.max() > LONG:
                for i, x, y, n in zip(*(c[left > LONG].tolist() for c in (live, at, by, left)), strict=True):
                    out[i] = self.buf[x + 8 : x + n].tobytes() == self.buf[y + 8 : y + n].tobytes()
                short = left <= LONG
                live, at, by, left = live[short], at[short], by[short], left[short]
            at, by, left = at + 8, by + 8, left - 8
        return out

    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words, ascending, a word of each, and the number of each word's kind.

        Words of one hash are compared; where they differ, they get further hashes, until no two kinds share one."""
        hashes, seed = self.hashes(), 2
        while True:
            order = np.argsort(hashes)
            new = np.concatenate((np.ones(min(1, len(order)), dtype=bool), hashes[order[1:]] != hashes[order[:-1]]))
            kind = np.cumsum(new) - 1
            one = order[new]
            unlike = ~self.same(order, one[kind]) if len(order) else new
            if not unlike.any():
                number = np.empty(len(order), dtype=np.int64)
                number[order] = kind
                return hashes[one], one, number
            for i in order[np.isin(kind, kind[unlike])].tolist():
                hashes[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), seed)
            seed += 1

    def joined(self, some: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words numbered ``some`` with a line feed after each, and where each begins in that (len(some) + 1 bounds)."""
        size = self.end[some] - self.start[some] + 1
        bounds = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(bounds[-1]) + np.repeat(self.start[some] - bounds[:-1], size)
        out = self.buf[at]
        out[bounds[1:] - 1] = 10
        return out.tobytes(), bounds

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n bytes (8 at most) inside words, and the word of each."""
        count = np.maximum(self.end - self.start - n + 1, 0)
        where = np.repeat(np.arange(len(count)), count)
        at = self.start[where] + np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        return mix((self.eight[at] & KEEP[n]) * ODD + np.uint64(n)), where

    def owner(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs of one array of word hashes, order counted; position i covers words i..i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mix((out ^ hashes[j : j + n]) * ODD)
    return out


def pieces(text: bytes | memoryview, size: int = CHUNK) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, each ending before a blank; a word is never cut, however long it is."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and not (found := BLANK.search(text[cut : cut + size])):
            cut += size
        cut = n if cut >= n else cut + found.start()
        yield bytes(text[at:cut])
        at = cut
    yield bytes(text[at:])


def overlapping(text: bytes | memoryview, words: int, size: int = CHUNK) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about ``size`` bytes, and whether a part is the last: each other one repeats its last ``words`` words at
    the head of the next, so that every run of up to words + 1 words is whole in the part where its first word isn't repeated."""
    if len(text) <= size:
        yield bytes(text), True
        return
    rest: list[bytes] = []
    for piece in pieces(text, size):
        part = b" ".join((*rest, piece))
        rest = part.rsplit(None, words) if words else [part]
        if len(rest) > words:
            yield part, False
            del rest[0]
        else:
            rest = [part]
    yield b" ".join(rest), True


def utf8(text) -> memoryview | bytes:
    """An Arrow string's bytes without a copy; null is empty."""
    return memoryview(text.as_buffer()) if text.is_valid else b""


def in_chunks(rows: Iterable[tuple], size_of, limit: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows in lists whose texts together stay under the limit; a longer text comes alone, whole."""
    chunk: list[tuple] = []
    total = 0
    for row in rows:
        n = size_of(row)
        if chunk and total + n > limit:
            yield chunk
            chunk, total = [], 0
        chunk.append(row)
        total += n
    if chunk:
        yield chunk
