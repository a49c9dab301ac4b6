"""A probabilistic suffix tree over the bytes of a text's words, built and read in parts.

A text is read as its words (A-Z lower-cased) with one space between them and a line feed as the end symbol; the end symbol
before it is the context of its first byte; a NUL byte is read as 0x01.  A context of up to ``depth`` bytes is a candidate if at
least ``least`` training symbols follow it (1 unless a caller asks for more, so each context seen is put to the test).  A candidate
is retained if the divergence of its next-symbol distribution from that of its suffix one byte shorter, times twice its count,
passes a BIC-like bound, or if a longer retained context ends in it.  Distributions are smoothed towards the suffix's:
P(a|c) = (n(c,a) + s * P(a|suffix)) / (n(c) + s).  The state for a history is its longest retained suffix.

The tree is dealt into parts by a context's last two bytes: all longer contexts that end in them are in one part, and what a part
needs from outside is the root and the contexts of one byte (Top), at most 65,536 counts whatever the corpus's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END, BLANK = 10, 32
DEPTH, LEAST_SHARE, STRENGTH, PENALTY = 6, 0.0, 20.0, 0.3
DEEPEST = 7  # a context and its symbol are one integer of eight bytes
BUCKETS = 1024


def gram_codes(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol but the first: its context of up to ``depth`` bytes, not past an end symbol, and itself, as one integer
    of up to 8 bytes, the symbol lowest; bytes above a shorter context are 0, which no symbol is."""
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"contexts have 1 to {DEEPEST} bytes, not {depth}")
    n = len(stream) - 1
    code = stream[1:].astype(np.uint64)
    alive = np.ones(n, dtype=bool)
    for k in range(1, min(depth, n) + 1):
        alive[: k - 1] = False
        back = np.zeros(n, dtype=np.uint64)
        back[k - 1 :] = stream[: n - k + 1]
        code |= np.where(alive, back << np.uint64(8 * k), np.uint64(0))
        alive &= back != END
    return code


def bucket_of(code: np.ndarray) -> np.ndarray:
    """The part of the tree that a gram's context is in, by its last two bytes."""
    return ((code >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)


def low(code: np.ndarray, level: int) -> np.ndarray:
    """Grams cut to contexts of ``level`` bytes."""
    return code & np.uint64((1 << 8 * (level + 1)) - 1)


@dataclass
class Top:
    """The root and the contexts of one byte: P by context byte << 8 | symbol, and log10 P in the root and in those contexts."""

    first: np.ndarray
    own: np.ndarray
    total: int
    base: np.ndarray

    def values(self, longer: np.ndarray) -> np.ndarray:
        """log10 P by context byte << 8 | symbol; ``longer`` marks bytes in which a retained longer context ends."""
        kept = np.repeat(self.own | longer, 256)
        return np.log10(np.where(kept, self.first, np.tile(self.base, 256)))


def top(code: np.ndarray, times: np.ndarray, least_share: float = LEAST_SHARE, strength: float = STRENGTH, penalty: float = PENALTY) -> tuple[Top, int]:
    """From counts by context byte << 8 | symbol; and the least count of a candidate."""
    n = np.bincount(code, times, 1 << 16).reshape(256, 256)
    total = int(n.sum())
    least = max(1, int(least_share * total))
    base = (n.sum(0) + 0.5) / (total + 128)
    count = n.sum(1)
    first = (n + strength * base) / (count + strength)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * np.where(n > 0, n * np.log(n / count[:, None] / base), 0.0).sum(1)
    own = (count >= least) & (gain > penalty * (n > 0).sum(1) * np.log(np.maximum(count, 2)))
    first = np.where((count >= least)[:, None], first, base)
    return Top(first.ravel(), own, total, base), least


def part(code: np.ndarray, n: np.ndarray, up: Top, least: int, depth: int, strength: float = STRENGTH, penalty: float = PENALTY) -> tuple[np.ndarray, int]:
    """log10 P of each gram of a part (sorted distinct grams and their counts in training texts, 0 for those only scored) in its
    longest retained context of two bytes or more, NaN where none is; and the number of such contexts."""
    grams, context, parent, prob, kept = [low(code, 1)], [None], [None], [up.first[low(code, 1).astype(np.int64)]], [None]
    at, level_of = np.arange(len(code)), np.ones(len(code), dtype=np.int8)
    alive = np.arange(len(code))
    for j in range(2, depth + 1):
        longer = code[alive] >> np.uint64(8 * j) > 0
        alive, below = alive[longer], at[alive[longer]]
        if not len(alive):
            break
        gram, one, back = np.unique(low(code[alive], j), return_index=True, return_inverse=True)
        times = np.bincount(back, n[alive], len(gram))
        at[alive], level_of[alive] = back, j
        cut = np.concatenate(([True], gram[1:] >> np.uint64(8) != gram[:-1] >> np.uint64(8)))
        row = np.cumsum(cut) - 1
        count = np.bincount(row, times)
        prior = prob[-1][below[one]]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * np.bincount(row, np.where(times > 0, times * np.log(times / count[row] / prior), 0.0))
        candidate = count >= least
        kept.append(candidate & (gain > penalty * np.bincount(row, times > 0) * np.log(np.maximum(count, 2))))
        prob.append(np.where(candidate[row], (times + strength * prior) / (count[row] + strength), prior))
        grams.append(gram)
        context.append(row)
        parent.append(below[one])
    for j in range(len(grams) - 1, 1, -1):  # suffixes of retained contexts are retained
        kept[j - 1][context[j - 1][parent[j][kept[j][context[j]]]]] = True
    value = [np.full(len(code), np.nan)]
    for j in range(1, len(grams)):
        value.append(np.where(kept[j][context[j]], np.log10(prob[j]), value[-1][parent[j]]))
    out = np.empty(len(code), dtype=np.float32)
    for j, v in enumerate(value, 1):
        mine = level_of == j
        out[mine] = v[at[mine]]
    return out, int(sum(k.sum() for k in kept[1:]))
