"""Token ids of whole texts from a tokenizer file of the ``tokenizers`` library, with a bounded cache of words.

Where a tokenizer drops white space and never joins across it (checked on probes when it is loaded), a text's ids are its
words' ids in a row, so each distinct word is encoded once while the cache holds it.  Where, besides, a run of Latin-1 letters
and the marks after it are pieces of their own, lower-cased and in byte-level form (checked likewise), a new word of that shape
goes to the tokenizer's model at once, without its normaliser and splitter, which take most of the time.  All other words, and
whole texts of other tokenizers, take the library's full path.
"""

from __future__ import annotations

import os
import re

import numpy as np

CACHE_WORDS, LONGEST = 800_000, 64
PROBES = ("a b", "ab\tcd", "x\ny", "é è", "don't 'tis", "1 2  3", "A. B", "</w> <w>", "a\x0bb\x0cc\rd", "  lead and trail  ")
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-&(-/:;=?@\\]-`{-~]*)")
LATIN_PROBES = ("the", "The,", "ÀÉÎ.", "größe###", "ÿþø!!", "ing", "x|", "ßa;:", "a$%&", "ñandú)", "thththth", "WHSH!!", "s-", "re_", "ve]", "ll}", "d@")


WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the public tokenizer files are; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


STAND_IN = _byte_letters()


class Encoder:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes; special tokens are not added."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The process's encoder for a file; workers that are used again keep its cache."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(whole(p) == [i for w in p.encode().split() for i in whole(w.decode())] for p in PROBES)
        self.latin = self.by_word and all(self._short(LATIN.fullmatch(p)) == np.array(whole(p), dtype="<u4").tobytes() for p in LATIN_PROBES)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _short(self, m: re.Match) -> bytes:
        """The ids of letters and marks, by the model alone."""
        letters, marks = m[1].lower(), m[2]
        if not letters.isascii():
            letters = "".join(map(STAND_IN.__getitem__, letters.encode()))
        if (tail := self.marks.get(marks)) is None:
            tail = self._ids([marks])[0]
            if len(self.marks) < 10_000:
                self.marks[marks] = tail
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)]) + tail

    def _learn(self, new: list[bytes]) -> None:
        rest = []
        for w in new:
            m = LATIN.fullmatch(w.decode()) if self.latin else None
            if m:
                self.known[w] = self._short(m)
            else:
                rest.append(w)
        if rest:
            self.known.update(zip(rest, self._ids([w.decode() for w in rest]), strict=True))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._ids([text])[0]
        words = text.encode("utf-8", "replace").split()
        ids = list(map(self.known.get, words))
        new = list({w for w, got in zip(words, ids, strict=True) if got is None}) if None in ids else []
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = list(set(words))
            self._learn(new)
            ids = map(self.known.__getitem__, words)
        out = b"".join(ids)
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out
