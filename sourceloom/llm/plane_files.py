"""Token ids in files of bit or byte planes.

A file is a run of blocks and a trailer.  A block has up to ``block_ids`` ids; they are transposed into planes (plane p has
byte p of every id, or bit p in bit mode), and each plane is compressed with zstandard by itself, so that the upper planes,
which are nearly constant, take almost no space.  The trailer is a zstandard-compressed JSON of the chunk index (for each
block: place, ids, plane sizes) followed by the document table (ids, first ids and lengths, as compressed arrays), their sizes
and a magic word.  Ids of a document may go over blocks; a reader needs only the blocks that hold the documents it wants.
"""

from __future__ import annotations

import json
from array import array
import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"PLANES01"
BLOCK_IDS, LEVEL = 1 << 16, 1


def _planes(ids: np.ndarray, mode: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def _joined(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Writes documents' ids to an output stream; memory holds one block, and 24 bytes a document for the table at the file's end."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, mode: str = "byte", level: int = LEVEL):
        self.out, self.block_ids, self.mode = out, block_ids, mode
        self.press = zstandard.ZstdCompressor(level=level)
        self.wait: list[np.ndarray] = []
        self.waiting = self.place = self.total = 0
        self.blocks: list[list] = []
        self.docs = array("q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.extend((doc_id or 0, doc_id is None, len(ids)))
        self.total += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            run = np.concatenate(self.wait)
            whole = len(run) - len(run) % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(run[i : i + self.block_ids])
            self.wait, self.waiting = [run[whole:]], len(run) - whole

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.press.compress(p) for p in _planes(ids, self.mode)]
        self.blocks.append([self.place, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.out.write(p)
            self.place += len(p)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        docs = np.frombuffer(self.docs, dtype="<i8").reshape(-1, 3) if self.docs else np.zeros((0, 3), dtype="<i8")
        index = self.press.compress(json.dumps({"mode": self.mode, "block_ids": self.block_ids, "blocks": self.blocks}).encode())
        table = self.press.compress(docs.T.tobytes())
        self.out.write(index + table + struct.pack("<QQ", len(index), len(table)) + MAGIC)


class Reader:
    """Reads a file that can be searched; blocks are read as they are needed."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 24)
        tail = source.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a plane file")
        n_index, n_table = struct.unpack("<QQ", tail[:16])
        source.seek(end - 24 - n_table - n_index)
        un = zstandard.ZstdDecompressor()
        head = json.loads(un.decompress(source.read(n_index)))
        self.mode, self.blocks = head["mode"], head["blocks"]
        self.first = np.concatenate(([0], np.cumsum([b[1] for b in self.blocks], dtype=np.int64)))
        doc, null, size = np.frombuffer(un.decompress(source.read(n_table)), dtype="<i8").reshape(3, -1)
        self.doc, self.null, self.size = doc, null.astype(bool), size
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.un = un

    def block(self, b: int) -> np.ndarray:
        place, n, sizes = self.blocks[b]
        self.source.seek(place)
        raw = self.source.read(sum(sizes))
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return _joined([self.un.decompress(raw[cuts[i] : cuts[i + 1]]) for i in range(len(sizes))], n, self.mode)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, its first id's place in this file, ids) in the file's order."""
        held, ids = -1, np.zeros(0, dtype="<u4")
        for d in range(len(self.doc)):
            at, end, parts = int(self.start[d]), int(self.start[d + 1]), []
            pos = at
            while pos < end:
                b = int(np.searchsorted(self.first, pos, side="right")) - 1
                if b != held:
                    held, ids = b, self.block(b)
                lo = pos - int(self.first[b])
                part = ids[lo : lo + end - pos]
                parts.append(part)
                pos += len(part)
            yield None if self.null[d] else int(self.doc[d]), at, parts[0] if len(parts) == 1 else np.concatenate([ids[:0], *parts])
