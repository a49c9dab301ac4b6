"""Matroska files: parsing into packet tables, and writing of lossless 8-bit sample tracks.

The format is EBML: elements of a variable-length id, a variable-length size and a body.  The parser walks Segment, Info, Tracks,
Clusters and Cues, also those of unknown size, and gives every frame of SimpleBlocks and BlockGroups as a packet: track,
timestamp, and the byte range of the frame in the file; the frames of a block are divided by its lacing (none, Xiph, fixed-size
or EBML).  The writer makes one audio track of unsigned 8-bit PCM at 8,000 samples a second, frames of 192 samples, up to eight
frames a block with a lacing that changes from cluster to cluster, 64 blocks a cluster, and cues for all clusters.

Timestamps are in milliseconds.  The frames of a laced block follow each other by the track's default duration, or else by an equal part of
their block group's duration, or else have the block's time.  A cluster of unknown size ends at the next element of its level, a
segment of unknown size at the next file head.  Elements that the tables don't need are passed over.  A file that is cut off or has
sizes that don't fit is an error (ValueError).

Cases: null text is an empty one, whose payload is one frame of blanks; very long texts are one file, whole; rows that repeat, and
rows with equal or null ids, each have a file; null media has no packets, and null numbers and feature; a file without tracks or
packets has no codec and an empty payload; an empty table gives no rows; columns other than doc_id and text (doc_id, n_bytes and
media when files are read) are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the Matroska specification (element ids, with their length marker).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE = 0x23E383, 0x9B, 0xFB
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
AFTER_CLUSTER = frozenset((CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, EBML, SEGMENT))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, FRAMES, BLOCKS, RATE_HZ = 192, 8, 64, 8000
MS_PER_FRAME = FRAME * 1000 // RATE_HZ


def write_size(n: int) -> bytes:
    """A variable-length size; all-ones values are kept for the unknown size."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def whole(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """A block's body after its flags: the frames' sizes by the lacing, then the frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == EBML_LACING:
        head += write_size(len(frames[0]))
        for before, f in zip(frames[:-2], frames[1:-1], strict=True):
            step, length = len(f) - len(before), 1
            while abs(step) >= (1 << 7 * length - 1) - 1:
                length += 1
            head += (step + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def write_samples(payload: bytes) -> bytes:
    """A Matroska file whose audio samples are the bytes of the payload, which has a positive multiple of FRAME bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, whole(EBML_VERSION, 1) + whole(EBML_READ, 1) + whole(EBML_ID_LENGTH, 4) + whole(EBML_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + whole(DOC_VERSION, 4) + whole(DOC_READ, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + whole(CHANNELS, 1) + whole(DEPTH, 8))
    track = element(TRACK_ENTRY, whole(TRACK_NUMBER, 1) + whole(TRACK_UID, 1) + whole(TRACK_TYPE, 2) + whole(FLAG_LACING, 1) + whole(DEFAULT_DURATION, MS_PER_FRAME * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    info = element(INFO, whole(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"sourceloom") + element(WRITER, b"sourceloom") + element(DURATION, struct.pack(">d", len(frames) * MS_PER_FRAME)))
    body, cues = info + element(TRACKS, track), []
    parts, place = [body], len(body)
    for number, i in enumerate(range(0, len(frames), FRAMES * BLOCKS)):
        start, inside = i * MS_PER_FRAME, []
        for j in range(i, min(len(frames), i + FRAMES * BLOCKS), FRAMES):
            group = frames[j : j + FRAMES]
            kind = NO_LACING if len(group) == 1 else (XIPH, FIXED, EBML_LACING)[number % 3]
            inside.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (j - i) * MS_PER_FRAME, 0x80 | kind << 1) + lace(group, kind)))
        cluster = element(CLUSTER, whole(CLUSTER_TIME, start) + b"".join(inside))
        cues.append(element(CUE_POINT, whole(CUE_TIME, start) + element(CUE_PLACES, whole(CUE_TRACK, 1) + whole(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """A file's tables: packets (track, timestamp in ms, first byte, size, keyframe, block, lacing), tracks and cues."""

    packets: list[tuple] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[tuple] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    segment: int = 0


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data):
        raise ValueError("the file is cut off")
    first = data[at]
    length = 9 - first.bit_length()
    if not 1 <= length <= 4 or at + length > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, None if it is the unknown one, and the place after it."""
    length = 9 - data[at].bit_length() if at < len(data) else 9
    if length > 8 or at + length > len(data):
        raise ValueError(f"no element size at byte {at}")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements of a body; one of unknown size goes on to an element that can't be inside it."""
    while at < end:
        name, body = read_id(data, at)
        size, body = read_size(data, body)
        stop = end if size is None else body + size
        if size is None and name in (CLUSTER, SEGMENT):
            stop, others = body, AFTER_CLUSTER if name == CLUSTER else (EBML, SEGMENT)
            while stop < end:
                inner, after = read_id(data, stop)
                if inner in others:
                    break
                n, after = read_size(data, after)
                stop = after + (n or 0)  # an inner one of unknown size: its own elements are passed over in turn
        if stop > end:
            raise ValueError(f"element {name:#x} at byte {at} is cut off")
        yield name, body, stop
        at = stop


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where they begin."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError("a laced block is cut off")
    count, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("a block with fixed-size lacing doesn't divide")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == XIPH:
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise ValueError("a block's lacing is cut off")
            n, at = n + data[at], at + 1
        else:
            n, after = read_size(data, at)
            length, at = after - at, after
            if n is None:
                raise ValueError("a frame of unknown size")
            if k:
                n = sizes[-1] + n - ((1 << 7 * length - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a block's lacing doesn't fit its size")
    return sizes, at


def _block(data: bytes, at: int, end: int, start: int, media: Media, key: bool | None, lasts: int | None = None) -> None:
    track, at = read_size(data, at)
    if at + 3 > end:
        raise ValueError("a block is cut off")
    shift, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    sizes, place = frame_sizes(data, at + 3, end, kind)
    step = next((t["frame_ns"] for t in media.tracks if t["number"] == track), 0) or (lasts * media.scale // len(sizes) if lasts else 0)
    number = media.packets[-1][5] + 1 if media.packets else 0
    for k, n in enumerate(sizes):
        media.packets.append((track, ((start + shift) * media.scale + k * step) // 1_000_000, place, n, bool(flags & 0x80) if key is None else key, number, kind))
        place += n


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a number of {b - a} bytes at byte {a}")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def parse(data: bytes) -> Media:
    """All tables of a file."""
    media, top = Media(), elements(data, 0, len(data))
    name, a, b = next(top, (0, 0, 0))
    if name != EBML:
        raise ValueError("not an EBML file")
    for name, a, b in top:
        if name != SEGMENT:
            continue
        media.segment = a
        for part, x, y in elements(data, a, b):
            if part == INFO:
                for n, i, j in elements(data, x, y):
                    if n == TIMESTAMP_SCALE:
                        media.scale = _number(data, i, j)
                    elif n == DURATION:
                        media.duration = _float(data, i, j)
            elif part == TRACKS:
                for n, i, j in elements(data, x, y):
                    if n == TRACK_ENTRY:
                        media.tracks.append(_track(data, i, j))
            elif part == CLUSTER:
                start = 0
                for n, i, j in elements(data, x, y):
                    if n == CLUSTER_TIME:
                        start = _number(data, i, j)
                        media.clusters.append((start, x))
                    elif n == SIMPLE_BLOCK:
                        _block(data, i, j, start, media, None)
                    elif n == BLOCK_GROUP:
                        inner = list(elements(data, i, j))
                        for m, k, z in inner:
                            if m == BLOCK:
                                lasts = next((_number(data, q[1], q[2]) for q in inner if q[0] == BLOCK_DURATION), None)
                                _block(data, k, z, start, media, not any(q[0] == REFERENCE for q in inner), lasts)
            elif part == CUES:
                for n, i, j in elements(data, x, y):
                    if n == CUE_POINT:
                        media.cues.append(_cue(data, i, j))
    return media


def _track(data: bytes, a: int, b: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0, "frame_ns": 0}
    for n, i, j in elements(data, a, b):
        if n == TRACK_NUMBER:
            out["number"] = _number(data, i, j)
        elif n == TRACK_TYPE:
            out["type"] = _number(data, i, j)
        elif n == DEFAULT_DURATION:
            out["frame_ns"] = _number(data, i, j)
        elif n == CODEC:
            out["codec"] = data[i:j].decode()
        elif n == AUDIO:
            for m, k, z in elements(data, i, j):
                if m == RATE:
                    out["rate"] = _float(data, k, z)
                elif m == CHANNELS:
                    out["channels"] = _number(data, k, z)
                elif m == DEPTH:
                    out["depth"] = _number(data, k, z)
    return out


def _cue(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    time = track = place = 0
    for n, i, j in elements(data, a, b):
        if n == CUE_TIME:
            time = _number(data, i, j)
        elif n == CUE_PLACES:
            for m, k, z in elements(data, i, j):
                if m == CUE_TRACK:
                    track = _number(data, k, z)
                elif m == CUE_CLUSTER:
                    place = _number(data, k, z)
    return time, track, place


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with blanks up to a positive multiple of FRAME, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [padded(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([write_samples(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a Matroska file.  Null text counts as empty; rows stay as they are."""
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


PACKET = "doc_id long, packet long, track int, timestamp_ms long, first_byte long, size long, keyframe boolean, block long, lacing int"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of files (doc_id, media); null media has no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "packet", "track", "timestamp_ms", "first_byte", "size", "keyframe", "block", "lacing"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()]
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                if data.as_py() is not None:
                    rows = [(doc, k, *p) for k, p in enumerate(parse(data.as_py()).packets)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, PACKET)


def features(media: DataFrame) -> DataFrame:
    """The payload that the packets hold, read from the stored bytes by their ranges, with its digests and the file's numbers.

    feature: codec, depth, packets, blocks, clusters, whether each cue leads to a cluster at its time, duration, and the mean,
    least and largest sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                data = data.as_py()
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                found = parse(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in found.packets])
                starts = dict(found.clusters)
                led = all(c[0] in starts and read_size(data, found.segment + c[2] + 4)[1] == starts[c[0]] for c in found.cues) and len(found.cues) == len(found.clusters)
                track = found.tracks[0] if found.tracks else {"codec": "", "depth": 0}
                blocks = found.packets[-1][5] + 1 if found.packets else 0
                sound = f"mean={sum(payload) / len(payload):.4f};min={min(payload)};max={max(payload)}" if payload else "mean=;min=;max="
                feature = f"{track['codec']};{track['depth']};packets={len(found.packets)};blocks={blocks};clusters={len(found.clusters)};cues={int(led)};ms={found.duration:.0f};{sound}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
