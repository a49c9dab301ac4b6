import hashlib
import random
import zlib

import pytest

from sourceloom.llm import matroska as mk


@pytest.mark.parametrize("n", [192, 384, 192 * 7, 192 * 8, 192 * 9, 192 * 512, 192 * 513, 192 * 1700])
def test_payload_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = mk.write_samples(payload)
    media = mk.parse(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in media.packets) == payload
    assert [p[1] for p in media.packets] == [24 * i for i in range(n // 192)]
    assert media.tracks[0]["codec"] == "A_PCM/INT/LIT" and media.tracks[0]["depth"] == 8
    assert len(media.cues) == len(media.clusters) == -(-n // (192 * 512))
    for time, _, place in media.cues:
        assert mk.read_id(data, media.segment + place)[0] == mk.CLUSTER and (time, ) == (dict((s, s) for s, _ in media.clusters)[time],)


@pytest.mark.parametrize("kind", [mk.XIPH, mk.EBML_LACING])
def test_lacing_of_uneven_frames(kind):
    frames = [bytes([i]) * n for i, n in enumerate([0, 255, 254, 510, 1, 9000, 63, 64, 127, 3])]
    body = b"\x00\x00" + mk.lace(frames, kind)
    sizes, at = mk.frame_sizes(body, 2, len(body), kind)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_block_groups_and_unknown_sizes():
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b"\x82" + b"\x00\x05\x00" + b"abc"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.whole(mk.CLUSTER_TIME, 100) + group
    data = mk.element(mk.EBML, b"") + mk.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster
    got = mk.parse(data).packets
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4]) for p in got] == [(2, 105, b"abc", True)] * 2
    for n in (0, 126, 127, 128, 16382, 16383, 1 << 30):
        assert mk.read_size(mk.write_size(n), 0) == (n, len(mk.write_size(n)))
    for bad in (b"", b"abc", mk.write_samples(b"x" * 192)[:-5]):
        with pytest.raises(ValueError):
            mk.parse(bad)


def some_file(*parts, size=b"\xff"):
    return mk.element(mk.EBML, b"") + mk.SEGMENT.to_bytes(4, "big") + size + b"".join(parts)


def endless(*parts):
    return mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b"".join(parts)


def test_other_files_times():
    track = lambda n, *more: mk.element(mk.TRACK_ENTRY, mk.whole(mk.TRACK_NUMBER, n) + b"".join(more))
    tracks = mk.element(mk.TRACKS, track(1, mk.whole(mk.DEFAULT_DURATION, 21_333_333)) + track(2) + track(3))
    info = mk.element(mk.INFO, mk.whole(mk.TIMESTAMP_SCALE, 500_000))
    body = lambda n, at: bytes([0x80 | n]) + at.to_bytes(2, "big", signed=True) + bytes([0x80 | mk.FIXED << 1]) + mk.lace([b"ab"] * 3, mk.FIXED)
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, body(2, -4)) + mk.whole(mk.BLOCK_DURATION, 60) + mk.element(mk.REFERENCE, b"\x01"))
    cluster = mk.element(mk.CLUSTER, mk.whole(mk.CLUSTER_TIME, 2000) + mk.element(mk.SIMPLE_BLOCK, body(1, 10)) + group + mk.element(mk.SIMPLE_BLOCK, body(3, 0)))
    got = mk.parse(some_file(info, tracks, cluster)).packets
    assert [(p[0], p[1], p[4]) for p in got] == [(1, 1005, True), (1, 1026, True), (1, 1047, True), (2, 998, False), (2, 1008, False), (2, 1018, False)] + [(3, 1000, True)] * 3


def test_unknown_sizes_end_at_their_level():
    block = mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + b"abc")
    for other in (mk.SEEK_HEAD, mk.TAGS, mk.CHAPTERS, mk.ATTACHMENTS, mk.INFO, mk.CUES):
        inside = mk.element(mk.CUE_POINT, mk.whole(mk.CUE_TIME, 3)) if other == mk.CUES else mk.element(0xEC, b"\x00" * 9)
        found = mk.parse(some_file(endless(mk.whole(mk.CLUSTER_TIME, 1), block), mk.element(other, inside), endless(mk.whole(mk.CLUSTER_TIME, 7), block)))
        assert [p[1] for p in found.packets] == [1, 7] and len(found.clusters) == 2 and len(found.cues) == (other == mk.CUES)
    two = some_file(endless(mk.whole(mk.CLUSTER_TIME, 1), block))
    assert [p[1] for p in mk.parse(two + two).packets] == [1, 1]


def test_damaged_files_are_errors():
    rng = random.Random(2)
    data = mk.write_samples(rng.randbytes(192 * 20))
    for _ in range(600):
        bad = bytearray(data[: rng.choice([len(data), rng.randrange(1, len(data))])])
        for _ in range(rng.randint(0, 3)):
            bad[rng.randrange(min(400, len(bad)))] = rng.randrange(256)
        try:
            mk.parse(bytes(bad))
        except ValueError:
            pass
    for kind in (mk.XIPH, mk.FIXED, mk.EBML_LACING):
        for body in (b"", b"\x05", b"\x02\xff\xff", b"\x02\x7f\x7f", b"\x01\x90abc"):
            block = mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([kind << 1]) + body)
            try:
                assert sum(p[3] for p in mk.parse(some_file(endless(block))).packets) <= len(body)
            except ValueError:
                pass


def test_media_without_tracks_or_packets(spark):
    df = spark.createDataFrame([(1, 4, None), (2, 0, some_file()), (None, None, some_file(mk.element(mk.TRACKS, b"")))], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in mk.features(df).collect()}
    assert rows[1].feature is None and rows[1].n_bytes == 4 and rows[2].payload_bytes == 0 and rows[None].feature.startswith(";0;packets=0;blocks=0")
    assert mk.packets(df).count() == 0


def test_query_form(spark):
    texts = [None, "", "é" * 96, "plain words " * 3000, "é" * 96, "x"]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "x", "", 1)], "doc_id long, text string, media string, n_bytes int")
    rows = mk.features(mk.encode(df)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        raw = (("x" if r.doc_id is None else texts[r.doc_id]) or "").encode()
        padded = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(mk.write_samples(padded)), hashlib.sha256(mk.write_samples(padded)).hexdigest())
        assert "cues=1" in r.feature
    assert mk.packets(mk.encode(df)).count() == sum(r.payload_bytes for r in rows) // 192
    assert mk.features(mk.encode(df.limit(0))).count() == 0
