import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sourceloom.llm import curve_packing, plane_files, queries, token_store, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "The and thing, ofthnt. don't", "a\x0bb\x0cc d\x85e\xa0f　g <|endoftext|>x É́ ΑΣ.", "z" * 300 + " end", "wort " * 9000, "The and thing, ofthnt. don't"]


def plain(text, end):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def test_words_give_the_tokenizers_ids():
    encoder = tokens.Encoder.of(PATH)
    assert encoder.by_word
    for t in TEXTS:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain(t, 0)[:-1]
    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    assert np.frombuffer(other.encode("a b  c"), "<u4").tolist() == other.tokenizer.encode("a b  c", add_special_tokens=False).ids


def test_cache_may_be_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    encoder = tokens.Encoder(PATH)
    for t in TEXTS * 2:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain(t, 0)[:-1]


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("sizes", [[], [0], [3, 0, 70, 16, 1, 200], [16, 16]])
def test_plane_files_round_trip(mode, sizes):
    rng = np.random.default_rng(1)
    docs = [(None if i == 1 else 10 * i, rng.integers(0, 1 << 32, n, dtype=np.uint32)) for i, n in enumerate(sizes)]
    out = io.BytesIO()
    writer = plane_files.Writer(out, block_ids=16, mode=mode)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    got = list(plane_files.Reader(io.BytesIO(out.getvalue())).documents())
    assert [(d, ids.tolist()) for d, _, ids in got] == [(d, ids.tolist()) for d, ids in docs]
    assert [s for _, s, _ in got] == [sum(sizes[:i]) for i in range(len(sizes))]


def frame(spark):
    rows = [(50 - 5 * i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(None, "no id here", "c", 1), (50, None, "c", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


def test_store_round_trip(spark):
    rows, df = frame(spark)
    got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_store.round_trip(spark, df, PATH).collect()), key=lambda r: r[0])
    want, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        ids = plain(t, 1)
        want.append((start, d, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert token_store.round_trip(spark, df.limit(0), PATH).count() == 0


def test_packing_holds_every_id_once(spark):
    rows, df = frame(spark)
    for capacity in (4096, 7):
        pieces = curve_packing.pack(df, PATH, capacity).collect()
        by_place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
        at = 0
        for p in by_place:
            assert (p.sequence_id * capacity + p.offset, len(p.ids)) == (at, 4 * p.length)
            at += p.length
        whole = {}
        for p in sorted(pieces, key=lambda p: p.start):
            whole.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        got = sorted(np.frombuffer(b"".join(bytes(p.ids) for p in by_place), "<u4").tolist())
        assert got == sorted(i for _, t, *_ in rows for i in plain(t, 2))
        for d, t, *_ in rows[2:3] + rows[4:7]:
            ids = plain(t, 2)
            mine = [p for p in whole[d, len(ids)]]
            assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes()
    assert curve_packing.pack(df.limit(0), PATH).count() == 0


def test_documents_lie_along_the_curve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    matrix = np.random.default_rng(7).standard_normal((256, 4)) / 16.0
    points = {}
    for r in docs.collect():
        count = np.zeros(256)
        for i in plain(r.text, 2):
            count[(i * 2654435761 % (1 << 32)) >> 24] += 1
        place = np.tanh(4 * ((count / np.sqrt((count**2).sum())) @ matrix))
        points[r.doc_id] = np.clip(((place + 1) / 2 * 4096).astype(np.int64), 0, 4095)
    key = dict(zip(points, curve_packing.hilbert_key(np.stack(list(points.values()))).tolist(), strict=True))
    first = [p for p in curve_packing.pack(docs, PATH).collect() if p.start == 0]
    order = [p.doc_id for p in sorted(first, key=lambda p: (p.sequence_id, p.offset))]
    keys = [key[d] for d in order]
    off = sum(a > b for a, b in zip(keys, keys[1:], strict=False))
    assert off <= 2 and len(set(keys)) > 100, off  # a sum's last bit may move a point by one step
    near = np.mean([np.abs(points[a] - points[b]).sum() for a, b in zip(order, order[1:], strict=False)])
    assert near < 0.5 * np.mean([np.abs(points[a] - points[b]).sum() for a, b in zip(sorted(order), sorted(order)[1:], strict=False)])


def test_hilbert_key_walks_in_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curve_packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_query_digests(spark):
    got = queries.op5_plane_files(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(got.itertuples(), docs, strict=True):
        ids = np.array(plain(doc.text, 1), "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
