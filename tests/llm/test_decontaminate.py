import random
from collections import Counter

from sourceloom.llm import decontaminate as dc


def words(text):
    return (text or "").encode().lower().split()


def bag(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def plain(docs, items, threshold):
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, q in items:
            iw = words(q)
            if not iw or len(dw) < len(iw):
                continue
            k = min(5, len(iw))
            want = bag(iw, k)
            for s in range(len(dw) - len(iw) + 1):
                mine = bag(dw[s : s + len(iw)], k)
                both = (mine & want).total()
                sim = both / (mine.total() + want.total() - both)
                if sim >= threshold and (-sim, s) < out.get((d, i), (0, 0)):
                    out[d, i] = (-sim, s)
    return sorted((str(d), i, round(-s, 9), at, len(words(dict(items)[i]))) for (d, i), (s, at) in out.items())


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["É"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 5, 6, 15, 30, 38, 54, 54])]
    items += [(20, "The the the the the the the the"), (21, ""), (22, None), (23, "rare1 rare2 rare3")]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 3, 50, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            ws = items[rng.randrange(4, 9)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                ws[rng.randrange(len(ws))] = "changed"
            if rng.random() < 0.3:
                del ws[rng.randrange(len(ws))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in ws]
        docs.append((d, rng.choice([" ", "\n\n"]).join(text)))
    docs += [(900, None), (901, "the " * 30), (902, "rare1 rare2\trare3"), (None, items[5][1]), (903, items[5][1] + " " + items[5][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 0.8)
    for block_words in (1_000_000, 60):
        got = dc.find(df.repartition(3), bench, block_words=block_words).collect()
        assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9), r.start_word, r.words) for r in got) == want
    held = {w[0] for w in want}
    left = dc.clean(df, bench, block_words=60)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if str(d) not in held)
    assert dc.find(df.limit(0), bench).count() == 0
    assert dc.find(df, bench.limit(0)).count() == 0


def test_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(2)
    g = dc.Items(10, 5, list(range(50)), [rng.integers(0, 1 << 64, 6, dtype=np.uint64) for _ in range(50)])
    g.index(20, 8)
    prints = np.concatenate([g.prints ^ np.uint64((1 << k) - 1) for k in range(0, 40, 3)] + [rng.integers(0, 1 << 64, 300, dtype=np.uint64)])
    near = np.bitwise_count(prints[:, None] ^ g.prints[None, :]) <= 20
    w, i = g.candidates(prints, 20)
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_documents_shorter_than_the_item(spark, tmp_path):
    import corpus_pipeline
    from sourceloom.llm import queries

    _, items = corpus()
    items = items[4:9] + [(30, " ".join(f"q{i}" for i in range(50)))]
    docs, want = [(999, "plain words")], []
    for i, q in items:
        for cut in (1, 2, 6, 12):
            ws = q.split()[:-cut]
            docs.append((len(docs), " ".join(ws)))
            mine, whole = bag(ws, 5), bag(q.split(), 5)
            sim = (mine & whole).total() / (mine | whole).total() if mine else 0
            if sim >= 0.8:
                want.append((len(docs) - 1, i, round(sim, 9), 0, len(ws)))
    assert (22, 30, round(44 / 46, 9), 0, 48) in want
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op7_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.words) for r in got) == sorted(want)
    left = corpus_pipeline.decontaminated(spark, df, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == {d for d, _ in docs} - {w[0] for w in want}


def test_shingles_that_a_polynomial_hash_mixes_up(spark):
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    rest = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {a} {rest}"), (2, f"x {b} {rest}")]
    bench = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{a} {a} {a} {a} {a} {a}")], "item_id long, text string")
    got = dc.find(spark.createDataFrame([*docs, (3, " ".join([b] * 6))], "doc_id long, text string"), bench, threshold=0.95).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_the_last_check_is_on_words(monkeypatch):
    monkeypatch.setattr(dc.Words, "hashes", lambda self: (self.end - self.start).astype("u8"))  # all words of one length collide
    bench = dc.benchmark_index([(1, " ".join(f"w{i:03d}" for i in range(30)))])
    texts = [" ".join(f"{c}{i:03d}" for i in range(40)).encode() for c in "wx"]
    assert [[m[:1] for m in ms] for ms in dc.scan(texts, bench)] == [[(1,)], []]


def test_long_texts_in_parts():
    docs, items = corpus()
    bench = dc.benchmark_index(items)
    text = " ".join(t for _, t in docs if t).encode()
    want = dc.scan([text], bench)
    assert len(want[0]) > 5
    for size in (400, 3000):
        assert [sorted(m) for m in dc.scan([text], bench, size)] == [sorted(m) for m in want]
    assert dc.scan([b"a" * 5000], bench, 100) == [[]]


def test_nothing_is_lost_beyond_the_radius_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda radius: sorted(map(tuple, dc.find(docs, items, radius=radius, short=True).collect()))
    some, every = rows(dc.RADIUS), rows(64)
    print("found within the radius:", len(some), "of", len(every))
    assert len(some) >= 0.99 * len(every) > 0
