import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sourceloom.llm import lm_scoring, suffix_tree as st, wordhash


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_tree(texts, depth, least):
    grams, low = Counter(), Counter()
    for t in texts:
        s = b"\n" + b" ".join(words(t)) + b"\n"
        s = b"\n\n" if not words(t) else s
        for i in range(1, len(s)):
            for k in range(0, min(depth, i) + 1):
                grams[s[i - k : i], s[i]] += 1
                low[s[i - k : i]] += 1
    candidates = {c: n for c, n in low.items() if n >= least}
    seen = sorted({a for c, a in grams if c == b""})
    total = low[b""]

    def prob(c, a):
        if c == b"":
            return (grams[b"", a] + 0.5) / (total + 128)
        return (grams[c, a] + st.STRENGTH * prob(c[1:], a)) / (candidates[c] + st.STRENGTH)

    retained = {b""}
    for c, n in candidates.items():
        if c:
            mine = [(a, grams[c, a]) for a in seen if grams[c, a]]
            gain = 2 * sum(m * math.log(m / n / prob(c[1:], a)) for a, m in mine)
            if gain > st.PENALTY * len(mine) * math.log(max(n, 2)):
                retained.update(c[i:] for i in range(len(c)))
    return retained, prob


def plain_score(text, tree, depth):
    retained, prob = tree
    s = b"\n" + b" ".join(words(text)) + b"\n" if words(text) else b"\n\n"
    out = 0.0
    for i in range(1, len(s)):
        context = s[max(0, i - depth) : i]
        context = context[context.rfind(b"\n") :] if b"\n" in context else context
        while context not in retained:
            context = context[1:]
        out += math.log10(prob(context, s[i]))
    return out


def corpus():
    rng = random.Random(5)
    parts = ["th", "er", "in", "on", "Wh", "é", "ing", "re"]
    vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 700])))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, " \n"), (None, "the end"), (7, rows[7][1]), (103, "zzz qqq \x01 zzz")]


@pytest.mark.parametrize(("depth", "share"), [(3, 0.0), (6, 0.002)])
def test_matches_brute_force(spark, depth, share):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, block string, score double")
    got = lm_scoring.score(df.repartition(3), depth, share).collect()
    train = [t for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    symbols = sum(len(b" ".join(words(t))) + 1 for t in train)
    tree = plain_tree(train, depth, max(1, int(share * symbols)))
    want = []
    for d, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        held = zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
        want.append((d, held, len(tokens), sum(count[w] > 0 for w in tokens), n, base, plain_score(t, tree, depth)))
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-5, abs=1e-4)
    assert any(len(c) > 2 for c in tree[0])


def test_empty_and_untrained(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm_scoring.score(df.limit(0)).count() == 0
    held = next(d for d in range(100) if lm_scoring.held_out(d))
    row = lm_scoring.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)
    assert row.score == pytest.approx(3 * math.log10(0.5 / 128))


def test_held_out_texts_beat_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [r for r in lm_scoring.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_contexts_stay_in_a_larger_corpus(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 5))) for _ in range(300)]
    rows = [(d, " ".join(rng.choices(vocabulary, k=3000))) for d in range(60)] + [(1000, "xyzzy quux"), (1001, "quux xyzzy")]
    train = [t for d, t in rows if not lm_scoring.held_out(d)]
    assert int(4e-6 * sum(len(t) + 1 for t in train)) > 1  # a share of the corpus would pass over contexts seen once
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    tree = plain_tree(train, st.DEPTH, 1)
    for d, t in rows[-8:]:
        assert got[d] == pytest.approx(plain_score(t, tree, st.DEPTH), rel=2e-5, abs=1e-4)


def test_tree_grows_with_the_corpus(spark):
    sizes = []
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        blocks = docs.select("doc_id", "text").mapInArrow(lm_scoring._blocks(st.DEPTH), lm_scoring.ROW_TYPE)
        answers = lm_scoring.learn(blocks, st.DEPTH, st.LEAST_SHARE)
        sizes.append(answers.where(f"block is null and kind = {lm_scoring.GRAMS}").agg({"total": "sum"}).first()[0])
    print("retained contexts of two bytes or more:", sizes)
    assert sizes[1] > sizes[0]


def test_words_that_a_polynomial_hash_mixes_up(spark):
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    train = [d for d in range(20) if not lm_scoring.held_out(d)]
    rows = [(train[0], a), (train[1], a), (train[2], "other"), (train[3], b)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, v = 8, 4  # four words and four ends; two like a, one b, other, the end
    assert got[train[0]].base_score == pytest.approx(math.log10(3 / (n + v + 1)) + math.log10(5 / (n + v + 1)))
    assert got[train[3]].base_score == pytest.approx(math.log10(2 / (n + v + 1)) + math.log10(5 / (n + v + 1)))
    assert got[train[3]].train_tokens == n


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(d, rng.choice(["", " "]) + rng.choice([" ", "\n"]).join("".join(rng.choices("abC\x00é", k=rng.randint(1, 9))) for _ in range(n)) + rng.choice(["", "  "])) for d, n in enumerate((1, 300, 0, 90, 2000, 7, 40))]
    rows += [(50, "x" * 500 + " " + "y" * 300 + "  z"), (51, " " * 400), (52, "q" + " " * 300)]
    batches = [lm_scoring.pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})]
    whole = list(lm_scoring._normal(iter(batches), 6))
    monkeypatch.setattr(lm_scoring, "CHUNK", 64)
    monkeypatch.setattr(lm_scoring, "pieces", lambda t: wordhash.pieces(t, 64))
    parts = list(lm_scoring._normal(iter(batches), 6))
    assert len(whole) == 1 and len(parts) > 50 and any(p.open for p in parts)
    codes, found = {}, {}
    for p in parts:
        code, owner = p.codes(6)
        for k, d in enumerate(p.docs):
            codes.setdefault(d, []).extend(code[owner == k].tolist())
            found.setdefault(d, []).extend(tokens_of(p, k))
    code, owner = whole[0].codes(6)
    for k, d in enumerate(whole[0].docs):
        assert codes[d] == code[owner == k].tolist() and found[d] == tokens_of(whole[0], k)


def tokens_of(texts, k):
    w, one, kind, owner = texts.tokens()
    return [w.buf[w.start[i] : w.end[i]].tobytes() for i in one[kind][owner == k].tolist()]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lm_scoring.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    rows = [(d, " ".join(random.Random(d).choices(["ab", "ba", "abcdefghijkl", "abcdefghijkm", "x" * 200 + "y", "x" * 200 + "z"], k=40))) for d in range(30)]
    monkeypatch.setattr(wordhash.Words, "hashes", lambda self: (self.end - self.start).astype("u8"))  # all words of one length collide
    w = wordhash.Words([t.encode() for _, t in rows])
    hashes, one, kind = w.kinds()
    assert len(one) == len(set(hashes.tolist())) == 6
    assert [w.buf[w.start[i] : w.end[i]].tobytes().decode() for i in one[kind].tolist()] == " ".join(t for _, t in rows).split()
    blocks = [r for b in lm_scoring._blocks(3)(iter([lm_scoring.pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})])) for r in b.to_pylist()]
    asked = [(lm_scoring.zstandard.ZstdDecompressor().decompress(r["data"]), lm_scoring.unpack(r["counts"], "<u4").tolist()) for r in blocks if r["kind"] == lm_scoring.WORDS and r["part"] < lm_scoring.WORD_PARTS]
    got = {w.decode(): n for data, ns in asked for w, n in zip(data.split(b"\n"), ns, strict=True)}
    assert got == Counter(w for d, t in rows if not lm_scoring.held_out(d) for w in t.split())


def test_depth_that_does_not_fit():
    for depth in (0, 8):
        with pytest.raises(ValueError):
            st.gram_codes(np.array([10, 97, 98], dtype=np.uint8), depth)
