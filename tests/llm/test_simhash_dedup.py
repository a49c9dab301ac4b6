import random

import numpy as np
import xxhash

from sourceloom.llm import simhash_dedup as sd


def plain_fingerprint(text):
    words, word = [], b""
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        if c == 0x20 or 9 <= c <= 13:
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([c])
    words += [word] if word else []
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius):
    label = {i: i for i in range(len(rows))}
    prints = [plain_fingerprint(t) for _, t in rows]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or least.get(root(i)) is not None else None
    return sorted(((d, prints[i], least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = ["W%d" % i for i in range(400)]
    rows, key = [], 0
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([90, 400, 900]))
        for _ in range(rng.choice([1, 5, 12])):
            near = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((key := key + 7, rng.choice([" ", "\n", "\t  "]).join(near)))
    rows += [(5, None), (3, ""), (9001, " \n "), (9002, "one"), (9003, "One two"), (9003, "One two"), (None, rows[0][1]), (None, "alone here"), (9004, "Été   x")]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, fp string, component_id long")
    for radius, tile in ((2, 8192), (2, 2), (0, 8192), (4, 3)):
        got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in sd.near_duplicates(df, radius=radius, tile_rows=tile).collect()]
        assert sorted(got, key=str) == plain_components(rows, radius)


def test_some_pairs_link_beyond_equality(spark):
    found = plain_components(corpus(), 2)
    assert len({c for _, _, c in found}) < len({f for _, f, _ in found})


def test_dense_groups_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(1500):
        near = words + ["end"] * (d % 3)
        near[rng.randrange(len(near))] = f"x{d}"
        rows.append((d, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, 6)
    assert len({f for _, f, _ in want}) > 1000 and len({c for _, _, c in want}) < 700
    for tile in (8192, 100):
        got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in sd.near_duplicates(df, radius=6, tile_rows=tile).collect()]
        assert sorted(got, key=str) == want


def test_a_dense_part_sends_few_links():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(0, 1 << 12, 4000) << 3)  # many pairs within the radius
    part = sd.Part(sd.Within(8))
    part.settle(ids, np.zeros(len(ids)), ids.view(np.uint64)[:, None])
    guests = np.unique(rng.integers(0, 1 << 12, 4000) << 3 | 1)
    part.visit(guests, np.zeros(len(guests)), guests.view(np.uint64)[:, None])
    assert sum(len(a) for a, _ in part.links) < len(ids) + 2 * len(guests)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.near_duplicates(empty).count() == 0 and sd.one_of_each(empty).count() == 0


def plain_heads(rows, threshold):
    """Kept rows by exact Jaccard similarity of sets of five-word shingles, and the similarities met that are near the threshold."""
    bags = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        bags.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)})
    label, close = list(range(len(rows))), []

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            s = len(bags[i] & bags[j]) / len(bags[i] | bags[j])
            close += [s] if abs(s - threshold) < 0.09 else []
            if s >= threshold:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    pick = lambda g: min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    return [rows[pick(g)] for g in groups.values()], close


def edited():
    rng = random.Random(5)
    vocabulary = ["W%d" % i for i in range(3000)]
    rows, key = [], 0
    for n in (500, 800, 1500, 2000):
        words = rng.choices(vocabulary, k=n)
        for edits in (0, 0.0, 1, 2, 0.15, 0.3, 1):
            near = list(words)
            for i in rng.sample(range(n), int(edits * n) if isinstance(edits, float) else edits):
                near[i] = rng.choice(vocabulary)
            rows.append((key := key + 3, rng.choice([" ", "\n", "\t "]).join(near)))
    return rows + [(1, None), (2, ""), (0, " \n"), (500, "one two"), (501, "ONE two"), (502, "two one")]


def test_one_of_each_matches_exact_similarity(spark):
    rows = edited()
    want, close = plain_heads(rows, 0.8)
    assert not close and 5 < len(want) < len(rows) - 10
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, words string, near_row int").repartition(3)
    for tile in (8192, 3):
        kept = sd.one_of_each(df, tile_rows=tile)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in want)


def test_a_dense_similar_group_leaves_one_row(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(words[:i] + [f"x{d}"] + words[i + 1 :])) for d in range(800) for i in [rng.randrange(200)]]
    assert [r.doc_id for r in sd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), tile_rows=150).collect()] == [0]


def test_unlinked_texts_under_one_id_stay(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(4)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (9, texts[0])]
    kept = sd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted({(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3])}, key=str)


def test_long_texts_in_parts():
    text = " ".join(random.Random(1).choices(["ab", "cde", "f"], k=500)).encode()
    for k in (3, 5):
        whole = np.concatenate(list(sd.shingle_hashes(text, k)))
        assert (np.concatenate(list(sd.shingle_hashes(text, k, 40))) == whole).all() and len(whole) == 501 - k
    assert len(list(sd.shingle_hashes(b"a" * 100 + b" b", 3, 10))) == 1
