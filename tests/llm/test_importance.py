import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sourceloom.llm import importance as im
from sourceloom.llm.wordhash import Words


def grams(text):
    """(kind, n-gram, word it begins in); exact n-grams, no hashing."""
    ws = (text or "").encode().lower().split()
    out = [("word", (w,), i) for i, w in enumerate(ws)] + [("pair", (a, b), i) for i, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
    return out + [("run", (w[j : j + 5],), i) for i, w in enumerate(ws) for j in range(len(w) - 4)], len(ws)


def plain(docs, labels, fitted, seen):
    """Fit, log importances and keys from the definitions; fitted and seen are sets of ids."""
    raw, target = Counter(), Counter()
    for d, t in docs:
        for kind, g, _ in grams(t)[0]:
            raw[kind, g] += 1
            target[kind, g] += d in fitted
    total = lambda c, kind: sum(n for (k, _), n in c.items() if k == kind)
    share = {k: total(target, k) / max(1, total(raw, k)) for k in ("word", "pair", "run")}
    ratio = lambda kind, g: math.log((target[kind, g] + 2.0) / (raw[kind, g] * share[kind] + 2.0))
    out = []
    for d, t in docs:
        found, n = grams(t)
        per = [0.0] * n
        for kind, g, i in found:
            per[i] += ratio(kind, g)
        passages = [sum(per[i : i + 5]) for i in range(max(1, n - 4))] if n else []
        li = -math.log(0.75 + 0.25 * sum(math.exp(-s) for s in passages) / len(passages)) if passages else 0.0
        u = ((xxhash.xxh3_64_intdigest((t or "").encode(), xxhash.xxh3_64_intdigest(str(d).encode(), 3)) >> 11) + 0.5) / 2**53
        out.append((str(d), t, li, li - math.log(-math.log(u))))
    least = np.quantile([r[2] for r in out if r[0] in {str(s) for s in seen}], 0.005) if seen else -math.inf
    k = round(sum(min(1.0, math.exp(r[2] - least)) for r in out)) if seen else len(out)
    return out, k


def corpus(n=150):
    rng = random.Random(9)
    good = ["alpha", "beta", "gammas", "delta", "epsilon", "zeta", "eta"]
    docs, labels = [], []
    for d in range(n):
        text = rng.choices(good, k=rng.choice([3, 20, 80]))
        kind = d % 10
        if kind == 0:
            text = [w + "###" for w in text]
        if kind == 1:
            text[rng.randrange(len(text))] = "horridly"
        docs.append((d, rng.choice([" ", "\n"]).join(text)))
        if d < 0.8 * n:
            labels.append((d, int(kind != 0), int(kind == 1)))
    docs += [(1000, None), (1001, ""), (None, "alpha beta Gammas"), (None, "delta###"), (5, docs[10][1]), (5, docs[5][1])]
    return docs, labels + [(5, None, 0), (None, 1, 0), (77777, 0, 0), (7, 1, 0)]


def frames(spark, docs, labels):
    df = spark.createDataFrame([(d, t, 0, "x", 1.0) for d, t in docs], "doc_id long, text string, label int, key string, importance_k double").repartition(3)
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def marks(spark, lab):
    rows = im._labelled(lab, im.MAX_LABELLED).collect()
    return {r["_id"] for r in rows if r[im.MARK] == 1}, {r["_id"] for r in rows if r[im.MARK] == 3}


def test_fit_weights_and_draw_match_brute_force(spark):
    docs, labels = corpus()
    df, lab = frames(spark, docs, labels)
    fitted, seen = marks(spark, lab)
    clean = {d for d in {x[0] for x in labels} if all(q == 1 and t == 0 for e, q, t in labels if e == d and q is not None) and d is not None}
    assert fitted | seen == clean and not fitted & seen and len(seen) > 10
    want, k = plain(docs, labels, fitted, seen)
    got = im.importance(df, lab).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0], round(r[1], 5)))
    for g, w in zip(order((str(r.doc_id), r.log_importance, r.key) for r in got), order((d, li, key) for d, _, li, key in want), strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=1e-4)
    for size in (None, 7, 0, 10_000):
        n = k if size is None else min(size, len(docs))
        last = sorted((w[3] for w in want), reverse=True)[n - 1] if n else math.inf
        rows = sorted((w[0], w[1] or "") for w in want if w[3] >= last)
        kept = im.keep_selected(df, lab, size)
        assert kept.columns == df.columns
        assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == rows
        assert sorted(str(r.doc_id) for r in im.resample(df, lab, size).collect()) == [d for d, _ in rows]


def test_clean_stay_and_bad_go(spark):
    docs, labels = corpus(1500)
    df, lab = frames(spark, docs, labels)
    unseen = set(range(1200, 1500))  # no label, so not fitted
    kept = {r.doc_id for r in im.resample(df, lab).collect()}
    clean = {d for d in unseen if d % 10 > 1}
    print("clean kept", len(clean & kept) / len(clean), "bad kept", len((unseen - clean) & kept) / len(unseen - clean))
    assert len(clean & kept) >= 0.98 * len(clean) and len((unseen - clean) & kept) <= 0.02 * len(unseen - clean)


def test_noise_decides_between_like_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    lab = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    drawn = [r.doc_id for r in im.resample(df, lab, 1000).collect()]
    assert len(drawn) == 1000 and 400 < sum(d % 2 for d in drawn) < 600 and 400 < sum(d < 2000 for d in drawn) < 600


def test_long_texts_in_parts():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "cde", "fghijkl", "mnopqrstuv"], k=n)) for n in (3000, 4, 700)] + ["x" * 5000 + " y", ""]
    rows = [(t.encode(), i % 2) for i, t in enumerate(texts)]
    ratios = np.random.default_rng(1).standard_normal((im.KINDS, 1 << im.BITS)).astype(np.float32)
    whole = [*im.tally(iter(rows))], list(im.log_importances(iter(rows), ratios))
    old, im.overlapping.__defaults__ = im.overlapping.__defaults__, (300,)
    chunk, im.in_chunks.__defaults__ = im.in_chunks.__defaults__, (300,)
    try:
        parts = [*im.tally(iter(rows))], list(im.log_importances(iter(rows), ratios))
    finally:
        im.overlapping.__defaults__, im.in_chunks.__defaults__ = old, chunk
    assert all((a == b).all() for a, b in zip(whole[0], parts[0], strict=True))
    assert parts[1] == pytest.approx(whole[1])


def test_empty_tables(spark):
    docs, labels = corpus()
    df, lab = frames(spark, docs, labels)
    assert im.resample(df.limit(0), lab).count() == 0
    assert im.resample(df, lab.limit(0)).count() == len(docs)


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.5] * 50 + [0.5 + 1e-16, -1e6, 1e6, 0.25 + 1e-12, 0.25]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for k in (1, 2, 60, 170, 300, len(values)):
        assert im.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert im.kth_largest(df, "v", 0) is None


def thue_morse(n, a=b"a", b=b"b"):
    return b"".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_hashes_of_words():
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(20_000)}
    words |= {thue_morse(n, *ab) for n in (64, 100, 1024, 2048, 4096) for ab in ((b"a", b"b"), (b"b", b"a"))} | {b"a" * n for n in range(1, 300)}
    words = sorted(words)
    for texts in ([b" ".join(words)], words):
        h = Words(texts).hashes()
        assert len(h) == len(words) == len(set(h.tolist()))
    assert (Words(words).hashes() == Words([b" \n ".join(words).upper()]).hashes()).all()


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "_id", "importance_mark", "importance_key", "importance_log", "fit", "column_2", "near_row_id", "bad"]
    rows = [(i, f"some plain words number {i} and more of them here", *[100 * i + n for n in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = im.keep_selected(df, labels, k=40)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == rows
    from sourceloom.llm import simhash_dedup as sd

    one = sd.one_of_each(df.withColumn("text", df.doc_id.cast("string")))
    assert one.columns == names and sorted(r.near_row_id for r in one.collect()) == [r[8] for r in rows]
