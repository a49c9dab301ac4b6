import random
import re
from math import ceil, floor, log2

import pytest

from sourceloom.llm import decision_lists as dl, queries

DOCS = "doc_id long, text string, rule string, bad int, n_words string, id long"
LABELS = "doc_id long, quality int, toxic int"


def plain(text, marked=()):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    count = lambda cls: len(re.findall(f"[{cls}]", t))
    hits = sum(x in marked for x in re.findall(r"[^\W\d_]+", t.lower()))
    return (len(w), sum(map(len, w)), count("#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), count("A-Z"), count(".!?"), count("0-9"), len(set(w)), hits)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c", "a b c a b c", "x x x x x x", "\na b\n\na b\n \nc\n", "ab c ab c d ab c ab", "é ü  #*$%&|<> $$x 12 Ü.", "a\r\na\r\nb", "ABC abc. Q! 7?", "😀 😀 😀 😀 a 😀 😀 😀",
    "idiot, IDIOT! idiotic 9idiot clown-idiot", " lead and trail ", " ".join(random.Random(4).choices("abcd", k=400)), " ".join(random.Random(5).choices([f"w{i}" for i in range(30)], k=300)),
]


def test_statistics_against_plain(spark):
    df = spark.createDataFrame([(i, t, "x", 7, "n", 1) for i, t in enumerate(TEXTS)], DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in dl.measured(df, ["clown", "idiot"]).collect()}
    assert got == {i: plain(t, ("clown", "idiot")) for i, t in enumerate(TEXTS)}
    many = " ".join(f"w{i % 9000}" for i in range(400_000)) + "\n"  # a long text
    one = dl.measured(spark.createDataFrame([(1, many, "", 1, "", 1)], DOCS)).first()
    assert (one.n_words, one.n_repeat_words, one.n_distinct) == (400_000, 400_000, 9000)


def corpus():
    rng = random.Random(11)
    good = [f"{a}{b}" for a in "bcdfghjklmnprstvwz" for b in ("ara", "eno", "ilu", "osi", "umba", "ekka", "orti", "assi")]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(good) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(60, 160))]
        kind = i % 9
        if kind == 0:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        if kind == 1:
            w[rng.randrange(len(w))] = w[rng.randrange(len(w))] = rng.choice(["grobnik", "Grobnik!"])
        docs.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    return docs, labels


def plain_list(rows):
    """Sequential covering in Python: rows of (statistics, bad, growing)."""
    def values(s):
        n = dict(zip(dl.STATISTICS, s))
        share = lambda a, b, k=1000: k * n[a] // n[b] if n[b] else 0
        return [n["n_words"], share("word_chars", "n_words", 100), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_distinct", "n_words"), share("n_words", "n_lines", 10), share("n_upper", "word_chars"), share("n_stops", "n_words"), share("n_digits", "word_chars"), n["n_marked"]]

    def quantile(v, q):
        at = (len(v) - 1) * q
        return v[floor(at)] + (v[ceil(at)] - v[floor(at)]) * (at - floor(at))

    rows, names = [(values(s), b, g) for s, b, g in rows], list(dl.MEASURES)
    holds = lambda v, c: (v[names.index(c.measure)] >= c.threshold) == c.at_least
    covers = lambda v, rule: all(holds(v, c) for c in rule)
    th = [sorted({n for b in {b for _, b, g in rows if g} for i in range(1, dl.THRESHOLDS) for q in [quantile(sorted(v[m] for v, c, g in rows if g and c == b), i / dl.THRESHOLDS)] for n in (ceil(q), floor(q) + 1)}) for m in range(len(names))]
    rules = []
    while len(rules) < dl.MAX_RULES:
        left = [r for r in rows if not any(covers(r[0], x) for x in rules)]
        rule = ()
        while len(rule) < dl.MAX_CONDITIONS:
            have = [(v, b) for v, b, g in left if g and covers(v, rule)]
            p0, best, found = sum(b for _, b in have), 0.0, None
            for m in range(len(names)):
                for t in th[m]:
                    for up in (True, False):
                        some = [b for v, b in have if (v[m] >= t) == up]
                        p = sum(some)
                        if p and len(some) < len(have):
                            gain = p * (log2(p / len(some)) - log2(p0 / len(have)))
                            if gain > best + 1e-9:
                                best, found = gain, (dl.Condition(names[m], up, t), len(some) - p)
            if not found:
                break
            rule += (found[0],)
            if not found[1]:
                break
        if not rule:
            break
        count = lambda x, side: (sum(b for v, b, g in left if g == side and covers(v, x)), sum(1 - b for v, b, g in left if g == side and covers(v, x)))
        worth = lambda x: (count(x, False)[0] - count(x, False)[1]) / sum(count(x, False)) if sum(count(x, False)) else -1
        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda x: (worth(x), -len(x)))
        if count(rule, False)[0] < dl.MIN_COVER or any(p < dl.PRECISION * (p + n) for p, n in (count(rule, False), count(rule, True))):
            break
        rules.append(rule)
    return rules


def test_list_against_plain_and_verdicts(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in docs], DOCS).repartition(3)
    lab = spark.createDataFrame(labels, LABELS)
    assert dl.marked_words(df, lab) == ["grobnik"]
    bad = {i: int(q == 0 or t == 1) for i, q, t in labels}
    growing = {r.doc_id: r.growing for r in lab.selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 3) > 0 AS growing").collect()}
    rules = plain_list([(plain(t, ("grobnik",)), bad[i], growing[i]) for i, t in docs if i in bad and 2 * plain(t)[4] <= plain(t)[0]])
    out = dl.judge(df, lab).collect()
    assert rules and {r.rule for r in out} == {None, *map(dl.named, rules)}
    for r in out:
        assert r.kept == (r.doc_id % 9 > 1) and r.kept == (r.rule is None)  # also the quarter that has no label
    assert len(out) == len(docs)


def test_copies_mark_no_words(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    text = " ".join(rng.choices(words, k=80))
    odd = " ".join(rng.choices([f"q{chr(97 + i)}" for i in range(20)], k=2000))
    docs = [(i, " ".join(rng.choices(words, k=80)) if i % 2 else text + " onceonly", "", 0, "", 0) for i in range(200)] + [(1000, odd, "", 0, "", 0)]
    labels = [(i, i % 2, 0) for i in range(200)] + [(1000, 0, 0)]
    assert dl.marked_words(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)) == []


def test_labels_that_teach_nothing(spark):
    df = spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in enumerate(TEXTS)] + [(None, "a " * 60, "", 0, "", 0), (3, "b", "", 0, "", 0)], DOCS)
    for labels in ([], [(1, 1, None), (None, 0, 0)], [(16, 1, 0), (16, 0, 0)], [(15, 1, 0), (3, 1, 0)]):
        rows = dl.judge(df, spark.createDataFrame(labels, LABELS)).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            assert r.kept is not r.base_failed and r.rule is None and r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert dl.judge(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    rows = queries.op11_decision_lists(spark, f"/root/testdata/{sf}").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
