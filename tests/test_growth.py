"""That the work of a query grows no faster than its input: how often texts are read, and by what patterns."""

import re

from pyspark.sql import functions as F

from sourceloom.operators import difficulty as df
from sourceloom.functions import fuzzy as fz, text as tx
from sourceloom.operators import relevance as rel
from sourceloom.operators import index as ix, records as rc
from sourceloom.plans import domains, matching, records, retrieval, understanding

SF = "/root/testdata/sf0.001"
ODD = ["", "we prove", "awe prove we  show", "Fig. 3 xFig. 3 Fig.3 _Table 2 (Table 22)", "doi: 10.1/x adoi:10.2/y DOI:10.3/z", "x_1 ax_1 x^{ab} 3x_1 a b_c_d _x_1", "¬∈ é ü α ωϊ∏", "moreover,moreovers furthermore", "let's lets outlet's Ada Lovelace aAda Lovelace"]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_look_for_their_words_first(spark):
    patterns = [*df.ACADEMIC_PROSE, *df.BEGINNER_PROSE, *df.NOTATION, *df.REFERENCES, df.NAMES]
    assert not [p for p in patterns if p != df.NAMES and df.java(p).startswith(("(?:(?<", "(?<", "(?i)(?:(?<"))]
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = rows.select("t", *[df.found(F.col("t"), p).alias(f"n{i}") for i, p in enumerate(patterns)]).collect()
    assert {r.t: list(r[1:]) for r in got} == {t: [len(re.findall(p, t, re.ASCII)) for p in patterns] for t in ODD}


def test_guard_searches_texts_once(spark):
    for query in (records.distribution_guard, records.distribution_guard_strict):
        assert "regexp" not in plan(query(spark, SF)).lower()


def test_gates_and_ladder_measure_texts_once(spark):
    for query in (matching.gates_in_a_row, matching.gate_quality_floor, matching.beginner_rescue, matching.validation_ladder, matching.validation_drops):
        read = plan(query(spark, SF))
        assert "doc_id" not in read and "regexp_extract_all" not in read.replace("regexp_extract_all(lower(coalesce(title", ""), query.__name__


def test_each_distinct_word_is_matched_once(spark, monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(fz, "kept_match", lambda q, w: asked.append((q, w)) or fz.tokens_match(q, w))
    words = pa.array([["learning", "x", "x"], [], ["lernings", "machines", "learning"]])
    assert fz.matched_of(["learning", "machine"]).func(words).to_pylist() == [1, 0, 2]
    assert len(asked) == len(set(asked)) == 8


def test_bounds_keep_what_matches():
    pairs = [("abcdefgh", "abcdefgx"), ("learning", "lerning"), ("tensor", "sensor"), ("algebra", "zzz"), ("", "a")]
    assert [fz.alike(a, b, 0.8) for a, b in pairs] == [fz.ratio(a, b) >= 0.8 for a, b in pairs]


def test_titles_far_apart_are_not_sent_to_python(spark):
    read = plan(understanding.fuzzy_titles_ratio(spark, SF))
    assert read.index("ratio") < read.index("levenshtein(")


def test_words_are_found_before_their_edges(spark):
    assert not tx.HARD_WORD.startswith("(?<") and "a-z" not in tx.listed("a-z0-9_")
    text = "idea ideal education a1e2i3o _a_e_i banana bcd aeiou"
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(tx.HARD_WORD), 0).alias("h"), rel.asked(F.lit("the theand and breathe le der the"), ["the", "and", "der"]).alias("a")).first()
    assert got.h == [w for w in text.split() if len(re.findall("[aeiouy]+", w)) >= 3] and got.a == ["the", "and", "der", "the"]
    assert "(?<![^ ])(?:" not in plan(spark.range(1).select(rel.asked(F.col("id").cast("string"), ["the"])))


def test_like_titles_meet_in_small_units(spark, monkeypatch):
    """Titles are sent a few times each, whatever grams they share, and every pair within the ratio is found."""
    import random

    import duckdb

    assert "gram" not in plan(rc.fuzzy_titles(spark.createDataFrame([(1, "aa aaaa")], "id long, title string")))
    r, titles = random.Random(1), ["ab" + "é" * 20, "ab" + "é" * 19, "ab" + "x" * 498, "ab" + "x" * 480, "ab", "abc", "abcdefg", "abcdef"]
    for _ in range(60):
        t = "".join(r.choice("abc +1") for _ in range(r.randrange(5, 40)))
        titles += [r.choice(["ab", "cd"]) + "".join(c for c in t if r.random() > 0.08) + r.choice(["", "x"]) for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate([*titles, *titles[:5]])), "id long, title string")
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT title, min(id) AS id FROM (SELECT unnest(?) AS title, unnest(range(?)) AS id) GROUP BY 1 HAVING length(title) BETWEEN 3 AND 500", [[*titles, *titles[:5]], len(titles) + 5])
    sql = "SELECT least(a.id, b.id), greatest(a.id, b.id) FROM t a JOIN t b ON left(a.title, 2) = left(b.title, 2) AND (length(a.title) > length(b.title) OR length(a.title) = length(b.title) AND a.id < b.id)"
    far = db.execute(f"{sql} WHERE len(list_filter(range(length(a.title)), lambda i: ord(a.title[i + 1]) > 127)) = 0 AND len(list_filter(range(length(b.title)), lambda i: ord(b.title[i + 1]) > 127)) = 0 AND levenshtein(a.title, b.title) <= floor(0.15 * length(a.title) + 1e-9)").fetchall()
    want = {*far, (0, 1)}  # DuckDB's distance is one of bytes
    for tile in (rc.TILE, 7):
        monkeypatch.setattr(rc, "TILE", tile)
        got = [(x.id_a, x.id_b) for x in rc.fuzzy_titles(rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    monkeypatch.undo()
    many = spark.range(20_000).select("id", F.concat(F.lit("ab"), F.repeat(F.lit("the "), 5), F.col("id").cast("string")).alias("title"), F.lit("ab").alias("block"), F.lit(30).alias("n"))
    assert rc._tiled(many, 0.85).count() == 3 * 20_000


def test_long_titles_are_compared(spark, tmp_path):
    """Titles of any length, also about as long as those that are compared as bits."""
    import random

    r, texts, want = random.Random(3), [], {}
    for n in (40, 490, 511, 512, 513, 700, 3000, 40_000):
        t, i = "ab" + "".join(r.choice("abcdefgh") for _ in range(n - 2)), len(texts)
        texts += [t, t[:-5], t[: int(n * 0.7)]]
        want[i, i + 1] = round(1 - 5 / n, 6)
    rows = spark.createDataFrame([(40 * i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")  # these ids get no head before the title
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.id_a // 40, x.id_b // 40): x.ratio for x in records.dedupe_fuzzy_lev(spark, str(tmp_path)).collect()}
    assert got == want


def test_common_letters_in_bits():
    """The longest common subsequence by words of bits, and without common ends by one number, against the plain table."""
    import random

    import numpy as np
    import pyarrow as pa

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    r, titles = random.Random(2), []
    for n in (1, 20, 63, 64, 65, 128, 129, 200):
        t = "".join(r.choice("abc d+1") for _ in range(n))
        titles += [t, "".join(c for c in t if r.random() > 0.1) or "a", "".join(r.sample(t, n))]
    titles.sort(key=len)
    n, codes = np.array([len(t) for t in titles]), rc._letters(pa.chunked_array([titles]))[1]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(n)) for j in range(len(n)) if n[j] <= n[i]]))
    true = np.array([common(titles[i], titles[j]) for i, j in zip(a, b)])
    for least in (true, true + 1, (0.85 * n[a]).astype(int)):
        assert sorted(rc._common(codes, a, codes, b, n[b], least)) == list(np.flatnonzero(true >= least))
    for i, j, t in list(zip(a, b, true))[::7]:
        x, y = rc._without_ends(titles[i], titles[j])
        ends = len(titles[i]) - len(x)
        assert [rc._common_of_long(x, y, least, 16) for least in (0, t - ends, t - ends + 1)] == [t - ends, t - ends, -1]


def test_titles_meet_by_blocks_in_small_units(spark, monkeypatch):
    """No pairs are joined or sent; those without a long enough common subsequence go where they meet, and every pair within the ratio is found, whatever its letters and length."""
    import difflib
    import random

    read = plan(understanding.fuzzy_titles_ratio(spark, SF))
    assert "FlatMapGroupsInArrow" in read and "explode(sequence(cast(ceil" not in read.lower()
    r, titles = random.Random(5), ["ab" + "é" * 20, "ab" + "ö" * 20, "ab" + "é" * 18 + "x", "a bcdefg", "abcdefg", "abcdefgh"]
    for n in (*range(8, 100, 6), 190, 230, 511, 513, 600, 1500):
        t = "ab" + "".join(r.choice("cdefghij +1é") for _ in range(n - 2))
        titles += [t, "a b" + t[2:], t[: int(n * 0.76)], *("ab" + "".join(c for c in t[2:] if r.random() > p) for p in (0.05, 0.2)), "ab" + "".join(r.sample(t[2:], n - 2))]
    rows = spark.createDataFrame(list(enumerate([*titles, *titles[:5]])), "id long, title string")
    first = {}
    for i, t in enumerate(titles):
        if len(t) >= 8:
            first.setdefault(t, i)
    want = set()
    for a, i in first.items():
        for b, j in first.items():
            if a < b and 3 * len(a) < 4.5 * len(b) and 3 * len(b) < 4.5 * len(a) and a.replace(" ", "")[:2] == b.replace(" ", "")[:2]:
                ratio = round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
                want |= {(min(i, j), max(i, j), ratio)} if ratio >= 0.85 else set()
    for tile, bits in ((rc.TILE, rc.BITS), (7, 64)):
        monkeypatch.setattr(rc, "TILE", tile)
        monkeypatch.setattr(rc, "BITS", bits)
        got = [tuple(x) for x in rc.fuzzy_titles_by_blocks(rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_unlike_titles_do_not_leave_their_unit(spark):
    import random

    r = random.Random(6)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randrange(2, 8))) for _ in range(60)]
    rows = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(14)), "ab") for i in range(600)], "id long, title string, block string").withColumn("n", F.length("title"))
    near = rc._like(rows, 0.739, lambda na, nb: -(-85 * (na + nb) // 200))
    assert near.count() < 50


def test_vectors_meet_as_matrices(spark):
    nan, big = float("nan"), 3e38
    vectors = [[1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [nan, 1.0], [None, 1.0], [big, big], [1.0], [], None, [-1.0, 0.5], [3.0, 1.0], [float("inf"), 1.0], [1.0, 2.0000002]]
    v = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert "CoGroupsInArrow" in plan(rel.vector_search(v, q, 3))
    every = v.crossJoin(q).select("query_id", "vec_id", rel.cosine(F.col("embedding"), F.col("query")).alias("score"))
    want = every.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").cast("long"))
    for k, rows in ((1, 100_000), (3, 100_000), (4, 2), (30, 3)):
        assert sorted(map(str, rel.vector_search(v, q, k, rows).collect())) == sorted(map(str, want.where(F.col("rank") <= k).collect()))


def test_texts_are_inverted_where_they_are_read(spark):
    import pyarrow as pa

    assert "Aggregate" not in plan(retrieval.inverted_index_roundtrip(spark, SF))
    words = pa.array([["x"], ["b", "a", "b", "é"], [], ["a", "a"], ["z"]]).slice(1, 3)
    index = fz.word_places.func(words)
    assert [sorted(m) for m in index.to_pylist()] == [[("a", [1]), ("b", [0, 2]), ("é", [3])], [], [("a", [0, 1])]]
    assert fz.words_in_order.func(index).to_pylist() == ["b a b é", "", "a a"]
    gaps = pa.array([[("q", [1])], [("y", [9]), ("x", [4, 12])]], index.type).slice(1)
    assert fz.words_in_order.func(gaps).to_pylist() == ["x y x"]


def test_aliases_are_looked_for_once(spark):
    read = plan(domains.domain_tagging(spark, SF))
    assert "Generate" not in read and "concat_ws" not in read


def test_ranking_is_scored_once_for_swaps(spark):
    assert "doc_id" not in plan(understanding.path_swaps(spark, SF))


def test_likeness_of_words_stays_in_arrow(spark, monkeypatch):
    import pyarrow as pa

    query = ["thing", "ention", "thing", "lichung"]
    titles = [["x"], ["thing", "ention", "lichung"], [], ["things", "mention"], ["thinq", "lichtung", "a"]]
    texts = [[], ["things", "things"], ["zz"], [], ["thing", "thong", "invention"]]
    want = [fz.overlap(query, t, a) for t, a in zip(titles, texts, strict=True)]
    asked = []
    monkeypatch.setattr(fz, "token_worth", lambda q, w, f=fz.token_worth: asked.append((q, w)) or f(q, w))
    of = fz.overlap_of(query)
    got = of.func(pa.array(titles), pa.array(texts)).to_pylist()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want] and len(set(want)) > 3
    assert len(asked) == 3 * (len({w for t in titles for w in t}) + len({w for t in texts for w in t}))
    assert of.func(pa.array(titles).slice(2, 3), pa.array(texts).slice(2, 3)).to_pylist() == got[2:]


def test_words_are_counted_where_texts_are_read(spark):
    docs = spark.createDataFrame([(1, "B a b, A-b"), (2, None), (3, " ")], "doc_id long, text string")
    assert "Aggregate" not in plan(rel.postings(docs))
    assert sorted(map(tuple, rel.postings(docs).collect())) == [("a", 1, 5, 2), ("b", 1, 5, 3)]


def test_index_is_built_by_all_cores(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(ix, "_held", {})
    monkeypatch.setattr(ix, "build", lambda docs, folder: parts.append(docs.rdd.getNumPartitions()) or folder)
    ix.held(spark, f"{SF}/documents.parquet")
    assert parts == [spark.sparkContext.defaultParallelism]
