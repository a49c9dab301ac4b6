"""Texts against a dictionary of aliases, on small texts of which each says one thing."""

from pyspark.sql import functions as F

from sourceloom.operators import aliases as al, path as pt

DICTIONARY = [
    ("machine learning", "computing"), ("Machine-Learning!", "art"), ("learning", "education"), ("ml", "computing"), ("c++", "computing"), ("heat", "physics"), ("quantum field theory", "physics"), ("field", "law"), ("law", "law"),
]
TEXTS = [
    (1, "MACHINE  learning, explained", "machine learning"), (2, "a quantum field theory of heat", ""), (3, "preheated lawful", ""), (4, "ml", ""), (5, "C++ and heat and heat", "Heat"), (6, None, ""), (7, "machine. learning", ""),
]


def _frames(spark):
    words = spark.createDataFrame(DICTIONARY, "alias string, domain string")
    texts = spark.createDataFrame(TEXTS, "k long, t string, title string")
    order = spark.createDataFrame([("computing", 2), ("physics", 1), ("law", 0), ("art", 5)], "domain string, priority int")
    return words, texts, order


def test_longest_alias_and_places(spark):
    words, texts, order = _frames(spark)
    for few in (al.BROADCAST_ALIASES, 0):
        kept, al.BROADCAST_ALIASES = al.BROADCAST_ALIASES, few
        found = {(r.k, r.alias, r.place) for r in al.hits(texts, "k", "t", words).collect()}
        tags = {r.k: (r.domain, r.topic) for r in al.tagged(texts, "k", "t", F.col("title"), words, order).collect()}
        al.BROADCAST_ALIASES = kept
        assert {(1, "machine learning", 0), (1, "learning", 1), (2, "quantum field theory", 1), (2, "field", 2), (2, "heat", 5), (4, "ml", 0), (5, "c++", 0), (5, "heat", 2), (5, "heat", 4), (7, "machine learning", 0), (7, "learning", 1)} == found
        # "machine learning" is claimed twice: the smaller name has it
        assert tags == {1: ("art", "machine learning"), 2: ("physics", "quantum field theory"), 3: ("general", ""), 4: ("computing", ""), 5: ("physics", "heat"), 6: ("general", ""), 7: ("art", "machine learning")}


def test_scores_order_and_names(spark):
    words, texts, order = _frames(spark)
    scored = al.scores(al.hits(texts, "k", "t", words), texts, "k", F.col("title"), F.array(F.lit("all heat")))
    got = {(r.k, r.domain): round(r.score, 2) for r in scored.collect()}
    assert got[1, "art"] == 0.7 and got[1, "education"] == 0.60 and got[2, "physics"] == 0.96 and got[2, "law"] == 0.38 and got[4, "computing"] == 0.30 and got[5, "physics"] == 0.70
    best = {r.k: [(x.domain, x.confidence) for x in r.domains] for r in al.detected(scored, "k", order).collect()}
    assert best[2] == [("physics", 0.96), ("law", 0.38)] and best[1] == [("art", 0.7)] and 3 not in best
    asked = spark.createDataFrame([(1, ["Law", "none", "ml", "law", "HEAT"]), (2, []), (3, ["nothing"])], "k long, names array<string>")
    assert {r.k: r.domains for r in al.resolved(asked, "k", F.col("names"), words).collect()} == {1: ["law", "computing", "physics"]}


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    texts = spark.createDataFrame([(1, "w1 w2 w999")], "k long, t string")
    size = []
    for n in (10, 2000):
        words = spark.range(n).select(F.concat(F.lit("w"), "id").alias("alias"), F.lit("d").alias("domain"))
        hits = al.hits(texts, "k", "t", words)
        size.append(len(hits._jdf.queryExecution().optimizedPlan().toString()))
    assert hits.count() == 3 and abs(size[0] - size[1]) < 200


def test_swaps_take_each_candidate_once(spark):
    path = [("r", 1, "Advanced matters", 1, "a", 0.1), ("r", 1, "Advanced matters", 2, "b", 0.9), ("r", 2, "Intro", 1, "c", 0.2), ("r", 3, "Core parts", 1, "d", 0.0), ("r", 4, "Untold", 1, "e", 0.0), ("r", 5, "Expert view", 1, "f", 0.05), ("q", 1, "Basics", 1, "a", 0.1)]
    ranked = [(run, s, score, i, None, d, t, "web") for run in ("r", "q") for i, (s, score, d, t) in enumerate((("x", 0.9, "intermediate", "blog"), ("y", 0.8, "intermediate", "blog"), ("z", 0.7, "advanced", "blog"), ("v", 0.6, None, "course"), ("u", 0.2, "advanced", "book"), ("b", 0.9, "advanced", "blog")))]
    steps = spark.createDataFrame(path, "run_id string, step long, title string, place long, source_id string, score double")
    rows = spark.createDataFrame(ranked, "run_id string, source_id string, score double, ordinal long, confidence double, difficulty string, source_type string, platform string")
    got = {(r.run_id, r.step, r.source_id): r.new_source_id for r in pt.swaps(steps, rows).collect()}
    # x fits every band and goes to the first step; the intro gets y; the core step is left with the course; the expert one with z; b is free in run q only
    assert got == {("r", 1, "a"): "x", ("r", 2, "c"): "y", ("r", 3, "d"): "v", ("r", 5, "f"): "z", ("q", 1, "a"): "x"}
    whole = {(r.step, r.place): (r.source_id, r.swapped) for r in pt.swapped(steps, rows).where("run_id = 'r'").collect()}
    assert whole == {(1, 1): ("x", True), (1, 2): ("b", False), (2, 1): ("y", True), (3, 1): ("v", True), (4, 1): ("e", False), (5, 1): ("z", True)}
