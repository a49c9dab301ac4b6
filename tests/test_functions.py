import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sourceloom.functions import fuzzy as fz, porter, text as tx
from sourceloom.operators import embedding as em, index, records as rc, relevance as rel, selection, selection as sel
from sourceloom.sources import readers, sinks, store
from sourceloom.streaming import windows as sw


def test_tokens_match_arms():
    for a, b, want in (("graph", "graph", True), ("training", "train", True), ("optimize", "optimal", True), ("net", "working", False), ("neural", "neuralnet", True), ("cat", "dog", False), ("learnng", "learning", True), ("", "x", False), ("cats", "cat", True), ("stations", "station", False), ("algebra", "algebar", True)):
        assert fz.tokens_match(a, b) is want, (a, b)


def test_json_repair():
    for text, want in (('```json\n{"a": [1, 2\n```', {"a": [1, 2]}), ('x {"a": "b', {"a": "b"}), ('{"a": 1, "b', {"a": 1}), ('{"a": {"b": 2}} tail', {"a": {"b": 2}}), ('{"a": 1,', {"a": 1})):
        assert json.loads(fz.repaired_json(text)) == want, text
    assert fz.repaired_json(None) is None and fz.repaired_json("none") is None and fz.repaired_json("}") is None


def test_urls():
    assert fz.normal_url("HTTP://Ex.org:80?ref=x&b=ä&a=1#f") == "http://ex.org/?b=%C3%A4&a=1#f"
    assert fz.normal_url("//ex.org/p") == "https://ex.org/p" and fz.normal_url(" ") is None and fz.normal_url("ex.org:443/") == "https://ex.org/"


def test_proximity_and_overlap():
    assert fz.proximity(["graph", "tree"], ["graph", "of", "tree", "kind"]) == 4 / 2 / 3 / 2.5
    assert fz.proximity(["graph", "tree"], ["graph", "x"]) == 0 == fz.proximity(["graph", "tree"], ["graph", "tree"])
    assert fz.proximity(["graph"], ["graphs"]) == 1
    assert abs(fz.overlap(["graph"], ["graph"], []) - 0.65) < 1e-9 and fz.overlap([], ["a"], []) == 0
    assert abs(fz.overlap(["learning"], ["learnings"], ["learning"], ["x"]) - (0.55 * 0.85 + 0.30)) < 1e-9


def test_registered_functions(spark):
    names = fz.register_all(spark)
    assert "sl_ratio" in names
    row = spark.sql("SELECT sl_ratio('abcd', 'abcx') AS r, sl_clean('ﬁ<b>x</b>') AS c, sl_tokens_match('train', 'training') AS m").first()
    assert (row.r, row.c, row.m) == (0.75, "fi x", True)
    text = " ".join(map(str, range(300)))
    got = spark.sql(f"SELECT * FROM chunk_words('{text}', 120)").collect()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.chunk_text for r in got] == [r.chunk_text for r in rel.chunked(df, 120).orderBy("chunk_index").collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=6))
def test_chunks_cover(spark, sizes):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = rel.chunked(df, 120).collect()
    for i, n in enumerate(sizes):
        words = {w for r in got if r.doc_id == i for w in r.chunk_text.split()}
        assert words == {f"w{j}" for j in range(n)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 100)), max_size=30))
def test_quota_and_gate(spark, rows):
    df = spark.createDataFrame([(i, p, s / 100) for i, (p, s) in enumerate(rows)], "ordinal long, platform string, score double")
    limit = 7
    quota, taken, rest = max(1, limit // max(1, len({p for p, _ in rows}))), [], []
    used = {}
    for i, (p, _) in enumerate(rows):
        used[p] = used.get(p, 0) + 1
        (taken if used[p] <= quota else rest).append(i)
    got = [r.ordinal for r in sel.quota_fill(df, "platform", limit).orderBy("position").collect()]
    assert got == (taken + rest)[:limit]
    out = sel.gated(df, "score", F.col("best") * 0.9, 3).collect()
    assert len(out) >= min(3, len(rows)) and len({r.ordinal for r in out}) == len(out)


def test_dedupe_idempotent_and_six_cases(spark):
    rows = [("a", "Deep learning on graphs", "https://x.org/1", 5), ("b", "Deep  Learning on Graphs!", "https://x.org/2", 50), ("c", "Other title here", "https://x.org/3", None), ("d", "", "https://x.org/3?ref=a", 1), ("e", "", "https://x.org/3", 2)]
    cols = "source_id string, title string, url string, citation_count long"
    df = spark.createDataFrame(rows, cols)
    for name, value in (("platform", F.lit("web")), ("source_type", F.lit("book")), ("abstract", F.lit("text")), ("n_authors", F.lit(1)), ("year", F.lit(2000)), ("has_code", F.lit(None).cast("boolean")), ("stars", F.lit(None).cast("long")), ("doi", F.lit(None).cast("string")), ("arxiv_raw", F.lit(None).cast("string")), ("meta_id", F.lit(None).cast("string")), ("external_arxiv", F.lit(None).cast("string")), ("external_doi", F.lit(None).cast("string")), ("downloads", F.lit(None).cast("long")), ("has_pdf", F.lit(False)), ("published", F.lit(None).cast("long")), ("publisher", F.lit(None).cast("string")), ("description", F.lit(None).cast("string")), ("summary", F.lit(None).cast("string")), ("authors_raw", F.concat(F.lit("Ann;"), F.upper("source_id"), F.lit(";ann")))):
        df = df.withColumn(name, value)
    df = df.withColumn("ordinal", F.expr("ascii(source_id)"))
    merged = rc.merged_by_key(df).collect()
    assert {r.source_id: r.duplicate_count for r in merged} == {"b": 2, "c": 1, "e": 2}
    assert {r.source_id: (r.authors, r.alternate_urls) for r in merged}["b"] == (["Ann", "B", "A"], ["https://x.org/2", "https://x.org/1"])
    assert {r.source_id for r in rc.exact_titles(df).collect()} == {"a", "b", "c", "d", "e"}  # only papers are compared by title
    papers = df.withColumn("source_type", F.lit("research_paper"))
    assert {r.source_id for r in rc.exact_titles(papers).collect()} == {"b", "c", "d", "e"}
    assert {r.source_id for r in rc.exact_titles(papers.unionByName(papers)).collect()} == {"b", "c", "d", "e"}


def test_readers_and_sinks(spark, tmp_path):
    lines = ['{"entry_id": "1", "prompt_tokens": 3, "completion_tokens": 4}', "bad", '{"entry_id": "1", "prompt_tokens": 3, "completion_tokens": 4}', '{"entry_id": "2", "tokens_used": 9}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    assert sorted((r.entry_id, r.tokens_used) for r in readers.ledger(spark, str(tmp_path / "l.jsonl")).collect()) == [("1", 7), ("2", 9)]
    (tmp_path / "e.jsonl").write_text('{"episode_id": "x", "created_at": "2024-01-01T00:00:00Z"}\nnope\n')
    assert readers.episodes(spark, str(tmp_path / "e.jsonl")).count() == 1
    raw = [("openalex", '{"display_name": "T", "id": "https://o/1", "publication_year": 2020, "cited_by_count": 4}'), ("crossref", '{"title": ["C"], "URL": "u", "issued": {"date-parts": [[2019, 5]]}}'), ("doaj", "{}"), ("zenodo", '{"metadata": {"title": "Z", "publication_date": "2021-02-03"}, "links": {"html": "h"}}')]
    got = {r.platform: (r.title, r.year, r.citation_count) for r in readers.records(spark.createDataFrame(raw, "platform string, raw string")).collect()}
    assert got == {"openalex": ("T", 2020, 4), "crossref": ("C", 2019, None), "zenodo": ("Z", 2021, None)}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"request_id": "r1", "sources": [{"source_id": "s", "title": "t", "url": "u"}]}')
    assert readers.run_reports(spark, str(tmp_path / "runs")).first().request_id == "r1"
    (tmp_path / "feed.xml").write_text("<feed><entry><id>1</id><title>A</title><summary>s</summary><published>2020</published></entry></feed>")
    assert readers.atom_entries(spark, str(tmp_path / "feed.xml")).first().title == "A"
    one = spark.createDataFrame([("r1", 1), ("r2", 2)], "request_id string, v int")
    sinks.save_runs(one, str(tmp_path / "t"))
    sinks.save_runs(spark.createDataFrame([("r2", 5)], "request_id string, v int"), str(tmp_path / "t"))
    assert sorted((r.request_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("r1", 1), ("r2", 5)]
    sinks.append(one, str(tmp_path / "a"))
    sinks.append(one.withColumn("v", F.col("v") + 10).withColumn("w", F.lit(1)), str(tmp_path / "a"))
    assert sorted((r.v, r.w) for r in sinks.current(spark, str(tmp_path / "a"), ["request_id"], F.desc("v")).collect()) == [(11, 1), (12, 1)]
    assert "| r1 |" in sinks.markdown(one, "x") and "<td>r1</td>" in sinks.html(one, "x")
    kept, kids = sinks.retained(one, one, "request_id", 1, F.desc("v"))
    assert kept.first().request_id == "r2" and kids.count() == 1
    assert sinks.replaced(one, one.where("v = 2"), "request_id").count() == 2
    assert readers.inverted_text(F.lit(None)) is not None


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sw.stream_of(spark, str(tmp_path / "in"), events.schema)
    key = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    got = sw.drained(sw.tumbling(stream, "1 hour"), "tumbled", str(tmp_path / "c1"), "complete").collect()
    assert key(got) == key(sw.tumbling(events, "1 hour").collect())
    got = sw.drained(sw.sliding(stream, "60 minutes", "10 minutes"), "slid", str(tmp_path / "c2"), "complete").collect()
    assert key(got) == key(sw.sliding(events, "60 minutes", "10 minutes").collect())
    got = sw.drained(sw.distinct_entries(stream, "10000 days"), "distinct_", str(tmp_path / "c3"))
    assert got.count() == events.count()
    query = sinks.in_batches(stream, str(tmp_path / "out"), str(tmp_path / "c4"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_text_columns(spark):
    row = spark.createDataFrame([("The  <b>Quick</b> fox.\x07 Runs! ", ["Ab", "aB", "c"])], "t string, a array<string>").select(
        tx.clean(F.col("t")).alias("c"), tx.normal_title(F.col("t")).alias("n"), tx.slug(F.col("t")).alias("s"), tx.distinct_ignoring_case(F.col("a")).alias("d"), tx.shared_prefix(F.lit("abcd"), F.lit("abxy")).alias("p"), tx.truncated(F.lit("abcdefgh"), 6).alias("u"), tx.has_secret(F.lit("token: abcdefgh12")).alias("x")
    ).first()
    assert row.c == "The Quick fox. Runs!" and row.n == "the quick fox runs" and row.s == "the-b-quick-b-fox-runs"
    assert row.d == ["Ab", "c"] and row.p == 2 and row.u == "abc..." and row.x


def test_title_ratio_matches_brute_force(spark, tmp_path):
    import difflib
    import random

    from sourceloom.plans import understanding as un

    rng = random.Random(4)
    titles = []
    for start in ("the", "tha", "a b", "ab "):
        for n in (9, 40, 60, 88):
            base = start + "".join(rng.choices("abcdefgh ", k=n)).replace("  ", " x").strip()
            titles += [base, base[:2] + "q" + base[3:], base + " " + "uvwxyz"[: max(1, n // 12)], base + " k" * (n // 6), base + " k" * (n // 3)]
    rows = [(i, t, "s") for i, t in enumerate(titles)] + [(500, titles[0], "s"), (501, None, "s"), (502, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    keys = {}
    for r in un.sources(spark, str(tmp_path)).select("ordinal", un.tx.normal_title(un.F.col("title")).alias("t")).collect():
        if len(r.t or "") >= 8:
            keys[r.t] = min(r.ordinal, keys.get(r.t, r.ordinal))
    want = set()
    for a in keys:
        for b in keys:
            if a < b and a.replace(" ", "")[:2] == b.replace(" ", "")[:2]:
                ratio = round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
                if ratio >= 0.85:
                    want.add((*sorted((keys[a], keys[b])), ratio))
    got = [tuple(r) for r in un.fuzzy_titles_ratio(spark, str(tmp_path)).select("id_a", "id_b", "ratio").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    lengths = {i: len(t) for t, i in keys.items()}
    assert any(abs(lengths[a] - lengths[b]) > 16 for a, b, _ in want)


def test_more_readers_and_sinks(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<feed xmlns:arxiv="http://a"><entry><id>http://arxiv.org/abs/1</id><title>A</title><summary>s</summary><published>2020-01-02</published><author><name>Ann</name></author><author><name>Bo</name></author>'
        '<arxiv:doi>10.1/x</arxiv:doi><link href="http://p" rel="alternate" type="text/html"/><link title="pdf" href="http://p.pdf" rel="related" type="application/pdf"/></entry></feed>'
    )
    row = readers.atom_entries(spark, str(tmp_path / "feed.xml")).first()
    assert (row.authors, row.doi, row.url, row.pdf_url) == (["Ann", "Bo"], "10.1/x", "http://p", "http://p.pdf")
    (tmp_path / "old.json").write_text('{"documents": [{"doc_id": "d1", "title": "T", "text": "x"}, {"run_id": "r", "title": "U", "url": "u"}]}')
    got = {r.title: r.doc_id for r in readers.legacy_documents(spark, str(tmp_path / "old.json")).collect()}
    assert got["T"] == "d1" and len(got["U"]) == 32
    (tmp_path / "memory.json").write_text('{"a": "1", "b": {"x": 2}}')
    assert {r.key: r.entry for r in readers.memories(spark, str(tmp_path / "memory.json")).collect()} == {"a": "1", "b": '{"x":2}'}
    dims = readers.dimension(spark, '{"physics": {"aliases": ["optics", "heat"], "platforms": ["arxiv", "core"]}, "law": {"aliases": []}}').collect()
    assert {(d.domain, d.alias, d.platform, d.place) for d in dims} == {("physics", "optics", None, None), ("physics", "heat", None, None), ("physics", None, "arxiv", 0), ("physics", None, "core", 1)}
    one = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "d " * 400)], "doc_id long, text string")
    sinks.add_records(one, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/documents")).count() == 3
    chunks = spark.read.parquet(str(tmp_path / "store/chunks"))
    assert {r.doc_id for r in chunks.collect()} == {1, 3} and chunks.count() == 4
    table = str(tmp_path / "published")
    sinks.publish(one, table)
    before = sinks.published(spark, table)
    sinks.publish(one.where("doc_id = 1"), table)
    assert before.count() == 3 and sinks.published(spark, table).count() == 1  # a reader that is at work keeps its version
    (tmp_path / "published/_commits/000000003").write_text("half a commi")  # a writer that died
    assert sinks.published(spark, table).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path / "nothing"))
    sinks.cleared(spark, str(tmp_path / "store/chunks"))
    assert spark.read.parquet(str(tmp_path / "store/chunks")).count() == 0 and set(spark.read.parquet(str(tmp_path / "store/chunks")).columns) == set(chunks.columns)
    names = spark.createDataFrame([("a/b: c?",), ("..",), (None,), ("x" * 100,)], "t string").select(sinks.safe_name(F.coalesce("t", F.lit(""))).alias("n")).collect()
    assert [r.n for r in names] == ["a_b_c", "untitled", "untitled", "x" * 80]
    entries = spark.createDataFrame([("m1", "c1", 5, 1.0), ("m1", "c2", 7, 2.0)], "model string, category string, tokens long, latency double")
    sinks.usage_report(entries, str(tmp_path / "usage"))
    assert {(r.model, r.category, r.tokens) for r in spark.read.json(str(tmp_path / "usage")).select("model", "category", "tokens").collect()} == {("m1", None, 12), (None, "c1", 5), (None, "c2", 7), (None, None, 12)}
    runs = spark.createDataFrame([("a1", "done")], "agent_id string, status string")
    steps = spark.createDataFrame([("a1", 2, "second"), ("a1", 1, "first")], "agent_id string, step int, what string")
    sinks.agent_run(runs, steps, str(tmp_path / "agents"))
    assert [s.what for s in spark.read.parquet(str(tmp_path / "agents")).first().steps] == ["first", "second"]


def test_numbering_in_ranges_equals_one_window(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = {(r.g, r.k): r.place for r in index.numbered(rows, str(tmp_path / "n"), "k", group="g").collect()}
    want = {}
    for g in range(3):
        for place, k in enumerate(sorted(i * 7919 % 500 for i in range(500) if i % 3 == g), 1):
            want[g, k] = place
    assert got == want
    assert [r.place for r in index.numbered(rows, str(tmp_path / "m"), "k").orderBy("k").collect()] == list(range(1, 501))


def test_first_of_each_and_merge_lists(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 3001).alias("v"))
    got = {}
    for r in selection.first_of_each(rows, "g", [F.asc("v")], 4).collect():
        got.setdefault(r.g, []).append(r.v)
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(i * 37 % 3001 for i in range(g, 3000, 2))[:4] for g in (0, 1)}


def test_proximity_of_batches_equals_single_rows(spark):
    words = [["the", "thing", "x", "mention"], [], ["nothing"], ["mention"] * 3 + ["a"] * 9 + ["things", "ention"], ["thing", "ention"]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    for query in (["thing", "ention"], ["thing"], []):
        got = {r.i: r.p for r in df.select("i", fz.proximity_of(query)("w").alias("p")).collect()}
        assert got == {i: fz.proximity(query, w) for i, w in enumerate(words)}


def test_stems_of_published_pairs(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform",
        "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
        "replacement": "replac", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "boyish": "boyish",
        "generalizations": "gener", "oscillators": "oscil", "is": "is", "c3po": "c3po", "": "",
    }
    got = spark.createDataFrame([(k,) for k in pairs], "w string").select("w", porter.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == pairs


def test_index_is_seen_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"relate word{i} alpha" + " relations" * (i % 3)) for i in range(60)], "doc_id long, text string")
    folder = str(tmp_path / "ix")
    index.build(docs, folder)
    score = lambda **kw: {r.doc_id: round(r.bm25, 9) for r in index.search(spark, folder, ["relations", "alpha"], **kw).collect()}
    for k in range(4):
        index.upsert(spark, folder, spark.createDataFrame([(k, f"relational beta {k}"), (100 + k, "alpha")], docs.schema), docs.where(f"doc_id = {50 + k}").select("doc_id"))
    plain, stemmed = score(), score(stemmed=True)
    assert set(stemmed) == {*range(50), *range(54, 60), *range(100, 104)} and set(plain) == set(stemmed) - set(range(4))
    during = index.search(spark, folder, ["relations", "alpha"])
    # a segment that no commit names is no part of the index
    index._write_segment(docs.limit(1), f"{folder}/generation=0", 9, None)
    assert score() == plain
    index.compact(spark, folder)
    assert score() == plain and score(stemmed=True) == stemmed
    assert {r.doc_id: round(r.bm25, 9) for r in during.collect()} == plain
    index.vacuum(spark, folder)
    assert sorted(f.name for f in (tmp_path / "ix").iterdir() if not f.name.startswith(".")) == ["_commits", "generation=1"]
    assert score() == plain
    state = index._state(spark, folder)
    store.commit(spark, folder, "1;0", state[0])
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(spark, folder, "1;0", state[0])  # another writer was first


def test_vectors_of_records_and_chunks(spark, tmp_path):
    rows = [(1, " ".join(f"word{i}" for i in range(400))), (2, "one two"), (3, None), (4, "!!! ???"), (5, "bad apple")]
    records = spark.createDataFrame(rows, "doc_id long, text string")

    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("a model that fails")
        return em.hashed(texts)

    folder = str(tmp_path / "v")
    assert em.add(records.limit(0), folder) == "empty" and store.current(spark, folder) is None
    assert em.add(records, folder, picky) == "chunked"
    docs, chunks = em.documents(spark, folder)
    assert {r.doc_id: r.vector is not None for r in docs.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert sorted((r.doc_id, r.chunk_index, r.vector is not None) for r in chunks.collect()) == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, True), (4, 0, False), (5, 0, False)]
    by = {r.doc_id: r for r in em.regrouped(em.with_chunks(records, embedder=picky)).collect()}
    assert [len(v) for v in by[1].chunk_vectors] == [64, 64, 64] and by[3].chunk_vectors == [] and by[5].chunk_vectors == [[]] and by[2].vector == pytest.approx(by[2].chunk_vectors[0])
    before = docs
    assert em.add(records.where("doc_id = 3"), folder) == "parent"  # nothing to embed: records alone
    docs, chunks = em.documents(spark, folder)
    assert [r.doc_id for r in docs.collect()] == [3] and chunks.count() == 0 and before.count() == 5
