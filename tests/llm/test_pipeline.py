import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sourceloom.llm import importance as im, pipeline, scratch

from .test_decontaminate import plain as plain_leaks
from .test_importance import plain as plain_draw
from .test_simhash_dedup import plain_heads

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    """Junk, texts with a bad word, copies, near copies and passages of a benchmark; few n-grams, so that no buckets collide."""
    rng = random.Random(12)
    good = ["".join(rng.choices("aeioun", k=rng.randint(2, 6))) for _ in range(24)]
    items = [(i, " ".join(rng.choices(good, k=40))) for i in range(3)]
    rows, labels = [], []
    for d in range(120):
        text = rng.choices(good, k=rng.choice([60, 150, 400]))
        if d % 10 == 0:
            text = [w + "###" for w in text]
        if d % 10 == 1:
            text[rng.randrange(len(text))] = "horridly"
        if d % 10 == 2:
            text[30:30] = items[d % 3][1].split()
        if d < 90:
            labels.append((d, int(d % 10 != 0), int(d % 10 == 1)))
        rows.append((d, " ".join(text)))
    for d in range(3, 120, 12):
        words = rows[d][1].split()
        words[rng.randrange(len(words))] = rng.choice(good)
        rows += [(1000 + d, rows[d][1]), (2000 + d, " ".join(words))]
    rows += [(None, None), (None, rows[4][1]), (5000, "")]
    spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def test_stages_match_brute_force(spark, tmp_path):
    rows, labels, items = fixture(spark, tmp_path)
    marked = im._labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), im.MAX_LABELLED).collect()
    fitted, seen = ({r["_id"] for r in marked if r[im.MARK] == m} for m in (1, 3))
    scored, k = plain_draw(rows, labels, fitted, seen)
    last = sorted((s[3] for s in scored), reverse=True)[k - 1]
    rows = [r for r, s in zip(rows, scored, strict=True) if s[3] >= last]
    kept = [len(rows)]
    rows, _ = plain_heads(rows, 0.8)
    kept.append(len(rows))
    leaks = {m[0] for m in plain_leaks(rows, items, 0.8)}
    rows = [r for r in rows if str(r[0]) not in leaks]
    assert 90 <= kept[0] <= 125 and kept[1] < kept[0] - 10 and len(rows) < kept[1] - 5
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((str(d), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows), key=str)
    got = {}
    for p in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: p.start):
        assert len(got.setdefault(str(p.doc_id), [])) == p.start
        got[str(p.doc_id)] += np.frombuffer(bytes(p.ids), "<u4").tolist()
    assert sorted(got.items(), key=str) == want


def test_stages_keep_the_columns_and_tidy_up(spark):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with scratch.passing(spark) as made:
            docs, path = scratch.keep(stage(spark, docs, SF), name)
            made.remove(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        for gone in made:
            p, fs = scratch._jvm_path(spark, gone)
            assert not fs.exists(p)
    assert 200 > sizes[0] > sizes[1] > sizes[2] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pack"] and corpus_pipeline.ORACLE_SQL is None and pipeline.ORACLE_SQL is None
