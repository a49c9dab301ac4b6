"""Queries over documents, chunks and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fuzzy as fz, text as tx
from ..operators import embedding as em, index as ix, relevance as rel
from ..sources import store
from .registry import query
from .views import SOURCES, sources, table

TERMS = ["the", "der", "les", "para", "ention", "and"]
TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_tf = [f"len(list_filter(t, lambda x: x = '{q}'))" for q in TERMS]
BM25 = f"""
tok AS (SELECT *, {TOKENS.format('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1e-9) AS avgdl, {', '.join(f"count(*) FILTER (list_contains(t, '{q}')) AS df_{i}" for i, q in enumerate(TERMS))} FROM tok),
bm AS (SELECT doc_id, {' + '.join(f"CASE WHEN {_tf[i]} > 0 THEN ln((n - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE) + 1) * {_tf[i]} * 2.5::DOUBLE / ({_tf[i]} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avgdl)) ELSE 0::DOUBLE END" for i in range(len(TERMS)))} AS bm25,
  CASE WHEN n <= 50 THEN 1.0 WHEN n <= 500 THEN 2.5 ELSE 5.0 END::DOUBLE AS c FROM tok, st),
rel AS (SELECT doc_id, bm25, bm25 / (bm25 + c) AS relevance FROM bm)"""


@query("corpus_stats", f"WITH tok AS (SELECT {TOKENS.format('text')} AS t FROM documents) SELECT count(*) AS n_docs, round(avg(len(t)), 4) AS avg_len, {', '.join(f'''count(*) FILTER (list_contains(t, '{q}')) AS df_{i}''' for i, q in enumerate(TERMS))} FROM tok")
def corpus_stats(spark, sf):
    return rel.corpus_stats(table(spark, sf, "documents"), TERMS).withColumn("avg_len", F.round("avg_len", 4))


@query("bm25_topk", f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25, round(relevance, 6) AS relevance, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM rel QUALIFY rank <= 50")
def bm25_topk(spark, sf):
    """From stored postings: of the texts, only the parts of the index that the terms are in are read."""
    scored = ix.search(spark, ix.held(spark, f"{sf}/documents.parquet"), TERMS)
    return rel.top_ranked(scored, [F.desc("bm25"), F.asc("doc_id")], 50).select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("relevance", 6).alias("relevance"), "rank")


@query("bm25_all", f"WITH {BM25} SELECT doc_id, round(relevance, 6) AS relevance FROM rel")
def bm25_all(spark, sf):
    return rel.bm25(table(spark, sf, "documents"), TERMS).select("doc_id", F.round("relevance", 6).alias("relevance"))


CHUNK_SQL = """
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+') AS w FROM documents),
ch AS (SELECT doc_id, s AS chunk_start, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, array_to_string(w[s + 1 : s + 160], ' ') AS chunk_text
  FROM (SELECT doc_id, w, unnest(range(0, (CASE WHEN len(w) <= 160 THEN 0 ELSE ceil((len(w) - 160) / 140.0)::BIGINT * 140 END) + 1, 140)) AS s FROM w WHERE len(w) > 0))"""


@query("chunk_documents", f"WITH {CHUNK_SQL} SELECT doc_id, chunk_index::INTEGER AS chunk_index, len(string_split(chunk_text, ' ')) AS n_words, md5(chunk_text) AS chunk_md5 FROM ch")
def chunk_documents(spark, sf):
    return rel.chunked(table(spark, sf, "documents"), 160).select("doc_id", "chunk_index", F.size(F.split("chunk_text", " ")).cast("long").alias("n_words"), F.md5("chunk_text").alias("chunk_md5"))


@query("chunk_size", "SELECT greatest(120, least(600, floor(0.35 * avg(len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))))))::BIGINT AS chunk_words FROM (SELECT text FROM documents ORDER BY doc_id DESC LIMIT 200)")
def chunk_size(spark, sf):
    return rel.chunk_size(table(spark, sf, "documents"))


@query("chunk_stats", f"WITH {CHUNK_SQL} SELECT count(*) AS chunks, count(DISTINCT ch.doc_id) AS parents, (SELECT count(*) FROM documents) - count(DISTINCT ch.doc_id) AS without_chunks, count(e.vec_id) AS with_embedding, round(count(e.vec_id) / count(*), 4) AS embedding_coverage, round(count(*) / count(DISTINCT ch.doc_id), 4) AS per_parent, round(avg(length(chunk_text)), 4) AS mean_chars FROM ch LEFT JOIN embeddings e ON e.vec_id = ch.doc_id")
def chunk_stats(spark, sf):
    docs = table(spark, sf, "documents")
    ch = rel.chunked(docs, 160).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    out = ch.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("parents"), F.count("vec_id").alias("with_embedding"), F.round(F.count("vec_id") / F.count("*"), 4).alias("embedding_coverage"), F.round(F.count("*") / F.countDistinct("doc_id"), 4).alias("per_parent"), F.round(F.avg(F.length("chunk_text")), 4).alias("mean_chars"))
    return out.crossJoin(docs.agg(F.count("*").alias("n"))).withColumn("without_chunks", F.col("n") - F.col("parents")).drop("n")


_ch_score = " + ".join(f"len(list_filter(t, lambda x: x = '{q}'))" for q in TERMS)


@query("best_chunk_per_parent", f"WITH {CHUNK_SQL}, sc AS (SELECT doc_id, chunk_index, ({_ch_score})::DOUBLE / len(string_split(chunk_text, ' ')) AS s FROM (SELECT *, {TOKENS.format('chunk_text')} AS t FROM ch)) SELECT doc_id, chunk_index::INTEGER AS chunk_index, round(s, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk_index) = 1")
def best_chunk_per_parent(spark, sf):
    ch = rel.chunked(table(spark, sf, "documents"), 160).withColumn("t", tx.tokens(F.col("chunk_text")))
    hits = sum((rel.occurrences(F.col("t"), q) for q in TERMS), F.lit(0))
    sc = ch.select("doc_id", "chunk_index", (hits / F.size(F.split("chunk_text", " "))).alias("s"))
    best = sc.groupBy("doc_id").agg(F.max(F.struct("s", (-F.col("chunk_index")).alias("i"))).alias("b"))
    return best.select("doc_id", (-F.col("b.i")).alias("chunk_index"), F.round("b.s", 6).alias("score"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("cosine_topk", f"SELECT b.vec_id AS query_id, a.vec_id AS vec_id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 QUALIFY rank <= 10")
def cosine_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    queries = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rel.vector_search(emb, queries, 10).withColumn("score", F.round("score", 6))


HYBRID = f"""{BM25}, kw AS (SELECT doc_id AS id, relevance AS kw FROM rel WHERE bm25 > 0 ORDER BY relevance DESC, doc_id LIMIT 60),
em AS (SELECT a.vec_id AS id, {COS} AS emb FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY emb DESC, a.vec_id LIMIT 60),
hy AS (SELECT coalesce(kw.id, em.id) AS id, coalesce(kw, 0) AS kw, coalesce(emb, 0) AS emb, 0.55::DOUBLE * coalesce(emb, 0) + 0.45::DOUBLE * coalesce(kw, 0) AS score FROM kw FULL OUTER JOIN em ON kw.id = em.id),
ok AS (SELECT hy.* FROM hy, (SELECT count(*) AS n FROM documents) WHERE score >= CASE WHEN n <= 100 THEN 0.35 WHEN n <= 1000 THEN 0.25 ELSE 0.05 END)"""


def _hybrid(spark, sf):
    docs, emb = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    kw = ix.search(spark, ix.held(spark, f"{sf}/documents.parquet"), TERMS).select(F.col("doc_id").alias("id"), F.col("relevance").alias("kw")).orderBy(F.desc("kw"), "id").limit(60)
    q = emb.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    em = emb.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), rel.cosine(F.col("embedding"), F.col("query")).alias("emb")).orderBy(F.desc("emb"), "id").limit(60)
    return rel.hybrid(kw, em, docs.agg(F.count("*").alias("n")))


@query("hybrid_search", f"WITH {HYBRID} SELECT id, round(kw, 6) AS kw, round(emb, 6) AS emb, round(score, 6) AS score FROM ok ORDER BY score DESC, id LIMIT 20")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).orderBy(F.desc("score"), "id").limit(20).select("id", *[F.round(c, 6).alias(c) for c in ("kw", "emb", "score")])


@query("rerank_blend", f"WITH {HYBRID}, sm AS (SELECT id, score, greatest(0, least(1, 0.75::DOUBLE * emb + 0.25::DOUBLE * kw)) AS sim FROM ok), sd AS (SELECT coalesce(stddev_pop(score), 0) AS s FROM (SELECT score FROM sm ORDER BY score DESC, id LIMIT 10)), bl AS (SELECT greatest(0.30, least(0.80, 0.55 + CASE WHEN s < 0.02 THEN 0.15 WHEN s > 0.15 THEN -0.10 ELSE 0 END))::DOUBLE AS b FROM sd) SELECT id, round(b * sim + (1 - b) * score, 6) AS final, row_number() OVER (ORDER BY b * sim + (1 - b) * score DESC, id) AS rank FROM sm, bl QUALIFY rank <= 20")
def rerank_blend(spark, sf):
    out = rel.rerank(_hybrid(spark, sf), F.col("emb"), F.col("kw"))
    return rel.top_ranked(out, [F.desc("final"), F.asc("id")], 20).select("id", F.round("final", 6).alias("final"), "rank")


_q3 = ["the", "and", "der"]
_ov = lambda c: f"len(list_intersect({_q3!r}, {TOKENS.format(c)}))"


@query("lexical_fallback", f"WITH {SOURCES} SELECT ordinal AS doc_id, round(least(1, ({_ov('abstract')} + 3 * {_ov('title')} + {_ov('platform')})::DOUBLE / 12), 6) AS score FROM src")
def lexical_fallback(spark, sf):
    return sources(spark, sf).select(F.col("ordinal").alias("doc_id"), F.round(rel.lexical(_q3, F.col("title"), F.col("abstract"), F.col("platform")), 6).alias("score"))


@query("inverted_index", f"SELECT term, doc_id, doc_len::INTEGER AS doc_len, count(*) AS tf FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)) GROUP BY ALL")
def inverted_index(spark, sf):
    return rel.postings(table(spark, sf, "documents")).groupBy("term", "doc_id", "doc_len").agg(F.sum("tf").alias("tf"))


@query("inverted_index_roundtrip", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t\\r\\n]+'), ' ') AS abstract FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 0")
def inverted_index_roundtrip(spark, sf):
    """A word -> positions map of each text, turned back to text, as one source's records need."""
    texts = table(spark, sf, "documents").where(F.col("text").rlike("[^ \t\r\n]"))
    index = texts.select("doc_id", fz.word_places(F.regexp_extract_all("text", F.lit("[^ \t\r\n]+"), 0)).alias("index"))
    return index.select("doc_id", fz.words_in_order("index").alias("abstract"))


FLAG = f"""WITH {SOURCES}, {BM25},
dd AS (SELECT src.*, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9+ ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM src QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(citation_count, 0) DESC, ordinal) = 1),
rr AS (SELECT dd.*, relevance FROM dd JOIN rel ON rel.doc_id = dd.ordinal),
best AS (SELECT max(relevance) AS b FROM rr),
g AS (SELECT rr.* FROM rr, best WHERE relevance >= greatest(b * 0.2::DOUBLE, 0.05)),
p AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY relevance DESC, ordinal) AS rp FROM g),
q AS (SELECT greatest(1, 20 // count(DISTINCT platform)) AS quota FROM g)
SELECT source_id, platform, round(relevance, 6) AS relevance, row_number() OVER (ORDER BY (rp > quota), relevance DESC, ordinal) AS rank FROM p, q QUALIFY rank <= 20"""


@query("flagship_ranked", FLAG)
def flagship_ranked(spark, sf):
    """Exact-title dedupe, corpus BM25, proportional gate, per-platform quota with back-fill, ranked top 20."""
    src = rel.bm25(sources(spark, sf), TERMS, "abstract").withColumn("key", tx.normal_title(F.col("title")))
    first = F.max_by(F.struct("source_id", "platform", "ordinal", "relevance"), F.struct(F.coalesce("citation_count", F.lit(0)), -F.col("ordinal")))
    scored = src.groupBy("key").agg(first.alias("s")).select("s.*")
    best = scored.agg(F.max("relevance").alias("b"))
    gated = scored.crossJoin(F.broadcast(best)).where(F.col("relevance") >= F.greatest(F.col("b") * 0.2, F.lit(0.05)))
    order = [F.desc("relevance"), F.asc("ordinal")]
    placed = gated.withColumn("rp", F.row_number().over(W.partitionBy("platform").orderBy(*order)))
    quota = gated.agg(F.greatest(F.lit(1), F.floor(20 / F.count_distinct("platform"))).alias("quota"))
    out = placed.crossJoin(F.broadcast(quota)).withColumn("over", F.col("rp") > F.col("quota"))
    return rel.top_ranked(out, [F.asc("over"), *order], 20).select("source_id", "platform", F.round("relevance", 6).alias("relevance"), "rank")


MOVED = "d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' the der the para' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5 AND (doc_id % 10 <> 0 OR doc_id % 7 = 0))"


@query("index_upsert", f"WITH {MOVED}, {BM25.replace('FROM documents', 'FROM d')} SELECT doc_id, round(bm25, 6) AS bm25, round(relevance, 6) AS relevance FROM rel WHERE bm25 > 0")
def index_upsert(spark, sf):
    """An index of part of the documents; then some come, some are replaced and some go, in a segment of their own."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "text"), store.new_folder(spark, "index")
    ix.build(docs.where("doc_id % 10 <> 0"), folder)
    more = docs.where("doc_id % 7 = 0 and doc_id % 11 <> 5").withColumn("text", F.concat("text", F.lit(" the der the para")))
    ix.upsert(spark, folder, more, docs.where("doc_id % 11 = 5"))
    return ix.search(spark, folder, TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("relevance", 6).alias("relevance"))


@query("index_compacted", f"WITH {MOVED}, {BM25.replace('FROM documents', 'FROM d')} SELECT doc_id, round(bm25, 6) AS bm25, round(relevance, 6) AS relevance FROM rel WHERE bm25 > 0")
def index_compacted(spark, sf):
    """The same index after its segments have been merged."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "text"), store.new_folder(spark, "index")
    ix.build(docs.where("doc_id % 10 <> 0"), folder)
    more = docs.where("doc_id % 7 = 0 and doc_id % 11 <> 5").withColumn("text", F.concat("text", F.lit(" the der the para")))
    ix.upsert(spark, folder, more, docs.where("doc_id % 11 = 5"))
    ix.compact(spark, folder)
    return ix.search(spark, folder, TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("relevance", 6).alias("relevance"))


@query("bm25_stems")
def bm25_stems(spark, sf):
    """Documents with any form of the terms, by Porter's stems."""
    found = ix.search(spark, ix.held(spark, f"{sf}/documents.parquet"), ["relations", "thes", "nation", "andes", "enting"], stemmed=True)
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("relevance", 6).alias("relevance"))


@query("rank_squash", "SELECT event_id, round(abs(value - 50) / (abs(value - 50) + 5), 6) AS score FROM events")
def rank_squash(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(ix.rank_squash(F.col("value") - 50), 6).alias("score"))


ASKED_TEXT = "the thing and the others of them"
_letters = lambda t: "[" + ", ".join(f"(length({t}) - length(replace({t}, '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
CHUNK_HITS = " + ".join(f"(list_contains(t, '{q}'))::INTEGER" for q in TERMS)


@query("chunk_search", f"""WITH {CHUNK_SQL}, v AS (SELECT doc_id, chunk_index, {_letters('lower(chunk_text)')} AS v, {_letters(f"'{ASKED_TEXT}'")} AS q, {TOKENS.format('chunk_text')} AS t FROM ch),
s AS (SELECT doc_id, chunk_index, CASE WHEN list_sum(v) = 0 THEN 0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END AS emb, ({CHUNK_HITS}) / {len(TERMS)}::DOUBLE AS kw FROM v),
b AS (SELECT doc_id, chunk_index, 0.55::DOUBLE * emb + 0.45::DOUBLE * kw AS s FROM s) SELECT doc_id, chunk_index::INTEGER AS chunk_index, round(s, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk_index) = 1""")
def chunk_search(spark, sf):
    """Chunks with vectors of their own, scored by vector and words, and each parent's best."""
    q = ix.letters(F.lit(ASKED_TEXT))
    ch = rel.chunked(table(spark, sf, "documents"), 160).withColumns({"v": ix.letters(F.col("chunk_text")), "t": tx.tokens(F.col("chunk_text"))})
    kw = sum((F.array_contains("t", t).cast("int") for t in TERMS), F.lit(0)) / len(TERMS)
    best = ix.best_per_parent(ch, 0.55 * rel.cosine(F.col("v"), q) + 0.45 * kw)
    return best.select("doc_id", "chunk_index", F.round("score", 6).alias("score"))


@query("chunk_coverage", f"WITH {CHUNK_SQL}, c AS (SELECT doc_id, chunk_index % 3 <> 1 AS has FROM ch) SELECT d.doc_id AS doc_id, coalesce(round(avg(has::INTEGER), 6), 0) AS coverage FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1")
def chunk_coverage(spark, sf):
    """The share of a document's chunks that have a vector; 0 for a document without chunks."""
    docs = table(spark, sf, "documents")
    ch = rel.chunked(docs, 160).select("doc_id", (F.col("chunk_index") % 3 != 1).cast("int").alias("has"))
    return docs.select("doc_id").join(ch.groupBy("doc_id").agg(F.avg("has").alias("c")), "doc_id", "left").select("doc_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("coverage"))


_h = "CAST('0x' || left(md5(t), 4) AS INTEGER)"
_vector = lambda rows: f"SELECT doc_id, place, {_h} % 64 AS b, sum(CASE WHEN {_h} // 4096 % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS c FROM ({rows}) GROUP BY ALL"


@query("chunk_vectors", f"""WITH {CHUNK_SQL}, pv AS ({_vector(f"SELECT doc_id, -1 AS place, unnest({TOKENS.format('text')}) AS t FROM documents")}), cv AS ({_vector(f"SELECT doc_id, chunk_index AS place, unnest({TOKENS.format('chunk_text')}) AS t FROM ch WHERE chunk_index < 30")}),
pn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM pv GROUP BY ALL HAVING sum(c * c) > 0), cn AS (SELECT doc_id, place, sqrt(sum(c * c)) AS n FROM cv GROUP BY ALL HAVING sum(c * c) > 0),
d AS (SELECT cv.doc_id, cv.place, sum(cv.c * coalesce(pv.c, 0)) AS dot FROM cv LEFT JOIN pv ON pv.doc_id = cv.doc_id AND pv.b = cv.b GROUP BY ALL)
SELECT d.doc_id AS doc_id, d.place::INTEGER AS chunk_index, round(dot / (pn.n * cn.n), 6) AS cosine FROM d JOIN pn ON pn.doc_id = d.doc_id JOIN cn ON cn.doc_id = d.doc_id AND cn.place = d.place""")
def chunk_vectors(spark, sf):
    """Documents and their chunks embedded and stored as one version; each chunk against its document."""
    folder = store.new_folder(spark, "vectors")
    em.add(table(spark, sf, "documents").select("doc_id", "text"), folder)
    return em.chunk_likeness(spark, folder).select("doc_id", "chunk_index", F.round("cosine", 6).alias("cosine"))
