"""Lexical relevance, retrieval and reranking over documents, chunks and vectors."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import text as tx

K1, B = 1.5, 0.75
BROADCAST_QUERIES = 50_000


def top_ranked(df: DataFrame, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows in an order, numbered from 1; only they are numbered, after a distributed top-k."""
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def occurrences(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == token))


def asked(words: Column, query: list[str]) -> Column:
    """The tokens of a text of blank-separated words (tx.ascii_words) that the query has, found in one pass of one pattern: a token first,
    then whether a word begins with it, which would else be looked up at every character."""
    if not query:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(words, F.lit(f"(?:{'|'.join(f'{q}(?<![^ ]{q})' for q in map(re.escape, query))})(?![^ ])"), 0)


def counted(docs: DataFrame, query: list[str], text: str) -> DataFrame:
    """docs with _n, the text's number of tokens, and _t, those of its tokens that the query has."""
    rows = docs.withColumn("_w", tx.ascii_words(F.col(text)))
    return rows.withColumns({"_n": tx.blank_count(F.col("_w")), "_t": asked(F.col("_w"), query)}).drop("_w")


def corpus_stats(docs: DataFrame, query: list[str], text: str = "text") -> DataFrame:
    """One row: documents, mean length in tokens, and each query token's document frequency."""
    toks = counted(docs.select(text), query, text)
    return toks.agg(F.count("*").alias("n_docs"), F.avg("_n").alias("avg_len"), *[F.count_if(F.array_contains("_t", q)).alias(f"df_{i}") for i, q in enumerate(query)])


def squash(n_docs: Column) -> Column:
    """c of s / (s + c): 1.0 to 50 documents, 2.5 to 500, 5.0 beyond."""
    return F.when(n_docs <= 50, 1.0).when(n_docs <= 500, 2.5).otherwise(5.0)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def saturated(tf: Column, length: Column, avg_len: Column) -> Column:
    """A term's weight by how often it occurs and how long the text is."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(avg_len, F.lit(1e-9))))


def bm25(docs: DataFrame, query: list[str], text: str = "text") -> DataFrame:
    """docs with bm25 and relevance = s / (s + c), c by corpus size.  Every text is read; see index.search for stored postings."""
    both = counted(docs, query, text).crossJoin(F.broadcast(corpus_stats(docs, query, text)))
    total = F.lit(0.0)
    for i, q in enumerate(query):
        tf = occurrences(F.col("_t"), q)
        total = total + F.when(tf > 0, idf(F.col("n_docs"), F.col(f"df_{i}")) * saturated(tf, F.col("_n"), F.col("avg_len"))).otherwise(0.0)
    scored = both.withColumn("bm25", total).withColumn("relevance", F.col("bm25") / (F.col("bm25") + squash(F.col("n_docs"))))
    return scored.drop("_t", "_n", "n_docs", "avg_len", *[f"df_{i}" for i in range(len(query))])


def chunked(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Overlapping word windows: doc_id, chunk_index, chunk_text.  Step = size - max(10, size // 8); no window that begins after
    one reached the end."""
    step = size - max(10, size // 8)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \t\r\n]+"), 0)
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    last = F.when(F.size("w") <= size, F.lit(0)).otherwise(F.ceil((F.size("w") - size) / F.lit(step)) * step)
    starts = F.sequence(F.lit(0), last.cast("int"), F.lit(step))
    return rows.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("chunk_index", "chunk_text"))


def chunk_size(docs: DataFrame, text: str = "text", newest: int = 200) -> DataFrame:
    """0.35 of the newest documents' mean number of words, within 120 and 600."""
    new = docs.orderBy(F.desc("doc_id")).limit(newest)
    return new.agg(F.greatest(F.lit(120), F.least(F.lit(600), F.floor(0.35 * F.avg(tx.word_count(F.col(text)))))).cast("long").alias("chunk_words"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def _exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """cosine() of rows of two arrays, in the same order of additions."""
    dots = lambda a, b: np.add.accumulate(a * b, axis=1)[:, -1]
    norm = np.sqrt(dots(vectors, vectors)) * np.sqrt(dots(queries, queries))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm == 0, 0.0, dots(vectors, queries) / norm)


def _nearest(k: int, rows: int = 8_192, columns: int = 256):
    """A part's k best vectors of each query: those whose product of unit vectors comes within SLACK of the k-th best are scored exactly.  Of equal vectors, the k with the smallest ids are enough."""
    SLACK = 1e-9

    def array(table: pa.Table, name: str) -> np.ndarray:
        return table[name].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(table), -1)

    def unit(v: np.ndarray) -> np.ndarray:
        size = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(size == 0, 1.0, size)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_by("vec_id")
            q, v, q_ids, v_ids = array(queries, "query"), array(vectors, "embedding"), queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
            _, same = np.unique(v, axis=0, return_inverse=True)
            order = np.argsort(same.ravel(), kind="stable")
            ordered = same.ravel()[order]
            keep = np.sort(order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k])
            v, v_ids, v_unit = v[keep], v_ids[keep], unit(v[keep])
            for i in range(0, len(q), columns):
                mine = q[i : i + columns]
                of_q, of_v, scores = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                mine_unit, floor = unit(mine), np.full(len(mine), -np.inf)
                for j in range(0, len(v), rows):
                    near = mine_unit @ v_unit[j : j + rows].T
                    best = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] >= k else floor
                    floor = np.maximum(floor, best)  # k vectors at least are at or above it
                    a, b = np.nonzero(near >= floor[:, None] - SLACK)
                    of_q, of_v, scores = np.concatenate([of_q, a]), np.concatenate([of_v, b + j]), np.concatenate([scores, near[a, b]])
                    left = scores >= floor[of_q] - SLACK
                    of_q, of_v, scores = of_q[left], of_v[left], scores[left]
                exact = _exact(v[of_v], mine[of_q])
                order = np.lexsort((v_ids[of_v], -exact, of_q))
                of_q, of_v, exact = of_q[order], of_v[order], exact[order]
                first = np.arange(len(of_q)) - np.searchsorted(of_q, of_q) < k
                out.append((q_ids[i + of_q[first]], v_ids[of_v[first]], exact[first]))
        ids, vecs, found = (np.concatenate([o[c] for o in out]) if out else [] for c in range(3))
        return pa.table({"query_id": pa.array(ids, queries.schema.field("query_id").type), "vec_id": pa.array(vecs, vectors.schema.field("vec_id").type), "score": pa.array(found, pa.float64())})

    return run


def _regular(vector: Column) -> Column:
    """Whether a vector has components, all numbers whose squares neither vanish nor overflow, or all zero; others are left to cosine()."""
    fit = lambda x: x.isNotNull() & ((x == 0) | F.abs(x).between(1e-100, 1e100))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fit), F.lit(False))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, part_rows: int = 50_000) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine for each row of a query table (query_id, query).

    All vectors are compared with all queries, by the plan of a query set against a corpus: vectors are dealt into parts of about ``part_rows``, each by number of components, and meet the
    queries there as products of matrices; each part gives its k best of each query.  Queries of more than BROADCAST_QUERIES go in blocks of that many.  Vectors of other sizes than the query's
    score 0, and those with nulls or no numbers what cosine() makes of them: these pairs are compared one by one."""
    n = queries.count()
    if n > BROADCAST_QUERIES:
        blocks, out = -(-n // BROADCAST_QUERIES), None
        for i in range(blocks):
            found = vector_search(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)).isin(2 * i, 2 * i + 1)), k, part_rows)
            out = found if out is None else out.unionByName(found)
        return out
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, n), -(-vectors.count() // part_rows))
    even = vectors.select("vec_id", "embedding", F.size("embedding").alias("size"), _regular(F.col("embedding")).alias("regular"))
    asked = queries.select("query_id", "query", F.size("query").alias("size"), _regular(F.col("query")).alias("regular"))
    dealt = even.where("regular").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    sent = asked.where("regular").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}"
    scored = sent.groupBy("size", "part").cogroup(dealt.groupBy("size", "part")).applyInArrow(_nearest(k), f"{ids}, score double")
    # what isn't regular is few or small; of other sizes, which score 0, the first ids of each size are enough
    plain, odd = even.where("regular"), even.where("not regular")
    first = plain.withColumn("_n", F.row_number().over(W.partitionBy("size").orderBy("vec_id"))).where(F.col("_n") <= k)
    pairs = lambda v, q: v.crossJoin(F.broadcast(q.withColumnRenamed("size", "asked_size").drop("regular")))
    score = cosine(F.col("embedding"), F.col("query")).alias("score")
    rest = [pairs(odd, asked), pairs(plain, asked.where("not regular")), pairs(first.drop("_n"), asked.where("regular")).where("size <> asked_size")]
    for r in rest:
        scored = scored.unionByName(r.select("query_id", "vec_id", score))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def adaptive_threshold(n: Column) -> Column:
    return F.when(n <= 100, 0.35).when(n <= 1000, 0.25).otherwise(0.05)


def hybrid(keyword: DataFrame, vector: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Full outer union of keyword (id, kw) and vector (id, emb) candidates: 0.55 * emb + 0.45 * kw, above the adaptive threshold."""
    both = keyword.join(vector, "id", "full_outer").select("id", F.coalesce("kw", F.lit(0.0)).alias("kw"), F.coalesce("emb", F.lit(0.0)).alias("emb"))
    scored = both.withColumn("score", 0.55 * F.col("emb") + 0.45 * F.col("kw")).crossJoin(F.broadcast(n_docs))
    return scored.where(F.col("score") >= adaptive_threshold(F.col("n"))).drop("n")


def rerank(df: DataFrame, primary: Column, secondary: Column) -> DataFrame:
    """sim = 0.75 * primary + 0.25 * secondary in [0, 1]; the blend moves by the spread of the ten best original scores."""
    sim = df.withColumn("sim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.75 * primary + 0.25 * secondary)))
    spread = sim.orderBy(F.desc("score"), "id").limit(10).agg(F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread"))
    blend = F.greatest(F.lit(0.30), F.least(F.lit(0.80), 0.55 + F.when(F.col("spread") < 0.02, 0.15).when(F.col("spread") > 0.15, -0.10).otherwise(0.0)))
    return sim.crossJoin(F.broadcast(spread)).withColumn("final", blend * F.col("sim") + (1 - blend) * F.col("score")).drop("spread")


def lexical(query: list[str], title: Column, text: Column, meta: Column) -> Column:
    """(text + 3 * title + metadata overlaps) / (4 * query tokens), at most 1."""
    q = F.array(*map(F.lit, query))
    hits = lambda c: F.size(F.array_intersect(q, tx.tokens(c)))
    return F.least(F.lit(1.0), (hits(text) + 3 * hits(title) + hits(meta)) / (4 * len(query)))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_len", T.IntegerType()), T.StructField("tf", T.LongType())])))
def word_counts(words: pa.Array) -> pa.Array:
    """The distinct words of each text of blank-separated words, the number of all its words, and how often it has each."""
    bounds, terms, sizes, counts = [0], [], [], []
    for text in words:
        found = Counter(text.as_py().split())
        terms.extend(found.keys())
        counts.extend(found.values())
        sizes.append(found.total())
        bounds.append(len(terms))
    sizes = np.repeat(np.array(sizes, dtype=np.int32), np.diff(bounds))
    each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["term", "doc_len", "tf"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, doc_id, doc_len, tf: an inverted index of docs (an id once).  A text's words are counted where it is read, so nothing is shuffled,
    no row is made for a word that is repeated, and the text goes before the rows are made."""
    each = docs.select("doc_id", word_counts(tx.ascii_words(F.col(text))).alias("c")).select("doc_id", F.explode("c").alias("c"))
    return each.select("c.term", "doc_id", "c.doc_len", "c.tf")
