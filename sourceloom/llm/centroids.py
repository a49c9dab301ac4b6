"""Clustering of vectors around centroids, with block norms that spare most exact distances.

A vector's components x become integers floor(scale * x), so all sums, means and distances are exact and do not depend on how rows are
dealt out.  Each vector is kept beside a compressed form: the Euclidean norms of its blocks of ``block`` components.  By Cauchy and
Schwarz the difference of two blocks is at least as long as the difference of their norms, so

    sum over blocks of (norm of x's block - norm of c's block) ** 2  <=  squared distance of x and c.

A vector first gets the exact distance to the centroid of the smallest bound; of the others only those whose bound is not above the best
distance so far get one.  Norms are kept in single precision and the bounds leave room for their rounding, so a centroid at the same
distance is never left out, and ties go to the smaller number.

The integers and norms are written once.  A round reads them, and its tasks send k rows of sums and counts for each component; the driver sees
k * dims sums, whatever the number of vectors.  Centroids (k * dims integers) are the only thing sent to tasks.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; components beyond
+-2**27 after scaling count as that, so that each distance fits a long; centroids start as the k kept vectors with the smallest hashes of their ids, then (null ids
last, repeated ids) by components; fewer than k vectors give fewer centroids; a centroid without vectors stays where it is; repeated rows
count each; an inertia beyond a long is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from .scratch import keep

K, DIMS, ROUNDS, SCALE, SEED, BLOCK = 8, 64, 10, 1024, 3, 8
LARGEST = 2**27
#: A norm in single precision is off by at most this share of itself.
ROUNDING = 2.0**-23


def integers(vector: Column, scale: int = SCALE) -> Column:
    low, high = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), low), high)).cast("int"))


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has the right length and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & fine


def block_norms(v: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Norms of each row's blocks of components, in single precision."""
    squares = v.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, v.shape[1], block), axis=1)).astype(np.float32)


def lower_bounds(norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """For each row of norms a value that is at most the squared distance to the centroid with these norms."""
    a, b = norms.astype(np.float64), centre.astype(np.float64)
    least = np.abs(a - b) - (a + b) * (2 * ROUNDING)
    return (np.maximum(least, 0.0) ** 2).sum(1) * (1 - 1e-9)


def distances(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of 64-bit integers to one centroid."""
    apart = v - centre
    return np.einsum("ij,ij->i", apart, apart)


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centre_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many exact distances were computed."""
    bounds = np.stack([lower_bounds(norms, c) for c in centre_norms], axis=1)
    which = bounds.argmin(1)
    best = distances(v, centroids[which])
    first, done = which.copy(), len(v)
    for j, centre in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, j] <= best) & (first != j))
        d = distances(v[rows], centre)
        closer = (d < best[rows]) | ((d == best[rows]) & (j < which[rows]))
        best[rows[closer]], which[rows[closer]] = d[closer], j
        done += len(rows)
    return which, best, done


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _with_norms(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norms = block_norms(_matrix(b.column(1), np.int64), block)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1]), pa.array(norms.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "v", "norms"])

    return run


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """id, v (integers) and norms of the usable vectors."""
    vector = F.col(f"`{vector_col}`")
    rows = vectors.where(usable(vector, dims)).select(F.col(f"`{id_col}`").alias("id"), integers(vector, scale).alias("v"))
    return rows.mapInArrow(_with_norms(block), StructType([rows.schema["id"], StructField("v", ArrayType(IntegerType())), StructField("norms", ArrayType(FloatType()))]))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    centre_norms = block_norms(centroids, block)
    for b in batches:
        if b.num_rows:
            v = _matrix(b.column(1), np.int64)
            which, best, _ = nearest(v, _matrix(b.column(2), np.float32), centroids, centre_norms)
            yield b, v, which, best


def _sums(centroids: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for _, v, which, _ in _assigned(batches, centroids, block):
            count += np.bincount(which, minlength=len(count))
            for j in np.unique(which):
                total[j] += v[which == j].sum(0)
        j, d = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(j.ravel()), pa.array(d.ravel()), pa.array(total.ravel()), pa.array(np.repeat(count, total.shape[1]))], names=["cluster", "dim", "total", "n"])

    return run


def _labels(centroids: np.ndarray, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, which, best in _assigned(batches, centroids, block):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the k rows with the smallest hashes of their ids."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The centroids after one round: exact floors of the means, those without vectors as before."""
    sums = rows.mapInArrow(_sums(centroids, block), "cluster int, dim int, total long, n long").groupBy("cluster", "dim")
    out = centroids.copy()
    for r in sums.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows
        if r.n:
            out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    rows, _ = keep(compressed(vectors, id_col, vector_col, dims, scale, block), "vectors")
    centroids = starts(rows, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), dtype=np.int64)  # there are no rows
    for _ in range(rounds):
        centroids = moved(rows, centroids, block)
    labels, _ = keep(rows.mapInArrow(_labels(centroids, block), StructType([rows.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])), "clusters")
    inertia = {r.cluster: int(r.sum) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()}  # k rows
    fits = lambda n: n if n < 2**63 else None
    sums = [(j, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    facts = spark.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for cluster() over the view embeddings: a round is two steps, as plain distances and exact floors."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS place, v, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS d FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hash NULLS LAST, v) - 1 AS cluster, v, d FROM (SELECT sha256('{seed}:' || vec_id) AS hash, v, d FROM kept ORDER BY hash NULLS LAST, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT place, min((apart, cluster)) AS best FROM (
  SELECT place, cluster, CAST(list_inner_product(kept.d, kept.d) - 2 * list_inner_product(kept.d, c{r}.d) + list_inner_product(c{r}.d, c{r}.d) AS BIGINT) AS apart FROM kept, c{r}) GROUP BY place)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT best[2] AS cluster, i, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n FROM (
  SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN kept USING (place)) GROUP BY ALL),
f{r} AS (SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, v, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS d FROM (SELECT c{r}.cluster, coalesce(f{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN f{r} ON f{r}.cluster = c{r}.cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (place) JOIN c{rounds} ON c{rounds}.cluster = best[2]"""
