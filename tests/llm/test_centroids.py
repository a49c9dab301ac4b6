import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa

from sourceloom.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string"


def plain(vectors, k=8, dims=64, rounds=10, scale=1024, seed=3):
    """The whole clustering with Python's integers."""
    kept = [(i, [max(-(2**27), min(2**27, math.floor(max(-1e30, min(1e30, scale * x))))) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assigned = lambda: [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(kept, assigned()):
            groups.setdefault(j, []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(x) // len(g) for x in zip(*g)]
    last = assigned()
    own = {j: sum(d for d, i in last if i == j) for _, j in last}
    return [(i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)]


def test_against_plain_python_and_sql(spark):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(m + rng.gauss(0, 0.2)) for m in middles[i % 5]]) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # one common vector
    rows += [(9, rows[3][1]), (9, rows[4][1]), (None, rows[5][1])]
    odd = [(300, None), (301, [1.0] * 63), (302, []), (303, [None] + [0.0] * 63), (304, [float("nan")] + [0.0] * 63), (305, [float("-inf")] * 64)]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows + odd], SCHEMA).repartition(3)
    got = ce.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    mine = sorted(map(tuple, got.collect()), key=repr)
    assert mine == sorted(plain(rows), key=repr)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows + odd], pa.int64()), "embedding": pa.array([v for _, v in rows + odd], pa.list_(pa.float32()))}))
    assert sorted(con.execute(ce.cluster_sql()).fetchall(), key=repr) == mine


def test_few_no_and_huge_vectors(spark):
    rows = [(1, [1e30, 3.0]), (2, [0.0, 0.0]), (3, [0.5, -0.0003])]
    df = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, ce.cluster(df, dims=2, block=2).collect())) == sorted(plain(rows, dims=2))
    assert ce.cluster(df.limit(0)).count() == 0 and ce.cluster(df).count() == 0  # none has 64 components


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (8, 64))
    v = centres[rng.integers(0, 8, 500)] + rng.integers(-60, 60, (500, 64))
    v[:8] = centres
    norms, centre_norms = ce.block_norms(v), ce.block_norms(centres)
    exact = np.stack([ce.distances(v, c) for c in centres], 1)
    for j in range(8):
        assert (ce.lower_bounds(norms, centre_norms[j]) <= exact[:, j]).all()
    which, best, done = ce.nearest(v, norms, centres, centre_norms)
    assert (which == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert done < 0.9 * exact.size
    twice = np.concatenate([centres[3:4], centres[3:4], centres[:1]])  # equal centroids: the smaller number
    assert (ce.nearest(v, norms, twice, ce.block_norms(twice))[0] != 1).all()
