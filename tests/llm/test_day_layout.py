import datetime as dt
import glob
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from sourceloom.llm import day_layout as dl

SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
EPOCH, CUT = dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 1)


def us(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def plain(sales):
    """(day, file_no) -> rows and whether the file was rewritten."""
    rows = list(sales)
    for r in sales:
        if r[0] is not None and r[4] is not None and (h := zlib.crc32(str(r[0]).encode())) % 3 == 0 and day(r[4]) % 10 == 0:
            more = lambda t, n: None if t is None else t + dt.timedelta(days=n)
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, more(r[4], h % 2), more(r[5], 1 + h % 97), r[6]))
    low = lambda v: (v is not None, v)
    best = lambda some: max(some, key=lambda r: (low(us(r[5])), low(us(r[4])), *map(low, r[:4]), low(r[6])))
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    early = lambda r: r[5] is not None and r[5] < CUT
    start = {i: best(e) for i, g in groups.items() if (e := [r for r in g if early(r)])}
    end = {i: best(g) for i, g in groups.items()}
    late = {i for i, r in end.items() if not early(r)}
    dirty = {day(end[i][4]) for i in late} | {day(start[i][4]) for i in late if i in start}
    days = defaultdict(list)
    for r in end.values():
        days[day(r[4])].append(r)
    k = 1 + len(sales) // 900
    return {(d, n): (part, d in dirty) for d, g in days.items() for n in range(-(-len(g) // k)) if (part := sorted(g, key=lambda r: (low(us(r[4])), low(r[0])))[n * k : n * k + k])}


def made(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sold = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(120 * 86400 // 3600) * 3600)
        out.append((i, i % 7, rng.choice(["done", "open", None]), rng.choice([None, 1.25, 74.19, 0.0, -3.5]), rng.choice([sold] * 9 + [None]), rng.choice([sold + dt.timedelta(hours=rng.randrange(300))] * 9 + [None]), rng.choice([1, None])))
    out += [(r[0], 99, *r[2:5], None if r[5] is None else r[5] + dt.timedelta(days=rng.randrange(60)), 5) for r in out[:200]]
    out += [(7, *r[1:]) for r in out[:300]]  # one id with many rows
    out += [*out[:40], (None, 1, "x", 1.0, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), 1), (None, 2, "x", 1.0, dt.datetime(2024, 1, 6), dt.datetime(2024, 4, 5), 1)]
    out.append((-5, 1, "before", float("nan"), dt.datetime(1969, 12, 30, 23), dt.datetime(2024, 1, 1), 1))
    return out


@pytest.mark.parametrize("n", [2500, 40])
def test_overwrite_against_plain(spark, n):
    sales = made(n)
    df = spark.createDataFrame(sales, SCHEMA).repartition(5)
    got = {(r.day, r.file_no): r for r in dl.overwritten(df).collect()}
    want = plain(sales)
    assert got.keys() == want.keys()
    text = lambda v: "" if v is None else str(v)
    for key, (rows, again) in want.items():
        r = got[key]
        assert r.rewritten == again and r.n_rows == len(rows) and r.columns == ",".join(df.columns)
        assert r.cents == sum(math.floor(100 * x[3] + 0.5) for x in rows if x[3] is not None and x[3] == x[3])
        assert r.rows_crc == sum(zlib.crc32(f"{text(x[0])}:{text(us(x[4]))}:{text(us(x[5]))}".encode()) for x in rows)
        assert r.ids_sha256 == hashlib.sha256(",".join(text(x[0]) for x in rows).encode()).hexdigest()
        assert [repr(tuple(x.values())) for x in pq.read_table(r.path).to_pylist()] == [repr(x) for x in rows]
    top = os.path.dirname(os.path.dirname(next(iter(got.values())).path))
    assert sorted(glob.glob(f"{top}/**/*.parquet", recursive=True)) == sorted(r.path for r in got.values())
    assert {r.rewritten for r in got.values()} == {True, False} or n == 40


def test_clean_files_keep_their_bytes_and_days_may_vanish(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    cut = "2024-01-20T00:00:00"
    rows = [(1, t(1), t(1), "a"), (2, t(1, 5), t(1), "b"), (3, t(2), t(2), "c"), (3, t(4), t(25), "moved"), (4, t(3), t(3), "stays")]
    df = spark.createDataFrame(rows, "`Order Id` int, `at` timestamp, `c1` timestamp, `day` string")
    layout = dl.Layout("Order Id", "at", "c1", per_file=1)
    first = str(tmp_path / "first")
    whole = dl.rewrite_days(dl.latest(df, cut, layout).where("start is not null").selectExpr("start.day", "1 AS kind", "start AS row"), df.schema, first, layout, "first")
    assert sorted((r.day, r.file_no) for r in whole) == [(19723, 0), (19723, 1), (19724, 0), (19725, 0)]
    folder = str(tmp_path / "all")
    files = {(r.day, r.file_no): r for r in dl.start_and_overwrite(df, folder, cut, layout).collect()}
    assert {k: r.rewritten for k, r in files.items()} == {(19723, 0): False, (19723, 1): False, (19725, 0): False, (19726, 0): True}
    assert not os.path.exists(f"{folder}/day_19724")
    for r in files.values():
        if not r.rewritten:
            same = r.path.replace(folder, first)
            assert open(r.path, "rb").read() == open(same, "rb").read()
    back = spark.read.parquet(*[r.path for r in files.values()])
    assert back.schema == df.schema and sorted(r[3] for r in back.collect()) == ["a", "b", "moved", "stays"]
    assert dl.start_and_overwrite(df.limit(0), str(tmp_path / "none"), cut, layout).count() == 0


def test_moving_again_changes_nothing(spark, tmp_path):
    folder, drafts = str(tmp_path / "l"), str(tmp_path / "d")
    os.makedirs(f"{folder}/day_3")
    os.makedirs(drafts)
    for path in (f"{folder}/day_3/first-000000.parquet", f"{drafts}/x"):
        open(path, "w").write(path)
    R = spark.createDataFrame([(3, 0, 1, "x", "day_3/late-000000.parquet")], dl.FILES).collect()
    for _ in range(2):
        dl._moved_to_places(spark, folder, drafts, R)
        assert os.listdir(f"{folder}/day_3") == ["late-000000.parquet"] and not os.path.exists(drafts)


def test_sort_is_external(tmp_path):
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("at", pa.timestamp("us")), ("text", pa.string())])
    work = dl._Day(1, schema, 0, 1, str(tmp_path))
    rng = np.random.default_rng(0)
    for _ in range(8):  # some 400 MB of rows against 256 MB of memory
        ids = rng.integers(0, 1 << 60, 50_000)
        work.add(np.ones(len(ids), dtype=int), pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids % 1000, pa.timestamp("us")), pa.array([str(i) * 52 for i in ids])], names=["a", "b", "c"]))
    fs, _ = dl.open_fs(str(tmp_path))
    files = list(work.write(fs, [], str(tmp_path), 150_000))
    work.close()
    assert [n for _, n, _ in files] == [150_000, 150_000, 100_000]
    keys = [k for _, _, path in files for k in zip(*[pq.read_table(path, columns=[c])[c].to_pylist() for c in ("at", "id")], strict=True)]
    assert keys == sorted(keys)
