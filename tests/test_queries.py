"""Every query that has SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


MAY_BE_EMPTY: set[str] = set()  # no query gives nothing on the given tables


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()]
    mine = [tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in sorted(names)]).collect()]
    assert sorted(mine, key=repr) == sorted(rows, key=repr)
    assert rows or name in MAY_BE_EMPTY


def test_every_other_query_has_a_plain_version():
    from .test_plain import CASES

    assert {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith(("op", "pipeline"))} == set(CASES)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
