"""Every query with an SQL twin, against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest

from strataspark.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    """By all values but doubles, then by those."""
    return sorted(rows, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr([v for v in r if isinstance(v, float)])))


def same(a, b):
    """Doubles may differ in the last rounded digit."""
    return abs(a - b) <= 1.5e-6 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = ordered(tuple(clean(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = ordered(tuple(clean(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(same(x, y) for x, y in zip(a, b)), (a, b)
