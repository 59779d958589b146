import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, list) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalog.SQL:
        c = duckdb.connect()
        for f in os.listdir(FOLDER):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
        r = c.execute(catalog.SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert rows == Counter(tuple(plain(x[names.index(n)]) for n in cols) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
