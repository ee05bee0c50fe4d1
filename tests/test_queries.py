"""Every query of the library against its DuckDB equivalent, on the smallest tables."""

import math

import pytest

from heddle import queries

FOUND, SQL = queries.load()


def rows(columns, data):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v.isoformat() if hasattr(v, "isoformat") else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(name, spark, sf, duck):
    df = FOUND[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
