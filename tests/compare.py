"""Spark rows against DuckDB rows, whatever their order."""

import math


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    a = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    b = sorted(tuple(norm(r[i]) for i in at) for r in relation.fetchall())
    assert len(a) == len(b)
    assert a == b
