"""Rows of a query and of its SQL, brought to one form."""

import math


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(records, columns):
    out = [tuple(norm(r[c]) for c in columns) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, con, sql):
    columns = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    assert rows(df.collect(), columns) == rows(want, columns)
