import decimal

import pandas as pd


def plain(v):
    """A value as text that both engines' results share; floats to nine digits."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (not isinstance(v, list) and pd.isna(v)):
        return None
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b) if x != y][:3] == []
