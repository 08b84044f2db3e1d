"""Rows of either engine in one form."""

from decimal import Decimal

import pandas as pd


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([plain(x) for x in v])
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
