"""Fractional positions: arrays of longs, ordered element by element, a prefix before what it begins.

between(), before() and after() always find room: nothing ends in 0, so there is a position below any other.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance between lines that are appended, and below a line that something is put before.
SPACING, STEP = 10000, 10


def first() -> list[int]:
    return [SPACING]


def after(p: list[int]) -> list[int]:
    return [*p[:-1], p[-1] + SPACING]


def before(p: list[int]) -> list[int]:
    """Below p: STEP less where there is room, else half, else deeper."""
    if p[0] > STEP:
        return [p[0] - STEP]
    if p[0] > 1:
        return [p[0] // 2]
    if p[0] == 1:
        return [0, SPACING // 2]
    if len(p) == 1:
        raise ValueError("nothing comes before [0]")
    return [0, *before(p[1:])]


def between(a: list[int], b: list[int]) -> list[int]:
    """Strictly between a and b, which must be in order and not one the other followed by zeros."""
    for k in range(len(b)):
        if k == len(a):  # a is a prefix of b
            return [*a, *_below(b[k:])]
        gap = b[k] - a[k]
        if gap < 0:
            break
        if gap > 1:
            return [*a[:k], a[k] + gap // 2]
        if gap == 1:  # no room here: go on behind a's next level
            return [*a[: k + 1], a[k + 1] + SPACING] if len(a) > k + 1 else [*a, SPACING]
    raise ValueError(f"{a} doesn't come before {b}")


def _below(p: list[int]) -> list[int]:
    if p[0] > 1:
        return [p[0] // 2]
    if p[0] == 1:
        return [0, SPACING]
    if len(p) == 1:
        raise ValueError("there is no room below a final 0")
    return [0, *_below(p[1:])]


def spread(a: list[int] | None, b: list[int] | None, n: int) -> list[list[int]]:
    """n ascending positions in the gap from a to b; None is an open end."""
    if n <= 0:
        return []
    if b is None:
        out = [after(a) if a else first()]
        while len(out) < n:
            out.append(after(out[-1]))
        return out
    if a is None:
        out = [before(b)]
        while len(out) < n:
            out.append(before(out[-1]))
        return out[::-1]
    mid = between(a, b)
    left = (n - 1) // 2
    return [*spread(a, mid, left), mid, *spread(mid, b, n - 1 - left)]


def _in_gap(a: pd.Series, b: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    known: dict = {}

    def one(x, y, count: int, at: int) -> list[int]:
        gap = (None if x is None else tuple(map(int, x)), None if y is None else tuple(map(int, y)), int(count))
        if gap not in known:
            known[gap] = spread(*(list(g) if g is not None else None for g in gap[:2]), gap[2])
        return known[gap][int(at)]

    return pd.Series([one(*row) for row in zip(a, b, n, k, strict=True)])


def in_gap(a: Column, b: Column, n: Column, k: Column) -> Column:
    """The k-th of n positions between a and b; a null is an open end."""
    return F.pandas_udf(_in_gap, "array<bigint>")(a, b, n, k)


def bulk(index: Column) -> Column:
    """The position of the index-th of lines that are loaded together."""
    return F.array((SPACING * (index + 1)).cast("long"))


def dotted(p: Column) -> Column:
    return F.array_join(p.cast("array<string>"), ".")
