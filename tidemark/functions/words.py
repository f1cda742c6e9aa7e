"""Differences between texts word by word, and three-way merging of them."""

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edit:
    """Words start to end of the base give way to `words`."""

    start: int
    end: int
    words: tuple[str, ...]


def split_words(text: str | None) -> list[str]:
    return (text or "").split()


def diff_words(base: list[str], other: list[str]) -> list[Edit]:
    match = SequenceMatcher(None, base, other, autojunk=False)
    return [Edit(a, b, tuple(other[c:d])) for kind, a, b, c, d in match.get_opcodes() if kind != "equal"]


def overlap(a: list[Edit], b: list[Edit]) -> bool:
    """Whether edits of both touch the same words, or the same place, in different ways."""
    return any(x != y and (x.start < y.end and y.start < x.end or x.start == y.start) for x in a for y in b)


def apply_edits(base: list[str], edits: list[Edit]) -> list[str]:
    out, at = [], 0
    for e in sorted(edits, key=lambda e: (e.start, e.end)):
        out += base[at : e.start]
        out += e.words
        at = e.end
    return out + base[at:]


def merge_words(base: str | None, *texts: str | None) -> str | None:
    """The text with all sides' edits of base; None if any two of them overlap."""
    words = split_words(base)
    sides = [diff_words(words, split_words(t)) for t in texts]
    if any(overlap(a, b) for i, a in enumerate(sides) for b in sides[:i]):
        return None
    return " ".join(apply_edits(words, list(dict.fromkeys(e for side in sides for e in side))))


def _merged(base: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else merge_words(b, *t) for b, t in zip(base, texts, strict=True)], dtype=object)


def _edits(base: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([[{"start": e.start, "end": e.end, "words": list(e.words)} for e in diff_words(split_words(a), split_words(b))] for a, b in zip(base, other, strict=True)])


def merged(base: Column, texts: Column) -> Column:
    """merge_words() of an array of texts; null for a null array."""
    return F.pandas_udf(_merged, "string")(base, texts)


def edits(base: Column, other: Column) -> Column:
    return F.pandas_udf(_edits, "array<struct<start:int,end:int,words:array<string>>>")(base, other)


def word_array(text: Column) -> Column:
    """The words between white space, without Python."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
