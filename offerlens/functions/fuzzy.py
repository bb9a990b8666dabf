"""Normalised Indel similarity and the weighted mapping score.

ratio = 100 * 2 * LCS / (len a + len b), by bit-parallel longest common
subsequences on Python integers, in Arrow batches.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(50_000)
def _masks(a: str) -> dict[str, int]:
    """The places of each character, as bits; a string meets many others in a batch."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    masks = _masks(a)
    row = full = (1 << len(a)) - 1
    for ch in b:
        if ch in masks:
            hit = row & masks[ch]
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 100.0 if not size else 200.0 * lcs_length(a, b) / size


@lru_cache(50_000)
def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_tokens(a), _sorted_tokens(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of shared tokens against shared plus own tokens of either side, and of these against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    found = ratio(with_x, with_y)
    return max(found, ratio(both, with_x), ratio(both, with_y)) if both else found


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}  # names repeat within a batch
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            found = known.get(pair)
            if found is None:
                found = known[pair] = f(*pair)
            out.append(found)
        return pd.Series(out, dtype="float64")

    return run


def ratio_of(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(a, b)


def token_sort_ratio_of(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio)(a, b)


def token_set_ratio_of(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio)(a, b)


def weighted_score(same_fingerprint: Column, parts: list[Column]) -> Column:
    """100 for the same fingerprint; else the mean of the parts that are not null, the first of them weighing 1.5."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    n = F.size(known)
    mean = (F.aggregate(known, F.lit(0.0), lambda a, x: a + x) + F.get(known, F.lit(0)) * 0.5) / (n + 0.5)
    return F.when(same_fingerprint, F.lit(100.0)).when(n == 0, F.lit(0.0)).when(n == 1, F.get(known, F.lit(0))).otherwise(mean)
