"""Sequence similarity by longest common subsequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a, b) -> int:
    """Length of the longest common subsequence, row by row over a with numpy over b."""
    if len(a) == 0 or len(b) == 0:
        return 0
    names: dict = {}
    x = np.array([names.setdefault(v, len(names)) for v in a])
    y = np.array([names.setdefault(v, len(names)) for v in b])
    best = np.zeros(len(y) + 1, np.int64)
    for v in x:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(y == v, best[:-1] + 1, 0)))
    return int(best[-1])


def common(a, b) -> list:
    """A longest common subsequence; of several, the one that takes a's units first."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i, j + 1] >= best[i + 1, j]:
            j += 1
        else:
            i += 1
    return out


def common_units(a: Column, b: Column) -> Column:
    """A longest common subsequence of two arrays of strings; null for null."""

    def units(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else common(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(units, T.ArrayType(T.StringType()))(a, b)


def lcs_length(a: Column, b: Column) -> Column:
    def lengths(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else lcs(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return F.pandas_udf(lengths, T.IntegerType())(a, b)


def lcs_similarity(a: Column, b: Column) -> Column:
    """2 * lcs / (n + m); 1 for two empty sequences."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * lcs_length(a, b) / total)


def reference_similarity(a: Column, b: Column) -> Column:
    """The common subsequence of reference lists as a part of the second one; null if that is empty."""
    return F.try_divide(lcs_length(a, b), F.size(b))
