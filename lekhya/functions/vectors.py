"""Vector functions: column expressions for definitions, Arrow matrix products for throughput."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 where a norm is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n))


def is_valid(c: Column, dim: int) -> Column:
    """Right length and all components finite."""
    return (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


@F.pandas_udf(T.DoubleType())
def cosine_fast(a: pd.Series, b: pd.Series) -> pd.Series:
    def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return np.where(n == 0, 0.0, (x * y).sum(axis=1) / np.where(n == 0, 1, n))

    return _pairwise(a, b, f)


def _pairwise(a: pd.Series, b: pd.Series, f) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if ok.any():
        x = np.stack([np.asarray(v, dtype=np.float64) for v in a[ok]])
        y = np.stack([np.asarray(v, dtype=np.float64) for v in b[ok]])
        out[ok] = f(x, y)
    return pd.Series(out).astype("Float64").where(ok)
