"""Exact nearest neighbours for one query vector or for a stated set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.session import nonempty

METRICS = ("l2", "ip", "cosine")


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x against rows of q; smaller is nearer."""
    if metric == "l2":
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ q.T + (q**2).sum(1)[None, :], 0)
    s = x @ q.T
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        s = np.where(n == 0, 0.0, s / np.where(n == 0, 1, n))
    return -s


def distance_to(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Squared distance, or minus the inner product or cosine, to one query vector; null where the vector is null or of another length."""
    q = np.asarray(query, dtype=np.float64)[None, :]

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="Float64")
        ok = np.array([x is not None and len(x) == q.shape[1] for x in v], dtype=bool)
        if ok.any():
            x = np.stack([np.asarray(y, dtype=np.float64) for y in v[ok]])
            d = ((x - q) ** 2).sum(1) if metric == "l2" else _scores(metric, x, q)[:, 0]
            out[ok] = d
        return out

    return run(vector)


def nearest(vectors: DataFrame, query: list[float], id_col: str, k: int = 10, metric: str = "l2") -> DataFrame:
    """(id, d) of the k nearest, ties by id; a top-k without a full sort. Vectors with no finite distance are left out."""
    d = vectors.select(F.col(id_col), distance_to(F.col("embedding"), query, metric).alias("d"))
    return d.filter(F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf"))).orderBy("d", id_col).limit(k)


def batch_nearest(vectors: DataFrame, queries: DataFrame, id_col: str, k: int = 10, metric: str = "l2", block: int = 4096) -> DataFrame:
    """(query, id, d): the k nearest of every query vector, in blocks of queries; all rows are scanned once per block."""
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // block))
    out = None
    for p in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == p).select(id_col, "embedding").toPandas()
        if not len(mine):
            continue
        boxed = spark.sparkContext.broadcast((mine[id_col].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in mine["embedding"]])))

        @nonempty
        def scan(batches: Iterator[pd.DataFrame], boxed=boxed) -> Iterator[pd.DataFrame]:
            ids, q = boxed.value
            for b in batches:
                b = b[[v is not None and len(v) == q.shape[1] for v in b["embedding"]]]
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, dtype=np.float64) for v in b["embedding"]])
                d = _scores(metric, x, q).T
                d[~np.isfinite(d)] = np.inf
                own = b[id_col].to_numpy()
                order = np.lexsort((np.broadcast_to(own, d.shape), np.round(d, 9)), axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(ids, order.shape[1]), id_col: own[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})

        part = vectors.select(id_col, "embedding").mapInPandas(scan, f"query long, {id_col} long, d double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], f"query long, {id_col} long, d double")
    best = out.filter(F.col("d") < float("inf")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 9).alias("r"), id_col, "d"))), 1, k).alias("l"))
    return best.select("query", F.inline("l")).select("query", id_col, "d")
