"""Clustering and value regression on MLlib, and the closed-form statistics beside them.

Missing values take the defaults area 0, value 0, bedrooms 2, bathrooms 1, year 2020, location score 5; repeated rows
count once. MLlib's labels are arbitrary: compare partitions, not numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.session import lookup_rows, materialise
from lekhya.sources.store import dense_ids

# The features of a property and their defaults.
DEFAULTS = {"area": 0.0, "bedrooms": 2, "bathrooms": 1, "year_built": 2020, "location_score": 5.0}
PRICE_PER_UNIT, DEFAULT_AREA = 10_000.0, 1000.0


def with_defaults(features: DataFrame) -> DataFrame:
    """(doc_id, area, bedrooms, bathrooms, year_built, location_score, value_rs) with defaults filled in."""
    f = features.dropDuplicates()
    return f.select("doc_id", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in DEFAULTS.items()), "value_rs")


def standardised(features: DataFrame) -> DataFrame:
    """(doc_id, area_z, value_z, year_z): population standard scores; a constant column divides by one. The statistics are one row."""
    f = features.dropDuplicates().select("doc_id", F.coalesce("area", F.lit(0.0)).alias("a"), F.coalesce("value_rs", F.lit(0.0)).alias("v"), F.coalesce("year_built", F.lit(2020)).cast("double").alias("y"))
    stats = f.agg(*(g(c).alias(f"{c}{n}") for c in "avy" for n, g in (("m", F.avg), ("s", F.stddev_pop))))
    j = f.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"{c}m")) / F.when(F.col(f"{c}s") == 0, 1.0).otherwise(F.col(f"{c}s"))
    return j.select("doc_id", z("a").alias("area_z"), z("v").alias("value_z"), z("y").alias("year_z"))


def price_heuristic(features: DataFrame) -> DataFrame:
    """(doc_id, predicted_value, confidence, low, high) of the untrained predictor."""
    p = F.coalesce("area", F.lit(DEFAULT_AREA)) * PRICE_PER_UNIT
    return features.dropDuplicates().select("doc_id", p.alias("predicted_value"), F.lit(0.3).alias("confidence"), (p * 0.7).alias("low"), (p * 1.3).alias("high"))


def kmeans(df: DataFrame, features: str = "features", k: int = 5, seed: int = 42, starts: int = 10) -> DataFrame:
    """df with `cluster`: the best of `starts` runs by training cost; k shrinks to max(2, n//2) for fewer than k rows."""
    n = df.count()
    k = k if n >= k else max(2, n // 2)
    best = None
    df = df.persist()
    for s in range(starts):
        model = KMeans(k=k, seed=seed + s, featuresCol=features, predictionCol="cluster").fit(df)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    df.unpersist()
    return best.transform(df)


def cluster_embeddings(vectors: DataFrame, id_col: str, **options) -> DataFrame:
    return kmeans(vectors.select(id_col, array_to_vector("embedding").alias("features")), **options).select(id_col, "cluster")


def cluster_properties(features: DataFrame, **options) -> DataFrame:
    f = features.dropDuplicates().select("doc_id", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("value_rs", F.lit(0.0)).alias("value_rs"), F.coalesce("year_built", F.lit(2020)).cast("double").alias("year"))
    made = VectorAssembler(inputCols=["area", "value_rs", "year"], outputCol="raw").transform(f)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(made).transform(made)
    return kmeans(scaled, **options).select("doc_id", "cluster")


def cluster_info(assigned: DataFrame, id_col: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(cluster, size[, centroid][, ids]) of assigned(id, cluster): with an id column the members, in order; with vectors(id, embedding) the centroid too."""
    out = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    if id_col and vectors is not None:
        each = assigned.join(vectors, id_col).select("cluster", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        middle = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
        out = out.join(middle, "cluster")
    if id_col:  # the members of a cluster are its result; use the assignment itself where clusters are too large for a row
        out = out.join(assigned.groupBy("cluster").agg(F.array_sort(F.collect_list(id_col)).alias("ids")), "cluster")
    return out


def cluster_documents(vectors: DataFrame, id_col: str = "doc_id", k: int = 5) -> tuple[int, DataFrame]:
    """(number of clusters that have members, (cluster, size, centroid, ids))."""
    info = materialise(cluster_info(cluster_embeddings(vectors, id_col, k=k), id_col, vectors.select(id_col, "embedding")), "clusters")
    return info.count(), info


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str) -> DataFrame:
    """(id, cluster): the nearest of a few centroids (cluster, centroid), ties by the smaller cluster; the centroids are checked to be few."""
    rows = sorted((r.cluster, list(r.centroid)) for r in lookup_rows(centroids.select("cluster", "centroid"), 10_000))
    labels, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)

    @F.pandas_udf("int")
    def assign(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(y, dtype=np.float64) for y in v])
        return pd.Series(labels[((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)])

    return vectors.select(id_col, assign("embedding").alias("cluster"))


def model_of(kind: str, seed: int = 42):
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed, featureSubsetStrategy="all", labelCol="value_rs")
    if kind == "gradient_boosting":
        return GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed, labelCol="value_rs")
    return LinearRegression(labelCol="value_rs")


def metrics(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(mae, r2, n) of predictions: one row; r2 against the labels' mean. One pass: the sums of squares come from the moments."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    return predicted.agg(F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), F.count("*").alias("n"))


def quantile(values: Column, share: float) -> Column:
    """A quantile of an array of doubles, by linear interpolation between its ordered values."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (at - low)


def interval(prediction: Column, values: Column) -> list[Column]:
    """confidence, low and high of an ensemble: the tenth and ninetieth percentile of its members' predictions, and how near they are for the prediction."""
    low, high = quantile(values, 0.1), quantile(values, 0.9)
    c = F.when(prediction > 0, 1 - (high - low) / prediction).otherwise(0.5)
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"), low.alias("low"), high.alias("high")]


class ValuePredictor:
    """Value regression: train, metrics, predict with an interval, save and load. Untrained, it estimates by area.

    Features are columns with the defaults of missing values; rows without a label take no part in training.
    """

    def __init__(self, kind: str = "random_forest", features: dict[str, float] | None = None, label: str = "value_rs", key: str = "doc_id"):
        self.kind, self.features, self.label, self.key, self.model = kind, dict(features or DEFAULTS), label, key, None

    def _rows(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(self.key, *(F.coalesce(c, F.lit(d)).alias(c) for c, d in self.features.items()), *more).dropDuplicates()

    def train(self, features: DataFrame, test_share: float = 0.2, seed: int = 42) -> dict:
        """Fit on all but the test rows: exactly ceil(share * n) of them, those that come first by a hash. The scaler is fitted on the training rows alone."""
        rows = self._rows(features, self.label).filter(F.col(self.label).isNotNull())
        placed = materialise(dense_ids(rows.withColumn("_h", F.xxhash64(self.key, *self.features, F.lit(seed))), "_h", "_at"), "split")
        held = math.ceil(placed.count() * test_share)
        train, test = placed.filter(F.col("_at") >= held), placed.filter(F.col("_at") < held)
        steps = [VectorAssembler(inputCols=list(self.features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model_of(self.kind, seed).setLabelCol(self.label)]
        self.model = Pipeline(stages=steps).fit(train)
        m = metrics(self.model.transform(test), self.label).first()
        return {"mae": m.mae, "r2": m.r2, "train_samples": train.count(), "test_samples": m.n}

    def predict(self, features: DataFrame) -> DataFrame:
        """(key, predicted_value, confidence, low, high)."""
        if self.model is None:
            return price_heuristic(features)
        p = self.model.transform(self._rows(features))
        value = F.col("prediction").alias("predicted_value")
        if self.kind != "random_forest":
            return p.select(self.key, value, F.lit(0.7).alias("confidence"), (F.col("prediction") * 0.85).alias("low"), (F.col("prediction") * 1.15).alias("high"))
        # each tree as arrays of (feature, threshold, left, right, value): evaluated for a whole batch at once
        flat = [_tree_arrays(t) for t in self.model.stages[-1].trees]

        @F.pandas_udf("array<double>")
        def each(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy())
            return pd.Series(list(np.stack([_tree_predict(t, x) for t in flat], axis=1)))

        q = p.withColumn("each", each(vector_to_array("features")))
        return q.select(self.key, value, *interval(F.col("prediction"), F.col("each")))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, kind: str = "random_forest", **options) -> ValuePredictor:
        out = cls(kind, **options)
        out.model = PipelineModel.load(path)
        return out


def _tree_arrays(tree) -> list[tuple]:
    """A fitted tree as a list of nodes (feature or -1, threshold, left, right, value)."""
    nodes: list[tuple] = []

    def walk(n) -> int:
        at = len(nodes)
        nodes.append(())
        if n.numDescendants() == 0:
            nodes[at] = (-1, 0.0, -1, -1, n.prediction())
        else:
            left, right = walk(n.leftChild()), walk(n.rightChild())
            nodes[at] = (n.split().featureIndex(), n.split().threshold(), left, right, 0.0)
        return at

    walk(tree._java_obj.rootNode())
    return nodes


def _tree_predict(nodes: list[tuple], x):
    f, t, le, ri, v = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.flatnonzero(f[at] >= 0)
        if not len(inner):
            return v[at]
        a = at[inner]
        at[inner] = np.where(x[inner, f[a]] <= t[a], le[a], ri[a])
