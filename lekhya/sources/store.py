"""The document store and the search index as parquet tables: append, scan, get, delete, upsert, save, load, search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.operators import embed, search
from lekhya.session import materialise


def scan(documents: DataFrame) -> DataFrame:
    return documents.orderBy("ingest_seq")


def get(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.filter(F.col("doc_id") == doc_id)


def without(df: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not deleted."""
    return df.join(tombstones.select(key), key, "left_anti")


def dense_ids(df: DataFrame, order: str, name: str = "internal_id") -> DataFrame:
    """Consecutive ids from 0 in the given order, without ordering everything in one task.

    Rows are range-partitioned and numbered within their partition; the offsets are one row per partition.
    """
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "ids")
    sizes = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())
    at, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return placed.join(F.broadcast(table), "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


class Index:
    """Documents, vectors and postings in a folder. Postings are kept with the vectors and stay right when documents are added or removed.

    Rows carry the version (the number of the change) that wrote them; a removal names a doc_id and the last version it covers,
    so nothing is rewritten until `compact`. Postings lie in folders by the hash of their term, and a search reads the
    folders of its own terms only. Kinds: flat (squared distance), cosine (inner product), ivf (squared distance within the
    `probes` nearest of `lists` cells, fitted on at most `max_sample` vectors; every vector is in a cell, folders by cell).
    Texts of queries are embedded by `embedder` (the offline stand-in unless a model is given).

    Defined results: a document added again counts with its last text, and each of its vectors stays (upsert drops the old ones);
    null texts have no postings; vectors of another length are refused; results are ordered by score, then id.
    """

    KINDS = ("flat", "cosine", "ivf")

    def __init__(
        self, spark: SparkSession, path: str, dimension: int = 384, kind: str = "flat", buckets: int = 32, counter: int = 0, version: int = 0,
        embedder: Callable[[list[str]], np.ndarray] | None = None, lists: int = 100, probes: int = 10, max_sample: int = 40_000,
    ):
        if kind not in self.KINDS:
            kind = "flat"
        self.spark, self.path, self.dimension, self.kind = spark, path.rstrip("/"), dimension, kind
        self.buckets, self.counter, self.version = buckets, counter, version
        self.embedder = embedder or (lambda texts: embed.hashed(texts, dimension))
        self.lists, self.probes, self.max_sample = lists, probes, max_sample

    # ---- writing

    def save(self, documents: DataFrame, vectors: DataFrame, buckets: int | None = None) -> None:
        """Start the index anew; one bucket of postings for each 100,000 documents unless their number is given."""
        self.buckets = buckets or int(min(4096, max(32, documents.count() // 100_000)))
        self.counter = self.version = 0
        self.spark.createDataFrame([], "doc_id long, version int").write.mode("overwrite").parquet(f"{self.path}/removed")
        if self.kind == "ivf":
            self._fit(vectors)
        self._append(documents, vectors, "overwrite")

    def add(self, documents: DataFrame, vectors: DataFrame) -> None:
        """Append documents with their vectors and postings. Vectors without internal_id get the next ones."""
        self._append(documents, vectors, "append")

    def upsert(self, documents: DataFrame, vectors: DataFrame) -> None:
        """Replace the documents with the same ids, or add them."""
        self._remove(documents.select("doc_id"))
        self._append(documents, vectors, "append")

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents of ids(doc_id), with their vectors and postings; unknown ids are ignored."""
        self._remove(ids.select("doc_id"))
        self._meta()

    def compact(self) -> None:
        """Write the rows that count to a new index in the same folder."""
        docs, vectors = materialise(self._whole(), "docs"), materialise(self.vectors(), "vectors")
        counter = self.counter
        self.save(docs, vectors, self.buckets)
        self.counter = counter
        self._meta()

    def _remove(self, ids: DataFrame) -> None:
        ids.filter("doc_id IS NOT NULL").distinct().select("doc_id", F.lit(self.version).alias("version")).write.mode("append").parquet(f"{self.path}/removed")
        self.version += 1

    def _append(self, documents: DataFrame, vectors: DataFrame, mode: str) -> None:
        if vectors.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension).limit(1).count():
            raise ValueError(f"vectors must have {self.dimension} components")
        if "internal_id" not in vectors.columns:
            start = self.counter
            vectors = dense_ids(vectors, "doc_id").withColumn("internal_id", F.col("internal_id") + start)
        version = F.lit(self.version).alias("version")
        meta = documents.select(*(c for c in documents.columns if c not in ("text", "version", "preview")), search.preview(F.col("text")).alias("preview"), version)
        meta.write.mode(mode).parquet(f"{self.path}/docs")
        documents.select("doc_id", "text", version).write.mode(mode).parquet(f"{self.path}/texts")
        rows = vectors.select("internal_id", "doc_id", "embedding", version)
        if self.kind == "ivf":
            rows.withColumn("cell", self._cell(F.col("embedding"))).hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")
        else:
            rows.write.mode(mode).parquet(f"{self.path}/vectors")
        posted = search.postings(documents).select("term", "doc_id", version, F.pmod(F.xxhash64("term"), F.lit(self.buckets)).alias("bucket"))
        # rebalanced by bucket: a bucket of any size is written by as many tasks as it needs
        posted.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")
        last = self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("version") == self.version).agg(F.max("internal_id")).first()[0]
        self.counter = self.counter if last is None else max(self.counter, last + 1)
        self.version += 1
        self._meta()

    def _meta(self) -> None:
        row = (self.dimension, self.kind, self.buckets, self.counter, self.version, self.lists, self.probes)
        schema = "dimension int, kind string, buckets int, counter long, version int, lists int, probes int"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Callable[[list[str]], np.ndarray] | None = None) -> Index:
        m = spark.read.parquet(f"{path.rstrip('/')}/meta").first()
        return cls(spark, path, m.dimension, m.kind, m.buckets, m.counter, m.version, embedder, m.lists, m.probes)

    # ---- cells of the ivf kind

    def _fit(self, vectors: DataFrame) -> None:
        some = vectors.filter(F.size("embedding") == self.dimension).orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_sample)
        data = some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        k = max(2, min(self.lists, data.count()))
        centres = [(i, c.tolist()) for i, c in enumerate(KMeans(k=k, seed=42, maxIter=10).fit(data).clusterCenters())]
        self.spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def _centres(self) -> np.ndarray:
        """At most `lists` rows."""
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()])

    def _cell(self, c):
        centres = self._centres()
        half = (centres**2).sum(1) / 2

        @F.pandas_udf("int")
        def cell(v):
            import pandas as pd

            return pd.Series((np.stack([np.asarray(x, dtype=np.float64) for x in v]) @ centres.T - half).argmax(1))

        return cell(c)

    # ---- reading

    def table(self, name: str) -> DataFrame:
        """The rows of docs, vectors or postings that no removal covers."""
        removed = self.spark.read.parquet(f"{self.path}/removed").groupBy("doc_id").agg(F.max("version").alias("until"))
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        kept = rows.join(removed.withColumnRenamed("doc_id", "_gone"), (F.col("doc_id") == F.col("_gone")) & (F.col("version") <= F.col("until")), "left_anti")
        return kept

    def documents(self, ids: DataFrame | None = None) -> DataFrame:
        """The last entry of every document, or of those of ids(doc_id), which are the hits of a search: all columns but the text, with a preview."""
        docs = self.table("docs")
        if ids is not None:
            docs = docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
        cols = [c for c in docs.columns if c != "version"]
        return docs.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "version").alias("d")).select("d.*")

    def vectors(self) -> DataFrame:
        return self.table("vectors").select("internal_id", "doc_id", "embedding")

    def get(self, doc_id: int) -> DataFrame:
        """The last entry of one document with its text; no row if there is none."""
        return self._whole(F.col("doc_id") == doc_id)

    def _whole(self, which=None) -> DataFrame:
        docs, texts = self.table("docs"), self.table("texts")
        if which is not None:
            docs, texts = docs.filter(which), texts.filter(which)
        rows = docs.join(texts, ["doc_id", "version"])
        cols = [c for c in rows.columns if c not in ("version", "preview")]
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "version").alias("d")).select("d.*")

    def size(self) -> int:
        return self.vectors().count()

    def postings(self, query: str | None = None) -> DataFrame:
        """(term, doc_id), distinct; for a query only those of its terms, read from their buckets alone."""
        rows = self.table("postings")
        if query is not None:
            terms = search.query_terms(self.spark, query).select("term", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).alias("bucket")).collect()
            rows = rows.filter(F.col("bucket").isin(sorted({r.bucket for r in terms})) & F.col("term").isin([r.term for r in terms]))
        return rows.select("term", "doc_id").distinct()

    def near(self, vector: list[float]) -> DataFrame:
        """The vectors that a search looks at: all, or for ivf those of the nearest cells."""
        if self.kind != "ivf":
            return self.vectors()
        d = ((self._centres() - np.asarray(vector, dtype=np.float64)) ** 2).sum(1)
        cells = [int(c) for c in np.argsort(d, kind="stable")[: self.probes]]
        return self.table("vectors").filter(F.col("cell").isin(cells)).select("internal_id", "doc_id", "embedding")

    def embedding_of(self, query: str) -> list[float]:
        return np.asarray(self.embedder([query])[0], dtype=np.float64).tolist()

    # ---- searching

    def keyword(self, query: str, k: int = 10) -> DataFrame:
        return search.keyword_search(self.postings(query), query, k)

    def semantic(self, query: str | list[float], k: int = 10) -> DataFrame:
        vector = self.embedding_of(query) if isinstance(query, str) else query
        return search.semantic_search(self.near(vector), vector, k, "ip" if self.kind == "cosine" else "l2")

    def hybrid(self, query: str, vector: list[float] | None = None, k: int = 10, filters: dict | None = None, **weights) -> DataFrame:
        vector = self.embedding_of(query) if vector is None else vector
        hits = search.hybrid_candidates(self.postings(query), self.near(vector), query, vector, k)
        hits = hits.join(self.vectors().select("doc_id"), "doc_id", "left_semi")
        return search.hybrid_ranked(hits, self.documents(hits), k, filters=filters, **weights)

    def search(self, query: str, vector: list[float] | None = None, mode: str = "hybrid", k: int = 10, **options) -> DataFrame:
        """Dispatch: keyword, semantic, anything else hybrid; filters and weights are for hybrid searches. Ordered by score, then id."""
        if mode not in ("keyword", "semantic"):
            return self.hybrid(query, vector, k, **options)
        if mode == "keyword":
            hits, order = self.keyword(query, k).join(self.vectors().select("doc_id"), "doc_id", "left_semi"), "doc_id"
        else:
            hits, order = self.semantic(query if vector is None else vector, k), "internal_id"
        docs = self.documents(hits).select("doc_id", F.col("doc_name").alias("title"), "preview")
        best = F.round("score", 9)
        return docs.join(F.broadcast(hits), "doc_id").orderBy(best.asc() if mode == "semantic" and self.kind == "cosine" else best.desc(), order)  # at most k hits
