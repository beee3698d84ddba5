"""Keyword, semantic and hybrid search, metadata filters, and the two simple search variants.

Orderings are total: score, then doc_id (or the ingest order where that is the contract). Null texts have no terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.functions.text import preview, tokens
from lekhya.operators import knn
from lekhya.session import spread


def postings(documents: DataFrame) -> DataFrame:
    """Distinct (term, doc_id) of the terms longer than two characters. Distinct within the document first, so no shuffle is needed while doc_id is a key."""
    terms = F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: F.length(t) > 2)
    docs = documents.filter("doc_id IS NOT NULL").select("doc_id", "text")
    return spread(docs).select(F.explode(terms).alias("term"), "doc_id")


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """(term, c, n): the query's terms with their multiplicity and the number of all terms."""
    return spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term"), F.size(tokens(F.col("q"))).alias("n")).groupBy("term", "n").agg(F.count("*").alias("c"))


def keyword_scores(index: DataFrame, query: str) -> DataFrame:
    terms = F.broadcast(query_terms(index.sparkSession, query))  # as many rows as the query has words
    return index.join(terms, "term").groupBy("doc_id").agg((F.sum("c") / F.max("n")).alias("score"))


def keyword_search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    return keyword_scores(index, query).orderBy(F.col("score").desc(), "doc_id").limit(k)


def keyword_search_batch(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score) for queries (query_id, query)."""
    t = queries.select("query_id", F.size(tokens(F.col("query"))).alias("n"), F.explode(tokens(F.col("query"))).alias("term"))
    t = t.groupBy("query_id", "n", "term").agg(F.count("*").alias("c"))
    scored = index.join(t, "term").groupBy("query_id", "doc_id").agg((F.sum("c") / F.max("n")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def first_by_doc(vectors: DataFrame) -> DataFrame:
    """(doc_id, internal_id): the least internal_id of every doc_id."""
    return vectors.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("internal_id").alias("internal_id"))


def semantic_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """(internal_id, doc_id, score), nearest first: score is 1/(1+d) of the squared distance; the inner product for metric ip is scored 1/(1+ip), as its users know it."""
    near = knn.nearest(vectors, query, "internal_id", k, metric)
    d = F.col("d") if metric == "l2" else -F.col("d")
    hits = vectors.select("internal_id", "doc_id").join(F.broadcast(near), "internal_id").orderBy("d", "internal_id")  # k rows
    return hits.select("internal_id", "doc_id", F.try_divide(F.lit(1.0), 1 + d).alias("score"))


def matches(filters: dict) -> Column:
    """A filter dictionary as one condition: {min,max} ranges inclusive, lists as IN, scalars as equality; a null column fails every test."""
    def one(name: str, value) -> Column:
        c = F.col(name)
        if isinstance(value, dict):
            tests = [c.isNotNull()] + ([c >= value["min"]] if "min" in value else []) + ([c <= value["max"]] if "max" in value else [])
            return reduce(lambda a, b: a & b, tests)
        return c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value

    return reduce(lambda a, b: a & b, (one(*kv) for kv in filters.items()), F.lit(True))


def hybrid_candidates(index: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10) -> DataFrame:
    """(doc_id, semantic_score, keyword_score): the best 2k of each side in a full outer join, 4k rows at most.

    A document indexed more than once counts with its last (lowest) hit.
    """
    kw = keyword_search(index, query, 2 * k).select("doc_id", F.col("score").alias("kw"))
    sem = semantic_search(vectors, vector, 2 * k).groupBy("doc_id").agg(F.min("score").alias("sem"))
    return kw.join(sem, "doc_id", "full_outer").select("doc_id", F.coalesce("sem", F.lit(0.0)).alias("semantic_score"), F.coalesce("kw", F.lit(0.0)).alias("keyword_score"))


def hybrid_ranked(hits: DataFrame, documents: DataFrame, k: int = 10, semantic_weight: float = 0.7, keyword_weight: float = 0.3, filters: dict | None = None) -> DataFrame:
    """The hits with their documents' title and preview, filtered after the truncation, as its users know it; best first."""
    joined = documents.join(F.broadcast(hits), "doc_id")  # 4k rows at most
    if filters:
        joined = joined.filter(matches(filters))
    score = F.col("semantic_score") * semantic_weight + F.col("keyword_score") * keyword_weight
    cols = ["doc_id", "semantic_score", "keyword_score", score.alias("score"), F.col("doc_name").alias("title"), "preview"]
    return joined.select(*cols).orderBy(F.round("score", 9).desc(), "doc_id").limit(k)


def hybrid_search(
    index: DataFrame, vectors: DataFrame, documents: DataFrame, query: str, vector: list[float], k: int = 10,
    semantic_weight: float = 0.7, keyword_weight: float = 0.3, filters: dict | None = None,
) -> DataFrame:
    """(doc_id, semantic_score, keyword_score, score, title, preview) over plain tables; documents without a vector are dropped."""
    hits = hybrid_candidates(index, vectors, query, vector, k).join(vectors.select("doc_id"), "doc_id", "left_semi")
    return hybrid_ranked(hits, documents.withColumn("preview", preview(F.col("text"))), k, semantic_weight, keyword_weight, filters)


def rest_search(documents: DataFrame, entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Substring search: 0.5 in the text, 0.3 in the name, 0.2 per entity mention, clamped to 1; ties in ingest order."""
    q = query.lower()
    hits = entities.dropDuplicates(["entity_id"]).filter(F.contains(F.lower("text"), F.lit(q))).groupBy("doc_id").agg(F.count("*").alias("hits"))
    text, name = (F.coalesce(F.lower(c), F.lit("")) for c in ("text", "doc_name"))
    joined = documents.join(hits, "doc_id", "left")
    score = F.when(F.contains(text, F.lit(q)), 0.5).otherwise(0.0) + F.when(F.contains(name, F.lit(q)), 0.3).otherwise(0.0) + 0.2 * F.coalesce("hits", F.lit(0))
    out = joined.select("doc_id", F.col("doc_name").alias("title"), preview(F.col("text")).alias("preview"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"), "ingest_seq")
    return out.filter("score > 0").orderBy(F.col("score").desc(), "ingest_seq").limit(k)


def ui_search(documents: DataFrame, query: str) -> DataFrame:
    """Every document with the query in its text or name, at a constant score."""
    q = F.lit(query.lower())
    hit = F.contains(F.coalesce(F.lower("text"), F.lit("")), q) | F.contains(F.coalesce(F.lower("doc_name"), F.lit("")), q)
    return documents.filter(hit).select("doc_id", F.col("doc_name").alias("title"), preview(F.col("text")).alias("preview"), F.lit(0.95).alias("score"))
