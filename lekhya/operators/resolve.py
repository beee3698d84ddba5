"""Resolution of mentions: normal forms, the similarity ladder, greedy leader clusters, canonical forms.

Mentions are taken per document and type, distinct and in ascending order; so is the prefix list (longest first, then
alphabetical), which makes every result deterministic. Null mentions are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.text import WS, strip, title_case
from lekhya.functions.vectors import cosine

# Prefixes of person names, and abbreviations of places.
NAME_PREFIXES = ["mr", "mrs", "ms", "dr", "shri", "smt", "kumari", "sri", "late", "s/o", "d/o", "w/o", "c/o", "son of", "daughter of", "wife of"]
LOCATIONS = [("blr", "bangalore"), ("bengaluru", "bangalore"), ("b'lore", "bangalore"), ("chn", "chennai"), ("hyd", "hyderabad"), ("mum", "mumbai"), ("del", "delhi"), ("ncr", "delhi ncr")]
THRESHOLD = 0.85


def ordered_prefixes() -> list[str]:
    return sorted(NAME_PREFIXES, key=lambda p: (-len(p), p))


def norm_name(c: Column, titled: bool = True) -> Column:
    c = strip(F.lower(c))
    for p in ordered_prefixes():
        c = F.regexp_replace(c, rf"^{re.escape(p)}\.?{WS}*", "")
    c = strip(F.regexp_replace(c, f"{WS}+", " "))
    return title_case(c) if titled else c


def norm_location(c: Column, titled: bool = True) -> Column:
    c = strip(F.lower(c))
    for short, full in LOCATIONS:
        c = F.regexp_replace(c, rf"^{re.escape(short)}( |\z)", f"{full}$1")
    c = F.regexp_replace(c, rf"{WS}*-{WS}*\p{{Nd}}+", "")
    return title_case(c) if titled else c


def similarity(a: Column, b: Column) -> Column:
    """1.0 equal, 0.9 contained, 0.8 same last word, 0.75 same initials, else Jaccard of the character sets."""
    a, b = F.lower(a), F.lower(b)
    wa, wb = (F.filter(F.split(x, f"{WS}+"), lambda w: w != "") for x in (a, b))
    initials = lambda w: F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")
    both = (F.size(wa) > 0) & (F.size(wb) > 0)
    ca, cb = (F.filter(F.array_distinct(F.split(x, "")), lambda ch: ch != "") for x in (a, b))
    return (
        F.when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.9)
        .when(both & (F.try_element_at(wa, F.lit(-1)) == F.try_element_at(wb, F.lit(-1))), 0.8)
        .when(both & (initials(wa) == initials(wb)), 0.75)
        .otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(ca, cb)).cast("double"), F.size(F.array_union(ca, cb)).cast("double")), F.lit(0.0)))
    )


def mentions(entities: DataFrame, types: list[str]) -> DataFrame:
    """(doc_id, entity_type, mention, norm): distinct mentions."""
    m = entities.filter(F.col("entity_type").isin(types) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    m = m.select("doc_id", "entity_type", F.col("text").alias("mention")).distinct()
    norm = F.when(F.col("entity_type") == "PERSON", norm_name(F.col("mention"), False)).when(F.col("entity_type") == "LOCATION", norm_location(F.col("mention"), False))
    return m.withColumn("norm", F.coalesce(norm, F.col("mention")))


def pairs(entities: DataFrame, types: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, entity_type, a, b, sim): mentions of one document at or above the threshold, a before b."""
    m = mentions(entities, types)
    left = m.select("doc_id", "entity_type", F.col("mention").alias("a"), F.col("norm").alias("na"))
    right = m.select("doc_id", "entity_type", F.col("mention").alias("b"), F.col("norm").alias("nb"))
    joined = left.join(right, ["doc_id", "entity_type"]).filter("a < b").withColumn("sim", similarity(F.col("na"), F.col("nb")))
    return joined.filter(F.col("sim") >= threshold).select("doc_id", "entity_type", "a", "b", F.round("sim", 6).alias("sim"))


def leader_clusters(entities: DataFrame, types: list[str], threshold: float = THRESHOLD, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, entity_type, leader, mention): each mention joins the first earlier leader it is similar to, else leads.

    Similar by the ladder, or with an embedder by the cosine of the normal forms' embeddings (0 where one has no length).
    A fold over the sorted mentions of one document and type; groups never span documents, so they stay small.
    """
    m = mentions(entities, types)
    kind = "string"
    if embedder is not None:
        kind = "array<double>"

        @F.pandas_udf(kind)
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(embedder(texts.tolist()), dtype=np.float64)))

        m = m.withColumn("norm", vector("norm"))
    alike = similarity if embedder is None else cosine
    lists = m.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("mention", "norm"))).alias("l"))
    start = F.array().cast(f"array<struct<leader:string,norm:{kind},mention:string>>")

    def step(acc: Column, x: Column) -> Column:
        leads = F.filter(acc, lambda y: (y["leader"] == y["mention"]) & (alike(y["norm"], x["norm"]) >= threshold))
        to = F.coalesce(F.get(leads, F.lit(0))["leader"], x["mention"])
        return F.concat(acc, F.array(F.struct(to.alias("leader"), x["norm"].alias("norm"), x["mention"].alias("mention"))))

    return lists.select("doc_id", "entity_type", F.inline(F.aggregate("l", start, step))).select("doc_id", "entity_type", "leader", "mention")


def canonical(clusters: DataFrame) -> DataFrame:
    """(doc_id, entity_type, canonical, mentions, confidence, cluster_size) of leader clusters; ties by the smaller mention."""
    words = F.when(F.col("entity_type") == "PERSON", F.size(F.filter(F.split("mention", f"{WS}+"), lambda w: w != ""))).otherwise(0)
    best = F.min(F.struct((-words).alias("w"), (-F.length("mention")).alias("n"), F.col("mention").alias("m")))["m"]
    out = clusters.groupBy("doc_id", "entity_type", "leader").agg(best.alias("canonical"), F.array_sort(F.collect_list("mention")).alias("mentions"), F.count("*").cast("int").alias("cluster_size"))
    return out.select("doc_id", "entity_type", "canonical", "mentions", F.when(F.col("cluster_size") == 1, 1.0).otherwise(0.9).alias("confidence"), "cluster_size")
