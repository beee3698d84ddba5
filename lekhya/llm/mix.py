"""Problem 9: a mix of sources with target shares of all tokens, by weighted sampling without replacement.

Every record gets the exponential key -ln(u)/w (u from a hash of its id and the seed, w its quality weight); within a
source records are taken in the order of their keys. A source whose budget exceeds its tokens gives complete epochs
first; the rest of the budget is the longest prefix, in key order, that fits it. The prefix sums are made in two
steps: sums of key ranges per source (a small table), then a window only within the range in which the budget ends, so no
source, however large, is ordered in one task. The ranges are `buckets` for each unit of the key's logarithm: the logarithm
of an exponential key has a density of at most 1/e whatever its weight, so has any mixture of weights, and no range is
expected to hold more than 1/(e * buckets) of a source (0.07 %).

The total is the parameter `total`, or else the largest at which no source needs more than its allowed repeats.

Defined results: null and blank texts have no tokens and stay out, as do null and untargeted sources; a targeted
source without tokens reaches share 0 and doesn't bound the total; repeated rows of a document count once; null
weights count as 0.5; null max_repeats as 1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.session import lookup_rows, materialise, nonempty

#: Folder of the public tokenizer files; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenisation pattern published with the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoder(folder: str):
    import tiktoken

    lines = Path(folder, "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, weight: Column, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, weight) of the documents with text."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(folder)
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) for t in b.pop("text")]
            yield b[["doc_id", "source", "tokens", "weight"]]

    docs = documents.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\S"))
    w = F.greatest(F.lit(0.01), F.coalesce(weight.cast("double"), F.lit(0.5)))
    return docs.select("doc_id", "source", "text", w.alias("weight")).mapInPandas(run, "doc_id long, source string, tokens long, weight double")


def _plan(totals: dict[str, int], targets: list, total: float | None) -> list[tuple]:
    """(source, target_share, budget, epochs, rest) per target."""
    goal = {}
    for t in targets:
        if t.source is not None and t.target_share and t.target_share > 0:
            goal[t.source] = (t.target_share, max(1, t.max_repeats or 1))
    whole = sum(s for s, _ in goal.values()) or 1.0
    goal = {k: (s / whole, r) for k, (s, r) in goal.items()}
    reach = [totals[k] * r / s for k, (s, r) in goal.items() if totals.get(k)]
    size = min([*reach, *([float(total)] if total else [])], default=0.0)
    out = []
    for k, (s, r) in goal.items():
        have = totals.get(k, 0)
        budget = int(size * s * (1 + 1e-12) + 1e-6)
        epochs = min(r, budget // have) if have else 0
        out.append((k, s, budget, epochs, min(budget - epochs * have, have) if epochs < r and have else 0))
    return out


def mix(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, weight: str = "ocr_confidence",
    buckets: int = 512, folder: str = TOKENIZERS, max_sources: int = 10_000,
) -> DataFrame:
    """(doc_id, source, tokens, times): the records of the mix and how often each is used."""
    goals = lookup_rows(targets.select("source", "target_share", "max_repeats"), max_sources)
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(g.source,) for g in goals if g.source is not None], "source string").distinct()
    docs = documents.join(F.broadcast(wanted), "source", "left_semi")  # at most max_sources names, checked above
    counted = materialise(token_counts(docs, F.col(weight), folder).dropDuplicates(["doc_id"]), "tokens")
    totals = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    plan = spark.createDataFrame(_plan(totals, goals, total), "source string, share double, budget long, epochs long, rest long")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = counted.join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    keyed = keyed.withColumn("key", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("bucket", F.floor(F.log("key") * buckets).cast("int"))
    sums = keyed.filter("rest > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.withColumn("before", F.coalesce(before, F.lit(0))).select("source", "bucket", "before", "n")
    placed = keyed.join(ranges, ["source", "bucket"], "left")
    clear = placed.withColumn("more", F.when(F.col("rest") == 0, 0).when(F.col("before") + F.col("n") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0))
    edge = clear.filter("more IS NULL")
    upto = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("more", F.when(F.col("before") + upto <= F.col("rest"), 1).otherwise(0))
    cols = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).alias("times")]
    return clear.filter("more IS NOT NULL").select(*cols).union(edge.select(*cols)).filter("times > 0")


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, max_repeats, records, uses, most_times, tokens, actual_share): what the mix reaches."""
    got = mix(documents, targets, **options).groupBy("source").agg(
        F.count("*").alias("records"), F.sum("times").alias("uses"), F.max("times").alias("most_times"), F.sum(F.col("tokens") * F.col("times")).alias("tokens")
    )
    joined = targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0)
    # one row per target: the window holds max_sources rows at most
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return joined.withColumn("actual_share", F.round(F.col("tokens") / F.nullif(whole, F.lit(0)), 6))
