"""Problem 8: documents that quote passages of held-out items, whole, in part or edited, with the items they leak.

1. Every item's word n-grams (five words; a shorter item is one n-gram as a whole) go into a Bloom filter of bounded size.
2. One scan of the documents gives the passages around the n-grams that the filter knows, with the passage's words as
   32-bit hashes. Texts are read once, whatever the number of items, and are never shuffled.
3. Seeds. The number of documents that hold each n-gram is counted. For edited copies every n-gram of an item that occurs
   is a seed. Where only runs of `run` words are asked for, the rarest n-gram of each window of `run` item words is one,
   and a window of which some n-gram occurs nowhere gives none: every shared run of `run` words still holds a seed.
4. Seeds join passages to items. Seeds of one passage and item give the diagonals around which Smith-Waterman aligns them;
   the score decides edited copies, the longest run of equal words exact ones.

Hot n-grams are salted: an n-gram of more than `hot` documents meets its items in as many parts as it has times `hot`
documents, so no task holds it whole. Items and seeds are joined by the planner, broadcast only when measured small.

Defined results: null and blank texts and items leak nothing; repeated rows of a document or item count once; words are
runs of a-z and 0-9, so a text in another script has none; texts and items of any length are aligned whole (an alignment
that a seed is part of cannot reach further than the passage); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.llm.hashing import flat_hashes, gram_hashes, mix
from lekhya.session import materialise, nonempty

_WORD = re.compile(r"[a-z0-9]+")
#: Bits of the Bloom filter: 64 for each n-gram, at most 2^30 (128 MB); beyond that more passages are written, none is lost.
MAX_BITS = 1 << 30
PROBES = 4
_BUCKET = 32_768  # bits that one row of bitmap_construct_agg holds


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align_all(docs: list[np.ndarray], items: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(best Smith-Waterman scores, longest runs of equal words) of pairs of hashed word sequences, all pairs row by row at once.

    A row's left gaps are a running maximum of H + gap*column, so each row is a few array operations. Padding matches nothing, so it raises no score.
    """
    k, n, m = len(docs), max(map(len, docs), default=0), max(map(len, items), default=0)
    best, longest = np.zeros(k, dtype=np.int32), np.zeros(k, dtype=np.int32)
    d, w = np.full((k, n), -1, dtype=np.int64), np.full((m, k, 1), -2, dtype=np.int64)
    for j, (x, y) in enumerate(zip(docs, items)):
        d[j, : len(x)], w[: len(y), j, 0] = x, y
    slope = gap * np.arange(n, dtype=np.int32)
    h, run = np.zeros((k, n + 1), dtype=np.int32), np.zeros((k, n + 1), dtype=np.int32)
    for row in w if n else ():
        eq = d == row
        diag = np.maximum(np.maximum(h[:, :-1] + np.where(eq, np.int32(match), np.int32(mismatch)), h[:, 1:] - gap), 0)
        diag += slope
        np.maximum.accumulate(diag, axis=1, out=diag)
        diag -= slope
        h[:, 1:] = diag
        run[:, 1:] = (run[:, :-1] + 1) * eq
        np.maximum(best, diag.max(axis=1), out=best)
        np.maximum(longest, run.max(axis=1), out=longest)
    return best, longest


def align(doc: np.ndarray, item: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int]:
    """(best Smith-Waterman score, longest run of equal words) of two hashed word sequences."""
    best, longest = align_all([doc], [item], match, mismatch, gap)
    return int(best[0]), int(longest[0])


def _probe(grams: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit position of each n-gram in a filter of so many bits (a power of two)."""
    step = mix(grams ^ np.uint64(0x5BD1E9955BD1E995)) | np.uint64(1) if k else np.uint64(0)
    return (grams + np.uint64(k) * step) & np.uint64(bits - 1)


def item_grams(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, words binary, m) with the items' words as 32-bit hashes, and (item_id, at, gram) with their n-grams."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [tokens(t) for t in b["text"]]
            h, off = flat_hashes(words)
            low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = []
            for k, i in enumerate(b["item_id"]):
                own = h[off[k] : off[k + 1]]
                if len(own):
                    g = gram_hashes(own, min(n, len(own))).view(np.int64)
                    rows.append((i, low[off[k] : off[k + 1]].tobytes(), len(own), g))
            yield pd.DataFrame(rows, columns=["item_id", "words", "m", "grams"])

    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").dropDuplicates(["item_id"])
    whole = materialise(rows.mapInPandas(run, "item_id long, words binary, m int, grams array<long>"), "items")
    return whole.select("item_id", "words", "m"), whole.select("item_id", "m", F.posexplode("grams").alias("at", "gram"))


def _bloom(grams: DataFrame) -> tuple[np.ndarray, int]:
    """The Bloom filter of the distinct n-grams: its bitmap is put together on the executors, the driver gets MAX_BITS at most."""
    known = grams.select("gram").distinct()
    bits = 1 << 16
    while bits < 64 * known.count() and bits < MAX_BITS:
        bits *= 2

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": np.concatenate([_probe(b["gram"].to_numpy().view(np.uint64), k, bits) for k in range(PROBES)]).astype(np.int64)})

    p = known.mapInPandas(run, "p long")
    # bitmap buckets count from 1, so position x is bit (x mod 32768) of bucket x div 32768
    rows = p.groupBy(F.floor(F.col("p") / _BUCKET).cast("int").alias("k")).agg(F.bitmap_construct_agg((F.col("p") % _BUCKET).cast("long")).alias("b")).collect()
    out = np.zeros(max(bits, _BUCKET) // 8, dtype=np.uint8)
    for r in rows:
        out[r.k * _BUCKET // 8 : (r.k + 1) * _BUCKET // 8] = np.frombuffer(bytes(r.b), dtype=np.uint8)
    return out, bits


def _known(filter_bits: np.ndarray, bits: int, grams: np.ndarray) -> np.ndarray:
    """Positions of the n-grams that the filter knows."""
    at = np.arange(len(grams))
    for k in range(PROBES):
        x = _probe(grams[at], k, bits)
        at = at[(filter_bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def passages(documents: DataFrame, sizes: list[int], longest: int, bloom: tuple[np.ndarray, int]) -> DataFrame:
    """(doc_id, part, grams, ats, words): the stretches of every document within reach of known n-grams, with the words' 32-bit hashes.

    An alignment through a seed gains at most 2 for each item word beside it and pays 1 for each gap, so it reaches no further
    than three times the longest item; stretches that overlap are one.
    """
    reach = 3 * longest
    shared = documents.sparkSession.sparkContext.broadcast(bloom)

    @nonempty
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_bits, bits = shared.value
        for b in batches:
            h, off = flat_hashes([tokens(t) for t in b["text"]])
            low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
            ids = b["doc_id"].to_numpy()
            found_at, found_gram = [], []
            for k in sizes:
                g = gram_hashes(h, k)
                hit = _known(filter_bits, bits, g)
                doc = np.searchsorted(off, hit, side="right") - 1
                hit = hit[hit + k <= off[doc + 1]]
                found_at.append(hit)
                found_gram.append(g[hit])
            at, gram = np.concatenate(found_at), np.concatenate(found_gram).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, gram = at[order], gram[order]
            doc = np.searchsorted(off, at, side="right") - 1
            new = np.ones(len(at), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)
            cuts = np.flatnonzero(np.append(new, True))
            rows = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                lo, hi = max(off[doc[s]], at[s] - reach), min(off[doc[s] + 1], at[e - 1] + reach + max(sizes))
                rows.append((ids[doc[s]], int(lo - off[doc[s]]), gram[s:e], (at[s:e] - lo).astype(np.int32), low[lo:hi].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "part", "grams", "ats", "words"])

    docs = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return docs.mapInPandas(scan, "doc_id long, part long, grams array<long>, ats array<int>, words binary")


def _seeds(grams: DataFrame, df: DataFrame, n: int, run: int | None) -> DataFrame:
    """(gram, item_id, at): every n-gram of the items that occurs, or with `run` the rarest of each window of `run` words whose n-grams all occur."""
    if run is None:
        return grams.join(df.select("gram"), "gram", "left_semi").select("gram", "item_id", "at")
    counted = grams.filter(F.col("m") >= run).join(df, "gram", "left")
    w = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, run - n)
    rarest = counted.select(
        "item_id", F.count("df").over(w).alias("there"), F.min(F.struct("df", "gram", "at")).over(w).alias("s")
    ).filter(F.col("there") == run - n + 1)
    return rarest.select("s.gram", "item_id", "s.at").distinct()


def leaks(documents: DataFrame, items: DataFrame, n: int = 5, run: int = 12, least: int = 18, exact: bool = False, hot: int = 20_000, band: int = 24) -> DataFrame:
    """(doc_id, item_id, score, coverage, longest_run): documents and items that align.

    A pair counts where its Smith-Waterman score (2 for equal words, -1 for others and gaps) reaches `least`, which is what
    `run` words with two of them changed give, or three quarters of a shorter item's best. Copies are reached as long as n
    consecutive words are left anywhere; alignments may drift by `band` words from their seeds' diagonals. With `exact`, only
    pairs that may share `run` consecutive words are sought, and none is filtered by score.
    """
    words, grams = item_grams(items, n)
    bounds = words.agg(F.max("m").alias("longest"), F.min("m").alias("least")).first()
    if bounds.longest is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, score int, coverage double, longest_run int")
    sizes = [n] if exact else list(range(min(n, bounds.least), n + 1))
    got = materialise(passages(documents, sizes, bounds.longest, _bloom(grams)), "passages")
    hits = got.select("doc_id", "part", F.explode(F.arrays_zip("grams", "ats")).alias("h")).select("doc_id", "part", F.col("h.grams").alias("gram"), F.col("h.ats").alias("p"))
    df = materialise(hits.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count("*").alias("df")), "gram-counts")
    seeds = _seeds(grams, df, n, run if exact else None).join(df, "gram").withColumn("parts", F.ceil(F.col("df") / hot).cast("int"))
    spread = seeds.select("gram", "item_id", "at", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    salted = hits.join(df.select("gram", F.ceil(F.col("df") / hot).cast("int").alias("k")), "gram").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    pairs = salted.join(spread, ["gram", "salt"]).groupBy("doc_id", "part", "item_id").agg(
        F.min(F.col("p") - F.col("at")).alias("lo"), F.max(F.col("p") - F.col("at")).alias("hi")
    )
    pairs = materialise(pairs, "candidates")
    start = F.greatest(F.col("lo") - band, F.lit(0))
    strip = F.expr("substring(words, 4 * start + 1, 4 * (hi + m + %d - start))" % band)
    rows = pairs.join(words.withColumnRenamed("words", "item"), "item_id").withColumn("start", start)
    rows = got.select("doc_id", "part", "words").join(rows, ["doc_id", "part"]).select("doc_id", "item_id", strip.alias("words"), "item")

    @nonempty
    def score(batches: Iterator[pd.DataFrame], cells: int = 16_384) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs, its = ([np.frombuffer(x, dtype="<u4") for x in b[c]] for c in ("words", "item"))
            size = np.array([len(x) for x in docs])
            best, longest = np.zeros(len(b), dtype=np.int32), np.zeros(len(b), dtype=np.int32)
            order = np.lexsort((size, [len(x) for x in its]))
            end = 0
            while end < len(order):  # pairs of like length together, as many as fit in the cells
                start, end = end, end + 1
                widest = size[order[start]]
                while end < len(order) and (end - start + 1) * max(widest, size[order[end]]) <= cells:
                    widest = max(widest, size[order[end]])
                    end += 1
                part = order[start:end]
                best[part], longest[part] = align_all([docs[k] for k in part], [its[k] for k in part])
            m = np.array([len(x) for x in its])
            yield pd.DataFrame({"doc_id": b["doc_id"], "item_id": b["item_id"], "score": best, "coverage": best / (2.0 * m), "longest_run": longest, "m": m.astype(np.int32)})

    scored = rows.mapInPandas(score, "doc_id long, item_id long, score int, coverage double, longest_run int, m int")
    if not exact:
        scored = scored.filter(F.col("score") >= F.least(F.lit(float(least)), 1.5 * F.col("m")))
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.max("longest_run").alias("longest_run"))


def found(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """p8_found: documents and items that share at least `run` consecutive words."""
    return leaks(documents, items, run=run, exact=True).filter(F.col("longest_run") >= run).select("doc_id", "item_id")
