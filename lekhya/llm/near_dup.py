"""Problem 3: pairs and groups of near-duplicate texts, by minhash with tensored banding.

Texts become sets of word n-grams (three words and Jaccard 0.6 here, as the project's statement says). Two smaller
collections of minhashes are kept: U of `sides` keys made of two minhashes each, V likewise. A table is keyed by a pair
(U_i, V_j), so sides^2 tables need only 4*sides minhashes. A pair at Jaccard 0.6 shares a table with probability
(1-(1-0.36)^sides)^2 = 0.9993 for sides = 18; at 0.7 and more it is above 0.99999. `exact` finds every pair instead.

The shuffle carries one row per (text, U_i) with the V minhashes as payload; the pairing with V_j happens inside the
sorted partition. Texts with equal n-gram sets are folded into one representative first. A U key held by more than
`hot` texts (100 bytes each) is split by its V keys before the shuffle, so no task holds more than `hot` rows of a key.
Buckets over `bucket` texts are not enumerated: their texts go to an exact prefix-filter join instead, so nothing is dropped.
That join writes every n-gram of its texts several times, so it is for buckets only whose pairs would take longer. Candidates
are checked against the V minhashes in the bucket (four standard deviations below the threshold are kept: one pair at the
threshold in 100,000 is not), then against the counts of their n-grams in 256 classes, which bound the n-grams in common from
above and so drop no pair, and verified exactly on the n-gram sets.

Defined results: null texts and texts under min_words words take no part; repeated rows of a document count once;
texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.llm.graph import components
from lekhya.llm.hashing import flat_hashes, gram_hashes
from lekhya.session import materialise, nonempty


#: Up to so many ids (8 bytes each) are broadcast to filter the documents; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Texts of a U key that a task may hold, and texts of a bucket whose pairs are enumerated: at more than 20,000 the prefix-filter join is less work.
HOT, BUCKET = 200_000, 20_000
#: Pairs that a task holds before it passes them on.
MAX_HELD_PAIRS = 1_000_000


def _sets(texts: list[str], n: int, min_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of the texts with at least min_words words."""
    for start in range(0, len(texts), 2000):  # the words of so many texts are held at once
        words = [t.lower().split() if t else [] for t in texts[start : start + 2000]]
        keep = [k for k, w in enumerate(words) if len(w) >= max(min_words, n)]
        h, off = flat_hashes([words[k] for k in keep])
        g = gram_hashes(h, n)
        for k, row in enumerate(keep):
            yield start + row, np.unique(g[off[k] : off[k + 1] - n + 1])


def _class_counts(s: np.ndarray) -> bytes:
    """How many of the hashes begin with each byte, as 256 numbers of 4 bits; 15 stands for 15 and more."""
    c = np.minimum(np.bincount((s >> np.uint64(56)).astype(np.intp), minlength=256), 15).astype(np.uint8)
    return (c[:128] | c[128:] << 4).tobytes()


def _may_reach(x: pd.Series, y: pd.Series, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these class counts and sizes can be as similar as the threshold: no class has more in common than its lesser count."""
    p, q = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), 128) for s in (x, y))
    low, high = np.minimum(p & 15, q & 15), np.minimum(p >> 4, q >> 4)
    common = np.minimum(low.sum(axis=1, dtype=np.int64) + high.sum(axis=1, dtype=np.int64) + 1, np.minimum(nx, ny))  # one more: hashes are cut to 32 bits later
    full = (low == 15).any(axis=1) | (high == 15).any(axis=1)  # no bound
    return full | (common >= threshold * (nx + ny - common - 2))


def signatures(documents: DataFrame, n: int = 3, min_words: int = 50, sides: int = 18) -> DataFrame:
    """(id, size, fp, u array<long>, v binary, c binary): the U keys whole, the V minhashes as 2*sides 16-bit words, the class counts."""
    rng = np.random.Generator(np.random.PCG64(20_240_601))
    seeds = rng.integers(0, 2**32, size=(4 * sides, 1), dtype=np.uint32)
    odd = rng.integers(0, 2**31, size=(4 * sides, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes, fps, us, vs, cs = [], [], [], [], [], []
            doc_ids = b["doc_id"].to_numpy()
            for row, s in _sets(b["text"].tolist(), n, min_words):
                x = (s >> np.uint64(32)).astype(np.uint32)[None, :] ^ seeds
                x *= odd
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x846CA68B)
                x ^= x >> np.uint32(16)
                m = x.min(axis=1).astype(np.uint64)
                u = m[0 : 2 * sides : 2] << np.uint64(32) | m[1 : 2 * sides : 2]
                ids.append(doc_ids[row])
                sizes.append(len(s))
                fps.append(int(np.add.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(32)))) & (2**63 - 1))
                us.append(u.view(np.int64))
                m2 = m[2 * sides :]
                vs.append((m2 & np.uint64(0xFFFF)).astype("<u2").tobytes())
                cs.append(_class_counts(s))
            yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "size": np.array(sizes, dtype=np.int32), "fp": np.array(fps, dtype=np.int64), "u": us, "v": vs, "c": cs})

    return documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(run, "id long, size int, fp long, u array<long>, v binary, c binary")


def _bucket_pairs(group: np.ndarray, ids: np.ndarray, v: np.ndarray, sides: list[int], bucket: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(ids, ids) of candidate pairs within U groups: texts that share a V key and at least `least` V minhashes; and (ids, None) of oversized buckets.

    group numbers the U group of each row. All groups are handled at once: rows are sorted by (group, V key), and the
    pairs of a bucket are the rows d apart with equal keys, for d = 1, 2, ... up to the largest bucket.
    """
    high = group.astype(np.uint64) << np.uint64(32)
    for j in sides:
        key = high | v[:, 2 * j].astype(np.uint64) << np.uint64(16) | v[:, 2 * j + 1].astype(np.uint64)
        order = np.argsort(key)
        k = key[order]
        cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        size = np.diff(cuts)
        if size.max(initial=1) < 2:
            continue
        if size.max() > bucket:
            big = np.repeat(size > bucket, size)
            yield ids[order[big]], None
            order, k = order[~big], k[~big]
        d = 1
        at = np.flatnonzero(k[1:] == k[:-1])
        while len(at):
            x, y = order[at], order[at + d]
            ok = (v[x] == v[y]).sum(axis=1) >= least
            if ok.any():
                yield ids[x[ok]], ids[y[ok]]
            d += 1
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]


def candidates(reps: DataFrame, sides: int, threshold: float, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(a, b, oversize): candidate pairs with a < b; rows with b null name texts of oversized buckets."""
    # a pair at the threshold matches Binomial(2*sides, threshold) V minhashes; four deviations below are still kept
    least = max(2, math.floor(2 * sides * threshold - 4 * math.sqrt(2 * sides * threshold * (1 - threshold))))
    rows = reps.select("id", F.posexplode("u").alias("i", "u"), "v").select("id", "v", F.xxhash64("i", "u").alias("g"))
    counts = materialise(rows.groupBy("g").count().filter(F.col("count") > hot).select("g"), "hot-keys")  # few: the planner sees how few
    cold = rows.select("g", F.lit(-1).cast("byte").alias("j"), "id", "v")
    over = None
    if counts.limit(1).count():  # only the rows of hot keys are written by parts; a part is one bucket: where it is oversized itself, its texts are named without being brought together
        split = rows.join(counts, "g", "left_semi").select("g", "id", "v", F.explode(F.expr(f"sequence(0, {sides - 1})")).alias("j"))
        part = F.expr("xxhash64(g, j, substring(v, 4 * j + 1, 4))")
        parts = materialise(split.select(part.alias("g"), F.col("j").cast("byte").alias("j"), "id", "v"), "parts")
        large = materialise(parts.groupBy("g").count().filter(F.col("count") > bucket).select("g"), "large-parts")
        over = parts.join(large, "g", "left_semi").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"))
        cold = cold.join(counts, "g", "left_anti").union(parts.join(large, "g", "left_anti").select("g", "j", "id", "v"))

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def frame(pairs: list[np.ndarray], over: list[np.ndarray]) -> pd.DataFrame:
            xy = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), dtype=np.int64)
            o = np.unique(np.concatenate(over)) if over else np.empty(0, dtype=np.int64)
            second = pd.arrays.IntegerArray(np.concatenate([xy[:, 1], o]), np.arange(len(xy) + len(o)) >= len(xy))
            return pd.DataFrame({"a": np.concatenate([xy[:, 0], o]), "b": second})

        def flush(parts: list[tuple]) -> Iterator[pd.DataFrame]:
            g, j, ids, v = (np.concatenate([p[k] for p in parts]) for k in range(4))
            group = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
            keep = np.bincount(group)[group] > 1
            pairs, over, n = [], [], 0
            for side in np.unique(j[keep]):
                rows = keep & (j == side)
                for p, q in _bucket_pairs(group[rows], ids[rows], v[rows], list(range(sides)) if side < 0 else [int(side)], bucket, least):
                    if q is None:
                        over.append(p)
                        continue
                    pairs.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
                    n += len(p)
                    if n >= MAX_HELD_PAIRS:
                        yield frame(pairs, [])
                        pairs, n = [], 0
            yield frame(pairs, over)

        for b in batches:
            if not len(b):
                continue
            g = b["g"].to_numpy()
            held.append((g, b["j"].to_numpy(), b["id"].to_numpy(), np.frombuffer(b"".join(b["v"]), dtype="<u2").reshape(len(b), 2 * sides)))
            last = int(np.searchsorted(g, g[-1]))  # groups are sorted; the last one may go on in the next batch
            if last > 0:
                done = [*held[:-1], tuple(x[:last] for x in held[-1])]
                held = [tuple(x[last:] for x in held[-1])]
                yield from flush(done)
        if held:
            yield from flush(held)

    out = cold.repartition("g").sortWithinPartitions("g").mapInPandas(run, "a long, b long")
    return (out if over is None else out.union(over)).distinct()


def _few(ids: DataFrame) -> bool:
    return ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS


def _once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each id; only the rows of repeated ids are brought together."""
    return rows.join(repeated, "id", "left_anti").union(rows.join(repeated, "id", "left_semi").dropDuplicates(["id"]))


def _representatives(sig: DataFrame, members: DataFrame) -> DataFrame:
    """The signatures of the representatives; the signatures stay where they are if the ids of either kind are few."""
    own, copies = members.filter("id = rep").select("id"), members.filter("id <> rep").select("id")
    if _few(copies):
        return sig.join(F.broadcast(copies), "id", "left_anti")
    return sig.join(F.broadcast(own) if _few(own) else own, "id", "left_semi")


def _ngram_sets(documents: DataFrame, wanted: DataFrame, repeated: DataFrame, n: int, min_words: int) -> DataFrame:
    """(id, s binary): the 32-bit sorted n-gram hashes of the wanted documents."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sets = [], []
            doc_ids = b["doc_id"].to_numpy()
            for row, s in _sets(b["text"].tolist(), n, min_words):
                ids.append(doc_ids[row])
                sets.append(np.unique((s >> np.uint64(32)).astype("<u4")).tobytes())
            yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "s": sets})

    ids = wanted.select(F.col("id").alias("doc_id"))
    if _few(ids):  # else the texts are shuffled to the ids
        ids = F.broadcast(ids)
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return _once(materialise(texts.mapInPandas(run, "id long, s binary"), "set-rows"), repeated)


def _prefix_join(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates (a, b) among the texts of oversized buckets: two sets over the threshold share one of their rarest members."""

    @nonempty
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.frombuffer(s, dtype="<u4") for s in b["s"]]
            size = [len(a) for a in arrays]
            flat = np.concatenate(arrays) if arrays else np.empty(0, dtype="<u4")
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), size), "n": np.repeat(size, size).astype(np.int32), "t": flat.astype(np.int64)})

    tokens = sets.mapInPandas(explode, "id long, n int, t long")
    df = tokens.groupBy("t").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    prefix = tokens.join(df, "t").withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).filter("df > 1")
    left, right = prefix.select("t", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("t", F.col("id").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "t").filter("a < b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()


def similar_pairs(documents: DataFrame, n: int = 3, threshold: float = 0.6, min_words: int = 50, sides: int = 18, bucket: int = BUCKET, exact: bool = False, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, jaccard) of representatives, and (id, rep) of every text that takes part.

    With `exact` all representatives go to the prefix-filter join, which misses no pair and costs more.
    """
    every = materialise(signatures(documents, n, min_words, sides), "signatures")
    repeated = materialise(every.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    sig = _once(every, repeated)
    members = materialise(_classes(sig), "classes")
    reps = _representatives(sig, members)
    if exact:
        cand = materialise(reps.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b")), "candidates")
    else:
        cand = materialise(candidates(reps, sides, threshold, bucket, hot), "candidates")
    over = cand.filter("b IS NULL").select(F.col("a").alias("id")).distinct()

    @F.pandas_udf("boolean")
    def may_reach(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series(_may_reach(x, y, nx.to_numpy(dtype=np.int64), ny.to_numpy(dtype=np.int64), threshold))

    counts = sig.select("id", "size", "c")
    pairs = (
        cand.filter("b IS NOT NULL")
        .join(counts.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("c").alias("ca")), "a")
        .join(counts.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("c").alias("cb")), "b")
        .filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1).filter(may_reach("ca", "cb", "na", "nb")).select("a", "b")
    )
    pairs = materialise(pairs, "pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(over).distinct(), "wanted")
    sets = _ngram_sets(documents, wanted, repeated, n, min_words)
    if over.limit(1).count():
        pairs = pairs.union(_prefix_join(sets.join(over, "id", "left_semi"), threshold)).distinct()

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for k, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p, dtype="<u4"), np.frombuffer(q, dtype="<u4")
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out[k] = common / max(1, len(both) - common)
        return pd.Series(out)

    scored = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", jaccard("sa", "sb").alias("jaccard")).filter(F.col("jaccard") >= threshold)
    )
    return scored, members


def _classes(sig: DataFrame) -> DataFrame:
    """(id, rep): texts with equal n-gram sets share the least id; the class table is pre-aggregated, so a class of any size is one row per map task."""
    first = sig.groupBy("fp", "size").agg(F.min("id").alias("rep"))
    return sig.select("id", "fp", "size").join(first, ["fp", "size"]).select("id", "rep")


def found(documents: DataFrame) -> DataFrame:
    """p3_found (doc_a, doc_b): every pair of documents over the threshold, copies included, the smaller id first."""
    pairs, members = similar_pairs(documents)
    m = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    k = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(m, "a").join(k, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    same = m.join(k, m["a"] == k["b"]).filter("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))
    return across.union(same)


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id, links): one row per document that has a near-duplicate; group_id is the least doc_id of its component."""
    pairs, members = similar_pairs(documents)
    pairs = materialise(pairs, "pairs")
    comp = components(pairs.select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("d"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("c"))
    joined = members.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left").join(sizes, "rep")
    out = joined.select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("group_id"), (F.coalesce("d", F.lit(0)) + F.col("c") - 1).alias("links"))
    return out.filter("links > 0")
