"""Problem 1: the k most similar vectors of every vector, by additive quantisation.

Index: a coarse codebook (the cells) and `levels` residual codebooks, all of full dimension, fitted on a bounded sample
of `max_sample` vectors; every vector is encoded by beam search over the residual codebooks, with the norm of its
reconstruction stored. Search: vectors meet in cells (each goes to its best cell, the second, and a third that is nearly as
good); there the lookup table of a query against all codewords scores the codes of the cell, the best `shortlist`
are reranked exactly on the full vectors, and the lists of the cells are merged.

Scale: cells grow with the square root of the collection up to `max_cells` (16,384, reached at 30 million vectors); from there
cells grow instead and are split into blocks, each a group of its own, so the work of a cell grows with the square of its size
while no group does. Equal vectors are folded into one representative first and
expanded afterwards, so a vector repeated any number of times does not make a hot cell. A cell over `cell_rows` is
split into blocks of queries and of base vectors, so that no group exceeds twice that. Rows are never dropped.

Defined results: vectors that are null, of another length, all zero or not finite take no part; norms do not matter
(cosine); ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.session import materialise, nonempty


def _unit(batch: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the rows whose vector is valid."""
    if not len(batch):
        return np.empty(0, dtype=np.int64), np.empty((0, dim), dtype=np.float32)
    x = np.stack([np.asarray(v, dtype=np.float64) for v in batch["embedding"]])
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[ok]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return batch["id"].to_numpy()[ok], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _parts(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    """Smaller batches: a task holds scores of so many rows against all codewords."""
    for b in batches:
        for s in range(0, len(b), rows):
            yield b.iloc[s : s + rows]


def _sized(vectors: DataFrame, dim: int, id_col: str) -> DataFrame:
    return vectors.filter(F.col(id_col).isNotNull() & (F.size("embedding") == dim)).select(F.col(id_col).alias("id"), "embedding")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[s : s + 4096] @ c.T - 0.5 * (c**2).sum(1)).argmax(1) for s in range(0, len(x), 4096)])
        order = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1])))
        sums = np.add.reduceat(x[order], cuts, axis=0)
        n = np.bincount(a, minlength=k)
        c[n > 0] = sums / n[n > 0][:, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c.astype(np.float32)


class Quantiser:
    """Codebooks of an additive quantiser: code 0 names the cell, the others the residual codewords."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray], beam: int = 4):
        self.coarse, self.books, self.beam = coarse, books, beam
        self.words = np.concatenate([coarse, *books])
        self.base = np.cumsum([0, len(coarse), *(len(b) for b in books)])
        self.gram = self.words[self.base[1] :] @ self.words.T if books else None

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, levels: int = 8, size: int = 64, beam: int = 4, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = _kmeans(x, cells, rng)
        books: list[np.ndarray] = []
        part = x[rng.permutation(len(x))[: 16 * size * 8]]
        for _ in range(levels):
            q = cls(coarse, books, beam)
            codes, _ = q.encode(part)
            books.append(_kmeans(part - q.decode(codes), size, rng, rounds=6))
        return cls(coarse, books, beam)

    def cells_of(self, table: np.ndarray) -> np.ndarray:
        return table[:, : len(self.coarse)] - 0.5 * (self.coarse**2).sum(1)

    def encode(self, x: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and reconstruction norms, by beam search: each level keeps the `beam` partial sums of least error."""
        table = x @ self.words.T if table is None else table
        n = len(x)
        first = self.cells_of(table)
        b = min(self.beam, first.shape[1])
        top = np.argpartition(-first, b - 1, axis=1)[:, :b]
        err = -2 * np.take_along_axis(first, top, 1)  # squared error without the constant |x|^2
        codes = top[:, :, None]
        for level in range(len(self.books)):
            lo, hi = self.base[level + 1], self.base[level + 2]
            g = self.gram[lo - self.base[1] : hi - self.base[1]]  # words of this level against all words
            cross = np.zeros((n, codes.shape[1], hi - lo), dtype=np.float32)
            for m in range(codes.shape[2]):
                cross += g.T[codes[:, :, m] + self.base[m]]
            new = err[:, :, None] - 2 * (table[:, None, lo:hi] - cross) + (self.words[lo:hi] ** 2).sum(1)
            flat = new.reshape(n, -1)
            b = min(self.beam, flat.shape[1])
            pick = np.argpartition(flat, b - 1, axis=1)[:, :b]
            err = np.take_along_axis(flat, pick, 1)
            parent, word = pick // (hi - lo), pick % (hi - lo)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
        best = codes[np.arange(n), err.argmin(1)]
        return best.astype(np.uint16), np.linalg.norm(self.decode(best), axis=1).astype(np.float32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[codes[:, 0]].copy()
        for m, b in enumerate(self.books):
            out += b[codes[:, m + 1]]
        return out

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines of all queries and codes, from the queries' lookup tables."""
        table = queries @ self.words.T
        out = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for m in range(codes.shape[1]):
            out += np.take(table, codes[:, m].astype(np.int64) + self.base[m], axis=1)
        return out / np.maximum(norms, 1e-6)


def _assign(score: np.ndarray, most: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row, best first, and which of them count: the best two, and more that are within the margin."""
    m = min(most, score.shape[1])
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    s = np.take_along_axis(score, top, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    top, s = np.take_along_axis(top, order, 1), np.take_along_axis(s, order, 1)
    use = s >= s[:, :1] - margin
    use[:, :2] = True
    return top, use


def _group_search(quantiser: Quantiser, q_ids, q, b_ids, b, codes, norms, k: int, shortlist: int) -> pd.DataFrame:
    out_q, out_n, out_s = [], [], []
    for s in range(0, len(q), 512):
        qs, ids = q[s : s + 512], q_ids[s : s + 512]
        approx = quantiser.scores(qs, codes, norms)
        approx[ids[:, None] == b_ids[None, :]] = -9
        r = min(shortlist, approx.shape[1])
        short = np.argpartition(-approx, r - 1, axis=1)[:, :r]
        exact = np.empty(short.shape, dtype=np.float64)
        for t in range(0, len(qs), 64):
            exact[t : t + 64] = np.einsum("qd,qrd->qr", qs[t : t + 64], b[short[t : t + 64]], optimize=False)
        exact[ids[:, None] == b_ids[short]] = -9
        order = np.lexsort((b_ids[short], -exact), axis=1)[:, :k]
        exact, near = np.take_along_axis(exact, order, 1), b_ids[np.take_along_axis(short, order, 1)]
        keep = exact > -2
        out_q.append(np.repeat(ids[:, None], near.shape[1], axis=1)[keep])
        out_n.append(near[keep])
        out_s.append(exact[keep])
    return pd.DataFrame({"q": np.concatenate(out_q), "n": np.concatenate(out_n), "cos": np.concatenate(out_s)})


def neighbours(
    vectors: DataFrame, k: int = 5, dim: int = 384, id_col: str = "internal_id", max_sample: int = 40_000, shortlist: int = 32,
    cell_rows: int = 2048, most_cells: int = 3, margin: float = 0.005, max_cells: int = 16_384,
) -> DataFrame:
    """(q, n, cos): the k most similar others of every valid vector; ties by the smaller id."""
    spark = vectors.sparkSession
    sized = _sized(vectors, dim, id_col)
    total = sized.count()
    cells = int(min(max_cells, max(1, round(3 * total**0.5))))
    wanted = min(max_sample, max(2_000, 32 * cells))

    @nonempty
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, x = _unit(b, dim)
            yield pd.DataFrame({"x": [r.tobytes() for r in x.astype(np.float16)]})

    # a bounded sample by hash order; filtered to twice the need first so that only that much is ordered
    share = min(1.0, 2 * wanted / max(total, 1))
    some = sized.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    rows = some.orderBy(F.xxhash64("id"), "id").limit(wanted).mapInPandas(pack, "x binary").collect()
    if not rows:
        return spark.createDataFrame([], "q long, n long, cos double")
    sample = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float16).reshape(-1, dim).astype(np.float32)
    fitted = Quantiser.fit(sample, min(cells, len(sample)))
    shared = spark.sparkContext.broadcast((fitted.coarse, fitted.books))

    @nonempty
    def light(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser = Quantiser(*shared.value)
        for b in _parts(batches):
            ids, x = _unit(b, dim)
            top, use = _assign(quantiser.cells_of(x @ quantiser.coarse.T), most_cells, margin)
            fps = [hash_bytes(r.tobytes()) for r in x]
            yield pd.DataFrame({"id": ids, "fp1": [f[0] for f in fps], "fp2": [f[1] for f in fps], "cells": [t[u].tolist() for t, u in zip(top, use)]})

    placed = materialise(sized.mapInPandas(light, "id long, fp1 long, fp2 long, cells array<int>").dropDuplicates(["id"]), "cells")
    classes = placed.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    copies = materialise(placed.join(classes, ["fp1", "fp2"]).select("id", "rep"), "copies")
    big = {r.cell: -(-r["count"] // cell_rows) for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().filter(F.col("count") > cell_rows).collect()}
    singles = sized.join(copies.filter("id <> rep").select("id"), "id", "left_anti")

    @nonempty
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser = Quantiser(*shared.value)
        for b in _parts(batches):
            ids, x = _unit(b, dim)
            table = x @ quantiser.words.T
            top, use = _assign(quantiser.cells_of(table), most_cells, margin)
            codes, norms = quantiser.encode(x, table)
            out: list[tuple] = []
            for r in range(len(ids)):
                v, c = x[r].tobytes(), codes[r].tobytes()
                for cell in top[r][use[r]].tolist():
                    parts = big.get(cell, 1)
                    if parts == 1:
                        out.append((cell, 0, 0, 3, ids[r], v, c, norms[r]))
                    else:  # role 1: query, 2: base
                        mine = int(ids[r] * 2_654_435_761 % 2**32) % parts
                        out += [(cell, mine, p, 1, ids[r], v, b"", 0.0) for p in range(parts)]
                        out += [(cell, p, mine, 2, ids[r], v, c, norms[r]) for p in range(parts)]
            yield pd.DataFrame(out, columns=["cell", "qc", "bb", "role", "id", "v", "c", "norm"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        quantiser = Quantiser(*shared.value)
        role = group["role"].to_numpy()
        ids = group["id"].to_numpy()
        x = np.frombuffer(b"".join(group["v"]), dtype=np.float32).reshape(-1, dim)
        qs, bs = role & 1 > 0, role & 2 > 0
        if not qs.any() or not bs.any():
            return pd.DataFrame({"q": np.empty(0, dtype=np.int64), "n": np.empty(0, dtype=np.int64), "cos": np.empty(0)})
        codes = np.frombuffer(b"".join(group["c"][bs]), dtype=np.uint16).reshape(int(bs.sum()), -1)
        return _group_search(quantiser, ids[qs], x[qs], ids[bs], x[bs], codes, group["norm"].to_numpy()[bs], k, shortlist)

    rows = singles.mapInPandas(spread, "cell int, qc int, bb int, role int, id long, v binary, c binary, norm float")
    near = rows.groupBy("cell", "qc", "bb").applyInPandas(search, "q long, n long, cos double")
    merged = materialise(_merge(near, k), "neighbours")
    return _expand(merged, copies, k)


def _merge(near: DataFrame, k: int) -> DataFrame:
    """The best k of each query over the lists of its cells; a query has at most k rows per cell and block."""
    best = near.groupBy("q", "n").agg(F.max("cos").alias("cos")).groupBy("q").agg(F.collect_list(F.struct((-F.col("cos")).alias("d"), "n")).alias("l"))
    return best.select("q", F.explode(F.slice(F.array_sort("l"), 1, k)).alias("e")).select("q", F.col("e.n").alias("n"), (-F.col("e.d")).alias("cos"))


def _expand(merged: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Give copies their neighbours: every member of a class sees its first k other members (cosine 1) and its representative's list, expanded."""
    if copies.limit(1).count() == 0:
        return merged
    # the first members of a class only: the limit is applied in every task before the shuffle, so a class of any size is k+1 rows of each
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = copies.withColumn("r", rank).filter(F.col("r") <= k + 1)
    ranked = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("first"))
    wide = merged.join(ranked.select(F.col("rep").alias("n"), "first"), "n", "left").select(
        "q", F.explode(F.coalesce("first", F.array("n"))).alias("n"), "cos"
    )
    lists = wide.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), "n"))), 1, k).alias("l"))
    own = copies.join(ranked, "rep").select(F.col("id").alias("q"), "rep", F.transform("first", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("n"))).alias("own"))
    members = own.join(lists.select(F.col("q").alias("rep"), "l"), "rep", "left").select("q", F.concat("own", F.coalesce("l", F.array())).alias("l"))
    others = lists.join(copies.select(F.col("id").alias("q")), "q", "left_anti").select("q", "l")
    every = members.union(others).select("q", F.slice(F.array_sort(F.filter("l", lambda e: e["n"] != F.col("q"))), 1, k).alias("l"))
    return every.select("q", F.explode("l").alias("e")).select("q", F.col("e.n").alias("n"), (-F.col("e.d")).alias("cos"))


def hash_bytes(data: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash."""
    import hashlib

    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def found(vectors: DataFrame, least: float = 0.8, **options) -> DataFrame:
    """p1_found (id_a, id_b): pairs of which one is among the five most similar others of the other, at a cosine of at least 0.80."""
    near = neighbours(vectors, **options).filter(F.col("cos") >= least)
    return near.select(F.least("q", "n").alias("id_a"), F.greatest("q", "n").alias("id_b")).distinct()


def brute_force(vectors: DataFrame, k: int = 5, dim: int = 384, id_col: str = "internal_id", every: int = 100, block: int = 4096) -> DataFrame:
    """(q, n, cos): the exact k most similar of the queries whose id is divisible by `every`, against all rows, in blocks of queries."""
    spark = vectors.sparkSession
    sized = _sized(vectors, dim, id_col)
    chosen = sized.filter(F.col("id") % every == 0)
    blocks = max(1, -(-chosen.count() // block))
    out = None
    for p in range(blocks):
        mine = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == p).toPandas()
        boxed = spark.sparkContext.broadcast(_unit(mine, dim))

        @nonempty
        def scan(batches: Iterator[pd.DataFrame], boxed=boxed) -> Iterator[pd.DataFrame]:
            q_ids, q = boxed.value
            for b in batches:
                ids, x = _unit(b, dim)
                if not len(ids) or not len(q_ids):
                    continue
                s = (q @ x.T).astype(np.float64)
                s[q_ids[:, None] == ids[None, :]] = -9
                r = min(k, s.shape[1])
                top = np.argpartition(-s, r - 1, axis=1)[:, :r]
                cos = np.take_along_axis(s, top, 1)
                keep = cos > -2
                yield pd.DataFrame({"q": np.repeat(q_ids[:, None], r, axis=1)[keep], "n": ids[top][keep], "cos": cos[keep]})

        part = sized.mapInPandas(scan, "q long, n long, cos double")
        out = part if out is None else out.union(part)
    return _merge(out, k)


def recall(vectors: DataFrame, k: int = 5, every: int = 100, slack: float = 1e-5) -> DataFrame:
    """(queries, true_pairs, found_pairs, recall) of the index against brute force; a neighbour as similar as the true k-th counts."""
    truth = brute_force(vectors, k, every=every)
    got = neighbours(vectors, k).filter(F.col("q") % every == 0)
    kth = truth.groupBy("q").agg(F.min("cos").alias("kth"), F.count("*").alias("m"))
    hits = got.join(kth, "q").filter(F.col("cos") >= F.col("kth") - slack).groupBy("q").agg(F.count("*").alias("h"))
    return kth.join(hits, "q", "left").agg(
        F.count("*").alias("queries"), F.sum("m").alias("true_pairs"), F.sum(F.coalesce("h", F.lit(0))).alias("found_pairs"),
        F.round(F.sum(F.coalesce("h", F.lit(0))) / F.sum("m"), 4).alias("recall"),
    )
