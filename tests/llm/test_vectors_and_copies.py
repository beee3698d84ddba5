import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lekhya.llm import graph, near_dup, similar_vectors


def exact_pairs(ids, x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    out = set()
    for r in range(len(ids)):
        for j in np.lexsort((ids, -s[r]))[:k]:
            if s[r, j] >= least:
                out.add((min(ids[r], ids[j]), max(ids[r], ids[j])))
    return out


def vectors(n=400, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    x = np.repeat(base, 4, axis=0) + 0.25 * rng.normal(size=(n, dim))
    return np.arange(n) * 3 + 1, x * rng.uniform(0.5, 9, size=(n, 1))


def frame(spark, ids, x):
    rows = [(int(i), v.astype("float32").tolist(), "m") for i, v in zip(ids, x)]
    bad = [(9001, None, "m"), (9002, [0.0] * x.shape[1], "m"), (9003, [float("nan")] * x.shape[1], "m"), (9004, [1.0], "m"), (9005, [], "m")]
    return spark.createDataFrame(rows + bad, "internal_id long, embedding array<float>, id string")


def test_p1_against_brute_force(spark):
    ids, x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = exact_pairs(ids, u, 5, 0.8)
    for options in ({}, {"cell_rows": 16}):  # the second splits hot cells
        got = {tuple(r) for r in similar_vectors.found(frame(spark, ids, x), dim=16, **options).collect()}
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_p1_copies_and_empty(spark):
    ids, x = vectors(40)
    x[:12] = x[0]  # a third of the rows are one vector
    near = similar_vectors.neighbours(frame(spark, ids, x), dim=16).filter("q <= 34").groupBy("q").agg(F.collect_list("n").alias("l")).collect()
    firsts = [int(i) for i in ids[:12]]
    for r in near:
        assert sorted(r.l) == [i for i in firsts if i != r.q][:5]
    assert similar_vectors.found(frame(spark, ids, x).limit(0), dim=16).count() == 0


def test_quantiser_beam_is_no_worse_than_greedy():
    _, x = vectors(2000, 32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = similar_vectors.Quantiser.fit(x, 16, levels=4, size=16, beam=8)
    errors = []
    for beam in (1, 8):
        q.beam = beam
        codes, norms = q.encode(x)
        errors.append(float(((x - q.decode(codes)) ** 2).sum(1).mean()))
        assert np.allclose(norms, np.linalg.norm(q.decode(codes), axis=1), atol=1e-4)
    assert errors[1] <= errors[0] + 1e-6


def texts(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(4000)]
    out = []
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        out.append((g * 10, " ".join(base)))
        for c in range(1, 5):
            w = base.copy()
            for _ in range(c * 3):
                w[rng.integers(len(w))] = str(rng.choice(words))
            out.append((g * 10 + c, ("\n" if c % 2 else " ").join(w)))
    out += [(500, out[0][1].upper()), (501, out[0][1]), (502, None), (503, "too short"), (504, "")]
    return out


def brute(rows, n=3, t=0.6, least=50):
    sets = {}
    for i, x in rows:
        w = x.lower().split() if x else []
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_p3_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, rep string")
    want = brute(rows)
    assert len(want) > 60
    assert {tuple(r) for r in near_dup.found(df.union(df.limit(3))).collect()} == want
    g = {r.doc_id: (r.group_id, r.links) for r in near_dup.groups(df).collect()}
    assert g[501][0] == 0 and all(g[a][0] == g[b][0] for a, b in want)
    assert near_dup.found(df.limit(0)).count() == 0


def test_p3_oversized_buckets_and_hot_keys_lose_nothing(spark):
    rows = texts(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    pairs, members = near_dup.similar_pairs(df, bucket=2)  # nearly every bucket is oversized: the prefix join takes over
    reps = {r.id: r.rep for r in members.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    assert {(min(reps[a], reps[b]), max(reps[a], reps[b])) for a, b in want if reps[a] != reps[b]} == got
    sig = near_dup.signatures(df).dropDuplicates(["id"])
    plain = {tuple(r) for r in near_dup.candidates(sig, 18, 0.6, 256).filter("b IS NOT NULL").collect()}
    split = {tuple(r) for r in near_dup.candidates(sig, 18, 0.6, 256, hot=1).filter("b IS NOT NULL").collect()}
    assert plain == split and plain


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in graph.components(e).collect()}
    assert all(got[k] == 0 for k in range(21)) and got[51] == 50


def test_p3_exact_mode_and_hot_keys_miss_no_pair(spark):
    rng = random.Random(33)
    vocab = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for k in range(90):  # two thirds are edited copies of one text: hot keys and oversized buckets
        w = list(base) if k % 3 else [rng.choice(vocab) for _ in range(60)]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(60)] = rng.choice(vocab)
        docs.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({"exact": True}, {"hot": 10, "bucket": 8}):
        pairs, members = near_dup.similar_pairs(df, **options)
        reps = {r.id: r.rep for r in members.collect()}
        got = {(r.a, r.b) for r in pairs.collect()}
        full = {(a, b) for a in reps for b in reps if a < b and (reps[a] == reps[b] or (min(reps[a], reps[b]), max(reps[a], reps[b])) in got)}
        assert len(want - full) <= (0 if "exact" in options else 0.01 * len(want)) and not full - want


def test_p3_large_buckets_are_enumerated_and_class_counts_drop_no_pair(spark):
    rng = random.Random(5)
    stock = [f"s{k}" for k in range(70)]
    docs = [(k, " ".join(stock + [f"n{rng.randrange(10**6)}" for _ in range(rng.choice((8, 60)))])) for k in range(420)]  # every text holds the stock: buckets of over 256
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sig = near_dup.signatures(df)
    cand = near_dup.candidates(sig, 18, 0.6).collect()
    assert not [r for r in cand if r.b is None]  # such buckets went to the prefix-filter join, which writes every n-gram of their texts
    assert len(cand) == len({(r.a, r.b) for r in cand}) and {tuple(r) for r in near_dup.found(df).collect()} == brute(docs)
    hot = near_dup.candidates(sig, 18, 0.6, hot=100)
    assert {tuple(r) for r in hot.collect()} == {(r.a, r.b) for r in cand}


def test_p3_class_counts_bound_the_common_ngrams():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, size=9000, dtype=np.uint64)
    for size in (3, 60, 300, 6000):  # at 6000 the counts are full
        for share in (0.0, 0.3, 0.75, 0.9, 1.0):
            x = np.unique(pool[:size])
            y = np.unique(np.concatenate([pool[: int(size * share)], pool[size : size + size - int(size * share)]])) if size < 4000 else np.unique(pool[int(size * (1 - share) / 2) :][:size])
            common = len(np.intersect1d(x, y))
            may = near_dup._may_reach(pd.Series([near_dup._class_counts(x)]), pd.Series([near_dup._class_counts(y)]), np.array([len(x)]), np.array([len(y)]), 0.6)
            assert may[0] or common < 0.6 * (len(x) + len(y) - common)
            assert not may[0] or size != 300 or share >= 0.75  # and it does tell unlike sets apart
    assert not len(near_dup._may_reach(pd.Series([], dtype=object), pd.Series([], dtype=object), np.array([]), np.array([]), 0.6))
