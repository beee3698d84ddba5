import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhya.operators import embed
from lekhya.sources import store

DOCS = "doc_id long, doc_name string, text string, lang string"
VECTORS = "doc_id long, embedding array<double>"


def docs(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.pdf", t, "en") for i, t in rows], DOCS)


def vectors(spark, *ids, dimension=16):
    return spark.createDataFrame([(i, embed.hashed([str(i)], dimension)[0].tolist()) for i in ids], VECTORS)


@pytest.fixture()
def index(spark, tmp_path):
    x = store.Index(spark, str(tmp_path / "ix"), 16)
    x.save(docs(spark, (1, "Sale deed of a house"), (2, "Lease of land"), (3, None)), vectors(spark, 1, 2, 3))
    return x


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_add_delete_and_upsert_keep_the_postings_right(spark, index):
    index.add(docs(spark, (4, "gift deed of the house")), vectors(spark, 4))
    assert ids(index.keyword("gift deed")) == [4, 1] and index.size() == 4 and index.counter == 4
    assert sorted(r.internal_id for r in index.vectors().collect()) == [0, 1, 2, 3]
    index.add(docs(spark, (4, "gift deed of the house")), vectors(spark, 4))  # again: the vector stays twice, scores don't double
    assert index.size() == 5 and [(r.doc_id, r.score) for r in index.keyword("gift deed").collect()] == [(4, 1.0), (1, 0.5)]
    index.upsert(docs(spark, (4, "will of the house")), vectors(spark, 4))
    assert ids(index.keyword("gift")) == [] and ids(index.keyword("will")) == [4] and index.size() == 4
    index.delete(spark.createDataFrame([(1,), (99,)], "doc_id long"))
    again = store.Index.load(spark, index.path)
    assert ids(again.keyword("deed")) == [] and again.size() == 3 and again.get(1).count() == 0
    assert again.get(4).first().text == "will of the house" and again.get(3).first().text is None
    again.add(docs(spark, (1, "deed once more")), vectors(spark, 1))  # added after its removal: it counts again
    assert ids(again.keyword("deed")) == [1] and max(r.internal_id for r in again.vectors().collect()) == 6
    again.compact()
    assert ids(again.keyword("house")) == [4] and again.size() == 4 and again.counter == 7
    with pytest.raises(ValueError):
        again.add(docs(spark, (9, "x")), vectors(spark, 9, dimension=3))


def test_searches_by_text_alone_are_ordered(spark, index):
    index.add(docs(spark, *((k, "sale " * (k % 3) + "land deed") for k in range(10, 30))), vectors(spark, *range(10, 30)))
    for mode in ("keyword", "semantic", "hybrid", "anything"):
        got = index.search("sale land deed", mode=mode, k=8).collect()
        scores = [round(r.score, 9) for r in got]
        assert len(got) == 8 and scores == sorted(scores, reverse=True), mode
    assert ids(index.search("17", mode="semantic", k=1)) == [17]
    assert index.search("sale", filters={"lang": "hi"}).count() == 0 and index.search("sale", filters={"lang": "en"}).count() > 0
    assert index.search("").count() > 0 and index.search("", mode="keyword").count() == 0


def test_keyword_search_reads_only_its_buckets_and_no_text(spark, index):
    plan = index.keyword("sale deed")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("PartitionFilters: [bucket", "PartitionFilters: [bucket") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "texts" not in plan and "text#" not in plan


def test_cells_of_the_ivf_kind(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 10
    x = np.concatenate([c + rng.normal(size=(40, 16)) for c in centres])
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], VECTORS)
    d = v.select("doc_id", F.lit("n").alias("doc_name"), F.lit("text").alias("text"))
    index = store.Index(spark, str(tmp_path / "ivf"), 16, "ivf", lists=8, probes=3)
    index.save(d, v)
    index = store.Index.load(spark, index.path)
    exact = np.argsort(((x - x[7]) ** 2).sum(1), kind="stable")[:10]
    got = ids(index.semantic(x[7].tolist(), 10))
    assert index.size() == 320 and len(set(got) & set(exact.tolist())) >= 9
    assert "cell" in index.near(x[7].tolist())._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
