import numpy as np
from pyspark.sql import functions as F

from lekhya.operators import analytics, embed, knn, reports, search
from lekhya.sources import ocr, store


def docs(spark):
    rows = [(1, "a.pdf", "Sale agreement for a property in Bangalore", 1), (2, "b.pdf", "Property sale deed", 2), (3, "c.pdf", "Rental agreement of a flat", 3), (4, "d.pdf", None, 4)]
    return spark.createDataFrame(rows, "doc_id long, doc_name string, text string, ingest_seq long")


def test_keyword(spark):
    index = search.postings(docs(spark))
    got = {r.doc_id: round(r.score, 4) for r in search.keyword_search(index, "sale sale of").collect()}
    assert got == {1: 0.6667, 2: 0.6667}
    batch = search.keyword_search_batch(index, spark.createDataFrame([(7, "property sale"), (8, "nothing")], "query_id long, query string"), 1).collect()
    assert [(r.query_id, r.doc_id) for r in batch] == [(7, 1)]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8)], "vec_id long, embedding array<double>").repartition(5)
    d = ((x - x[3]) ** 2).sum(1)
    assert [r.vec_id for r in knn.nearest(v, x[3].tolist(), "vec_id", 5).collect()] == np.lexsort((np.arange(200), d))[:5].tolist()
    got = knn.batch_nearest(v, v.filter("vec_id < 20"), "vec_id", 3, block=7).groupBy("query").agg(F.collect_list("vec_id").alias("l")).collect()
    for r in got:
        assert set(r.l) == set(np.argsort(((x - x[r["query"]]) ** 2).sum(1))[:3].tolist())


def test_hybrid_and_filters(spark):
    v = spark.createDataFrame([(0, 1, [0.0, 1.0]), (1, 2, [1.0, 0.0]), (2, 2, [5.0, 0.0])], "internal_id long, doc_id long, embedding array<double>")
    d = docs(spark).withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    got = search.hybrid_search(search.postings(d), v, d, "property sale", [0.0, 1.0]).collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].semantic_score == 1.0
    assert [r.doc_id for r in search.hybrid_search(search.postings(d), v, d, "property sale", [0.0, 1.0], filters={"lang": "en"}).collect()] == [1]
    assert d.filter(search.matches({"lang": ["en"], "doc_id": {"max": 3}})).count() == 1 and d.filter(search.matches({})).count() == 4


def test_simple_searches(spark):
    e = spark.createDataFrame([(1, 1, "Bangalore", "LOCATION", 0), (1, 1, "Bangalore", "LOCATION", 0), (2, 2, "bangalore east", "LOCATION", 0)], "entity_id long, doc_id long, text string, entity_type string, start_pos int")
    got = [(r.doc_id, r.score) for r in search.rest_search(docs(spark), e, "Bangalore").collect()]
    assert got == [(1, 0.7), (2, 0.2)]
    assert search.ui_search(docs(spark), "B.PDF").count() == 1


def test_reports(spark):
    e = spark.createDataFrame([(1, 1, "Ram", "PERSON", 5), (2, 1, "Sita", "PERSON", 1), (3, 1, "10 acres", "AREA", 9)], "entity_id long, doc_id long, text string, entity_type string, start_pos int")
    f = reports.fields(docs(spark), e)
    r = {x.doc_id: x for x in f.collect()}
    assert r[1].parties == "- Sita\n- Ram" and r[1].area == "10 acres" and r[2].parties == "- Not identified" and r[2].area == "Not specified"
    text = spark.createDataFrame([(1, "lost\n**A**\nx\n\n## B \n y\n**A**\nz\n****\nq")], "doc_id long, text string")
    assert {(x.section, x.body) for x in reports.parse_sections(text).collect()} == {("A", "z"), ("B", "y")}
    assert reports.parse_sections(f.select("doc_id", reports.report_text().alias("text"))).count() == 20


def test_ocr_and_store(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one\ftwo")
    files = ocr.checked(ocr.read_files(spark, str(tmp_path)))
    pages = ocr.process(files, "text")
    assert ocr.assemble(pages, "file_path").first().full_text == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo"
    (tmp_path / "y.exe").write_bytes(b"MZ")
    try:
        ocr.checked(ocr.read_files(spark, str(tmp_path))).collect()
        raise AssertionError("bad types must fail")
    except Exception as x:
        assert "unsupported file type" in str(x)
    try:
        ocr.process(files, "missing")
        raise AssertionError("a missing provider must fail")
    except ValueError:
        pass
    ids = store.dense_ids(docs(spark).repartition(3), "ingest_seq", "n").orderBy("ingest_seq")
    assert [r.n for r in ids.collect()] == [0, 1, 2, 3]
    index = store.Index(spark, str(tmp_path / "ix"), 2)
    index.save(docs(spark), spark.createDataFrame([(0, 1, [0.0, 1.0])], "internal_id long, doc_id long, embedding array<double>"))
    again = store.Index.load(spark, str(tmp_path / "ix"))
    assert again.size() == 1 and again.search("sale", mode="keyword").count() == 1 and again.search("sale", [0.0, 1.0]).count() == 1


def test_analytics(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(a * 3 + 5), 2, 1, 2000, 5.0) for k, a in enumerate(rng.uniform(10, 100, 60))] + [(99, None, None, None, None, None, None)]
    f = spark.createDataFrame(rows, "doc_id long, area double, value_rs double, bedrooms int, bathrooms int, year_built int, location_score double")
    assert {r.doc_id: r.predicted_value for r in analytics.price_heuristic(f).collect()}[99] == 1e7
    model = analytics.ValuePredictor("linear")
    assert model.predict(f).count() == 61
    assert model.train(f)["r2"] > 0.99
    z = analytics.standardised(f).agg(F.avg("area_z"), F.stddev_pop("area_z"), F.max("year_z")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    v = spark.createDataFrame([(k, [float(k % 2), 0.0]) for k in range(12)], "vec_id long, embedding array<double>")
    parts = analytics.cluster_embeddings(v, "vec_id", k=2, starts=2).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in parts) == [6, 6]
    e = embed.hashed(["a b", "a b", ""])
    assert np.allclose(e[0], e[1]) and not e[2].any()
