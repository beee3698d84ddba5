"""Queries over vectors, search, property features and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions import vectors as V
from lekhya.operators import analytics, chunk, embed, knn, search
from lekhya.plans.registry import query
from lekhya.session import new_folder, table
from lekhya.sources import store
from lekhya.streaming import ingest

WORDS = "sale deed property in Kondivali registered sale"
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
SQL_POST = f"SELECT DISTINCT term, doc_id FROM (SELECT unnest({TOK.format('text')}) AS term, doc_id FROM documents) WHERE length(term) > 2"
SQL_KW = f"""SELECT doc_id, sum(c) / 7.0 AS score FROM ({SQL_POST}) p JOIN (SELECT term, count(*) AS c FROM (SELECT unnest({TOK.format("'" + WORDS + "'")}) AS term) GROUP BY term) q ON p.term = q.term GROUP BY doc_id"""
SQL_VALID = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
SQL_VEC = f"SELECT internal_id, doc_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE {SQL_VALID}"
# the query vector belongs to the best keyword hit that has one, so that some document scores on both sides
SQL_QV = f"""SELECT v.e FROM ({SQL_VEC}) v JOIN ({SQL_KW}) k ON k.doc_id = v.doc_id ORDER BY round(k.score, 9) DESC, v.doc_id, v.internal_id LIMIT 1"""
SQL_EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
SQL_D2 = "pow(list_distance({0}, {1}), 2)"


def index_of(s: SparkSession, d: str) -> DataFrame:
    return search.postings(table(s, d, "documents"))


def valid_vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vectors")
    return v.filter(V.is_valid(F.col("embedding"), 384)).select("internal_id", "doc_id", "embedding")


_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(s: SparkSession, d: str) -> store.Index:
    """The search index of a data folder: built once in a session, in the shared folder, and only read by the searches."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        index = store.Index(s, new_folder(s, "index", keep=True))
        index.save(table(s, d, "documents"), valid_vectors(s, d))
        _INDEXES[key] = index.path
    return store.Index.load(s, _INDEXES[key])


def query_vector(s: SparkSession, d: str) -> list[float]:
    index = stored_index(s, d)
    kw = search.keyword_scores(index.postings(WORDS), WORDS)
    row = index.vectors().join(kw, "doc_id").orderBy(F.round("score", 9).desc(), "doc_id", "internal_id").select("embedding").first()
    return list(row.embedding)


def first_embedding(s: SparkSession, d: str) -> list[float]:
    return list(table(s, d, "embeddings").orderBy("vec_id").select("embedding").first().embedding)


# ---- keyword -----------------------------------------------------------------------------------------------------------

query("postings", SQL_POST)(index_of)
query("doc_frequency", f"SELECT term, count(*) AS df FROM ({SQL_POST}) GROUP BY term")(lambda s, d: index_of(s, d).groupBy("term").agg(F.count("*").alias("df")))
query("kw_search", f"SELECT doc_id, round(score, 6) AS score FROM ({SQL_KW}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10")(
    lambda s, d: stored_index(s, d).keyword(WORDS).withColumn("score", F.round("score", 6))
)
query(
    "kw_search_batch",
    f"""WITH p AS ({SQL_POST}), t AS (SELECT item_id, len(ts) AS n, unnest(ts) AS term FROM (SELECT item_id, {TOK.format("text")} AS ts FROM eval_items)),
    c AS (SELECT item_id, n, term, count(*) AS c FROM t GROUP BY ALL)
    SELECT item_id AS query_id, doc_id, round(score, 6) AS score FROM (
        SELECT item_id, doc_id, sum(c) / CAST(max(n) AS DOUBLE) AS score FROM c JOIN p USING (term) GROUP BY item_id, doc_id)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 10""",
)(lambda s, d: search.keyword_search_batch(stored_index(s, d).postings(), table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).withColumn("score", F.round("score", 6)))
query(
    "search_keyword_docs",
    f"""SELECT k.doc_id, round(score, 6) AS score, doc_name AS title, substring(text, 1, 200) AS preview FROM (SELECT * FROM ({SQL_KW}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10) k
    JOIN documents d ON d.doc_id = k.doc_id WHERE k.doc_id IN (SELECT doc_id FROM vectors WHERE {SQL_VALID})""",
)(
    lambda s, d: stored_index(s, d).search(WORDS, mode="keyword").withColumn("score", F.round("score", 6))
)

# ---- vectors -------------------------------------------------------------------------------------------------------------

query(
    "cosine_pair",
    f"""SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM ({SQL_EMB}) a JOIN ({SQL_EMB}) b ON b.vec_id = a.vec_id + 1""",
)(
    lambda s, d: (lambda e: e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(V.cosine_fast("embedding", "b"), 6).alias("sim")))(
        table(s, d, "embeddings").select("vec_id", "embedding")
    )
)
query(
    "cosine_topk",
    f"""SELECT vec_id, round(list_cosine_similarity(e, (SELECT e FROM ({SQL_EMB}) ORDER BY vec_id LIMIT 1)), 6) AS sim FROM ({SQL_EMB}) ORDER BY sim DESC, vec_id LIMIT 5""",
)(lambda s, d: knn.nearest(table(s, d, "embeddings"), first_embedding(s, d), "vec_id", 5, "cosine").select("vec_id", F.round(-F.col("d"), 6).alias("sim")))
query(
    "knn_l2",
    f"""SELECT vec_id, round(1 / (1 + d2), 6) AS score FROM (SELECT vec_id, {SQL_D2.format("e", f"(SELECT e FROM ({SQL_EMB}) ORDER BY vec_id LIMIT 1)")} AS d2 FROM ({SQL_EMB})) ORDER BY d2, vec_id LIMIT 10""",
)(lambda s, d: knn.nearest(table(s, d, "embeddings"), first_embedding(s, d), "vec_id", 10, "l2").select("vec_id", F.round(1 / (1 + F.col("d")), 6).alias("score")))
query(
    "knn_ip",
    f"""SELECT vec_id, round(1 / (1 + ip), 6) AS score FROM (SELECT vec_id, list_inner_product(e, (SELECT e FROM ({SQL_EMB}) ORDER BY vec_id LIMIT 1)) AS ip FROM ({SQL_EMB})) ORDER BY ip DESC, vec_id LIMIT 10""",
)(lambda s, d: knn.nearest(table(s, d, "embeddings"), first_embedding(s, d), "vec_id", 10, "ip").select("vec_id", F.round(F.try_divide(F.lit(1.0), 1 - F.col("d")), 6).alias("score")))
query(
    "knn_l2_batch",
    f"""SELECT query, vec_id, round(d2, 6) AS d2 FROM (SELECT q.vec_id AS query, x.vec_id, {SQL_D2.format("q.e", "x.e")} AS d2 FROM ({SQL_EMB}) q, ({SQL_EMB}) x WHERE q.vec_id % 100 = 0)
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(d2, 9), vec_id) <= 10""",
)(
    lambda s, d: (lambda e: knn.batch_nearest(e, e.filter("vec_id % 100 = 0"), "vec_id").select("query", "vec_id", F.round("d", 6).alias("d2")))(table(s, d, "embeddings").select("vec_id", "embedding"))
)
query(
    "vec_mean",
    f"""SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(e[i]), 6) AS mean FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM ({SQL_EMB})) GROUP BY label, i""",
)(lambda s, d: table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")))
query(
    "search_semantic_docs",
    f"""SELECT internal_id, doc_id, round(1 / (1 + d2), 6) AS score FROM (SELECT internal_id, doc_id, {SQL_D2.format("e", f"({SQL_QV})")} AS d2 FROM ({SQL_VEC})) ORDER BY round(d2, 9), internal_id LIMIT 10""",
)(lambda s, d: stored_index(s, d).semantic(query_vector(s, d)).withColumn("score", F.round("score", 6)))

# ---- hybrid and filters --------------------------------------------------------------------------------------------------------


def sql_hybrid(where: str) -> str:
    return f"""WITH kw AS (SELECT * FROM ({SQL_KW}) ORDER BY round(score, 9) DESC, doc_id LIMIT 20),
    sem AS (SELECT doc_id, min(score) AS score FROM (SELECT doc_id, 1 / (1 + d2) AS score FROM (SELECT internal_id, doc_id, {SQL_D2.format("e", f"({SQL_QV})")} AS d2 FROM ({SQL_VEC})) ORDER BY round(d2, 9), internal_id LIMIT 20) GROUP BY doc_id),
    m AS (SELECT doc_id, coalesce(sem.score, 0) AS semantic_score, coalesce(kw.score, 0) AS keyword_score FROM kw FULL OUTER JOIN sem USING (doc_id))
    SELECT m.doc_id, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, round(0.7 * semantic_score + 0.3 * keyword_score, 6) AS score
    FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE m.doc_id IN (SELECT doc_id FROM vectors WHERE {SQL_VALID}) {where} ORDER BY round(0.7 * semantic_score + 0.3 * keyword_score, 9) DESC, m.doc_id LIMIT 10"""


def hybrid(filters: dict | None) -> object:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = stored_index(s, d).search(WORDS, query_vector(s, d), filters=filters)
        return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "score")))

    return run


query("hybrid_search", sql_hybrid(""))(hybrid(None))
query("hybrid_filtered", sql_hybrid("AND d.lang IN ('en', 'EN', 'eng') AND d.n_chars >= 500 AND d.n_chars <= 4000"))(hybrid({"lang": ["en", "EN", "eng"], "n_chars": {"min": 500, "max": 4000}}))
for _n, _f, _w in (
    ("filter_range", {"ocr_confidence": {"min": 0.7, "max": 0.9}}, "ocr_confidence >= 0.7 AND ocr_confidence <= 0.9"),
    ("filter_in", {"source": ["notary_feed", "court_archive"]}, "source IN ('notary_feed', 'court_archive')"),
    ("filter_eq", {"lang": "hi"}, "lang = 'hi'"),
    ("filter_combined", {"lang": ["en", "eng"], "source": "registry_scan", "n_chars": {"min": 1000}}, "lang IN ('en', 'eng') AND source = 'registry_scan' AND n_chars >= 1000"),
):
    query(_n, f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {_w}")(lambda s, d, f=_f: table(s, d, "documents").filter(search.matches(f)).select("doc_id", "lang", "source", "n_chars"))

REST = "kondivali"
query(
    "rest_search",
    f"""SELECT doc_id, doc_name AS title, substring(text, 1, 200) AS preview, score, ingest_seq FROM (
        SELECT d.*, round(CAST(least((CASE WHEN contains(coalesce(lower(d.text), ''), '{REST}') THEN 0.5 ELSE 0 END) + (CASE WHEN contains(coalesce(lower(doc_name), ''), '{REST}') THEN 0.3 ELSE 0 END) + 0.2 * coalesce(hits, 0), 1.0) AS DOUBLE), 6) AS score
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS hits FROM (SELECT DISTINCT * FROM entities) WHERE contains(lower(text), '{REST}') GROUP BY doc_id) h ON h.doc_id = d.doc_id)
    WHERE score > 0 ORDER BY score DESC, ingest_seq LIMIT 10""",
)(lambda s, d: search.rest_search(table(s, d, "documents"), table(s, d, "entities"), REST))
query(
    "ui_search",
    f"""SELECT doc_id, doc_name AS title, substring(text, 1, 200) AS preview, CAST(0.95 AS DOUBLE) AS score FROM documents
    WHERE contains(coalesce(lower(text), ''), '{REST}') OR contains(coalesce(lower(doc_name), ''), '{REST}')""",
)(lambda s, d: search.ui_search(table(s, d, "documents"), REST))

# ---- embedding provider (a stand-in without models) -----------------------------------------------------------------------------------

query("embed_document")(
    lambda s, d: embed.document_embeddings(table(s, d, "documents").select("doc_id", chunk.sentence_chunks(F.col("text")).alias("chunks"))).select(
        "doc_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2")
    )
)

# ---- analytics ---------------------------------------------------------------------------------------------------------------------

SQL_P = "(SELECT DISTINCT * FROM property_features)"
SQL_CENTROIDS = f"SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM ({SQL_EMB})) GROUP BY label, i) GROUP BY label"
SQL_ASSIGN = f"""SELECT vec_id, label AS cluster FROM (SELECT v.vec_id, c.label, {SQL_D2.format("v.e", "c.c")} AS d2 FROM ({SQL_EMB}) v, ({SQL_CENTROIDS}) c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) = 1"""


def assigned(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
    return analytics.nearest_centroid(e, centroids, "vec_id")


query("nearest_centroid", SQL_ASSIGN)(assigned)
query("cluster_sizes", f"SELECT cluster, count(*) AS size FROM ({SQL_ASSIGN}) GROUP BY cluster")(lambda s, d: analytics.cluster_info(assigned(s, d)))
query(
    "cluster_info",
    f"""WITH a AS ({SQL_ASSIGN}), m AS (SELECT cluster, i, round(avg(e[i]), 5) AS m FROM (SELECT a.cluster, v.e, unnest(range(1, 65)) AS i FROM a JOIN ({SQL_EMB}) v ON v.vec_id = a.vec_id) GROUP BY cluster, i)
    SELECT cluster, size, ids, c1, c64 FROM (SELECT cluster, count(*) AS size, string_agg(vec_id, ',' ORDER BY vec_id) AS ids FROM a GROUP BY cluster)
    JOIN (SELECT cluster, max(m) FILTER (i = 1) AS c1, max(m) FILTER (i = 64) AS c64 FROM m GROUP BY cluster) USING (cluster)""",
)(
    lambda s, d: analytics.cluster_info(assigned(s, d), "vec_id", table(s, d, "embeddings").select("vec_id", "embedding")).select(
        "cluster", "size", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.round(F.col("centroid")[0], 5).alias("c1"), F.round(F.col("centroid")[63], 5).alias("c64")
    )
)
query("kmeans_embed")(lambda s, d: analytics.cluster_embeddings(table(s, d, "embeddings"), "vec_id"))
query("kmeans_features")(lambda s, d: analytics.cluster_properties(table(s, d, "property_features")))
query(
    "standardize",
    f"""WITH f AS (SELECT doc_id, coalesce(area, 0) AS a, coalesce(value_rs, 0) AS v, CAST(coalesce(year_built, 2020) AS DOUBLE) AS y FROM {SQL_P}),
    s AS (SELECT avg(a) am, stddev_pop(a) sa, avg(v) vm, stddev_pop(v) sv, avg(y) ym, stddev_pop(y) sy FROM f)
    SELECT doc_id, round((a - am) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS area_z, round((v - vm) / CASE WHEN sv = 0 THEN 1 ELSE sv END, 6) AS value_z, round((y - ym) / CASE WHEN sy = 0 THEN 1 ELSE sy END, 6) AS year_z FROM f, s""",
)(lambda s, d: analytics.standardised(table(s, d, "property_features")).select("doc_id", *(F.round(c, 6).alias(c) for c in ("area_z", "value_z", "year_z"))))
query(
    "features_default",
    f"""SELECT doc_id, coalesce(area, 0.0) AS area, coalesce(bedrooms, 2) AS bedrooms, coalesce(bathrooms, 1) AS bathrooms, coalesce(year_built, 2020) AS year_built, coalesce(location_score, 5.0) AS location_score, value_rs FROM {SQL_P}""",
)(lambda s, d: analytics.with_defaults(table(s, d, "property_features")))
query(
    "price_heuristic",
    f"""SELECT doc_id, p AS predicted_value, CAST(0.3 AS DOUBLE) AS confidence, round(p * 0.7, 4) AS low, round(p * 1.3, 4) AS high FROM (SELECT doc_id, coalesce(area, 1000.0) * 10000.0 AS p FROM {SQL_P})""",
)(lambda s, d: analytics.price_heuristic(table(s, d, "property_features")).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)}))


def fitted_line(s: SparkSession, d: str) -> DataFrame:
    """The line of a linear predictor with one feature: its predictions at 0 and 1 give intercept and slope."""
    model = analytics.ValuePredictor("linear", {"o_custkey": 0.0}, "o_totalprice", "o_orderkey")
    orders = table(s, d, "orders")
    n = model.train(orders, test_share=0.0)["train_samples"]
    at = {r.o_orderkey: r.predicted_value for r in model.predict(s.createDataFrame([(0, 0.0), (1, 1.0)], "o_orderkey long, o_custkey double")).collect()}
    return s.createDataFrame([(round(at[1] - at[0], 6), round(at[0], 3), n)], "slope double, intercept double, n long")


query(
    "linreg_1d",
    """SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept, count(*) AS n FROM orders""",
)(fitted_line)
query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * (SELECT sum(l_extendedprice) / sum(l_quantity) FROM lineitem) AS p FROM lineitem)
    SELECT round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2, count(*) AS n FROM p, (SELECT avg(y) AS m FROM p)""",
)(
    lambda s, d: (lambda l: analytics.metrics(l.crossJoin(F.broadcast(l.agg((F.sum("y") / F.sum("q")).alias("u")))).select("y", (F.col("q") * F.col("u")).alias("prediction")), "y").select(
        F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), "n"
    ))(table(s, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q")))  # the other side is one row
)
query(
    "ensemble_interval",
    """SELECT l_orderkey, round(quantile_cont(l_extendedprice, 0.1), 4) AS low, round(quantile_cont(l_extendedprice, 0.9), 4) AS high,
        round(greatest(0.0, least(1.0, CASE WHEN avg(l_extendedprice) > 0 THEN 1 - (quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1)) / avg(l_extendedprice) ELSE 0.5 END)), 6) AS confidence
    FROM lineitem GROUP BY l_orderkey""",
)(
    lambda s, d: (lambda g: g.select("l_orderkey", *analytics.interval(F.col("m"), F.col("v"))).select("l_orderkey", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("confidence", 6).alias("confidence")))(
        table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"), F.avg("l_extendedprice").alias("m"))
    )
)


def forecast(kind: str) -> object:
    def run(s: SparkSession, d: str) -> DataFrame:
        model = analytics.ValuePredictor(kind)
        model.train(table(s, d, "property_features"))
        return model.predict(table(s, d, "property_features").select("doc_id", *analytics.DEFAULTS, "value_rs"))

    return run


query("value_forecast_forest")(forecast("random_forest"))
query("value_forecast_linear")(forecast("linear"))
query("value_forecast_boosting")(forecast("gradient_boosting"))

# ---- streaming ----------------------------------------------------------------------------------------------------------------------


def event_counts(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    stream = ingest.windowed_counts(ingest.stream_of(s, path, s.read.parquet(path).schema))
    out = ingest.run_once(s, stream, "complete", "events")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


query(
    "stream_event_counts",
    """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)(event_counts)


def stream_entities(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/ocr_pages.parquet"
    stream = ingest.ingest(ingest.stream_of(s, path, s.read.parquet(path).schema))
    return ingest.run_once(s, stream, "append", "pages").groupBy("entity_type").agg(F.count("*").alias("n"))


query("stream_entities")(stream_entities)
