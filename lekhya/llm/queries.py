"""Queries of the training-data operators over texts and vectors, and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.llm import addresses, leak, mix, near_dup, ocr_repair, residue, similar_vectors, split
from lekhya.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.found(table(spark, d, "vectors"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.recall(table(spark, d, "vectors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.found(table(spark, d, "ocr_pages"), table(spark, d, "cleaned_texts"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.paragraphs(table(spark, d, "ocr_pages"), table(spark, d, "cleaned_texts"))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = ocr_repair.pages_of(table(spark, d, "ocr_pages"), table(spark, d, "cleaned_texts"))
    return ocr_repair.repair_documents(table(spark, d, "ocr_documents"), pages)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.found(table(spark, d, "documents"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.found(table(spark, d, "entities"), table(spark, d, "resolved_entities"))


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    return addresses.places(table(spark, d, "entities"), table(spark, d, "resolved_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.found(table(spark, d, "ocr_documents"), table(spark, d, "cleaned_texts"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_items(split.items(table(spark, d, "ocr_documents"), table(spark, d, "cleaned_texts")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    return residue.score_documents(table(spark, d, "documents")).select("doc_id", F.array_join("kinds", ",").alias("kinds"), "score", "host_copies")


QUERIES = {
    "p1_found": p1_found, "p1_recall": p1_recall,
    "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p2_documents": p2_documents,
    "p3_found": p3_found, "p3_groups": p3_groups, "p8_found": p8_found, "p8_alignments": p8_alignments,
    "p4_found": p4_found, "p4_places": p4_places,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_evidence": p10_evidence,
}
_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ORACLES: dict[str, str] = {
    "p1_found": """
        WITH v AS MATERIALIZED (SELECT internal_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE len(embedding) = 384
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.id AS q, b.id AS n, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
        t AS (SELECT q, n, c FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, n) <= 5)
        SELECT DISTINCT least(q, n) AS id_a, greatest(q, n) AS id_b FROM t WHERE c >= 0.8""",
    "p3_found": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{_SPACE}]+') AS w FROM documents WHERE text IS NOT NULL),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 50)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p3_groups": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{_SPACE}]+') AS w FROM documents WHERE text IS NOT NULL),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 50)),
        h AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY doc_id),
        m AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS copies FROM h),
        r AS MATERIALIZED (SELECT doc_id, n FROM m WHERE doc_id = rep),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM r) AND b.doc_id IN (SELECT doc_id FROM r) GROUP BY ALL),
        p AS MATERIALIZED (SELECT a, b FROM c JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c)),
        e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        t AS (SELECT doc_id AS a, doc_id AS b FROM r UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
        g AS (SELECT a AS rep, min(b) AS group_id FROM t GROUP BY a),
        d AS (SELECT a AS rep, count(*) AS d FROM e GROUP BY a)
        SELECT doc_id, group_id, coalesce(d, 0) + copies - 1 AS links FROM m JOIN g USING (rep) LEFT JOIN d USING (rep) WHERE coalesce(d, 0) + copies > 1""",
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
        eg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p6_found": """
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_no
        FROM (SELECT doc_id, unnest(range(1, len(paragraphs) + 1)) AS i, paragraphs FROM cleaned_texts)
        WHERE length(paragraphs[i]) > 512
        UNION ALL SELECT doc_id, CAST(-1 AS INTEGER) FROM ocr_documents WHERE length(full_text) > 512""",
}
