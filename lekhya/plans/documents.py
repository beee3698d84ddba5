"""Queries over documents, pages and entities: store, cleaning, chunks, extraction, resolution, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.functions import text as T
from lekhya.operators import chunk, ner, reports, resolve, search
from lekhya.plans.registry import query
from lekhya.session import spread, table
from lekhya.sources import ocr, pipeline, store

WS = T.WS
S = WS[1:-1]

# ---- SQL fragments -------------------------------------------------------------------------------------------------


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def sql_ocr(x: str) -> str:
    w, n = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|{n})0({WS}+(?:Rs|INR|₹)|₹)', '\1O\2', 'g')"
    for a in ("[a-z]", "[A-Z]"):
        digit, to = ("1", "l") if a == "[a-z]" else ("0", "O")
        for _ in range(2):
            x = rf"regexp_replace({x}, '({a}){digit}({a})', '\1{to}\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|{n})l($|{n})', '\1I\2', 'g')"
    return f"replace(replace({x}, 'rn', 'm'), 'vv', 'w')"


def sql_noise(x: str) -> str:
    pattern = T.NOISE.replace("^(?i)", "(?i)^")
    return rf"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches({sql_strip('l')}, '{pattern}')), chr(10))"


def sql_legal(x: str) -> str:
    for p, to in T.LEGAL_TERMS:
        x = f"regexp_replace({x}, '{p}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return x


def sql_space(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{WS}*\n', chr(10) || chr(10), 'g')"
    return sql_strip(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {sql_strip('l')}), chr(10))")


def sql_map(x: str) -> str:
    for old, new in T.UNICODE_MAP:
        x = f"replace({x}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return x


def per_document(expr) -> object:
    return lambda s, d: spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", expr(F.col("text")).alias("cleaned"))


def sql_per_document(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS cleaned FROM documents"


# ---- cleaning --------------------------------------------------------------------------------------------------------

query("clean_unicode_map", sql_per_document(sql_map("text")))(per_document(T.unicode_map))
query("clean_ocr_fix", sql_per_document(sql_ocr("text")))(per_document(T.ocr_fix))
query("clean_noise_lines", sql_per_document(sql_noise("text")))(per_document(T.drop_noise_lines))
query("clean_legal_terms", sql_per_document(sql_legal("text")))(per_document(T.legal_terms))
query("clean_whitespace", sql_per_document(sql_space("text")))(per_document(T.whitespace))
query("clean_without_nfkc", sql_per_document(sql_space(sql_legal(sql_noise(sql_ocr("text"))))))(per_document(lambda c: T.clean(c, normalize_unicode=False)))
query("clean_full")(per_document(T.clean))
query(
    "clean_noise_pages",
    f"SELECT DISTINCT doc_id, page_number, {sql_noise('text')} AS cleaned FROM ocr_pages WHERE text IS NOT NULL",
)(lambda s, d: table(s, d, "ocr_pages").filter("text IS NOT NULL").select("doc_id", "page_number", T.drop_noise_lines(F.col("text")).alias("cleaned")).distinct())
query(
    "clean_paragraphs",
    f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_no, p[i] AS paragraph FROM (
        SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
            SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda l: {sql_strip("l")}), lambda l: l <> '') AS p FROM documents WHERE text IS NOT NULL))""",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_no", "paragraph")))
query(
    "text_stats",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{S}]+')) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents""",
)(lambda s, d: table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").alias("chars")))
query("text_preview", "SELECT doc_id, substring(text, 1, 200) AS p200, substring(text, 1, 150) AS p150 FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("p200"), T.preview(F.col("text"), 150).alias("p150"))
)
query(
    "tokenize",
    r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")))

# ---- store and OCR -----------------------------------------------------------------------------------------------------

query("doc_scan", "SELECT doc_id, doc_name, ingest_seq FROM documents")(lambda s, d: store.scan(table(s, d, "documents").select("doc_id", "doc_name", "ingest_seq")))
query("doc_get", "SELECT doc_id, doc_name, text FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")(
    lambda s, d: store.get(table(s, d, "documents"), table(s, d, "documents").agg(F.min("doc_id")).first()[0]).select("doc_id", "doc_name", "text")
)
query(
    "doc_delete_anti",
    """WITH gone AS (SELECT doc_id FROM documents WHERE ocr_confidence < 0.75)
    SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
    UNION ALL SELECT 'vectors', internal_id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = v.doc_id)""",
)(
    lambda s, d: (lambda docs, gone, v: store.without(docs, gone).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id")).union(
        store.without(v, gone).select(F.lit("vectors"), "internal_id")))(table(s, d, "documents"), table(s, d, "documents").filter("ocr_confidence < 0.75"), table(s, d, "vectors"))
)
query("vec_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY ingest_seq) - 1 AS BIGINT) AS vec_id FROM documents")(
    lambda s, d: store.dense_ids(table(s, d, "documents").select("doc_id", "ingest_seq"), "ingest_seq", "vec_id").select("doc_id", "vec_id")
)
query("vec_size", "SELECT count(*) AS n FROM vectors")(lambda s, d: table(s, d, "vectors").agg(F.count("*").alias("n")))
query("vec_first_by_doc", "SELECT doc_id, min(internal_id) AS internal_id FROM vectors WHERE doc_id IS NOT NULL GROUP BY doc_id")(
    lambda s, d: search.first_by_doc(table(s, d, "vectors"))
)
query(
    "ocr_assemble",
    """SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number, text) AS full_text,
        round(avg(confidence), 6) AS avg_confidence, CAST(count(*) AS INTEGER) AS total_pages
    FROM (SELECT DISTINCT doc_id, page_number, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence FROM ocr_pages) GROUP BY doc_id""",
)(lambda s, d: ocr.assemble(table(s, d, "ocr_pages")).withColumn("avg_confidence", F.round("avg_confidence", 6)))
query(
    "ocr_conf_tesseract",
    """SELECT doc_id, round(coalesce(avg(confidence) FILTER (confidence > 0), 0.0), 6) AS confidence
    FROM (SELECT DISTINCT * FROM ocr_pages WHERE lower(backend) = 'tesseract') GROUP BY doc_id""",
)(lambda s, d: ocr.word_confidence(table(s, d, "ocr_pages")).withColumn("confidence", F.round("confidence", 6)))

# ---- chunks ------------------------------------------------------------------------------------------------------------

query(
    "chunk_fixed",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 462 + 1, 512) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 462.0) AS INTEGER), 1))) AS i FROM documents WHERE text IS NOT NULL)""",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(chunk.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk")))


def sql_chunk_end(b: str) -> str:
    """Where the sentence chunk that begins at b ends, from the reversed window: its first full stop and blank, full stop and line end, or blank line."""
    w = f"substring(text, {b} + 1, 512)"
    ends = [f"CASE WHEN contains({w}, {sep}) THEN {b} + length({w}) - strpos(reverse({w}), {rev}) + 1 END" for sep, rev in (("'. '", "' .'"), ("'.' || chr(10)", "chr(10) || '.'"), ("chr(10) || chr(10)", "chr(10) || chr(10)"))]
    picks = ", ".join(f"CASE WHEN {e} > {b} + 50 THEN {e} END" for e in ends)
    return f"CASE WHEN {b} + 512 < length(text) THEN coalesce({picks}, {b} + 512) ELSE {b} + 512 END"


query(
    "chunk_sentence",
    f"""WITH RECURSIVE c AS (
        SELECT doc_id, text, CAST(0 AS BIGINT) AS b, CAST({sql_chunk_end("0")} AS BIGINT) AS e FROM documents WHERE length(text) > 512
        UNION ALL SELECT doc_id, text, b, CAST({sql_chunk_end("b")} AS BIGINT) FROM (SELECT doc_id, text, e - 50 AS b FROM c WHERE e - 50 < length(text))),
    k AS (SELECT doc_id, b, {sql_strip("substring(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))")} AS chunk FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS chunk_no, chunk FROM k WHERE chunk <> ''
    UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 512""",
)(lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(chunk.sentence_chunks(F.col("text"))).alias("chunk_no", "chunk")))

# ---- extraction ----------------------------------------------------------------------------------------------------------


def sql_pattern(p: str) -> str:
    return "(?i)" + ner.portable(p).replace("'", "''")


def sql_matches(types: list[str] | None, offsets: bool) -> str:
    parts = []
    for k, (t, p) in enumerate(ner.PATTERNS):
        if types and t not in types:
            continue
        q = sql_pattern(p)
        pos = (
            f"""CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(w, 1, i - 1), lambda x: length(x))), 0) AS INTEGER) AS start_pos,"""
            if offsets
            else ""
        )
        split = f", regexp_split_to_array(text, '{q}') AS g" if offsets else ""
        parts.append(
            f"""SELECT doc_id, '{t}' AS entity_type, CAST({k} AS INTEGER) AS ord, CAST(i - 1 AS INTEGER) AS occ, {pos} w[i] AS text, {sql_strip("c[i]")} AS normalized
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{q}', 0) AS w, regexp_extract_all(text, '{q}', 1) AS c{split} FROM documents WHERE text IS NOT NULL))"""
        )
    return " UNION ALL ".join(parts)


def _found(types: list[str]) -> object:
    return lambda s, d: ner.raw_matches(table(s, d, "documents").select("doc_id", "text"), types).select("doc_id", "entity_type", "ord", "occ", "text", "normalized")


for _name, _type in (("ner_property_id", "PROPERTY_ID"), ("ner_area", "AREA"), ("ner_money", "MONEY"), ("ner_date", "DATE"), ("ner_doctype", "DOCUMENT_TYPE")):
    query(_name, sql_matches([_type], False))(_found([_type]))
query(
    "ner_offsets",
    f"SELECT doc_id, ord, occ, start_pos, CAST(start_pos + length(text) AS INTEGER) AS end_pos FROM ({sql_matches(None, True)})",
)(lambda s, d: ner.raw_matches(table(s, d, "documents").select("doc_id", "text")).select("doc_id", "ord", "occ", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")))

SQL_DEDUP = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, CAST(start_pos + length(text) AS INTEGER) AS end_pos FROM ({sql_matches(None, True)})),
    pick AS (
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, ord, occ) = 1
        UNION ALL
        SELECT e.* FROM pick JOIN e ON e.doc_id = pick.doc_id AND e.start_pos >= pick.end_pos
        QUALIFY row_number() OVER (PARTITION BY e.doc_id ORDER BY e.start_pos, e.ord, e.occ) = 1)"""
query("ner_dedup", f"{SQL_DEDUP} SELECT doc_id, start_pos, end_pos, entity_type, text, normalized FROM pick")(
    lambda s, d: ner.extract(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "entity_type", "text", "normalized")
)
query("ner_counts", f"{SQL_DEDUP} SELECT doc_id, entity_type, count(*) AS n FROM pick GROUP BY ALL")(
    lambda s, d: ner.counts(ner.extract(table(s, d, "documents").select("doc_id", "text")))
)
query(
    "ner_grouped",
    f"{SQL_DEDUP} SELECT doc_id, entity_type, string_agg(text, '|' ORDER BY start_pos) AS texts FROM pick GROUP BY ALL",
)(
    lambda s, d: ner.grouped(ner.extract(table(s, d, "documents").select("doc_id", "text"))).select(
        "doc_id", "entity_type", F.array_join(F.transform("entities", lambda x: x["text"]), "|").alias("texts")
    )
)
query(
    "ner_label_map",
    """SELECT entity_id, CASE label WHEN 'PERSON' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'DATE' THEN 'DATE' WHEN 'MONEY' THEN 'MONEY' END AS mapped
    FROM (SELECT DISTINCT entity_id, CASE entity_type WHEN 'LOCATION' THEN 'LOC' WHEN 'ORGANIZATION' THEN 'ORG' ELSE entity_type END AS label FROM entities)""",
)(
    lambda s, d: reports.unique(table(s, d, "entities")).select(
        "entity_id",
        ner.label_map(F.when(F.col("entity_type") == "LOCATION", "LOC").when(F.col("entity_type") == "ORGANIZATION", "ORG").otherwise(F.col("entity_type"))).alias("mapped"),
    )
)


def titled_names() -> object:
    """A stand-in for a model: names behind a courtesy title are persons."""
    import re

    name = re.compile(r"(?:Mr|Mrs|Dr|Smt|Shri)\.? [A-Z][a-z]+ [A-Z][a-z]+")
    return lambda texts: [[(m.start(), m.end(), "PER", None) for m in name.finditer(t)] for t in texts]


ner.register("titled", titled_names)
query(
    "ner_model",
    r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS occ, 'PERSON' AS entity_type, w[i] AS text, CAST(0.85 AS DOUBLE) AS confidence
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:Mr|Mrs|Dr|Smt|Shri)\.? [A-Z][a-z]+ [A-Z][a-z]+') AS w FROM documents WHERE text IS NOT NULL))""".replace("\\\\", "\\"),
)(lambda s, d: table(s, d, "documents").select("doc_id", F.inline(ner.model_matches(F.col("text"), "titled"))).select("doc_id", "occ", "entity_type", "text", "confidence"))


def processed_counts(p: pipeline.Processed) -> object:
    sizes = p.vectors.select("doc_id", F.size("embedding").alias("dimension"))
    return ner.counts(p.entities).join(p.documents.select("doc_id", F.col("word_count").alias("words"), F.col("char_count").alias("chars")), "doc_id").join(sizes, "doc_id")


query("pipeline_doc")(lambda s, d: processed_counts(pipeline.process(table(s, d, "ocr_pages"))))

# ---- resolution ------------------------------------------------------------------------------------------------------------


def sql_title(x: str) -> str:
    return rf"array_to_string(list_transform(string_split(lower({x}), ''), lambda ch, i: CASE WHEN i = 1 OR NOT regexp_matches(string_split(lower({x}), '')[i - 1], '\p{{L}}') THEN upper(ch) ELSE ch END), '')"


def sql_name(x: str) -> str:
    x = sql_strip(f"lower({x})")
    for p in resolve.ordered_prefixes():
        x = rf"regexp_replace({x}, '^{p}\.?{WS}*', '')"
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_location(x: str) -> str:
    x = sql_strip(f"lower({x})")
    for short, full in resolve.LOCATIONS:
        q = short.replace("'", "''")
        x = f"regexp_replace({x}, '^{q}( |\\z)', '{full}\\1')"
    return rf"regexp_replace({x}, '{WS}*-{WS}*\p{{Nd}}+', '', 'g')"


def sql_similarity(a: str, b: str) -> str:
    a, b = f"lower({a})", f"lower({b})"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
    initials = lambda x: f"array_to_string(list_transform({words(x)}, lambda w: substring(w, 1, 1)), '')"
    chars = lambda x: f"list_filter(list_distinct(string_split({x}, '')), lambda ch: ch <> '')"
    some = f"len({words(a)}) > 0 AND len({words(b)}) > 0"
    both = f"len(list_intersect({chars(a)}, {chars(b)}))"
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9
        WHEN {some} AND {words(a)}[-1] = {words(b)}[-1] THEN 0.8 WHEN {some} AND {initials(a)} = {initials(b)} THEN 0.75
        WHEN len({chars(a)}) + len({chars(b)}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({chars(a)}) + len({chars(b)}) - {both}) END"""


TYPES = ["PERSON", "ORGANIZATION", "LOCATION"]
SQL_MENTIONS = f"""SELECT DISTINCT doc_id, entity_type, text AS mention, CASE entity_type WHEN 'PERSON' THEN {sql_name("text")} WHEN 'LOCATION' THEN {sql_location("text")} ELSE text END AS norm
    FROM entities WHERE entity_type IN ('PERSON', 'ORGANIZATION', 'LOCATION') AND text IS NOT NULL AND doc_id IS NOT NULL"""
query("er_norm_name", f"SELECT DISTINCT text AS mention, {sql_title(sql_name('text'))} AS norm FROM entities WHERE entity_type = 'PERSON' AND text IS NOT NULL")(
    lambda s, d: table(s, d, "entities").filter("entity_type = 'PERSON' AND text IS NOT NULL").select(F.col("text").alias("mention")).distinct().select("mention", resolve.norm_name(F.col("mention")).alias("norm"))
)
query("er_norm_location", f"SELECT DISTINCT text AS mention, {sql_title(sql_location('text'))} AS norm FROM entities WHERE entity_type = 'LOCATION' AND text IS NOT NULL")(
    lambda s, d: table(s, d, "entities").filter("entity_type = 'LOCATION' AND text IS NOT NULL").select(F.col("text").alias("mention")).distinct().select("mention", resolve.norm_location(F.col("mention")).alias("norm"))
)
query(
    "er_string_similarity",
    f"SELECT DISTINCT canonical, mention, round({sql_similarity('canonical', 'mention')}, 6) AS sim FROM (SELECT canonical, unnest(mentions) AS mention FROM resolved_entities)",
)(
    lambda s, d: table(s, d, "resolved_entities").select("canonical", F.explode("mentions").alias("mention")).distinct()
    .select("canonical", "mention", F.round(resolve.similarity(F.col("canonical"), F.col("mention")), 6).alias("sim"))
)
query(
    "er_pairs",
    f"""WITH m AS MATERIALIZED ({SQL_MENTIONS}) SELECT * FROM (
        SELECT x.doc_id, x.entity_type, x.mention AS a, y.mention AS b, round({sql_similarity("x.norm", "y.norm")}, 6) AS sim
        FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.entity_type = y.entity_type AND x.mention < y.mention) WHERE sim >= 0.85""",
)(lambda s, d: resolve.pairs(table(s, d, "entities"), TYPES))
SQL_CLUSTERS = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY mention) AS pos FROM ({SQL_MENTIONS})),
    r AS (
        SELECT doc_id, entity_type, pos, mention, mention AS leader, [mention] AS leaders, [norm] AS norms FROM m WHERE pos = 1
        UNION ALL
        SELECT doc_id, entity_type, pos, mention, coalesce(leaders[hit], mention), CASE WHEN hit IS NULL THEN list_append(leaders, mention) ELSE leaders END, CASE WHEN hit IS NULL THEN list_append(norms, norm) ELSE norms END
        FROM (SELECT m.doc_id, m.entity_type, m.pos, m.mention, m.norm, r.leaders, r.norms,
                list_filter(range(1, len(r.leaders) + 1), lambda i: {sql_similarity("r.norms[i]", "m.norm")} >= 0.85)[1] AS hit
              FROM r JOIN m ON m.doc_id = r.doc_id AND m.entity_type = r.entity_type AND m.pos = r.pos + 1))"""
query("er_leader_clusters", f"{SQL_CLUSTERS} SELECT doc_id, entity_type, leader, mention FROM r")(lambda s, d: resolve.leader_clusters(table(s, d, "entities"), TYPES))
SQL_CANONICAL = f"""{SQL_CLUSTERS} SELECT doc_id, entity_type,
    arg_min(mention, (CASE entity_type WHEN 'PERSON' THEN -len(list_filter(regexp_split_to_array(mention, '{WS}+'), lambda w: w <> '')) ELSE 0 END, -length(mention), mention)) AS canonical"""
query("er_canonical", f"{SQL_CANONICAL}, CAST(count(*) AS INTEGER) AS cluster_size FROM r GROUP BY doc_id, entity_type, leader")(
    lambda s, d: resolve.canonical(resolve.leader_clusters(table(s, d, "entities"), TYPES)).select("doc_id", "entity_type", "canonical", "cluster_size")
)
query(
    "er_resolve",
    f"{SQL_CANONICAL}, string_agg(mention, '|' ORDER BY mention) AS mentions, CAST(CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM r GROUP BY doc_id, entity_type, leader",
)(
    lambda s, d: resolve.canonical(resolve.leader_clusters(table(s, d, "entities"), TYPES)).select("doc_id", "entity_type", "canonical", F.array_join("mentions", "|").alias("mentions"), "confidence")
)

# ---- statistics and reports --------------------------------------------------------------------------------------------------

E = "(SELECT DISTINCT * FROM entities)"
query("stats_by_type", f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {E} GROUP BY entity_type")(
    lambda s, d: reports.unique(table(s, d, "entities")).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
)
query("stats_totals", f"SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM {E}) AS total_entities")(
    lambda s, d: table(s, d, "documents").agg(F.count("*").alias("total_documents")).crossJoin(reports.unique(table(s, d, "entities")).agg(F.count("*").alias("total_entities")))
)
query(
    "entities_of_doc",
    f"SELECT entity_id, text, entity_type, coalesce(confidence, 0.9) AS confidence FROM {E} WHERE doc_id = (SELECT min(doc_id) FROM entities)",
)(
    lambda s, d: reports.unique(table(s, d, "entities").filter(F.col("doc_id") == table(s, d, "entities").agg(F.min("doc_id")).first()[0])).select(
        "entity_id", "text", "entity_type", F.coalesce("confidence", F.lit(0.9)).alias("confidence")
    )
)
query(
    "topk_per_type",
    f"""SELECT doc_id, entity_type, CAST(r AS INTEGER) AS r, text FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start_pos, entity_id) AS r FROM {E}) WHERE r <= 5""",
)(lambda s, d: reports.ranked(table(s, d, "entities"), 5).select("doc_id", "entity_type", "r", "text"))
query("first_per_type", f"SELECT doc_id, entity_type, arg_min(text, (start_pos, entity_id)) AS text FROM {E} GROUP BY doc_id, entity_type")(
    lambda s, d: reports.first_per_type(table(s, d, "entities"))
)


def sql_fields(missing: str) -> str:
    firsts = ", ".join(f"arg_min(text, (start_pos, entity_id)) FILTER (entity_type = '{t}') AS {n}" for t, n in reports.FIELDS.items())
    four = "list_slice(list(text ORDER BY start_pos, entity_id) FILTER (entity_type = 'PERSON'), 1, 4)"
    cols = ", ".join(f"coalesce({n}, '{missing}') AS {n}" for n in reports.FIELDS.values())
    return f"""SELECT d.doc_id, {cols}, coalesce(nullif(parties, ''), '- Not identified') AS parties FROM documents d LEFT JOIN (
        SELECT doc_id, {firsts}, array_to_string(list_transform({four}, lambda x: '- ' || coalesce(x, '')), chr(10)) AS parties FROM {E} GROUP BY doc_id) e ON e.doc_id = d.doc_id"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_REPORT = f"""SELECT doc_id, {_lit(chr(10) + "# Property Report" + chr(10) * 2 + "## Property Summary" + chr(10) + "This is a property transaction document involving property transaction." + chr(10) * 2 + "## Parties Involved" + chr(10))}
    || parties || {_lit(chr(10) * 2 + "## Property Details" + chr(10) + "- **Location:** ")} || location || {_lit(chr(10) + "- **Area:** ")} || area || {_lit(chr(10) + "- **Property ID:** ")} || property_id
    || {_lit(chr(10) * 2 + "## Transaction Details" + chr(10) + "- **Transaction Value:** ")} || value || {_lit(chr(10) + "- **Transaction Date:** ")} || date
    || {_lit(chr(10) * 2 + "## Key Observations" + chr(10) + "- Document has been processed and entities extracted" + chr(10) + "- Further manual verification recommended" + chr(10))} AS report
    FROM ({sql_fields("Not specified")})"""
query("report_fields", sql_fields("Not specified"))(lambda s, d: reports.fields(table(s, d, "documents"), table(s, d, "entities")))
query("report_fields_na", sql_fields("N/A"))(lambda s, d: reports.fields(table(s, d, "documents"), table(s, d, "entities"), "N/A"))
query(
    "report_cards",
    f"""SELECT doc_id, replace(entity_type, '_', ' ') AS label, string_agg(coalesce(text, ''), chr(10) ORDER BY r) AS texts FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start_pos, entity_id) AS r FROM {E}) WHERE r <= 5 GROUP BY doc_id, entity_type""",
)(lambda s, d: reports.cards(table(s, d, "entities")))
reports.register("echo", lambda prompt: "before\n**Property Summary**\n" + str(len(prompt)) + " characters")  # a stand-in for a language model
query(
    "report_generated",
    f"""SELECT doc_id, 'Property Transaction Report' AS title, 'Report generated from extracted entities.' AS summary, 4 AS n_sections, report AS full_report FROM ({SQL_REPORT})""",
)(
    lambda s, d: reports.generate(table(s, d, "documents"), table(s, d, "entities"), use_model=False).select("doc_id", "title", "summary", F.size("sections").alias("n_sections"), "full_report")
)
query("report_text", SQL_REPORT)(
    lambda s, d: reports.fields(table(s, d, "documents"), table(s, d, "entities")).select("doc_id", reports.report_text().alias("report"))
)
query(
    "report_sections",
    f"""WITH f AS ({sql_fields("Not specified")}) SELECT doc_id, 'Property Summary' AS section, 'Property transaction document processed.' AS body FROM f
    UNION ALL SELECT doc_id, 'Parties Involved', parties FROM f UNION ALL SELECT doc_id, 'Property Details', 'Location: ' || location || ', Area: ' || area FROM f
    UNION ALL SELECT doc_id, 'Transaction Details', 'Value: ' || value || ', Date: ' || date FROM f""",
)(lambda s, d: reports.sections(reports.fields(table(s, d, "documents"), table(s, d, "entities"))))
query(
    "parse_sections",
    f"""WITH l AS (SELECT doc_id, i, {sql_strip("ls[i]")} AS s, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(report, chr(10)) AS ls FROM ({SQL_REPORT})))),
    h AS (SELECT *, CASE WHEN s LIKE '**%' AND s LIKE '%**' THEN {sql_strip("trim(s, '*')")} WHEN starts_with(s, '## ') THEN {sql_strip("substring(s, 4)")} END AS h FROM l),
    n AS (SELECT *, count(h) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
    g AS (SELECT doc_id, no, max(h) AS section, {sql_strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h IS NULL), '')")} AS body FROM n WHERE no > 0 GROUP BY doc_id, no)
    SELECT doc_id, section, arg_max(body, no) AS body FROM g WHERE section <> '' GROUP BY doc_id, section""",
)(
    lambda s, d: reports.parse_sections(reports.fields(table(s, d, "documents"), table(s, d, "entities")).select("doc_id", reports.report_text().alias("text")))
)
SQL_FORMATTED = f"""SELECT doc_id, string_agg('**' || entity_type || ':**' || chr(10) || b, chr(10) ORDER BY entity_type) AS formatted FROM (
    SELECT doc_id, entity_type, string_agg('  - ' || coalesce(text, ''), chr(10) ORDER BY r) AS b FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start_pos, entity_id) AS r FROM {E}) WHERE r <= 5 GROUP BY doc_id, entity_type) GROUP BY doc_id"""
query("format_entities", SQL_FORMATTED)(lambda s, d: reports.formatted(table(s, d, "entities")))
query(
    "report_prompt",
    f"""SELECT d.doc_id, {_lit("You are a property document analyst. Generate a structured property report based on the following extracted information." + chr(10) * 2 + "**Document Text:**" + chr(10))}
    || coalesce(substring(text, 1, 3000), '') || {_lit(chr(10) * 2 + "**Extracted Entities:**" + chr(10))} || coalesce(formatted, '') || {_lit(
        chr(10) * 2 + "**Generate a report with the following sections:**" + chr(10) * 2 + "1. **Property Summary** - Brief overview of the property" + chr(10) + "2. **Parties Involved** - Who are the buyers/sellers" + chr(10)
        + "3. **Property Details** - Location, area, identifiers" + chr(10) + "4. **Transaction Details** - Value, date, terms" + chr(10) + "5. **Key Observations** - Any notable points or concerns" + chr(10) * 2
        + "Keep the report professional, concise, and factual. Use bullet points where appropriate." + chr(10))} AS prompt FROM documents d LEFT JOIN ({SQL_FORMATTED}) f ON f.doc_id = d.doc_id""",
)(lambda s, d: reports.prompts(table(s, d, "documents"), table(s, d, "entities")))
SQL_FIRSTS = ", ".join(f"coalesce(arg_min(text, (start_pos, entity_id)) FILTER (entity_type = '{t}'), 'N/A') AS {n}" for t, n in reports.FIELDS.items())
query(
    "report_download_text",
    f"""SELECT d.doc_id, {_lit(chr(10) + "PROPERTY TRANSACTION REPORT" + chr(10) + "===========================" + chr(10) * 2 + "Document: ")} || coalesce(doc_name, '') || {_lit(chr(10) + "Processed: ")} || coalesce(processed_at, 'N/A')
    || {_lit(chr(10) * 2 + "PROPERTY SUMMARY" + chr(10) + "----------------" + chr(10) + "Location: ")} || coalesce(location, 'N/A') || {_lit(chr(10) + "Area: ")} || coalesce(area, 'N/A') || {_lit(chr(10) + "Value: ")} || coalesce(value, 'N/A')
    || {_lit(chr(10) + "Date: ")} || coalesce(date, 'N/A') || {_lit(chr(10) * 2 + "PARTIES INVOLVED" + chr(10) + "----------------" + chr(10))} || coalesce(people, '') || {_lit(chr(10) * 2 + "EXTRACTED TEXT" + chr(10) + "--------------" + chr(10))}
    || coalesce(substring(d.text, 1, 1000), '') || {_lit("..." + chr(10))} AS report FROM documents d LEFT JOIN (
        SELECT doc_id, {SQL_FIRSTS}, array_to_string(list_transform(list(text ORDER BY start_pos, entity_id) FILTER (entity_type = 'PERSON'), lambda x: '• ' || coalesce(x, '')), chr(10)) AS people FROM {E} GROUP BY doc_id) e ON e.doc_id = d.doc_id""",
)(lambda s, d: reports.download_text(table(s, d, "documents"), table(s, d, "entities")))
