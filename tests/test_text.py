from pyspark.sql import functions as F

from lekhya.functions import text as T
from lekhya.operators import chunk, ner, resolve


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def test_clean_golden(spark):
    raw = "\n".join("    " + x for x in ["Page 1 of 5", "", "SALE DEED", "", "- Survey No: 123/4", "- Total Area: 2400 sq.ft.", "- Sale Consideration: Rs 1,50,00,000/- (Rupees One Crore Fifty Lakhs only)", "", "Page 2 of 5"])
    got = one(spark, raw, T.clean)
    assert got == "SALE DEED\n\n- Survey No: 123/4\n- Total Area: 2400 Sq.Ft.\n- Sale Consideration: Rs. 1,50,00,000/- (Rupees One Crore Fifty Lakhs only)"
    assert len(got) == 131 and one(spark, got, T.word_count) == 22


def test_clean_switches_and_edges(spark):
    assert one(spark, "120 sq. meters", T.clean) == "120 Sq.M.eters"
    assert one(spark, "abc 0\nPage 1 of 2\nRs. 5", T.clean) == "abc 0\nRs. 5"
    assert one(spark, "government", T.clean) == "govemment"
    assert one(spark, "government", lambda c: T.clean(c, fix_ocr_errors=False)) == "government"
    assert one(spark, None, T.clean) is None and one(spark, "", T.clean) == ""
    assert one(spark, "ﬁne “x” …", T.clean) == 'fine "x" ...'


def test_tokens_titles(spark):
    assert one(spark, "Élan_1 पता x-y", T.tokens) == ["élan_1", "पत", "x", "y"]
    assert one(spark, "r.k. narayan o'neil", T.title_case) == "R.K. Narayan O'Neil"


def test_chunks(spark):
    text = ("A sentence of some words. " * 60).strip()
    parts = one(spark, text, chunk.sentence_chunks)
    assert all(len(p) <= 512 for p in parts) and len(parts) > 2
    assert chunk.chunk_text("x. " + "y" * 2000)  # the guard: it ends
    fixed = one(spark, text, chunk.fixed_chunks)
    assert fixed[0] + "".join(p[50:] for p in fixed[1:]) == text
    assert one(spark, "", chunk.fixed_chunks) == [""]


def test_ner_golden(spark):
    def found(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return [(r.start, r.end, r.entity_type, r.text, r.normalized) for r in ner.extract(df).collect()]

    assert found("This is not valid") == [(6, 11, "PROPERTY_ID", "s not", "t")]
    assert found("1,50,000 Sq.Ft.") == [(2, 15, "AREA", "50,000 Sq.Ft.", "50,000")]
    assert found("Rs. 500 only") == [(0, 8, "MONEY", "Rs. 500 ", "500")]
    assert {x[2] for x in found("General Power of Attorney dated 1/2/2020")} == {"DOCUMENT_TYPE", "DATE"}
    text = "😀 Survey No.: 123/4 and Plot No. A-42, Rupees One Crore Fifty Lakhs only; 12 acres"
    for s, e, _, t, _ in found(text):
        assert text[s:e] == t
    assert found("") == []


def test_ner_overlap_prefers_confidence(spark):
    rows = [(0, 10, "A", 0.5, 0, 0), (5, 12, "B", 0.9, 1, 0), (12, 15, "C", 0.9, 2, 0), (13, 20, "D", 0.9, 3, 0)]
    df = spark.createDataFrame([(rows,)], "e array<struct<start:int,end:int,entity_type:string,confidence:double,ord:int,occ:int>>")
    assert [x.entity_type for x in df.select(ner.drop_overlaps(F.col("e")).alias("r")).first().r] == ["B", "C"]


def test_similarity_ladder(spark):
    cases = [("Ramesh Kumar", "ramesh kumar", 1.0), ("Indiranagar, Bangalore", "Bangalore", 0.9), ("R. Kumar", "Ramesh Kumar", 0.8), ("Priya S.", "Priya Sharma", 0.75), ("abc", "abd", 0.75), ("", "x", 0.9)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for r in df.select("*", resolve.similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want, r


def test_resolution(spark):
    rows = [(1, "PERSON", t) for t in ("Mr. Ramesh Kumar", "Ramesh Kumar", "Ramesh Kumar", "Dr. Priya Sharma")] + [(1, "LOCATION", "blr east - 560"), (2, "PERSON", None)]
    e = spark.createDataFrame(rows, "doc_id long, entity_type string, text string")
    got = {(r.canonical, r.cluster_size) for r in resolve.canonical(resolve.leader_clusters(e, ["PERSON"])).collect()}
    assert got == {("Mr. Ramesh Kumar", 2), ("Dr. Priya Sharma", 1)}
    assert one(spark, "blr east - 560", resolve.norm_location) == "Bangalore East"
    assert one(spark, "Late Shri R.K. Rao", resolve.norm_name) == "Late R.K. Rao" or one(spark, "Smt Priya", resolve.norm_name) == "Priya"
