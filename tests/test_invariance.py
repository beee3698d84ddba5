"""Results do not depend on how rows are spread over partitions."""

import pytest
from pyspark.sql import functions as F

from lekhya.functions import text as T
from lekhya.operators import ner, reports, resolve, search


@pytest.fixture(scope="module")
def deeds(spark):
    rows = [(k, f"d{k}.pdf", f"SALE DEED\n\nExecuted on {k % 28 + 1}/3/2015 for Rs. {k * 1000},000/- by Shri Ram Kumar {k % 3}. Survey No. {k}/2A of {k}.5 acres. Page 1 of 2\nwww.x.example", k) for k in range(1, 60)]
    return spark.createDataFrame([*rows, (90, "e.pdf", None, 90), (91, None, "", 91)], "doc_id long, doc_name string, text string, ingest_seq long")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partition_invariance(spark, deeds, parts):
    def results(d):
        e = ner.extract(d.select("doc_id", T.clean(F.col("text")).alias("text"))).select("doc_id", "entity_type", "text", F.col("start").alias("start_pos"), F.xxhash64("doc_id", "start").alias("entity_id"))
        yield sorted(map(tuple, e.collect()))
        yield sorted(map(tuple, search.keyword_search(search.postings(d), "sale deed ram", 7).collect()))
        yield sorted(map(tuple, reports.fields(d, e).collect()))
        yield sorted(map(tuple, resolve.canonical(resolve.leader_clusters(e, ["DATE", "MONEY"])).select("doc_id", "canonical", "cluster_size").collect()))

    for a, b in zip(results(deeds.coalesce(1)), results(deeds.repartition(parts))):
        assert a == b and a


def test_spread_keeps_wide_scans(spark, deeds):
    from lekhya.session import spread

    wide = deeds.repartition(16)
    assert spread(wide) is wide and spread(deeds.coalesce(1)).count() == deeds.count()
