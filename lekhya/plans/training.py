"""Queries of the general training-data problems (5 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.operators import quantities, timestamps
from lekhya.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.found(table(spark, d, "entities"), table(spark, d, "unit_factors"))


def p5_missing_units(spark: SparkSession, d: str) -> DataFrame:
    return quantities.missing_units(table(spark, d, "entities"), table(spark, d, "unit_factors"))


def p5_quality(spark: SparkSession, d: str) -> DataFrame:
    q = quantities.stated_quantities(table(spark, d, "entities"), table(spark, d, "unit_factors"))
    return q.groupBy("dimension").agg(
        F.count("*").alias("n"), F.count("hundredths").alias("stated"), F.count("bare").alias("unit_missing")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(*(table(spark, d, t) for t in ("entities", "documents", "offices", "zone_abbrevs")))


QUERIES = {"p5_found": p5_found, "p5_missing_units": p5_missing_units, "p5_quality": p5_quality, "p7_found": p7_found}
ORACLES: dict[str, str] = {}
