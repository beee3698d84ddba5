"""Statistics over entities, and structured reports of documents.

Entities are whole-row distinct by entity_id; within a document and type the order is (start_pos, entity_id).
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lekhya.functions.text import preview, strip
from lekhya.session import materialise

FIELDS = {"LOCATION": "location", "AREA": "area", "PROPERTY_ID": "property_id", "MONEY": "value", "DATE": "date"}


def unique(entities: DataFrame) -> DataFrame:
    return entities.dropDuplicates(["entity_id"])


def ranked(entities: DataFrame, k: int) -> DataFrame:
    """The first k entities of each document and type, with their rank r."""
    w = Window.partitionBy("doc_id", "entity_type").orderBy("start_pos", "entity_id")
    return unique(entities).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)


def first_per_type(entities: DataFrame) -> DataFrame:
    first = F.min(F.struct("start_pos", "entity_id", "text"))
    return unique(entities).groupBy("doc_id", "entity_type").agg(first["text"].alias("text"))


def fields(documents: DataFrame, entities: DataFrame, missing: str = "Not specified") -> DataFrame:
    """(doc_id, location, area, property_id, value, date, parties): the report's fields with their defaults."""
    at = F.struct("start_pos", "entity_id", "text")
    firsts = [F.min(F.when(F.col("entity_type") == t, at))["text"].alias(n) for t, n in FIELDS.items()]
    four = F.slice(F.array_sort(F.collect_list(F.when(F.col("entity_type") == "PERSON", at))), 1, 4)
    people = F.array_join(F.transform(four, lambda e: F.concat(F.lit("- "), F.coalesce(e["text"], F.lit("")))), "\n")
    agg = unique(entities).groupBy("doc_id").agg(*firsts, people.alias("parties"))
    joined = documents.select("doc_id").join(agg, "doc_id", "left")
    parties = F.when(F.coalesce("parties", F.lit("")) == "", "- Not identified").otherwise(F.col("parties"))
    return joined.select("doc_id", *(F.coalesce(n, F.lit(missing)).alias(n) for n in FIELDS.values()), parties.alias("parties"))


# The wording of the report.
def report_text() -> Column:
    return F.concat(
        F.lit("\n# Property Report\n\n## Property Summary\nThis is a property transaction document involving property transaction.\n\n## Parties Involved\n"), F.col("parties"),
        F.lit("\n\n## Property Details\n- **Location:** "), F.col("location"), F.lit("\n- **Area:** "), F.col("area"), F.lit("\n- **Property ID:** "), F.col("property_id"),
        F.lit("\n\n## Transaction Details\n- **Transaction Value:** "), F.col("value"), F.lit("\n- **Transaction Date:** "), F.col("date"),
        F.lit("\n\n## Key Observations\n- Document has been processed and entities extracted\n- Further manual verification recommended\n"),
    )


def sections(f: DataFrame) -> DataFrame:
    """(doc_id, section, body): the four sections of the template report."""
    pairs = {
        "Property Summary": F.lit("Property transaction document processed."), "Parties Involved": F.col("parties"),
        "Property Details": F.concat(F.lit("Location: "), F.col("location"), F.lit(", Area: "), F.col("area")),
        "Transaction Details": F.concat(F.lit("Value: "), F.col("value"), F.lit(", Date: "), F.col("date")),
    }
    return f.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("section"), v.alias("body")) for k, v in pairs.items()))))


#: Report providers by name: a function from a prompt to the text of a report.
PROVIDERS: dict[str, Callable[[str], str]] = {}
TITLE = "Property Transaction Report"


def register(name: str, provider: Callable[[str], str]) -> None:
    PROVIDERS[name.lower()] = provider


def configured(name: str | None = None) -> Callable[[str], str] | None:
    """The provider named by the argument or by LEKHYA_REPORT_PROVIDER; None without a name, an error for one that is not registered."""
    name = name or os.environ.get("LEKHYA_REPORT_PROVIDER")
    if name and name.lower() not in PROVIDERS:
        raise ValueError(f"report provider {name!r} is not registered; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name.lower()] if name else None


def generate(documents: DataFrame, entities: DataFrame, use_model: bool = True, provider: str | None = None) -> DataFrame:
    """(doc_id, title, summary, sections map, full_report) of every document: by the configured provider, where it fails or is missing by the template."""
    f = fields(documents, entities)
    plain = sections(f).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("sections"))
    made = f.select("doc_id", report_text().alias("full_report")).join(plain, "doc_id")
    made = made.select("doc_id", F.lit(TITLE).alias("title"), F.lit("Report generated from extracted entities.").alias("summary"), "sections", "full_report")
    ask = configured(provider) if use_model else None
    if ask is None:
        return made

    @F.pandas_udf("string")
    def answers(prompts_: pd.Series) -> pd.Series:
        def one(p: str) -> str | None:
            try:
                return ask(p)
            except Exception:  # a document that the provider fails on gets the template
                return None

        return prompts_.map(one)

    told = materialise(prompts(documents, entities).select("doc_id", answers("prompt").alias("answer")).filter("answer IS NOT NULL"), "answers")
    parsed = parse_sections(told, "answer").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("s"))
    whole = told.join(parsed, "doc_id", "left").select("doc_id", "answer", F.coalesce("s", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("s"))
    both = made.join(whole, "doc_id", "left")
    by_model = F.col("answer").isNotNull()
    summary = F.coalesce(F.try_element_at("s", F.lit("Property Summary")), F.lit("Report generated successfully."))
    return both.select(
        "doc_id", "title", F.when(by_model, summary).otherwise(F.col("summary")).alias("summary"),
        F.when(by_model, F.col("s")).otherwise(F.col("sections")).alias("sections"), F.coalesce("answer", "full_report").alias("full_report"),
    )


def cards(entities: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, label, texts): at most k entities of each type, one per line; underscores of the label become blanks."""
    lists = ranked(entities, k).groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return lists.select("doc_id", F.replace("entity_type", F.lit("_"), F.lit(" ")).alias("label"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("texts"))


def write_texts(df: DataFrame, path: str, text: str = "report") -> None:
    """Reports as text files, one folder for each document."""
    df.select("doc_id", F.col(text).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def parse_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section, body): headers are lines in ** ** or after '## '; a later section of the same name wins."""
    lines = df.filter(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    s = strip(F.col("line"))
    starred = s.startswith("**") & s.endswith("**")
    header = F.when(starred, strip(F.regexp_replace(s, r"^\*+|\*+$", ""))).when(s.startswith("## "), strip(F.substring(s, 4, 1 << 30)))
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("h", header).withColumn("no", F.count("h").over(w)).filter("no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    found = marked.groupBy("doc_id", "no").agg(F.max("h").alias("section"), strip(body).alias("body")).filter("section <> ''")
    return found.groupBy("doc_id", "section").agg(F.max_by("body", "no").alias("body"))


def formatted(entities: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, formatted): markdown bullets, types in alphabetical order, at most k entities each."""
    one = ranked(entities, k).groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("l"))
    bullets = F.transform("l", lambda x: F.concat(F.lit("  - "), F.coalesce(x["text"], F.lit(""))))
    block = F.concat(F.lit("**"), F.col("entity_type"), F.lit(":**\n"), F.array_join(bullets, "\n"))
    return one.select("doc_id", "entity_type", block.alias("b")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_type", "b"))), lambda x: x["b"]), "\n").alias("formatted")
    )


def download_text(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, report): the downloadable text; 1000 characters of the document."""
    at = F.struct("start_pos", "entity_id", "text")
    firsts = [F.coalesce(F.min(F.when(F.col("entity_type") == t, at))["text"], F.lit("N/A")).alias(n) for t, n in FIELDS.items()]
    people = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_type") == "PERSON", at))), lambda e: F.concat(F.lit("• "), F.coalesce(e["text"], F.lit("")))), "\n")
    agg = unique(entities).groupBy("doc_id").agg(*firsts, people.alias("people"))
    j = documents.select("doc_id", "doc_name", "processed_at", "text").join(agg, "doc_id", "left")
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    report = F.concat(
        F.lit("\nPROPERTY TRANSACTION REPORT\n===========================\n\nDocument: "), F.coalesce("doc_name", F.lit("")), F.lit("\nProcessed: "), na("processed_at"),
        F.lit("\n\nPROPERTY SUMMARY\n----------------\nLocation: "), na("location"), F.lit("\nArea: "), na("area"), F.lit("\nValue: "), na("value"), F.lit("\nDate: "), na("date"),
        F.lit("\n\nPARTIES INVOLVED\n----------------\n"), F.coalesce("people", F.lit("")), F.lit("\n\nEXTRACTED TEXT\n--------------\n"), F.coalesce(preview(F.col("text"), 1000), F.lit("")), F.lit("...\n"),
    )
    return j.select("doc_id", report.alias("report"))


# The wording of the prompt.
def prompts(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, prompt): the prompt that a language model provider is given."""
    j = documents.select("doc_id", "text").join(formatted(entities), "doc_id", "left")
    p = F.concat(
        F.lit("You are a property document analyst. Generate a structured property report based on the following extracted information.\n\n**Document Text:**\n"),
        F.coalesce(preview(F.col("text"), 3000), F.lit("")), F.lit("\n\n**Extracted Entities:**\n"), F.coalesce("formatted", F.lit("")),
        F.lit(
            "\n\n**Generate a report with the following sections:**\n\n1. **Property Summary** - Brief overview of the property\n2. **Parties Involved** - Who are the buyers/sellers\n"
            "3. **Property Details** - Location, area, identifiers\n4. **Transaction Details** - Value, date, terms\n5. **Key Observations** - Any notable points or concerns\n\n"
            "Keep the report professional, concise, and factual. Use bullet points where appropriate.\n"
        ),
    )
    return j.select("doc_id", p.alias("prompt"))
