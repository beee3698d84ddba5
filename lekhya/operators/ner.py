"""Entity extraction by patterns, offsets, overlap removal and grouping; JVM-side.

Matches and captures come from regexp_extract_all, offsets from the gaps that split leaves between matches. All
candidates are sorted by (start, confidence descending, pattern, occurrence) and folded against the last one kept.

Defined results: null texts have no entities; texts are read whole; ties go to the pattern declared first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.session import spread

# The patterns of each type, case ignored; group 1 is the normalised form.
PATTERNS: list[tuple[str, str]] = [
    ("PROPERTY_ID", r"(?:Survey\s*No\.?|S\.?\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("PROPERTY_ID", r"(?:Plot\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("PROPERTY_ID", r"(?:Khata\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("PROPERTY_ID", r"(?:Property\s*ID)\s*[:.]?\s*([\w\-/]+)"),
    ("PROPERTY_ID", r"(?:PID)\s*[:.]?\s*([\w\-/]+)"),
    ("PROPERTY_ID", r"(?:Khasra\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("PROPERTY_ID", r"(?:Khatoni\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("PROPERTY_ID", r"(?:Document\s*No\.?)\s*[:.]?\s*([\d/\-A-Za-z]+)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Sq\.?\s*Ft\.?|Square\s*Feet|sq\.?\s*ft\.?)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Sq\.?\s*M\.?|Square\s*Meters?|sq\.?\s*m\.?)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Sq\.?\s*Yards?|Square\s*Yards?)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Acres?|acres?)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Guntas?|guntas?)"),
    ("AREA", r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:Cents?|cents?)"),
    ("MONEY", r"Rs\.?\s*([\d,]+(?:\.\d{2})?)\s*(?:/-)?"),
    ("MONEY", r"INR\.?\s*([\d,]+(?:\.\d{2})?)"),
    ("MONEY", r"₹\s*([\d,]+(?:\.\d{2})?)"),
    ("MONEY", r"([\d,]+)\s*(?:Lakhs?|lakhs?)"),
    ("MONEY", r"([\d,]+)\s*(?:Crores?|crores?)"),
    ("MONEY", r"(?:Rupees?)\s+([\w\s]+(?:Lakhs?|Crores?|Thousand)\s*(?:only)?)"),
    ("DATE", r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
    ("DATE", r"(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"),
    ("DATE", r"(\d{1,2}(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)[,]?\s+\d{4})"),
    ("DOCUMENT_TYPE", r"(Sale\s*Deed)"),
    ("DOCUMENT_TYPE", r"(General\s*Power\s*of\s*Attorney)"),
    ("DOCUMENT_TYPE", r"(Special\s*Power\s*of\s*Attorney)"),
    ("DOCUMENT_TYPE", r"(Agreement\s*to\s*Sell)"),
    ("DOCUMENT_TYPE", r"(Gift\s*Deed)"),
    ("DOCUMENT_TYPE", r"(Will\s*Deed)"),
]
TYPES = list(dict.fromkeys(t for t, _ in PATTERNS))
# Labels of model providers and the types they mean.
MODEL_LABELS = {"PERSON": "PERSON", "PER": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION", "ORG": "ORGANIZATION", "DATE": "DATE", "MONEY": "MONEY"}
REGEX_CONFIDENCE, MODEL_CONFIDENCE = 0.9, 0.85

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def portable(pattern: str) -> str:
    """The pattern with Unicode digits, white space and words spelled out, the same for Java and RE2."""
    out, inside, k = "", False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\d", r"\s", r"\w"):
            body = {"d": r"\p{Nd}", "s": _SPACE, "w": r"\p{L}\p{N}_"}[two[1]]
            out += body if inside or two == r"\d" else f"[{body}]"
            k += 2
        elif two[0] == "\\":
            out, k = out + two, k + 2
        else:
            inside = inside or two[0] == "["
            inside = inside and two[0] != "]"
            out, k = out + two[0], k + 1
    return out


def java(pattern: str) -> str:
    return "(?iu)" + portable(pattern)


def anchors(pattern: str) -> list[str]:
    """Literals of which every match of the pattern holds one, in lower case; empty where there is no such set."""
    m = re.search(r"(Survey|Plot|Khata|Property|PID|Khasra|Khatoni|Document|Sq\\|Acres|Guntas|Cents|Rs|INR|₹|Lakhs|Crores|Rupees|Deed|Attorney|Sell)", pattern)
    word = m[1] if m else ""
    return {
        "": [], "Survey": ["no"], "Sq\\": ["sq"], "Acres": ["acre"], "Guntas": ["gunta"], "Cents": ["cent"], "Lakhs": ["lakh"], "Crores": ["crore"], "Rupees": ["rupee"],
    }.get("Rupees" if "Rupees" in pattern else word, [word.lower()])


def matches(text: Column, pattern: str, entity_type: str, ordinal: int, low: Column | None = None) -> Column:
    """array<struct<start, end, entity_type, text, normalized, confidence, ord, occ>> of the matches of one pattern.

    One pass of the pattern over the text. The captures are taken from the matches, and each match is where its text
    first occurs after the match before: an earlier occurrence would have been a match itself, as the patterns look at
    nothing outside. `low`, the text in lower case, lets texts without the pattern's literal go without a pass.
    """
    p = F.lit(java(pattern))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    need = anchors(pattern)
    if low is not None and need:
        hit = F.contains(low, F.lit(need[0]))
        whole = F.when(hit, whole).otherwise(F.array().cast("array<string>"))
    strip = lambda c: F.regexp_replace(c, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")
    empty = F.array().cast(_MATCHES)

    def step(acc: Column, w: Column) -> Column:
        start = F.call_function("locate", w, text, F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + 1) - 1
        return F.concat(
            acc,
            F.array(
                F.struct(
                    start.alias("start"), (start + F.length(w)).alias("end"), F.lit(entity_type).alias("entity_type"), w.alias("text"),
                    strip(F.regexp_extract(w, java(pattern), 1)).alias("normalized"), F.lit(REGEX_CONFIDENCE).alias("confidence"), F.lit(ordinal).alias("ord"), F.size(acc).alias("occ"),
                )
            ),
        )

    return F.aggregate(whole, empty, step)


def _prepared(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    df = df.filter(F.col(text).isNotNull()).select(*keep, text)
    df = df if df.isStreaming else spread(df)
    return df.withColumn("_low", F.lower(F.upper(text)))  # upper first: it folds the few letters that only case-blind matching equates


def raw_matches(df: DataFrame, types: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per match: the columns of df but the text, and the match's fields. One generate per row, no shuffle."""
    keep = [c for c in df.columns if c != text]
    arrays = [matches(F.col(text), p, t, k, F.col("_low")) for k, (t, p) in enumerate(PATTERNS) if not types or t in types]
    return _prepared(df, keep, text).select(*keep, F.inline(F.concat(*arrays)))


def _order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, otherwise: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(otherwise)

    return by(a["start"], b["start"], by(b["confidence"], a["confidence"], by(a["ord"], b["ord"], by(a["occ"], b["occ"], F.lit(0)))))


def drop_overlaps(entities: Column) -> Column:
    """Sort and fold: an entity that overlaps the last one kept replaces it only if more confident."""
    first = F.slice(entities, 1, 0)
    return F.aggregate(
        F.array_sort(entities, _order),
        first,
        lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(x)))
        .when(x["confidence"] > F.element_at(acc, -1)["confidence"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))
        .otherwise(acc),
    )


def extract(df: DataFrame, text: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """One row per entity after overlap removal; `extra` are candidate arrays of model providers with the same fields."""
    keep = [c for c in df.columns if c != text]
    arrays = [matches(F.col(text), p, t, k, F.col("_low")) for k, (t, p) in enumerate(PATTERNS)] + (extra or [])
    raw = _prepared(df, keep, text).select(*keep, F.concat(*arrays).alias("_raw"))
    return raw.select(*keep, F.inline(drop_overlaps(F.col("_raw")))).drop("ord", "occ")


#: Model providers by name: a factory, called once per Python worker, of a function from texts to lists of (start, end, label, score or None).
Spans = list[tuple[int, int, str, float | None]]
PROVIDERS: dict[str, Callable[[], Callable[[list[str]], list[Spans]]]] = {}
_MATCHES = "array<struct<start:int,end:int,entity_type:string,text:string,normalized:string,confidence:double,ord:int,occ:int>>"


def register(name: str, factory: Callable[[], Callable[[list[str]], list[Spans]]]) -> None:
    PROVIDERS[name.lower()] = factory


def model_matches(text: Column, provider: str) -> Column:
    """The candidates of a registered model provider, as `matches` gives them. Labels without a type are dropped; a label without a score has MODEL_CONFIDENCE."""
    if provider.lower() not in PROVIDERS:
        raise ValueError(f"extraction provider {provider!r} is not registered; known: {sorted(PROVIDERS)}")
    factory = PROVIDERS[provider.lower()]

    @F.pandas_udf(_MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out = []
            for t, spans in zip(texts, model([t or "" for t in texts])):
                kept = [(s, e, MODEL_LABELS[label], t[s:e], score) for s, e, label, score in spans if label in MODEL_LABELS] if t else []
                out.append([
                    {"start": s, "end": e, "entity_type": k, "text": x, "normalized": None, "confidence": MODEL_CONFIDENCE if c is None else float(c), "ord": len(PATTERNS), "occ": i}
                    for i, (s, e, k, x, c) in enumerate(kept)
                ])
            yield pd.Series(out)

    return run(text)


def extract_entities(df: DataFrame, text: str = "text", use_transformers: bool = False) -> DataFrame:
    """Extraction with the best models at hand: patterns, and the provider "transformer" if asked for and registered, else "spacy" if registered."""
    name = next((n for n in (["transformer"] if use_transformers else []) + ["spacy"] if n in PROVIDERS), None)
    return extract(df, text, [model_matches(F.col(text), name)] if name else None)


def label_map(label: Column) -> Column:
    """The entity type of a model's label, null for labels that are dropped."""
    pairs = [F.lit(x) for kv in MODEL_LABELS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), label)


def counts(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return entities.groupBy(key, "entity_type").agg(F.count("*").alias("n"))


def grouped(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of a document by type, in order of position."""
    cols = F.struct("start", "end", "text", "normalized", "confidence")
    return entities.groupBy(key, "entity_type").agg(F.array_sort(F.collect_list(cols)).alias("entities"))


assert all(re.compile(p) for _, p in PATTERNS)
