"""Text functions as column expressions: cleaning, tokens, previews.

Defined results: null in, null out. All lengths are code points. White space is Unicode white space, spelled out
because Java's \\s, RE2's \\s and Unicode differ.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
# Typographic characters and what replaces them, in this order.
UNICODE_MAP = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), (" ", " "), ("₹", "Rs.")]
# Line forms that are noise; matched at the start of the stripped line, case ignored.
NOISE = (
    rf"^(?i)(?:Page{WS}*\p{{Nd}}+{WS}*of{WS}*\p{{Nd}}+|{WS}*\p{{Nd}}+{WS}*\z|[-_=]{{3,}}\z|{WS}*(?:CONFIDENTIAL|DRAFT|COPY){WS}*\z"
    r"|www\.[^\s]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})"
)
# Spellings of currency and area units, in this order.
LEGAL_TERMS = [
    (rf"Rs\.?{WS}*", "Rs. "), (rf"INR\.?{WS}*", "Rs. "), (rf"₹{WS}*", "Rs. "),
    (rf"(\p{{Nd}}+){WS}*[Ll]akhs?", "$1 Lakhs"), (rf"(\p{{Nd}}+){WS}*[Cc]rores?", "$1 Crores"),
    (rf"[Ss]q\.?{WS}*[Ff]t\.?", "Sq.Ft."), (rf"[Ss]q\.?{WS}*[Mm]\.?", "Sq.M."), (rf"[Ss]q\.?{WS}*[Yy]ards?", "Sq.Yards"),
]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def unicode_map(c: Column) -> Column:
    for old, new in UNICODE_MAP:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalise_unicode(c: Column) -> Column:
    """NFKC (Arrow: Spark has no builtin), then the replacements."""
    return unicode_map(_nfkc(c))


def ocr_fix(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?<!{WORD})0(?!{WORD})(?={WS}*(?:Rs|INR|₹))", "O")
    c = F.regexp_replace(c, "(?<=[a-z])1(?=[a-z])", "l")
    c = F.regexp_replace(c, "(?<=[A-Z])0(?=[A-Z])", "O")
    c = F.regexp_replace(c, rf"(?<!{WORD})l(?!{WORD})", "I")
    return F.replace(F.replace(c, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def drop_noise_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~strip(x).rlike(NOISE)), "\n")


def legal_terms(c: Column) -> Column:
    for pattern, to in LEGAL_TERMS:
        c = F.regexp_replace(c, pattern, to)
    return c


def whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), rf"\n{WS}*\n", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda x: x != "")


def clean(c: Column, normalize_unicode: bool = True, fix_ocr_errors: bool = True, remove_noise: bool = True, normalize_whitespace: bool = True) -> Column:
    """The whole cleaning chain with its four switches."""
    c = normalise_unicode(c) if normalize_unicode else c
    c = ocr_fix(c) if fix_ocr_errors else c
    c = drop_noise_lines(c) if remove_noise else c
    c = legal_terms(c)
    return whitespace(c) if normalize_whitespace else c


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{WS[1:-1]}]+"))


def preview(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    chars = F.split(F.lower(c), "")
    return F.array_join(
        F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), ""
    )
