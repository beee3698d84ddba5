"""Problem 5: areas and amounts in mixed units become hundredths of a square metre or of a rupee.

A text that states a unit is parsed exactly (digits in Western or Indian grouping, Devanagari digits, number words,
vulgar fractions, scale words, unit before or after the number, compound quantities). Where a number stands without a
unit, a log-scale mixture is fitted over all such numbers: one component per unit of the dimension, all with the
spread of the stated quantities, their means offset by the known conversion factors; the posterior assigns the unit
and low posteriors are flagged.

Defined results: null or empty texts, texts without a number and unknown units give no quantity; repeated entity
rows give one row; of a quantity stated twice the first counts; parts of a compound are added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.session import lookup_rows, nonempty

# Spellings of the units, as patterns over lower-cased text after digit and fraction folding.
UNIT_SPELLINGS = {
    "sq_ft": r"sq\.?\s*-?\s*f(?:ee)?t\.?|square\s*f(?:ee|oo)t|sq\.?\s*feet|s\.?\s?ft\.?|वर्ग\s*फ(?:ुट|ीट|़ुट)|व\.?\s*फु\.?|वर्गफुट",
    "sq_yd": r"sq\.?\s*-?\s*y(?:ar)?ds?\.?|square\s*y(?:ar)?ds?|gaj|gaz|वर्ग\s*(?:गज|यार्ड)|व\.?\s*ग\.?|गज",
    "sq_m": r"sq\.?\s*-?\s*m(?:et(?:er|re)s?|trs?|ts?)?\.?|square\s*met(?:er|re)s?|m²|m\^?2|वर्ग\s*मी(?:टर)?\.?|व\.?\s*मी\.?",
    "hectare": r"hectares?|hect?\.?|ha\.?|हेक्टेयर|हेक्टर|हे\.?",
    "gunta": r"gunt(?:h)?as?\.?|gts\.?|गुंठा|गुंठे|गुन्ठा",
    "acre": r"acres?|acs?\.?|एकड़|एकड",
    "cent": r"cents?|cts?\.?|सेंट",
    "ground": r"grounds?|ग्राउंड",
    "are": r"ares?|आर",
    "crore": r"crores?|crs?\.?|करोड़|करोड",
    "lakh": r"lakhs?|lacs?|l\.?|लाख",
    "million": r"millions?|mn\.?|mio\.?",
    "thousand": r"thousands?|k|हज़ार|हजार",
    "rupee": r"rupees?|rs\.?|inr\.?|₹|रुपये|रुपए|रु\.?|₨",
}
SCALES = {"crore": 10**7, "lakh": 10**5, "million": 10**6, "thousand": 10**3}
# Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORD_VALUES = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)} | {"fourty": 40}
WORD_MULTIPLIERS = {"hundred": 100, "thousand": 10**3, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "million": 10**6, "crore": 10**7, "crores": 10**7}
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
_FOLD = {0x0966 + i: str(i) for i in range(10)} | {ord(k): f" {v}" for k, v in FRACTIONS.items()} | {0xA0: " "}

_W = "|".join(sorted([*WORD_VALUES, *WORD_MULTIPLIERS], key=len, reverse=True))
_WORDS = rf"(?:(?:{_W})(?:[\s\-]+(?:and\s+)?(?=(?:{_W})\b)|(?![a-z])))+"
_NUM = rf"(?:\d[\d,]*(?:\.\d+)?\s+\d+/\d+|\d+/\d+|\d[\d,]*(?:\.\d+)?|(?<!\S)\.\d+|{_WORDS})"
_END = r"(?![^\W\d_])"


def _units(codes: tuple[str, ...]) -> str:
    return "|".join(f"(?P<{{0}}{c}>{UNIT_SPELLINGS[c]})" for c in UNIT_SPELLINGS if c in codes)


AREA_CODES = ("sq_ft", "sq_yd", "sq_m", "hectare", "gunta", "acre", "cent", "ground", "are")
_AREA = "(?:" + _units(AREA_CODES) + ")" + _END
_SCALE = rf"(?:\s*(?P<{{0}}x>{UNIT_SPELLINGS['crore']}|{UNIT_SPELLINGS['lakh']}|{UNIT_SPELLINGS['million']}|{UNIT_SPELLINGS['thousand']}){_END})?"
AREA_AFTER = re.compile(rf"(?<![\w./])(?P<n>{_NUM}){_SCALE.format('')}\s*-?\s*{_AREA.format('')}")
AREA_BEFORE = re.compile(rf"(?<![^\W_]){_AREA.format('')}\s*[:\-]?\s*(?P<n>{_NUM})")
_JOIN = re.compile(r"\s*(?:[-–,&+.]|and|एवं|और|तथा)?\s*")
_MSCALE = "(?:" + _units(("crore", "lakh", "million", "thousand")).format("") + ")" + _END
MONEY_SCALED = re.compile(rf"(?P<n>\d[\d,]*(?:\.\d+)?(?:\s+\d+/\d+)?|\d+/\d+|(?<!\S)\.\d+)\s*-?\s*{_MSCALE}")
MONEY_WORDS = re.compile(rf"(?<![a-z])(?P<n>{_WORDS})")
RUPEE = re.compile(rf"(?<![^\W\d_])(?:{UNIT_SPELLINGS['rupee']}){_END}|/[-=]")
PLAIN = re.compile(r"\d[\d,]*(?:\.\d+)?|(?<!\S)\.\d+")
ANY_NUMBER = re.compile(rf"(?<![\w./]){_NUM}")


def words_value(text: str) -> Decimal:
    """The value of English number words with Western or Indian multipliers."""
    total = group = 0
    for w in re.findall(r"[a-z]+", text):
        if w in WORD_VALUES:
            group += WORD_VALUES[w]
        elif w == "hundred":
            group = (group or 1) * 100
        elif w in WORD_MULTIPLIERS:
            total += (group or 1) * WORD_MULTIPLIERS[w]
            group = 0
    return Decimal(total + group)


def number(text: str) -> Decimal | None:
    """The value of a number in digits, digits with a fraction, a fraction, or words."""
    text = text.strip().replace(",", "")
    if text[:1].isalpha():
        return words_value(text)
    total = Decimal(0)
    for part in text.split():
        a, _, b = part.partition("/")
        if b and not int(b):
            return None
        total += Decimal(a) / Decimal(b) if b else Decimal(a)
    return total


def _unit(groups: dict) -> str:
    return next(c for c in UNIT_SPELLINGS if groups.get(c))


def _scale(word: str | None) -> int:
    return next((v for c, v in SCALES.items() if word and re.fullmatch(UNIT_SPELLINGS[c], word)), 1)


def _fold(text: str) -> str:
    return re.sub(r"\s+", " ", text.translate(_FOLD)).strip().lower()


def parse_area(text: str, factors: dict[str, Decimal]) -> Decimal | None:
    """Square metres of an area text, or None where it states no quantity in a known unit."""
    t = _fold(text)
    total, end = None, None
    for m in AREA_AFTER.finditer(t):
        if total is not None and not _JOIN.fullmatch(t[end : m.start()]):
            break
        value, unit = number(m["n"]), _unit(m.groupdict())
        if value is None or unit not in factors:
            break
        total = (total or 0) + value * _scale(m["x"]) * factors[unit]
        end = m.end()
    if total is None and (m := AREA_BEFORE.search(t)) and (value := number(m["n"])) is not None and _unit(m.groupdict()) in factors:
        total = value * factors[_unit(m.groupdict())]
    return total


def parse_money(text: str, factors: dict[str, Decimal]) -> Decimal | None:
    """Rupees of an amount text, or None where it states no quantity in rupees or one of the scale units."""
    t = _fold(text)
    words, scaled, plain = MONEY_WORDS.search(t), MONEY_SCALED.search(t), PLAIN.search(t)
    if words and (plain is None or words.start() < plain.start()):
        if not RUPEE.search(t) and not any(w in WORD_MULTIPLIERS and w != "hundred" for w in re.findall(r"[a-z]+", words["n"])):
            return None
        return words_value(words["n"]) * factors.get("rupee", Decimal(1))
    if plain is None:
        return None
    if scaled and scaled.start() <= plain.start():
        total, end = Decimal(0), scaled.start()
        for m in MONEY_SCALED.finditer(t):
            unit = _unit(m.groupdict())
            if not _JOIN.fullmatch(t[end : m.start()]) or unit not in factors or (value := number(m["n"])) is None:
                break
            total, end = total + value * factors[unit], m.end()
        return total or None
    if not RUPEE.search(t) or (value := number(plain[0])) is None:
        return None
    return value * factors.get("rupee", Decimal(1))


def hundredths(value: Decimal | None) -> int | None:
    if value is None:
        return None
    out = int((value * 100).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    return out if abs(out) < 2**63 else None


def bare_number(text: str | None) -> float | None:
    """The number of a text that holds one number and no letters: the unit is missing."""
    t = _fold(text or "")
    if not re.fullmatch(rf"{_NUM}", t) or t[:1].isalpha():
        return None
    n = number(t)
    return float(n) if n else None


def stated_quantities(entities: DataFrame, unit_factors: DataFrame) -> DataFrame:
    """(entity_id, dimension, hundredths, bare): one row per AREA or MONEY entity.

    hundredths is null where the text states no quantity in a known unit; bare is then its number when it has only that.
    """
    rows = lookup_rows(unit_factors.select("unit_code", "factor"))
    factors = {r[0]: Decimal(repr(float(r[1]))) for r in rows if r[0] and r[1] is not None}

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=50_000)
        def one(kind: str, text: str | None) -> tuple[int | None, float | None]:
            h = hundredths((parse_area if kind == "AREA" else parse_money)(text, factors)) if text else None
            return h, None if h is not None else bare_number(text)

        for b in batches:
            got = [one(k, t) for k, t in zip(b["entity_type"], b["text"])]
            yield pd.DataFrame({
                "entity_id": b["entity_id"], "dimension": b["entity_type"].map({"AREA": "area", "MONEY": "money"}),
                "hundredths": pd.array([g[0] for g in got], dtype="Int64"), "bare": pd.array([g[1] for g in got], dtype="Float64"),
            })

    parsed = (
        entities.filter("entity_type IN ('AREA','MONEY') AND entity_id IS NOT NULL").select("entity_id", "entity_type", "text")
        .mapInPandas(run, "entity_id long, dimension string, hundredths long, bare double")
    )
    return parsed.groupBy("entity_id", "dimension").agg(F.max("hundredths").alias("hundredths"), F.max("bare").alias("bare"))


def fit_mixture(stated: list[tuple[float, int]], bare: list[tuple[float, int]], log_factors: dict[str, float], rounds: int = 200) -> dict:
    """EM over histograms of log10 values: component u has mean mu - log10(factor_u) and a shared sigma; weights are free.

    `stated` (log10 of base units) gives mu and sigma; `bare` (log10 of bare numbers) gives the weights.
    """
    n = sum(c for _, c in stated)
    mu = sum(x * c for x, c in stated) / n if n else 0.0
    sigma = max(math.sqrt(sum((x - mu) ** 2 * c for x, c in stated) / n) if n else 1.0, 0.05)
    weights = {u: 1 / len(log_factors) for u in log_factors}
    dens = [({u: math.exp(-0.5 * ((x + lf - mu) / sigma) ** 2) for u, lf in log_factors.items()}, c) for x, c in bare]
    for _ in range(rounds):
        acc = dict.fromkeys(weights, 1e-6)
        for d, c in dens:
            z = sum(weights[u] * d[u] for u in d) or 1e-300
            for u in d:
                acc[u] += c * weights[u] * d[u] / z
        total = sum(acc.values())
        new = {u: a / total for u, a in acc.items()}
        moved = max(abs(new[u] - weights[u]) for u in new)
        weights = new
        if moved < 1e-6:
            break
    return {"mu": mu, "sigma": sigma, "weights": weights}


def _bin(c: Column, width: float) -> Column:
    return F.round(F.log10(c) / width).cast("int")


def missing_units(entities: DataFrame, unit_factors: DataFrame, bin_width: float = 0.02, sure: float = 0.8) -> DataFrame:
    """Units for the numbers without one: (entity_id, dimension, bare, unit_code, posterior, uncertain, hundredths).

    The histograms have at most 600 / bin_width bins whatever the data (a double's decimal exponents), so the fit on the driver is
    bounded; every row is counted in them and every bare number gets a row. Dimensions without a stated quantity or
    without a bare number give no rows.
    """
    spark = entities.sparkSession
    q = stated_quantities(entities, unit_factors)
    units = [(r[0], r[1], float(r[2])) for r in lookup_rows(unit_factors.select("unit_code", "dimension", "factor")) if r[0] and r[2]]
    hist = (
        q.filter("hundredths > 0 OR bare > 0")
        .select("dimension", F.col("hundredths").isNotNull().alias("s"), _bin(F.coalesce(F.col("hundredths") / 100, F.col("bare")), bin_width).alias("b"))
        .groupBy("dimension", "s", "b").count().collect()
    )
    rows = []
    for dim in sorted({u[1] for u in units}):
        logs = {c: math.log10(f) for c, d, f in units if d == dim}
        st, ba = ([(r.b * bin_width, r["count"]) for r in hist if r.dimension == dim and r.s == s] for s in (True, False))
        if st and ba:
            fit = fit_mixture(st, ba, logs)
            rows += [(dim, c, 10.0**lf, math.log(max(fit["weights"][c], 1e-300)), fit["mu"] - lf, fit["sigma"]) for c, lf in logs.items()]
    model = spark.createDataFrame(rows, "dimension string, unit_code string, factor double, lw double, m double, s double")
    score = F.col("lw") - 0.5 * F.pow((F.log10("bare") - F.col("m")) / F.col("s"), 2)
    joined = q.filter("hundredths IS NULL AND bare > 0").join(model, "dimension").withColumn("lp", score)
    best = joined.groupBy("entity_id", "dimension", "bare").agg(
        F.max(F.struct("lp", "unit_code", "factor")).alias("b"), F.collect_list("lp").alias("all")
    )
    post = 1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("b.lp")))
    return best.select(
        "entity_id", "dimension", "bare", F.col("b.unit_code").alias("unit_code"), F.round(post, 6).alias("posterior"),
        (post < sure).alias("uncertain"), F.round(F.col("bare") * F.col("b.factor") * 100).cast("long").alias("hundredths"),
    )


def found(entities: DataFrame, unit_factors: DataFrame) -> DataFrame:
    """p5_found: the entities whose text states a quantity in a known unit."""
    return stated_quantities(entities, unit_factors).filter("hundredths IS NOT NULL").select("entity_id", "dimension", "hundredths")
