"""Problem 7: dates and times in mixed formats and zones become one calendar date or one UTC instant.

Every format is one branch of a single compiled alternation with named groups. A text is matched once; its
components are range-checked on the calendar and the instant is put together by integer day arithmetic. Only the
offset of a civil zone comes from the zone database.

Defined results: null, empty, incomplete or impossible dates and wall times that the zone skips give null; a wall
time that occurs twice gives the earlier instant; nine or ten digits count seconds since 1970, eleven to thirteen
milliseconds (eight digits are a date, fewer name nothing); repeated entity rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.session import lookup_rows, nonempty

DEFAULT_ZONE, DEFAULT_ORDER = "Asia/Kolkata", "DMY"

# Month names and spellings found in English and Hindi records.
MONTHS = {
    1: ["january", "jan", "जनवरी"], 2: ["february", "feb", "फरवरी", "फ़रवरी"], 3: ["march", "mar", "मार्च"],
    4: ["april", "apr", "अप्रैल"], 5: ["may", "मई"], 6: ["june", "jun", "जून"], 7: ["july", "jul", "जुलाई"],
    8: ["august", "aug", "अगस्त"], 9: ["september", "sept", "sep", "सितंबर", "सितम्बर"],
    10: ["october", "oct", "अक्टूबर", "अक्तूबर"], 11: ["november", "nov", "नवंबर", "नवम्बर"],
    12: ["december", "dec", "दिसंबर", "दिसम्बर"],
}
MONTH_NO = {name: no for no, names in MONTHS.items() for name in names}
_MON = "|".join(sorted(map(re.escape, MONTH_NO), key=len, reverse=True))
_TIME = (
    r"(?:(?P<{0}h>\d{{1,2}}):(?P<{0}mi>\d{{2}})(?::(?P<{0}s>\d{{2}})(?:[.,](?P<{0}f>\d{{1,9}}))?)?"
    r"|(?P<{0}hc>\d{{2}})(?P<{0}mic>\d{{2}})(?:(?P<{0}sc>\d{{2}})(?:[.,](?P<{0}fc>\d{{1,9}}))?)?)"
    r"(?:\s*(?P<{0}ap>[ap])(?:\.m\.|m\.?(?=$|[^a-z]|z\b)))?(?:\s*hrs\.?)?"
)
_ZONE = (
    r"\s*(?:(?P<z>z)|[\[(]?(?:(?:utc|gmt)\s*)?(?P<sign>[+\-−])(?P<zh>\d{1,2}):?(?P<zm>\d{2})?[\])]?"
    r"|[\[(]?(?P<iana>[a-z]+(?:/[a-z_+\-]+)+)[\])]?|[\[(]?(?P<abbr>[a-z]{2,5})[\])]?)"
)
_DATE = (
    r"(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2})"
    r"|(?P<y2>\d{4})(?P<m2>\d{2})(?P<d2>\d{2})"
    r"|(?P<a3>\d{1,2})(?P<s3>[-/.])(?P<b3>\d{1,2})(?P=s3)(?P<y3>\d{4}|\d{2})"
    r"|(?P<d4>\d{1,2})(?:st|nd|rd|th)?[\s\-.,]*(?:day\s+of\s+)?(?P<m4>" + _MON + r")(?![a-z])[\s\-.,]*(?P<y4>\d{4}|\d{2})"
    r"|(?P<m5>" + _MON + r")(?![a-z])[\s\-.,]*(?P<d5>\d{1,2})(?:st|nd|rd|th)?[\s,\-.]+(?P<y5>\d{4}|\d{2}))"
)
PATTERN = re.compile(
    r"(?:(?P<epoch>\d{9,13})|" + _TIME.format("p") + r"\s+on\s+" + _DATE.replace("(?P<", "(?P<p").replace("(?P=", "(?P=p") + r"(?:" + _ZONE.replace("(?P<", "(?P<p") + r")?"
    r"|" + _DATE + r"(?:(?:\s*t\s*|\s*,?\s+(?:at\s+)?|\s*,\s*)" + _TIME.format("") + r"(?:" + _ZONE + r")?)?)[\s.,;]*",
    re.IGNORECASE,
)
_DIGITS = {0x0966 + i: str(i) for i in range(10)} | {0x09E6 + i: str(i) for i in range(10)} | {0x2212: "-"}


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic on 400-year eras starting in March."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def civil_from_days(z: int) -> tuple[int, int, int]:
    """The date of a day number; inverse of days_from_civil."""
    z += 719_468
    era = z // 146_097
    doe = z - era * 146_097
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def valid_date(y: int, m: int, d: int) -> bool:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return y >= 1 and 1 <= m <= 12 and 1 <= d <= (29 if m == 2 and leap else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1])


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    for n in (name, "/".join("_".join(w.capitalize() for w in part.split("_")) for part in name.lower().split("/"))):
        try:
            return ZoneInfo(n)
        except (KeyError, ValueError, OSError):
            continue
    return None


def zone_offset(name: str, y: int, m: int, d: int, h: int, mi: int, s: int) -> int | None:
    """Seconds east of UTC of a wall time in a civil zone: the earlier instant where it occurs twice, None where it is skipped."""
    zone = _zone(name)
    if zone is None:
        return None
    wall = datetime(y, m, d, h, mi, s)
    first = zone.utcoffset(wall)
    second = zone.utcoffset(wall.replace(fold=1))
    return None if first < second else int(first.total_seconds())


def iso_instant(micros: int) -> str:
    day, rest = divmod(micros, 86_400_000_000)
    y, m, d = civil_from_days(day)
    sec, frac = divmod(rest, 1_000_000)
    return f"{y:04d}-{m:02d}-{d:02d}T{sec // 3600:02d}:{sec // 60 % 60:02d}:{sec % 60:02d}.{frac:06d}Z"


def normalise(text: str | None, zone: str | None, order: str | None, abbrevs: dict[str, int]) -> str | None:
    """`YYYY-MM-DD`, `YYYY-MM-DDTHH:MM:SS.ffffffZ`, or None where the text names no real day or instant."""
    if not text:
        return None
    m = PATTERN.fullmatch(text.translate(_DIGITS).strip())
    if m is None:
        return None
    g = m.groupdict()
    if g["epoch"]:
        n = int(g["epoch"])
        return iso_instant(n * (1_000 if len(g["epoch"]) > 10 else 1_000_000))
    p = "p" if g["ph"] or g["phc"] else ""
    if g[p + "y1"] or g[p + "y2"]:
        k = "1" if g[p + "y1"] else "2"
        y, mo, d = int(g[p + "y" + k]), int(g[p + "m" + k]), int(g[p + "d" + k])
    elif g[p + "y3"]:
        a, b, y = int(g[p + "a3"]), int(g[p + "b3"]), g[p + "y3"]
        mo, d = (a, b) if (order or DEFAULT_ORDER).upper() == "MDY" else (b, a)
        y = int(y) if len(y) == 4 else int(y) + (1900 if int(y) >= 50 else 2000)
    else:
        k = "4" if g[p + "y4"] else "5"
        mo, d, y = MONTH_NO[g[p + "m" + k].lower()], int(g[p + "d" + k]), g[p + "y" + k]
        y = int(y) if len(y) == 4 else int(y) + (1900 if int(y) >= 50 else 2000)
    if not valid_date(y, mo, d):
        return None
    c = "c" if g[p + "hc"] else ""
    if not g[p + "h" + c]:
        return f"{y:04d}-{mo:02d}-{d:02d}"
    h, mi, s = int(g[p + "h" + c]), int(g[p + "mi" + c]), int(g[p + "s" + c] or 0)
    if g[p + "ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g[p + "ap"].lower() == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    micros = int((g[p + "f" + c] or "").ljust(6, "0")[:6])
    if g[p + "z"]:
        offset = 0
    elif g[p + "sign"]:
        zh, zm = int(g[p + "zh"]), int(g[p + "zm"] or 0)
        if zh > 18 or zm > 59:
            return None
        offset = (zh * 3600 + zm * 60) * (1 if g[p + "sign"] == "+" else -1)
    elif g[p + "abbr"]:
        if g[p + "abbr"].upper() not in abbrevs:
            return None
        offset = abbrevs[g[p + "abbr"].upper()] * 60
    else:
        offset = zone_offset(g[p + "iana"] or zone or DEFAULT_ZONE, y, mo, d, h, mi, s)
        if offset is None:
            return None
    return iso_instant((days_from_civil(y, mo, d) * 86_400 + h * 3600 + mi * 60 + s - offset) * 1_000_000 + micros)


def normal_dates(entities: DataFrame, documents: DataFrame, offices: DataFrame, zone_abbrevs: DataFrame) -> DataFrame:
    """One row (entity_id, normal_form) per DATE entity; normal_form is null where the text names no real day or instant.

    The office of `documents.sro_code` gives zone and order of a text that states none. zone_abbrevs is a fixed lookup
    (refused when it isn't small); the other joins are left to the planner. Null entity_ids are left out.
    """
    abbrevs = {r[0].upper(): int(r[1]) for r in lookup_rows(zone_abbrevs.select("abbrev", "offset_minutes")) if r[0]}
    office = offices.select("sro_code", F.col("tz_name").alias("_tz"), F.col("date_order").alias("_ord"))
    place = documents.select("doc_id", "sro_code").join(office, "sro_code").select("doc_id", "_tz", "_ord").dropDuplicates(["doc_id"])
    dates = entities.filter("entity_type = 'DATE' AND entity_id IS NOT NULL").select("entity_id", "doc_id", "text")

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            out = []
            for key in zip(b["text"], b["_tz"], b["_ord"]):
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = normalise(*key, abbrevs)
                out.append(seen[key])
            yield pd.DataFrame({"entity_id": b["entity_id"], "normal_form": out})

    return (
        dates.join(place, "doc_id", "left")
        .select("entity_id", "text", "_tz", "_ord")
        .mapInPandas(run, "entity_id long, normal_form string")
        .groupBy("entity_id").agg(F.max("normal_form").alias("normal_form"))
    )


def found(entities: DataFrame, documents: DataFrame, offices: DataFrame, zone_abbrevs: DataFrame) -> DataFrame:
    """p7_found: the DATE entities that name a real day or instant."""
    return normal_dates(entities, documents, offices, zone_abbrevs).filter("normal_form IS NOT NULL")
