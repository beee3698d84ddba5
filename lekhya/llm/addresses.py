"""Problem 4: which address records denote the same house or flat, by a gazetteer built from the records themselves.

1. Every record is parsed into PIN, locality (name and kind), street (side, name, kind), house number and flat.
2. Gazetteer of localities: PINs with the locality they are most often given with; spellings of locality names are
   clustered by edit distance within their kind. Gazetteer of streets: spellings are clustered within each locality, by one
   edit or swap, and where there is nothing so near by two edits; the most frequent spelling names the street and gets its
   identifier. A spelling moves only to one that is several times as frequent: ratios, not counts, so any size is judged alike.
3. Every address is resolved by a beam search with additive costs: the `beam` best hypotheses for its locality (its PIN, its
   name, near spellings; a cost for each edit) are extended by the gazetteer's streets there (a cost for each edit, one for a
   side that is not given, more the better the street without a side is known itself), and the least total wins.
4. Records with equal street identifier, house number and flat are joined, on the values themselves.

Defined results: null and empty texts, mere localities and texts without house number or street are no address
records; landmarks, building, city and state are ignored; repeated rows of a record count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lekhya.session import materialise, nonempty

# Written forms of the words that address parts are made of.
STREET_KINDS = {
    "main road": r"(?:main|mn\.?)\s*(?:road|rd)", "cross road": r"(?:cross|crs\.?|x)\s*(?:road|rd)", "road": r"road|rd",
    "street": r"street|str|st", "lane": r"lane|ln", "avenue": r"avenue|ave|av", "marg": r"marg|mg",
}
LOCALITY_KINDS = {
    "colony": r"colony|colny|coly|col|cly", "nagar": r"nagara|nagar|ngr", "layout": r"lay-?\s?out|lyt|l/o", "extension": r"extension|extn|ext",
}
SIDES = {
    "east": r"east|e", "west": r"west|w", "north": r"north|n", "south": r"south|s", "upper": r"upper|upr", "lower": r"lower|lwr",
    "old": r"old", "new": r"new|nw",
}


def _alt(forms: dict[str, str]) -> str:
    return "|".join(f"(?:{v})" for v in forms.values())


#: What a side that is not given costs, in edits; a street known without a side must be 2^(2*SIDE_COST) times rarer to be taken for one with a side.
SIDE_COST = 3.0
_NAME = r"[^\W\d_][^\W\d_']{2,}"
PIN = re.compile(r"(?<!\d)(?:pin(?:\s?code)?\s*[:\-–.]?\s*)?([1-9]\d{2})\s?(\d{3})(?!\d)(?!\s*/)")
FLAT = re.compile(r"(?<![a-z])(?:flat|apartment|apt|unit|f)\b\.?\s*(?:no\b\.?)?\s*[:#\-]?\s*(\d{1,4})\s?-?\s?([a-z])?(?![a-z0-9/])")
STREET = re.compile(rf"(?:(?<![a-z0-9])({_alt(SIDES)})\b\.?\s+)?(?<![a-z0-9'])({_NAME})\s+({_alt(STREET_KINDS)})(?![a-z])\.?")
LOCALITY = re.compile(rf"(?<![a-z0-9'])({_NAME})\s+({_alt(LOCALITY_KINDS)})(?![a-z])\.?")
LANDMARK = re.compile(r"(?<![a-z])(?:opposite|opp|near|nr|behind|beside|next to|adjacent to)\b\.?\s*[^\W\d_]+(?:\s+[^\W\d_]+)?")
HOUSE = re.compile(r"(?:(?<![a-z])(?:house|door|plot|h|d)?\.?\s*no\b\.?|#)\s*[:#\-]?\s*(\d+[a-z]?(?:\s?/\s?\d+[a-z]?)*)")
BARE = re.compile(r"(?<![\w/\-])(\d+[a-z]?(?:/\d+[a-z]?)*)(?![\w/])")
# missing separators: before a capital that follows a small letter, between letters and long numbers, after a flat's letter
_GLUED = [
    (re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[a-z]{2}\.)(?=[A-Z])"), " , "), (re.compile(r"(?<=[A-Za-z.])(?=\d{2,})(?<![A-Z]\.)"), " "),
    (re.compile(r"(?<=\d)(?=[A-Z][a-z]{2})"), " , "), (re.compile(r"(\d\s?-?\s?[A-Z])(?=[A-Z][a-z])"), r"\1 , "), (re.compile(r"(?<=\d[A-Z])(?=[A-Z]\.No)|(?<=\d-[A-Z])(?=[A-Z]\.No)|(?<=[a-z])(?=\d/)|(?<=L/O)(?=[A-Z])|(?<=l/o)(?=[a-z])"), " , "),
    (re.compile(r"(?<=[A-Za-z])(?=[Nn][Rr]\. )"), " , "),
]
_KIND_WORDS = "road|street|lane|avenue|marg|colony|nagara|nagar|layout|extension|residency|towers|enclave|court|homes|arcade|heights|apartments"
_GLUED_LOW = re.compile(rf"(?<![a-z])({_KIND_WORDS})(?=[a-z]{{4,}})(?!ension|ments)")
_GLUED_FLAT = re.compile(r"(?<![a-z])((?:flat|apartment|apt|unit|f)\b\.?\s*(?:no\b\.?)?\s*\d{1,4}\s?-?\s?[a-z])(?=[a-z]{4,}\s)")
_PUNCT = re.compile(r"\s*[;\n\r]+\s*|\s{2,}")


def _canonical(word: str, forms: dict[str, str]) -> str:
    return next((k for k, v in forms.items() if re.fullmatch(v, word.strip(". "))), word)


def parse(text: str | None) -> dict | None:
    """The parts of an address, or None where it has no house number or no street, or neither PIN nor locality."""
    if not text or not any(c.isdigit() for c in text):
        return None
    for pattern, by in _GLUED:
        text = pattern.sub(by, text)
    t = _PUNCT.sub(" , ", text).lower()
    t = re.sub(r"\s+", " ", t)
    t = _GLUED_FLAT.sub(r"\1 , ", t)
    t = re.sub(r"(?<=\d{3})(?=[a-z]{4})", " , ", t)
    t = _GLUED_LOW.sub(r"\1 , ", t)
    t = LANDMARK.sub(" , ", t)
    pins = [m for m in PIN.finditer(t) if (m[0][0] == "p" or re.search(r"(?:^|[\s,\-–a-z.])$", t[: m.start()]))]
    pin = pins[-1] if pins else None
    if pin and pin[0][0] != "p":  # a house number of three digits before the PIN's two halves
        pin = PIN.search(t, pin.start() + 1, pin.end() + 4) or pin
    rest = t[: pin.start()] + " , " + t[pin.end() :] if pin else t
    flat = FLAT.search(rest)
    if flat:
        rest = rest[: flat.start()] + " , " + rest[flat.end() :]
    house = HOUSE.search(rest)
    if house:
        rest = rest[: house.start()] + " , " + rest[house.end() :]
    else:
        house = BARE.search(rest)
        if house is None:
            return None
        rest = rest[: house.start()] + " , " + rest[house.end() :]
    street = locality = None
    for m in STREET.finditer(rest):
        if re.fullmatch(_alt(SIDES), m[2]) or re.fullmatch(_alt(LOCALITY_KINDS), m[2]):
            continue
        street = m
        break
    if street is None:
        return None
    rest = rest[: street.start()] + " , " + rest[street.end() :]
    for m in LOCALITY.finditer(rest):
        locality = m
        break
    if pin is None and locality is None:
        return None
    return {
        "pin": pin[1] + pin[2] if pin else None,
        "loc": locality[1] if locality else None, "loc_kind": _canonical(locality[2], LOCALITY_KINDS) if locality else None,
        "side": _canonical(street[1], SIDES) if street[1] else "", "street": street[2], "kind": _canonical(street[3], STREET_KINDS),
        "house": re.sub(r"\s", "", house[1]).lstrip("0"), "flat": (flat[1].lstrip("0") + (flat[2] or "")) if flat else "",
    }


def parsed(kind: str, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_kind, id, pin, loc, loc_kind, side, street, skind, house, flat) of the address records of a table."""
    cols = ["pin", "loc", "loc_kind", "side", "street", "kind", "house", "flat"]

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=20_000)(parse)
        for b in batches:
            rows = [(i, *(p[c] for c in cols)) for i, t in zip(b["id"], b["t"]) if (p := known(t))]
            yield pd.DataFrame(rows, columns=["id", "pin", "loc", "loc_kind", "side", "street", "skind", "house", "flat"], dtype=object).astype({"id": "int64"})

    places = df.filter(F.col("entity_type") == "LOCATION").filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\d"))
    out = places.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(
        run, "id long, pin string, loc string, loc_kind string, side string, street string, skind string, house string, flat string"
    )
    return out.dropDuplicates(["id"]).withColumn("record_kind", F.lit(kind))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _double_deletions(names: pd.Series) -> pd.Series:
    """Hashes of the name with at most two letters left out: names within two edits share one."""

    def of(name: str) -> set[str]:
        one = {name[:k] + name[k + 1 :] for k in range(len(name))}
        return {name} | one | {w[:k] + w[k + 1 :] for w in one for k in range(len(w))}

    return pd.Series([[xxhash.xxh3_64_intdigest(w) - 2**63 for w in sorted(of(n))] for n in names])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _deletions(names: pd.Series, places: pd.Series) -> pd.Series:
    """Hashes of (place, name with at most one letter left out): names of a place within one edit, or one swap of neighbours, share one."""

    @lru_cache(maxsize=10_000)
    def of(name: str) -> list[str]:
        return sorted({name, *(name[:k] + name[k + 1 :] for k in range(len(name)))})

    return pd.Series([[xxhash.xxh3_64_intdigest(f"{p}|{w}") - 2**63 for w in of(n)] for n, p in zip(names, places)])


def _near(left: str, right: str) -> F.Column:
    """One edit, or one swap of neighbours (two by Levenshtein, with the same letters)."""
    d = F.levenshtein(left, right)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (d <= 1) | ((d == 2) & (F.length(left) == F.length(right)) & (letters(left) == letters(right)))


def _shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the records: never broadcast. The planner goes by the size of compressed files, and takes a row for one however
    many keys are made of it, so that it would hold a multiple of its broadcast threshold on the driver, for several joins at once."""
    return df.hint("merge")


def gazetteer(records: DataFrame, beam: int = 8) -> DataFrame:
    """(pin, loc, loc_kind, side, street, skind, street_id): the identifier of every written form among the records."""
    form = ["pin", "loc", "loc_kind", "side", "street", "skind"]
    forms = materialise(records.groupBy(*form).agg(F.count("*").alias("n")).withColumn("form", F.xxhash64(*(F.coalesce(c, F.lit("\x00")) for c in form))), "forms")

    # localities: each PIN has the name it is most often given with
    named = forms.filter("pin IS NOT NULL AND loc IS NOT NULL").groupBy("pin", "loc", "loc_kind").agg(F.sum("n").alias("n"))
    pins = named.groupBy("pin").agg(F.max(F.struct("n", "loc", "loc_kind")).alias("b")).select("pin", F.col("b.loc").alias("gloc"), F.col("b.loc_kind").alias("gkind"), F.col("b.n").alias("gn"))
    spelled = forms.filter("pin IS NULL").select("loc", "loc_kind").distinct()
    left = spelled.select("loc", "loc_kind", F.explode(_deletions("loc", "loc_kind")).alias("key"))
    right = pins.select("pin", "gloc", "gn", F.explode(_deletions("gloc", "gkind")).alias("key"))
    close = left.join(_shuffled(right), "key").filter(_near("loc", "gloc")).select("loc", "loc_kind", F.col("pin").alias("l"), F.levenshtein("loc", "gloc").alias("cost"), "gn").distinct()
    order = Window.partitionBy("loc", "loc_kind").orderBy("cost", F.col("gn").desc(), "l")
    prior = 0.5 * (1 - F.col("gn") / F.max("gn").over(Window.partitionBy("loc", "loc_kind")))  # a PIN that the name is seldom given with
    close = close.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).select("loc", "loc_kind", "l", (F.col("cost") + prior).alias("cost"))

    with_pin = forms.filter("pin IS NOT NULL").select("form", "side", "street", "skind", "n", F.col("pin").alias("l"), F.lit(0.0).alias("cost"))
    by_name = forms.filter("pin IS NULL").join(_shuffled(close), ["loc", "loc_kind"], "left").select(
        "form", "side", "street", "skind", "n", F.coalesce("l", F.concat_ws("|", "loc", "loc_kind")).alias("l"), F.coalesce("cost", F.lit(0.0)).alias("cost")
    )
    hypotheses = materialise(with_pin.union(by_name), "hypotheses")

    # streets: spellings of a locality, side and kind; a spelling that is rare everywhere goes to its most frequent neighbour
    total = hypotheses.groupBy("street").agg(F.sum("n").alias("g"))
    spell = materialise(hypotheses.groupBy("l", "side", "skind", "street").agg(F.sum(F.col("n") / (1 + F.col("cost"))).alias("n")).join(_shuffled(total), "street"), "spellings")
    keyed = spell.select("l", "side", "skind", "street", "g", "n", F.explode(_deletions("street", F.concat_ws("|", "l", "side", "skind"))).alias("key"))
    other = keyed.filter("g >= 4").select(  # what the ratio of four asks for anyway
        "key", F.col("street").alias("to"), F.col("n").alias("ton"), F.col("g").alias("tog"))
    moves = keyed.drop("n").join(_shuffled(other), "key").filter("street <> to AND g * 4 <= tog").filter(_near("street", "to"))
    best = moves.groupBy("l", "side", "skind", "street").agg(F.max(F.struct("tog", "ton", "to")).getField("to").alias("to"))
    one = spell.join(_shuffled(best), ["l", "side", "skind", "street"], "left").select("l", "side", "skind", "street", F.coalesce("to", "street").alias("to"), "n")
    two = one.join(_shuffled(best.select("l", "side", "skind", F.col("street").alias("to"), F.col("to").alias("to2"))), ["l", "side", "skind", "to"], "left")
    # a locality may hold misspellings only: what has no frequent neighbour there takes the one it has among all streets
    words = total.select("street", "g", F.explode(_deletions("street", F.lit(""))).alias("key"))
    frequent = words.filter("g >= 4").select("key", F.col("street").alias("everywhere"), F.col("g").alias("tog"))
    wide = words.join(_shuffled(frequent), "key").filter("street <> everywhere AND g * 4 <= tog").filter(_near("street", "everywhere"))
    wide = wide.groupBy(F.col("street").alias("name")).agg(F.max(F.struct("tog", "everywhere")).getField("everywhere").alias("everywhere"))
    # and names of seven letters and more without any such neighbour may be two edits off, from a name that is far more frequent
    alone = total.join(_shuffled(wide.select(F.col("name").alias("street"))), "street", "left_anti").filter(F.length("street") >= 7)
    far = alone.select("street", "g", F.explode(_double_deletions("street")).alias("key"))
    targets = far.filter("g >= 20").select("key", F.col("street").alias("everywhere"), F.col("g").alias("tog"))  # as the ratio of twenty asks
    far = far.join(_shuffled(targets), "key").filter("street <> everywhere AND g * 20 <= tog").filter(F.levenshtein("street", "everywhere") == 2)
    far = far.groupBy(F.col("street").alias("name")).agg(F.max(F.struct("tog", "everywhere")).getField("everywhere").alias("everywhere"))
    wide = wide.union(far)
    named = two.withColumn("name", F.coalesce("to2", "to")).join(_shuffled(wide), "name", "left").withColumn("name", F.coalesce("everywhere", "name"))
    named = materialise(named.select("l", "side", "skind", "street", "name", "n"), "streets")
    streets = named.select("l", "side", "skind", "street", "name", F.least(F.levenshtein("street", "name"), F.lit(2)).alias("edits"))
    entries = materialise(named.groupBy("l", "side", "skind", "name").agg(F.sum("n").alias("support")), "entries")

    # the beam: hypotheses of the locality are extended by its streets; a street without a side may stand for the one with a side that
    # is known there by the same name, unless two sides are about equally well known
    given = hypotheses.join(_shuffled(streets), ["l", "side", "skind", "street"]).select("form", "l", "skind", "name", "side", (F.col("cost") + F.col("edits")).alias("cost"))
    sided = entries.filter("side <> ''").groupBy("l", "skind", "name").agg(F.max(F.struct("support", "side")).alias("best"), F.sum("support").alias("all"))
    sided = sided.filter(F.col("best.support") >= 0.8 * F.col("all")).select("l", "skind", "name", F.col("best.side").alias("to_side"), F.col("best.support").alias("to_support"))
    known = given.join(_shuffled(entries), ["l", "side", "skind", "name"])
    open_side = known.filter("side = ''").join(_shuffled(sided), ["l", "skind", "name"])
    better = F.log2(F.col("to_support") / F.col("support")) / 2  # what it costs to stay with a street that is hardly known
    moved = open_side.filter(better > SIDE_COST).select("form", "l", "skind", "name", F.col("to_side").alias("side"), (F.col("cost") + SIDE_COST).alias("cost"), F.col("to_support").alias("support"))
    stay = known.join(_shuffled(open_side.select("form", "l", "skind", "name", "side", better.alias("more"))), ["form", "l", "skind", "name", "side"], "left")
    stay = stay.select("form", "l", "skind", "name", "side", (F.col("cost") + F.greatest(F.coalesce("more", F.lit(0.0)), F.lit(0.0))).alias("cost"), "support")
    scored = stay.union(moved.select(*stay.columns)).withColumn("id", F.concat_ws("|", "l", "side", "name", "skind"))
    chosen = scored.groupBy("form").agg(F.min(F.struct("cost", (-F.col("support")).alias("s"), "id")).getField("id").alias("street_id"))
    return forms.join(_shuffled(chosen), "form").select(*form, "street_id")


def resolve(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """(record_kind, id, street_id, house, flat) of every address record."""
    records = materialise(parsed("entity", entities, "entity_id", "text").unionByName(parsed("resolved", resolved, "resolved_id", "canonical")), "addresses")
    gaz = gazetteer(records)
    keys = ["pin", "loc", "loc_kind", "side", "street", "skind"]
    h = F.xxhash64(*(F.coalesce(c, F.lit("\x00")) for c in keys))
    return records.withColumn("form", h).join(_shuffled(gaz.select(h.alias("form"), "street_id")), "form").select("record_kind", "id", "street_id", "house", "flat")


def found(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """p4_found (record_kind, id_a, id_b): the pairs of records of one kind that denote the same house or flat.

    The result's definition asks for all pairs of a house; the planner splits a house of any number of records (adaptive skew joins).
    """
    key = ["record_kind", "street", "house", "flat"]
    r = materialise(resolve(entities, resolved).select("record_kind", F.xxhash64("street_id").alias("street"), "house", "flat", "id"), "resolved")
    return r.withColumnRenamed("id", "id_a").join(_shuffled(r.withColumnRenamed("id", "id_b")), key).filter("id_a < id_b").select("record_kind", "id_a", "id_b")


def places(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """(record_kind, id, place_id, records): one row per address record, with its place and how many records the place has."""
    r = materialise(resolve(entities, resolved).withColumn("place_id", F.concat_ws("|", "street_id", "house", "flat")), "resolved")
    n = r.groupBy("place_id").agg(F.count("*").alias("records"))
    return r.join(_shuffled(n), "place_id").select("record_kind", "id", "place_id", "records")
