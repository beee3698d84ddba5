import random
from datetime import date, timedelta
from decimal import Decimal

from lekhya.operators import quantities, timestamps

AB = {"IST": 330, "EST": -300, "UTC": 0}


def test_civil_days_round_trip():
    for k in range(-700_000, 2_900_000, 997):
        y, m, d = timestamps.civil_from_days(k)
        assert timestamps.days_from_civil(y, m, d) == k
    start = date(1970, 1, 1)
    for k in range(0, 40_000, 13):
        assert timestamps.civil_from_days(k) == tuple((start + timedelta(days=k)).timetuple()[:3])


def test_p7_counts_before_2001():
    n = lambda t: timestamps.normalise(t, None, None, {})
    assert n("999999999") == "2001-09-09T01:46:39.000000Z" and n("999999999999") == "2001-09-09T01:46:39.999000Z"
    assert n("100000000") == "1973-03-03T09:46:40.000000Z" and n("10000000000") == "1970-04-26T17:46:40.000000Z"
    assert n("1000000000") == "2001-09-09T01:46:40.000000Z" and n("1000000000000") == "2001-09-09T01:46:40.000000Z"
    assert n("20080925") == "2008-09-25" and n("1234567") is None and n("12345678901234") is None


def test_dates():
    n = lambda t, zone=None, order=None: timestamps.normalise(t, zone, order, AB)
    for t, want in {
        "31-01-1999": "1999-01-31", "10.10.04": "2004-10-10", "12/06/99": "1999-06-12", "19951126": "1995-11-26", "2nd day of April, 1991": "1991-04-02", "15th  JUNE\n2012": "2012-06-15",
        "Aug 8, 2021 8:05:14am Asia/Kolkata": "2021-08-08T02:35:14.000000Z", "२५ अगस्त १९८९": "1989-08-25", "1555212850": "2019-04-14T03:34:10.000000Z", "1495583340000": "2017-05-23T23:49:00.000000Z",
        "20180326T170705 IST": "2018-03-26T11:37:05.000000Z", "20240410T2139 GMT-0400": "2024-04-11T01:39:00.000000Z", "9:41:17 PM on 14th August 2018": "2018-08-14T16:11:17.000000Z",
    }.items():
        assert n(t) == want, t
    for t in ("31-02-1994", "the year 2000", "28-3", "July 1993", "32nd June, 2011", "", None, "25:61 on 1 May 2000", "01-13-2001"):
        assert n(t) is None, t
    assert n("9/26/1992", order="MDY") == "1992-09-26"
    assert n("2018-03-11T02:06", "America/New_York") is None  # skipped by the zone
    assert n("2018-11-04T01:06", "America/New_York") == "2018-11-04T05:06:00.000000Z"  # twice: the earlier


def test_dates_on_tables(spark):
    e = spark.createDataFrame([(1, 10, "DATE", "1/2/2003"), (1, 10, "DATE", "1/2/2003"), (2, 11, "DATE", "1/2/2003"), (3, None, "DATE", None), (None, 10, "DATE", "1/2/2003")], "entity_id long, doc_id long, entity_type string, text string")
    d = spark.createDataFrame([(10, "A", "clash"), (11, None, "clash")], "doc_id long, sro_code string, text string")
    o = spark.createDataFrame([("A", "America/New_York", "MDY")], "sro_code string, tz_name string, date_order string")
    z = spark.createDataFrame([("IST", 330)], "abbrev string, offset_minutes int")
    assert {tuple(r) for r in timestamps.found(e, d, o, z).collect()} == {(1, "2003-01-02"), (2, "2003-02-01")}
    assert timestamps.found(e.limit(0), d, o, z).count() == 0


F = {"sq_ft": Decimal("0.09290304"), "sq_m": Decimal(1), "sq_yd": Decimal("0.83612736"), "acre": Decimal("4046.8564224"), "gunta": Decimal("101.17141056"), "cent": Decimal("40.468564224"), "hectare": Decimal(10000), "are": Decimal(100), "ground": Decimal("222.967296"), "rupee": Decimal(1), "thousand": Decimal(1000), "lakh": Decimal(100000), "million": Decimal(1000000), "crore": Decimal(10000000)}


def test_quantities():
    h = lambda f, t: quantities.hundredths(f(t, F))
    for t, want in {
        "450.25 sq.ft. (41.83 sq.m.)": 4183, "8 Ac - 23 cents": 3330563, "4 1/2 grounds": 100335, "6¾ guntas": 68291, "Two Thousand Eighty Square Feet": 19324, "sqm 806": 80600, "४२०६ व.मी.": 420600,
        "1,987  sqft": 18460, "1/2 gunthas": 5059, "0.02 lakh Sq.Yards": 167225, "290": None, "974 bigha": None, "": None,
    }.items():
        assert h(quantities.parse_area, t) == want, t
    for t, want in {
        "Rs. 5,32,20,000/- (Rupees Five Crores Thirty Two Lakhs Twenty Thousand only)": 5322000000, "₹344K": 34400000, "Rs 17.5 L": 175000000, "rs, ": None, "₹ १० लाख": 100000000, "Rs.2,36,000": 23600000,
        "Rupees Seven Crores Nine\nLakhs Twenty Thousand only": 7092000000, "INR 11.5 million": 1150000000, "9325000 rupees": 932500000, "500": None,
    }.items():
        assert h(quantities.parse_money, t) == want, t


def test_missing_units(spark):
    rng = random.Random(3)
    stated = [(k, "AREA", f"{round(10 ** rng.gauss(2.5, 0.15), 2)} sq. m") for k in range(400)]
    bare = [(1000 + k, "AREA", f"{round(10 ** rng.gauss(2.5, 0.15) / 0.09290304, 2)}") for k in range(200)]
    e = spark.createDataFrame(stated + bare + [(5000, "AREA", None)], "entity_id long, entity_type string, text string")
    u = spark.createDataFrame([("sq_m", "area", 1.0), ("sq_ft", "area", 0.09290304), ("acre", "area", 4046.8564224), ("lakh", "money", 1e5)], "unit_code string, dimension string, factor double")
    got = quantities.missing_units(e, u).collect()
    assert len(got) == 200 and sum(r.unit_code == "sq_ft" for r in got) > 190
    assert quantities.missing_units(e.limit(0), u).count() == 0
    assert quantities.found(e, u).count() == 400


def test_missing_units_planted(spark):
    """Numbers whose units are taken away: those the model is sure of are right nine times in ten, and the rest is flagged."""
    rng = random.Random(55)
    factors = spark.createDataFrame([("sq_m", "area", 1.0), ("sq_ft", "area", 0.09290304), ("acre", "area", 4046.8564224), ("rupee", "money", 1.0)], "unit_code string, dimension string, factor double")
    size = {"sq_m": 1.0, "sq_ft": 0.09290304, "acre": 4046.8564224}
    rows, truth = [], {}
    for k in range(1500):
        unit = rng.choice(list(size))
        value = 10 ** rng.gauss(2.5, 0.18) / size[unit]  # plots of about 300 square metres
        if k % 5 == 0:
            truth[k] = unit
            rows.append((k, "AREA", f"{value:.3f}"))
        else:
            rows.append((k, "AREA", f"{value:.3f} {'sq.m.' if unit == 'sq_m' else 'sq.ft.' if unit == 'sq_ft' else 'acres'}"))
    e = spark.createDataFrame(rows, "entity_id long, entity_type string, text string")
    got = {r.entity_id: r for r in quantities.missing_units(e, factors).collect()}
    assert set(got) == set(truth)
    sure = [i for i, r in got.items() if not r.uncertain]
    assert len(sure) >= 0.6 * len(truth) and sum(got[i].unit_code == truth[i] for i in sure) >= 0.9 * len(sure)
