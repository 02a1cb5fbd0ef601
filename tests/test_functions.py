import pytest

from lapsewise.functions import clean, derive

READABLE = [
    ("90.000 € bis 130.000 € / Jahr", 90000.0, 130000.0, "EUR", "yearly", True), ("15,50 €", 15.5, 15.5, "EUR", "unstated", False),
    ("£13.00 - £18.20 Per Hour", 13.0, 18.2, "GBP", "hourly", True), ("$120,000", 120000.0, 120000.0, "USD", "unstated", False), ("1,234.56 USD Month", 1234.56, 1234.56, "USD", "monthly", False),
]


@pytest.mark.parametrize("raw,low,high,currency,period,spread", READABLE)
def test_salaries(spark, raw, low, high, currency, period, spread):
    r = clean.with_salary(spark.createDataFrame([(raw,)], "salary_raw string")).first()
    assert (r["salary_min_clean"], r["salary_max_clean"], r["salary_currency_clean"], r["salary_is_range"]) == (low, high, currency, spread)
    assert r["salary_period"] == period and r["salary_stated"] and r["salary_parsed"]


def test_unreadable_and_absent(spark):
    rows = {r["salary_raw"]: r for r in clean.with_salary(spark.createDataFrame([("Competitive",), ("",), (None,)], "salary_raw string")).collect()}
    assert rows["Competitive"]["salary_stated"] and not rows["Competitive"]["salary_parsed"]
    assert not rows[""]["salary_stated"] and not rows[None]["salary_stated"]


def test_numbers(spark):
    cases = {"1.234,56": 1234.56, "1.234.56": None, "5,": 5.0, "1.000": 1000.0, "1,5": 1.5, "7": 7.0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["v"] for r in df.select("x", clean.parse_number(df["x"]).alias("v")).collect()} == cases


def test_whitespace_and_unicode(spark):
    df = spark.createDataFrame([("a  b",), ("ﬁ",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(clean.normalize_whitespace(df["x"])).collect()] == ["a b", "fi", None, None]


def test_derived(spark):
    df = spark.createDataFrame([("Senior Engineering Manager", "Berlin; Remote", 100000.0), (None, None, None), ("Intern", "", 99999.0)], "title string, location string, salary_min_clean double")
    a, b, c = derive.with_derived(df).collect()
    assert (a["title_seniority"], a["title_is_manager"], a["n_locations"], a["location_is_remote"], a["salary_band"], a["title_words"]) == ("senior", 1.0, 2.0, 1.0, "100k_150k", 3.0)
    assert (b["title_seniority"], b["n_locations"], b["salary_band"], b["title_words"]) == ("unspecified", 0.0, "unstated", 0.0)
    assert (c["title_seniority"], c["salary_band"]) == ("junior", "under_100k")
