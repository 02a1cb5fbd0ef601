"""Cleaning of text and pay columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
HOURS_PER_YEAR, MONTHS_PER_YEAR = 2080, 12
SENIORITY = ("intern", "junior", "senior", "staff", "lead", "principal", "head", "director")
SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"))
TOKENS = ("USD", "EUR", "GBP")
PERIODS = (
    ("hourly", r"(?iu)\bhour(?:s|ly)?\b|\bhr\b|\bstunde\w*"),
    ("monthly", r"(?iu)\bmonth(?:s|ly)?\b|\bmonat\w*"),
    ("yearly", r"(?iu)\byear(?:s|ly)?\b|\byr\b|\bannum\b|\bannual\w*|\bjahr\w*"),
)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def normalize_whitespace(text: Column, unicode_form: bool = True) -> Column:
    """NFKC (only where a character beyond ASCII occurs), single blanks, trimmed; empty becomes null."""
    if unicode_form:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def normalize_seniority(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*SENIORITY), low)


def parse_number(raw: Column) -> Column:
    """With both separators the last is decimal; one kind groups thousands if three digits follow its last, else is decimal."""
    last_dot, last_comma = F.length(raw) - F.instr(F.reverse(raw), "."), F.length(raw) - F.instr(F.reverse(raw), ",")
    dots, commas = F.contains(raw, F.lit(".")), F.contains(raw, F.lit(","))
    both = F.when(last_dot > last_comma, F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    grouped = raw.rlike(r"[^.,].*[.,][^.,]{3}$")
    one = F.when(grouped, F.regexp_replace(raw, "[.,]", "")).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    return F.when(dots & commas, both).when(dots | commas, one).otherwise(raw).try_cast("double")


def currency(text: Column) -> Column:
    out = None
    for symbol, code in SYMBOLS:
        out = F.when(F.contains(text, F.lit(symbol)), code) if out is None else out.when(F.contains(text, F.lit(symbol)), code)
    for token in TOKENS:
        out = out.when(F.upper(text).rlike(rf"\b{token}\b"), token)
    return out


def period(text: Column) -> Column:
    out = None
    for name, pattern in PERIODS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unstated")


def with_salary(df: DataFrame, raw: str = "salary_raw", unicode_form: bool = True) -> DataFrame:
    """df plus salary_min_clean, salary_max_clean, salary_currency_clean, salary_period, salary_stated, salary_parsed, salary_is_range."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*kept, normalize_whitespace(F.col(raw), unicode_form).alias("_pay"))
    body = F.regexp_replace("_pay", r"(?iu)(?:per|/)\s*\w+", " ")
    found = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"[0-9][0-9.,]*"), F.lit(0)), parse_number), lambda x: x.isNotNull())
    df = df.select(*kept, "_pay", F.coalesce(found, F.array().cast("array<double>")).alias("_numbers"))
    low, high = F.array_min("_numbers"), F.array_max("_numbers")
    return df.select(
        *kept,
        low.alias("salary_min_clean"),
        high.alias("salary_max_clean"),
        currency(F.col("_pay")).alias("salary_currency_clean"),
        F.coalesce(F.when(F.col("_pay").isNotNull(), period(F.col("_pay"))), F.lit("unstated")).alias("salary_period"),
        F.col("_pay").isNotNull().alias("salary_stated"),
        (F.size("_numbers") > 0).alias("salary_parsed"),
        F.coalesce((F.size("_numbers") > 1) & (low != high), F.lit(False)).alias("salary_is_range"),
    )


def annualise(amount: Column, unit: Column) -> Column:
    return amount * F.when(unit == "hourly", HOURS_PER_YEAR).when(unit == "monthly", MONTHS_PER_YEAR).otherwise(1)


def clean_jobs(jobs: DataFrame) -> DataFrame:
    """jobs plus cleaned title, company, location, seniority and pay columns; no row goes."""
    names = {f"{c}_clean": normalize_whitespace(F.col(c)) for c in ("title", "company", "location")}
    out = with_salary(jobs.withColumns(names).withColumn("seniority_clean", normalize_seniority(F.col("seniority"))))
    return out.withColumn("salary_min_annual", annualise(F.col("salary_min_clean"), F.col("salary_period"))).withColumn("salary_max_annual", annualise(F.col("salary_max_clean"), F.col("salary_period")))
