"""Features of a single posting. The same functions serve training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.clean import with_salary

# Fixed values that results depend on.
TITLE_SENIORITY = (
    ("executive", r"(?iU)\b(?:chief|c[teofi]o|vp|vice president|head of|director)\b"),
    ("lead", r"(?iU)\b(?:staff|principal|lead|distinguished|fellow)\b"),
    ("senior", r"(?iU)\b(?:senior|sr\.?)\b"),
    ("junior", r"(?iU)\b(?:junior|jr\.?|intern|internship|graduate|entry[- ]level|apprentice)\b"),
)
MANAGER = r"(?iU)\b(?:manager|management|managing)\b"
REMOTE = r"(?iU)\b(?:remote|anywhere|distributed|work from home|wfh)\b"
BANDS = ((100_000.0, "under_100k"), (150_000.0, "100k_150k"), (200_000.0, "150k_200k"), (250_000.0, "200k_250k"), (350_000.0, "250k_350k"))
OVER, UNSTATED = "over_350k", "unstated"
DAY_MICROS = 86_400_000_000


def posting_key(source: str = "source", source_id: str = "source_id") -> Column:
    return F.concat_ws("|", F.col(source), F.col(source_id))


def title_seniority(title: Column) -> Column:
    text = F.coalesce(title, F.lit(""))
    out = None
    for name, pattern in TITLE_SENIORITY:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unspecified")


def flag(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern).cast("double")


def n_locations(location: Column) -> Column:
    text = F.trim(F.coalesce(location, F.lit("")))
    return F.when(text == "", 0.0).otherwise(F.regexp_count(text, F.lit(";")).cast("double") + 1.0)


def title_words(title: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(title, F.lit("")), r"(?U)\s+"), "")).cast("double")


def salary_band(amount: Column) -> Column:
    """Left-closed bands; null is a level of its own."""
    out = F.when(amount.isNull(), UNSTATED)
    for edge, name in BANDS:
        out = out.when(amount < edge, name)
    return out.otherwise(OVER)


def with_derived(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title_seniority": title_seniority(F.col("title")),
        "title_is_manager": flag(F.col("title"), MANAGER),
        "title_words": title_words(F.col("title")),
        "title_chars": F.length(F.coalesce("title", F.lit(""))).cast("double"),
        "location_is_remote": flag(F.col("location"), REMOTE),
        "n_locations": n_locations(F.col("location")),
        "salary_band": salary_band(F.col("salary_min_clean")),
    })


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(DAY_MICROS))


def with_row_local(df: DataFrame, unicode_form: bool = True) -> DataFrame:
    """Age, weekdays (Monday is 0), month and pay fields of each row at its t."""
    df = df.withColumns({
        "age_days": days_between(F.col("t"), F.col("first_published")),
        "days_since_update": days_between(F.col("t"), F.col("updated_at")),
        "t_dow": F.weekday("t"),
        "posted_dow": F.weekday("first_published"),
        "posted_month": F.month("first_published"),
    })
    return with_salary(df, unicode_form=unicode_form)


def older_than_thirty_days(age: Column) -> Column:
    return F.coalesce(age > 30, F.lit(False))


def posted_this_week(age: Column) -> Column:
    return F.coalesce(age <= 7, F.lit(False))
