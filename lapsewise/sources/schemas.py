"""Types of the crawl tables, coercion and the checks that run before any job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table lacks a required column or breaks a structural rule."""


_KINDS = {"long": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _schema(spec: str) -> T.StructType:
    """From "name type, ..." without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in spec.split(", "))])


RUNS = _schema("id long, source string, started_at timestamp, finished_at timestamp, status string, rows_parsed long, page_cap long, pages_fetched long, parser_version long, rules_version long")
JOBS = _schema(
    "id long, source string, source_id string, title string, company string, location string, remote boolean, salary_min long, salary_max long, currency string, salary_raw string, posted_at timestamp, url string, description string, first_seen timestamp, last_seen timestamp, content_hash string, seniority string"
)
OBSERVATIONS = _schema("job_id long, run_id long")
SNAPSHOT_ROWS = _schema(
    "observed_at timestamp, source string, source_id string, title string, company string, location string, remote boolean, salary_min long, salary_max long, currency string, salary_raw string, posted_at timestamp, url string"
)
TABLES = {"runs": RUNS, "jobs": JOBS, "job_observations": OBSERVATIONS}
#: Required of each table; other columns of the schema are typed where present.
REQUIRED = {"runs": ("id", "source", "started_at", "status"), "jobs": ("id", "source", "source_id", "title", "first_seen", "last_seen"), "job_observations": ("job_id", "run_id")}


def require(df: DataFrame, names: tuple[str, ...], table: str) -> DataFrame:
    """df itself; SchemaError names what is missing. Extra columns stay."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise SchemaError(f"{table}: missing {', '.join(missing)}")
    return df


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns cast to their types; what cannot be read becomes null. remote keeps its three states."""
    out = {}
    for field in schema:
        if field.name not in df.columns:
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType) and isinstance(df.schema[field.name].dataType, T.StringType):
            out[field.name] = F.try_to_timestamp(column)
        elif isinstance(field.dataType, T.BooleanType) and isinstance(df.schema[field.name].dataType, T.StringType):
            word = F.lower(F.trim(column))
            out[field.name] = F.when(word.isin("1", "1.0", "true"), True).when(word.isin("0", "0.0", "false"), False)
        elif isinstance(field.dataType, T.LongType):
            out[field.name] = column.try_cast("double").try_cast("long") if isinstance(df.schema[field.name].dataType, T.StringType) else column.try_cast("long")
        else:
            out[field.name] = column.try_cast(field.dataType)
    return df.withColumns(out)
