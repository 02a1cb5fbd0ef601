"""Which columns a model may see. Every column of a panel has a verdict; an unknown one refuses the frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, kind, fill.
FEATURES = (
    ("age_days", "numeric", "median"), ("days_since_update", "numeric", "median"), ("content_chars", "numeric", "median"), ("n_offices", "numeric", "median"), ("n_metadata", "numeric", "median"),
    ("salary_min_clean", "numeric", "median"), ("salary_max_clean", "numeric", "median"), ("board_size_at_t", "numeric", "median"), ("n_same_title_on_board", "numeric", "median"),
    ("n_same_req_on_board", "numeric", "one"), ("board_growth", "numeric", "zero"), ("departments", "categorical", "category"), ("offices", "categorical", "category"),
    ("location", "categorical", "category"), ("posted_dow", "categorical", "category_numeric"), ("salary_currency_clean", "categorical", "category"), ("salary_stated", "boolean", "zero"),
)
DERIVED = (
    ("title_seniority", "categorical", "category"), ("title_is_manager", "numeric", "zero"), ("title_words", "numeric", "median"), ("title_chars", "numeric", "median"),
    ("location_is_remote", "numeric", "zero"), ("n_locations", "numeric", "zero"), ("salary_band", "categorical", "category"),
)
BOARD_IDENTITY = (("source", "categorical", "category"), ("company", "categorical", "category"), ("company_posting_volume", "numeric", "zero"))
LEAKY = (("n_observations_total", "numeric", "median"), ("days_on_board_total", "numeric", "zero"))
TEXT = ("title",)
# Columns no model may see, by reason.
EXCLUDED = {
    "axis": ("t", "run_id", "run_index", "source_id", "url", "requisition_id", "horizon_days", "horizon_basis", "rules_version", "page", "response_sha256"),
    "label": ("y", "label_observable"),
    "experiment": ("split", "seen_in_train"),
    "consumed": ("first_published", "updated_at"),
    "skew": ("n_complete_runs_observed", "t_dow", "posted_month"),
    "superseded": ("remote", "n_departments", "salary_period", "salary_parsed", "salary_min", "salary_max", "currency", "posted_at", "salary_raw", "job_type_raw", "tags_raw"),
}
BOARD_CONTEXT = ("board_size_at_t", "board_growth", "n_same_title_on_board", "n_same_req_on_board")


def allowed(board_identity: bool = False, leaky: bool = False, only: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> tuple[tuple[str, str, str], ...]:
    """Features a model may use; only names a subset, without withholds some."""
    found = FEATURES + DERIVED + (BOARD_IDENTITY if board_identity else ()) + (LEAKY if leaky else ())
    names = {f[0] for f in found}
    if only is not None:
        if unknown := sorted(set(only) - names):
            raise ValueError(f"not features: {unknown}")
        found = tuple(f for f in found if f[0] in only)
    return tuple(f for f in found if f[0] not in without)


def known_columns() -> set[str]:
    out = {f[0] for f in FEATURES + DERIVED + BOARD_IDENTITY + LEAKY} | set(TEXT)
    return out.union(*EXCLUDED.values())


def assert_known(df: DataFrame) -> DataFrame:
    if unknown := sorted(set(df.columns) - known_columns()):
        raise ValueError(f"columns without a verdict: {unknown}")
    return df


def selected(df: DataFrame, features: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """The named features only: numbers and booleans as double, categories as text."""
    kinds = {"numeric": "double", "boolean": "double", "categorical": "string"}
    return df.select(*[(F.col(n).cast("int") if k == "boolean" else F.col(n)).cast(kinds[k]).alias(n) for n, k, _ in features])


def without_board_context(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in BOARD_CONTEXT if c in df.columns})


def described(spark: SparkSession) -> DataFrame:
    """name, kind, fill of every feature."""
    return spark.createDataFrame(list(FEATURES + DERIVED + BOARD_IDENTITY), "name string, kind string, fill string")
