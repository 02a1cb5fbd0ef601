"""Validation of supplied postings, board context of a snapshot, prediction and ranking of whole boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.functions import derive
from lapsewise.operators import metrics, models
from lapsewise.operators.features import BOARD_CONTEXT

# Name, kind, origin, required.
CONTRACT = (
    ("title", "text", "supplied", True), ("location", "text", "supplied", False), ("salary_raw", "text", "supplied", False), ("departments", "category", "supplied", False),
    ("offices", "category", "supplied", False), ("n_offices", "number", "supplied", False), ("n_metadata", "number", "supplied", False), ("content_chars", "number", "supplied", False),
    ("first_published", "timestamp", "supplied", False), ("updated_at", "timestamp", "supplied", False), ("source", "category", "supplied", False), ("company", "category", "supplied", False),
    ("board_size_at_t", "number", "board", False), ("board_growth", "number", "board", False), ("n_same_title_on_board", "number", "board", False), ("n_same_req_on_board", "number", "board", False),
)


def describe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACT), "name string, kind string, origin string, required boolean")


def validate(rows: DataFrame, extra: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """rows plus valid and error_code (the first failure in contract order); a column outside the contract refuses the frame."""
    names = {c[0] for c in CONTRACT}
    if unknown := sorted(set(rows.columns) - names - set(extra)):
        raise ValueError(f"unknown fields: {unknown}")
    code = F.lit("ok")
    for name, kind, _, required in reversed(CONTRACT):
        if name not in rows.columns:
            if required:
                code = F.lit(f"missing_{name}")
            continue
        c, text = F.col(name), rows.schema[name].dataType.simpleString() == "string"
        bad = F.lit(False)
        if kind == "number":
            value = c.try_cast("double")
            bad = c.isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
        elif kind == "timestamp" and text:
            bad = c.isNotNull() & F.try_to_timestamp(c).isNull()
        elif rows.schema[name].dataType.simpleString() == "boolean":
            bad = c.isNotNull()
        code = F.when(bad, f"bad_{name}").otherwise(code)
        if required:
            code = F.when(c.isNull() | (F.trim(c.cast("string")) == ""), f"missing_{name}").otherwise(code)
    return rows.withColumn("error_code", code).withColumn("valid", F.col("error_code") == "ok")


def model_rows(rows: DataFrame, at: str) -> DataFrame:
    """Contract rows with t and every feature that training has; what was not supplied is null."""
    for name, kind, _, _ in CONTRACT:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast({"number": "double", "timestamp": "timestamp"}.get(kind, "string")))
    return derive.with_derived(derive.with_row_local(rows.withColumn("t", F.lit(at).cast("timestamp")), unicode_form=False))


def context_supplied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("board_context_supplied", F.coalesce(*[F.col(c).cast("double") for c in BOARD_CONTEXT]).isNotNull())


def board_context(board: DataFrame, previous_size: int | DataFrame | None = None, key: str = "source") -> DataFrame:
    """Counts of declared snapshots, of one board or of many in one pass: what the panel gives at the same run. Refuses supplied context.

    previous_size: of the only board, or a table (key, previous_size).
    """
    if supplied := sorted(set(BOARD_CONTEXT) & set(board.columns)):
        raise ValueError(f"context is derived, not supplied: {supplied}")
    added = key not in board.columns
    board = board.withColumn(key, F.lit("")) if added else board
    if not isinstance(previous_size, DataFrame):
        if previous_size is not None and len(board.select(key).distinct().limit(2).collect()) > 1:
            raise ValueError("one size before is for one board")
        previous_size = board.select(key).distinct().withColumn("previous_size", F.lit(previous_size).cast("long"))
    size = board.groupBy(key).agg(F.count("*").alias("board_size_at_t")).join(previous_size, key, "left")
    title = F.count(F.lit(1)).over(Window.partitionBy(key, "title"))
    requisition = F.when(F.col("requisition_id").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(key, "requisition_id")))
    out = board.withColumn("n_same_title_on_board", title).withColumn("n_same_req_on_board", requisition).join(size, key)
    out = out.withColumn("board_growth", F.col("board_size_at_t") - F.col("previous_size")).drop("previous_size")
    return out.drop(key) if added else out


def rank_upload(rows: DataFrame, model, at: str, board: str = "source", budget: int | None = 20, threshold: float | None = None) -> DataFrame:
    """Validated rows scored and ranked, any number of boards of any size in one job."""
    good = validate(rows).where("valid").drop("valid", "error_code")
    scored = models.predict(model, context_supplied(model_rows(good, at)))
    return metrics.rank_board(scored, board, budget=budget, threshold=threshold)
