"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of documents. A document is a row, not a doc_id: rows may repeat a doc_id or have none, so the stages that compare rows
number them first, in a written table. run writes every stage's result as Parquet in the shared folder and rereads it, so
that a lost executor costs a part of one stage, and then deletes what the stage has written for itself.

Nulls: a null or letterless text is in no language and goes in the first stage; a null doc_id or other column stays as
it is. Of repeated rows one stays. Ties between rows of a group go to the smallest doc_id, then the first row. Extra
columns are carried unchanged, whatever their names, up to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import langid, minhash, packing, pii, suffix_dedup
from lapsewise.llm.shared import Scratch, read_table

#: A text whose best language has a lower mean probability is in none of the learned languages.
LEAST_SCORE = 0.4


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id: a number; row: all columns of docs. Written, so that the numbers stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return Scratch(spark, "rows").table(rows, "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    found = langid.identify(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, one without doc_id only where no row has any."""
    rows = numbered(spark, docs)
    groups = minhash.near_duplicates(rows.select("doc_id", F.col("row.text").alias("text"))).select("doc_id", "component_id")
    groups = groups.join(rows.select("doc_id", F.col("row.doc_id").alias("own")), "doc_id")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("doc_id"))
    return rows.join(kept, "doc_id", "left_semi").select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that occur more than once. A character that loses some of its bytes becomes U+FFFD."""
    out = suffix_dedup.strip_repeats(docs).select("row", F.make_valid_utf8(F.col("kept").cast("string")).alias("left"))
    given = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[given.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with sequence and offset."""
    rows = numbered(spark, docs.select("doc_id", "text"))
    out = packing.pack(packing.pieces(rows.select("doc_id", F.col("row.text").alias("text"))))
    out = out.join(rows.select("doc_id", F.col("row.doc_id").alias("own")), "doc_id").withColumn("doc_id", F.col("own"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("repeated-strings", repeated_strings),
    ("personal-data", personal_data),
    ("packing", packed),
]

#: No SQL: the network, the vocabulary and the repeated strings cannot be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch.collecting():  # what a stage has written for itself goes when its result is written
            docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
