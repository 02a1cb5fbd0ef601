"""Readers and writers of crawl tables, snapshot logs, archived payloads and uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.sources import schemas
from lapsewise.sources.working import Working

#: Payload files carry their fetch time in their name.
STAMP = r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z)\.html(\.gz)?$"
PAYLOAD = (
    "jobs array<struct<id:long,internal_job_id:long,absolute_url:string,company_name:string,requisition_id:string,content:string,first_published:string,updated_at:string,application_deadline:string,"
    "location:struct<name:string>,departments:array<struct<id:long,name:string>>,offices:array<struct<id:long,name:string,location:string>>,metadata:array<struct<id:long,name:string,value:string,value_type:string>>>>"
)


def load_tables(spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """runs, jobs and job_observations, checked and typed."""
    out = {}
    for name, schema in schemas.TABLES.items():
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        df = reader.format(kind).load(f"{path}/{name}.{kind}")
        out[name] = schemas.coerced(schemas.require(df, schemas.REQUIRED[name], name), schema)
    return out


def load_snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """One frame of all per-run CSV logs under path."""
    df = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    return schemas.coerced(schemas.require(df, ("observed_at", "source", "source_id"), "snapshot rows"), schemas.SNAPSHOT_ROWS)


def _names(items: Column, field: str = "name") -> Column:
    """Sorted, trimmed, pipe-joined names; null if there is none."""
    names = F.filter(F.transform(items, lambda x: F.trim(x[field])), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_sort(names), "|"), F.lit(""))


def _metadata(items: Column) -> Column:
    """Name to value as JSON with sorted keys; the last of equal names wins."""
    named = F.filter(items, lambda m: m["name"].isNotNull())
    last = F.filter(named, lambda m, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda later: later["name"] == m["name"]))
    pairs = F.array_sort(F.transform(last, lambda m: F.struct(m["name"].alias("key"), m["value"].alias("value"))))
    return F.when(F.size(named) > 0, F.to_json(F.map_from_entries(pairs)))


def instant(text: Column) -> Column:
    """An ISO instant, with an offset or in UTC; what is none becomes null."""
    return F.try_to_timestamp(text)


def flatten_payloads(payloads: DataFrame) -> DataFrame:
    """One row per job of payloads (path, jobs)."""
    token = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = payloads.select(
        F.try_to_timestamp(F.regexp_extract("path", STAMP, 1), F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'")).alias("fetched_at"),
        token.alias("board_dir"),
        F.explode("jobs").alias("j"),
    )
    return rows.select(
        "fetched_at",
        "board_dir",
        F.regexp_extract("j.absolute_url", r"^https?://[^/]+/([^/]+)/", 1).alias("board_token"),
        F.col("j.id").cast("string").alias("source_id"),
        "j.company_name",
        "j.requisition_id",
        "j.internal_job_id",
        instant(F.col("j.first_published")).alias("first_published"),
        instant(F.col("j.updated_at")).alias("updated_at"),
        instant(F.col("j.application_deadline")).alias("application_deadline"),
        F.col("j.location.name").alias("location_name"),
        _names(F.col("j.departments")).alias("departments"),
        F.greatest(F.coalesce(F.size("j.departments"), F.lit(0)), F.lit(0)).alias("n_departments"),
        _names(F.col("j.offices")).alias("offices"),
        _names(F.col("j.offices"), "location").alias("office_locations"),
        F.greatest(F.coalesce(F.size("j.offices"), F.lit(0)), F.lit(0)).alias("n_offices"),
        _metadata(F.col("j.metadata")).alias("metadata_json"),
        F.greatest(F.coalesce(F.size("j.metadata"), F.lit(0)), F.lit(0)).alias("n_metadata"),
        F.length(F.coalesce("j.content", F.lit(""))).alias("content_chars"),
        F.col("j.content").alias("content"),
    )


def load_archive(spark: SparkSession, path: str, include_content: bool = False) -> DataFrame:
    """All payloads under path (board_dir/<stamp>.html or .html.gz); other files are skipped."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html*").json(path)
    raw = raw.select("jobs", F.col("_metadata.file_path").alias("path")).where(F.col("path").rlike(STAMP))
    out = flatten_payloads(raw)
    return out if include_content else out.drop("content")


def write_archive(archive: DataFrame, path: str) -> dict[str, int]:
    """Fields and bodies as two tables keyed by (fetched_at, source_id); row counts by table."""
    archive.drop("content").write.mode("overwrite").parquet(f"{path}/fields")
    archive.select("fetched_at", "source_id", "content").write.mode("overwrite").parquet(f"{path}/bodies")
    spark = archive.sparkSession
    return {name: spark.read.parquet(f"{path}/{name}").count() for name in ("fields", "bodies")}


def newest_run(runs: DataFrame) -> DataFrame:
    """newest: the date of the last run inside the data."""
    return runs.agg(F.max(F.to_date("started_at")).cast("string").alias("newest"))


def latest_snapshot(spark: SparkSession, path: str) -> str | None:
    """The folder under path with the latest date (yyyy-mm-dd) as its name; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()]
    dated = [n for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n)]
    return f"{path.rstrip('/')}/{max(dated)}" if dated else None


def attach_source(archive: DataFrame, jobs: DataFrame) -> DataFrame:
    """archive with the smallest source that knows each source_id."""
    return archive.join(jobs.groupBy("source_id").agg(F.min("source").alias("source")), "source_id", "left")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/{name}.parquet")


def write_panel(panel: DataFrame, path: str) -> None:
    """One directory per horizon and basis."""
    panel.write.mode("overwrite").partitionBy("horizon_days", "horizon_basis").parquet(path)


def canonical_text(df: DataFrame) -> Column:
    """A row as text that any engine can write: columns by name, each "-" if null, else the length of its value, ":" and the value.

    Moments are microseconds since 1970, floating numbers whole millionths, nested values JSON; others are as they are cast.
    """
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind in ("double", "float"):
            c = F.when(F.isnan(c), "nan").otherwise(F.floor(c.cast("double") * 1_000_000 + 0.5).cast("long").cast("string"))
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        elif kind == "binary":
            c = F.hex(c)
        return F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))

    return F.concat(*[text(name, kind) for name, kind in sorted(df.dtypes)])


def content_hash(df: DataFrame) -> DataFrame:
    """n_rows and an order-insensitive hash of all rows: the sum of the first 60 bits of each row's md5."""
    number = F.conv(F.substring(F.md5(canonical_text(df)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("content_hash"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, content_hash."""
    parts = [content_hash(df).select(F.lit(name).alias("table_name"), "n_rows", "content_hash") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row of each (stage, dataset, panel_sha256, git_sha)."""
    both = ledger.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("stage", "dataset", "panel_sha256", "git_sha").orderBy(F.desc("recorded_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df plus name: the place of each row in this order, from 1. Dealt out by range and written, counted by part, numbered inside: no task sorts all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = Working(df.sparkSession, "numbered").table(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn(name, inside).join(per.select("_part", before.alias("_before")), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def parse_board(df: DataFrame, known: list[str], order: str) -> DataFrame:
    """An upload: unknown columns go, blanks become null, title is required, client_id falls back to row-N in that order."""
    schemas.require(df, ("title",), "board")
    rows = numbered(df, order, "_row")
    keep = [c for c in known if c in df.columns and c != "client_id"]
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    own = blank("client_id") if "client_id" in df.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(own, F.concat(F.lit("row-"), F.col("_row").cast("string"))).alias("client_id"), *[blank(c).alias(c) for c in keep])
