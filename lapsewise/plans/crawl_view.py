"""A view of the events table as crawls of boards: a user is a posting, a day of a board is a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions.derive import days_between
from lapsewise.operators import panel as P
from lapsewise.sources.working import Working

TITLES = ("Senior Engineer", "Staff Engineer", "Engineering Manager", "Junior Analyst", "Director of Sales", "Remote Support Intern", "Analyst")
HORIZON = 7


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting and day with an event: source, source_id, user_id, t."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("day")).distinct()
    return events.select(F.concat(F.lit("board:"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("user_id").cast("string").alias("source_id"), "user_id", F.col("day").cast("timestamp").alias("observed_at"))


def run_log(rows: DataFrame) -> DataFrame:
    """All runs with status and rules_version worked out from board and day."""
    days = rows.select("source", "observed_at").distinct()
    first = rows.agg(F.min("observed_at").alias("first"))
    n = F.datediff("observed_at", "first")
    out = days.join(F.broadcast(first), F.lit(True)).withColumn("n", n)
    board = F.substring("source", 7, 9).cast("int")
    return out.select(
        (F.col("n") * 10 + board).cast("long").alias("id"), "source", F.col("observed_at").alias("started_at"),
        F.when((F.col("n") + board) % 13 == 12, "partial").otherwise("ok").alias("status"), F.when(F.col("n") < 1, 1).otherwise(2).cast("long").alias("rules_version"),
        F.lit(10).cast("long").alias("page_cap"), (8 + F.col("n") % 3).cast("long").alias("pages_fetched"),
    )


def with_attributes(rows: DataFrame) -> DataFrame:
    u = F.col("user_id")
    title = F.get(F.array(*[F.lit(t) for t in TITLES]), (u % 7).cast("int"))
    out = rows.withColumns({
        "title": title, "company": F.concat(F.lit("company "), (u % 3).cast("string")), "requisition_id": F.when(u % 4 != 0, F.concat(F.lit("req "), (u % 11).cast("string"))),
        "location": F.when(u % 5 != 0, F.concat(F.lit("Berlin; Remote "), (u % 2).cast("string"))), "first_published": F.date_add(F.lit("2023-12-01").cast("date"), (u % 40).cast("int")).cast("timestamp"),
        "score": ((u * 37 + F.dayofmonth("t") * 17) % 101) / F.lit(101.0),
    })
    return out.withColumn("age_days", days_between(F.col("t"), F.col("first_published")))


def labelled_panel(spark: SparkSession, sf_dir: str, horizon: int = HORIZON, basis: str = "calendar") -> DataFrame:
    """The labelled panel, written once for the query that asks for it: what is built on it plans one scan, not the making of the panel over and over."""
    work = Working(spark, "panel")
    rows = work.table(seen(spark, sf_dir))
    runs = work.table(P.complete_runs(run_log(rows)))
    panel = work.table(P.observations(runs, rows))
    return work.table(with_attributes(P.with_labels(panel, runs, horizon, basis)))


#: The same view in SQL.
SQL = """
WITH obs0 AS (SELECT DISTINCT 'board:' || (user_id % 5) AS source, user_id::VARCHAR AS source_id, user_id, ts::DATE AS day FROM events),
log0 AS (SELECT source, day, date_diff('day', (SELECT min(day) FROM obs0), day) AS dn, substr(source, 7)::INT AS b FROM (SELECT DISTINCT source, day FROM obs0)),
log AS (SELECT dn * 10 + b AS id, source, day, CASE WHEN (dn + b) % 13 = 12 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN dn < 1 THEN 1 ELSE 2 END AS rules_version, 10 AS page_cap, 8 + dn % 3 AS pages_fetched FROM log0),
runs AS (SELECT id AS run_id, source, day AS t, row_number() OVER (PARTITION BY source ORDER BY day, id) - 1 AS run_index FROM log WHERE status = 'ok' AND rules_version = (SELECT max(rules_version) FROM log)),
panel AS (SELECT o.source, o.source_id, o.user_id, r.run_id, r.t, r.run_index FROM obs0 o JOIN runs r ON o.source = r.source AND o.day = r.t),
nxt AS (SELECT source, source_id, run_index, lead(run_index) OVER (PARTITION BY source, source_id ORDER BY run_index) AS nx FROM panel),
lastr AS (SELECT source, max(run_index) AS mi, max(t) AS mt FROM runs GROUP BY source),
gone AS (SELECT n.source, n.source_id, min(n.run_index) + 1 AS gi FROM nxt n JOIN lastr l ON l.source = n.source WHERE nx >= run_index + 3 OR (nx IS NULL AND run_index + 2 <= mi) GROUP BY n.source, n.source_id),
gonet AS (SELECT g.source, g.source_id, r.t AS t_gone FROM gone g JOIN runs r ON r.source = g.source AND r.run_index = g.gi),
lasts AS (SELECT source, source_id, max(t) AS ls FROM panel GROUP BY source, source_id),
lab AS (SELECT p.*, CASE WHEN l.mt >= p.t + {H} THEN CASE WHEN g.t_gone <= p.t + {H} THEN 1 WHEN s.ls >= p.t + {H} THEN 0 END END AS y
  FROM panel p JOIN lastr l ON l.source = p.source JOIN lasts s ON s.source = p.source AND s.source_id = p.source_id LEFT JOIN gonet g ON g.source = p.source AND g.source_id = p.source_id),
feat AS (SELECT *, y IS NOT NULL AS label_observable,
  ['Senior Engineer', 'Staff Engineer', 'Engineering Manager', 'Junior Analyst', 'Director of Sales', 'Remote Support Intern', 'Analyst'][(user_id % 7 + 1)::INT] AS title,
  'company ' || (user_id % 3) AS company, CASE WHEN user_id % 4 <> 0 THEN 'req ' || (user_id % 11) END AS requisition_id,
  CASE WHEN user_id % 5 <> 0 THEN 'Berlin; Remote ' || (user_id % 2) END AS location,
  DATE '2023-12-01' + (user_id % 40)::INT AS first_published, ((user_id * 37 + day(t) * 17) % 101) / 101.0::DOUBLE AS score,
  (t - (DATE '2023-12-01' + (user_id % 40)::INT))::DOUBLE AS age_days FROM lab),
known AS (SELECT * FROM feat WHERE label_observable),
ann AS (SELECT f.*, min(run_index) OVER (PARTITION BY source, source_id) AS fs, count(*) OVER (PARTITION BY source, source_id) AS runs_seen, min(run_index) OVER (PARTITION BY source) AS bf FROM feat f),
cohorts AS (SELECT *, CASE WHEN fs = bf THEN 'incumbent' ELSE 'entrant' END AS cohort, run_index = fs AS first_observation FROM ann),
kc AS (SELECT * FROM cohorts WHERE label_observable)
"""


def sql(select: str, horizon: int = HORIZON) -> str:
    return SQL.replace("{H}", str(horizon)) + select
