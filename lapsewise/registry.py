"""Registered queries and the SQL that states them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.functions import clean, derive
from lapsewise.operators import audit, experiments, metrics, models, panel, scoring, waves
from lapsewise.plans import crawl_view as V
from lapsewise.sources import crawls
from lapsewise.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits).alias(name or (c if isinstance(c, str) else "x"))


def day(c: str) -> Column:
    return F.to_date(c).cast("string").alias(c)


def known(s: SparkSession, d: str) -> DataFrame:
    return V.labelled_panel(s, d).where("label_observable")


def annotated(s: SparkSession, d: str) -> DataFrame:
    return audit.annotate(V.labelled_panel(s, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e2e_rates_by_board"](spark, sf_dir)


RATES = "count(*) AS rows, count(DISTINCT source_id) AS postings, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate, round(avg(age_days), 6) AS mean_age"


def rates(df: DataFrame, *keys: str) -> DataFrame:
    return audit.group_rates(df, *keys).select(*keys, "rows", "postings", "positives", r("rate"), r("mean_age"))


@query("e2e_rates_by_board", V.sql(f"SELECT source, {RATES} FROM known GROUP BY source"))
def _(s, d):
    return rates(known(s, d), "source")


# ---- sources ------------------------------------------------------------------------------------------------------


def crawl_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = V.seen(s, d)
    jobs = V.with_attributes(rows.groupBy("source", "source_id", "user_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen")).withColumn("t", F.col("first_seen")))
    jobs = jobs.select(F.col("user_id").alias("id"), "source", "source_id", "title", "company", "first_seen", "last_seen", F.concat("title", "company").alias("content_hash"), (F.col("user_id") % 9 * 10).alias("salary_min"), (F.col("user_id") % 7 * 12).alias("salary_max"))
    runs = V.run_log(rows)
    obs = rows.join(runs, (rows["source"] == runs["source"]) & (rows["observed_at"] == runs["started_at"])).select(F.when(F.col("user_id") % 50 == 7, -F.col("user_id")).otherwise(F.col("user_id")).alias("job_id"), F.col("id").alias("run_id"))
    return {"runs": runs, "jobs": jobs, "job_observations": obs}


JOBS = """, jobs AS (SELECT user_id AS id, source, source_id, min(day) AS first_seen, max(day) AS last_seen FROM obs0 GROUP BY ALL),
obsj AS (SELECT CASE WHEN user_id % 50 = 7 THEN -user_id ELSE user_id END AS job_id, l.id AS run_id, l.source FROM obs0 o JOIN log l ON o.source = l.source AND o.day = l.day) """


@query("s4_validation_report", V.sql(JOBS + """
SELECT 'rows_runs' AS "check", count(*) AS n FROM log UNION ALL SELECT 'rows_jobs', count(*) FROM jobs UNION ALL SELECT 'rows_job_observations', count(*) FROM obsj
UNION ALL SELECT 'duplicate_posting', 0 UNION ALL SELECT 'duplicate_content_hash', count(*) - count(DISTINCT (id % 7, id % 3)) FROM jobs
UNION ALL SELECT 'duplicate_title_company', count(*) - count(DISTINCT (id % 7, id % 3)) FROM jobs
UNION ALL SELECT 'orphan_observations', count(*) FROM obsj WHERE job_id NOT IN (SELECT id FROM jobs) UNION ALL SELECT 'seen_backwards', 0
UNION ALL SELECT 'salary_backwards', count(*) FROM jobs WHERE id % 9 * 10 > id % 7 * 12 UNION ALL SELECT 'runs_' || status, count(*) FROM log GROUP BY status
UNION ALL SELECT 'truncated_runs', count(*) FROM log WHERE pages_fetched >= page_cap"""))
def _(s, d):
    return audit.validation_report(crawl_tables(s, d))


def canonical_sql(rows: str, columns: dict[str, str]) -> str:
    """n_rows and content_hash of rows, whose columns are given as text."""
    each = " || ".join(f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for _, c in sorted(columns.items()))
    return f"SELECT count(*) AS n_rows, coalesce(sum(('0x' || substr(md5({each}), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS content_hash FROM {rows}"


TITLE_SQL = "['Senior Engineer', 'Staff Engineer', 'Engineering Manager', 'Junior Analyst', 'Director of Sales', 'Remote Support Intern', 'Analyst'][(id % 7 + 1)::INT]"
MANIFEST = {
    "runs": ("log", {c: c for c in ("id", "source", "status", "rules_version", "page_cap", "pages_fetched")} | {"started_at": "epoch_us(day::TIMESTAMP)"}),
    "jobs": ("jobs", {c: c for c in ("id", "source", "source_id")} | {"title": TITLE_SQL, "company": "'company ' || (id % 3)", "first_seen": "epoch_us(first_seen::TIMESTAMP)", "last_seen": "epoch_us(last_seen::TIMESTAMP)", "content_hash": f"{TITLE_SQL} || 'company ' || (id % 3)", "salary_min": "id % 9 * 10", "salary_max": "id % 7 * 12"}),
    "job_observations": ("obsj", {"job_id": "job_id", "run_id": "run_id"}),
}


@query("s15_manifest", V.sql(JOBS + " UNION ALL ".join(f"SELECT '{name}' AS table_name, * FROM ({canonical_sql(*of)})" for name, of in MANIFEST.items())))
def _(s, d):
    return crawls.manifest(crawl_tables(s, d))


@query("s14_newest_run", V.sql("SELECT max(day)::VARCHAR AS newest FROM log"))
def _(s, d):
    return crawls.newest_run(V.run_log(V.seen(s, d)))


@query("s16_ledger_upsert", """
WITH rows AS (SELECT event_type AS stage, (user_id % 3)::VARCHAR AS dataset, 'p' AS panel_sha256, (user_id % 2)::VARCHAR AS git_sha, event_id AS recorded_at, value FROM events)
SELECT stage, dataset, panel_sha256, git_sha, recorded_at, value FROM rows QUALIFY row_number() OVER (PARTITION BY stage, dataset, panel_sha256, git_sha ORDER BY recorded_at DESC) = 1""")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).cast("string").alias("dataset"), F.lit("p").alias("panel_sha256"), (F.col("user_id") % 2).cast("string").alias("git_sha"), F.col("event_id").alias("recorded_at"), "value")
    return crawls.upsert_ledger(rows.where("recorded_at % 2 = 0"), rows.where("recorded_at % 2 = 1"))


# ---- panel --------------------------------------------------------------------------------------------------------


@query("p1_complete_runs", V.sql("SELECT run_id, source, t::VARCHAR AS t, run_index FROM runs"))
def _(s, d):
    return panel.complete_runs(V.run_log(V.seen(s, d))).select("run_id", "source", day("t"), "run_index")


@query("j2_unrecorded_runs", V.sql("SELECT source, run_index FROM runs WHERE dayofmonth(t) % 5 = length(source) % 5"))
def _(s, d):
    """The snapshot rows of some runs are missing: whole days, one in five."""
    rows = V.seen(s, d)
    left = rows.where(F.dayofmonth("observed_at") % 5 != F.length("source") % 5)
    return panel.unrecorded_runs(panel.complete_runs(V.run_log(rows)), left).select("source", "run_index")


for _h in (1, 3, 7):

    @query(f"l1_labels_h{_h}", V.sql("SELECT source, source_id, run_index, y::BIGINT AS y FROM lab", _h))
    def _(s, d, h=_h):
        return V.labelled_panel(s, d, h).select("source", "source_id", "run_index", F.col("y").cast("long").alias("y"))


@query("l1_labels_instant", V.sql("SELECT source, source_id, run_index, y::BIGINT AS y FROM lab", 3))
def _(s, d):
    return V.labelled_panel(s, d, 3, "instant").select("source", "source_id", "run_index", F.col("y").cast("long").alias("y"))


@query("w2_board_context", V.sql("""
, sz AS (SELECT source, run_index, count(*) AS n, count(*) - lag(count(*)) OVER (PARTITION BY source ORDER BY run_index) AS g FROM feat GROUP BY source, run_index)
SELECT f.source, f.source_id, f.run_index, count(*) OVER (PARTITION BY f.source, f.run_index) AS board_size_at_t, count(*) OVER (PARTITION BY f.source, f.run_index, title) AS n_same_title_on_board,
  CASE WHEN requisition_id IS NOT NULL THEN count(*) OVER (PARTITION BY f.source, f.run_index, requisition_id) END AS n_same_req_on_board, g AS board_growth,
  row_number() OVER (PARTITION BY f.source, f.source_id ORDER BY f.run_index) AS n_complete_runs_observed
FROM feat f JOIN sz ON sz.source = f.source AND sz.run_index = f.run_index"""))
def _(s, d):
    return panel.with_board_context(V.labelled_panel(s, d)).select("source", "source_id", "run_index", "board_size_at_t", "n_same_title_on_board", "n_same_req_on_board", "board_growth", "n_complete_runs_observed")


@query("j3_nearest_fetch", """
WITH a AS (SELECT user_id, ts AS t, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
b AS (SELECT user_id, ts AS f, min(event_id) AS fid FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id, ts),
m AS (SELECT a.event_id, b.fid, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.f) - epoch_us(a.t)), b.f) AS k FROM a JOIN b ON a.user_id = b.user_id AND abs(epoch_us(b.f) - epoch_us(a.t)) <= 86400000000)
SELECT a.event_id, m.fid AS fetched FROM a LEFT JOIN m ON m.event_id = a.event_id AND m.k = 1""")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("t"), "event_type")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(kinds), F.lit(True))
    rows = e.where("event_type = lo").select("event_id", "source_id", "t")
    archive = e.where("event_type = hi").groupBy("source_id", F.col("t").alias("fetched_at")).agg(F.min("event_id").alias("fetched"))
    return panel.attach_nearest(rows, archive, 86_400).select("event_id", "fetched")


@query("f9_row_local", V.sql("SELECT source_id, run_index, age_days, isodow(t) - 1 AS t_dow, isodow(first_published) - 1 AS posted_dow, month(first_published) AS posted_month FROM feat"))
def _(s, d):
    rows = V.labelled_panel(s, d).withColumn("updated_at", F.col("first_published")).withColumn("salary_raw", F.lit(None).cast("string"))
    out = derive.with_row_local(rows, unicode_form=False)
    return out.select("source_id", "run_index", "age_days", F.col("t_dow").cast("long").alias("t_dow"), F.col("posted_dow").cast("long").alias("posted_dow"), F.col("posted_month").cast("long").alias("posted_month"))


@query("f10_derived", V.sql("""
SELECT DISTINCT title, location,
 CASE WHEN title LIKE '%Director%' THEN 'executive' WHEN title LIKE '%Staff%' THEN 'lead' WHEN title LIKE '%Senior%' THEN 'senior' WHEN title LIKE '%Junior%' OR title LIKE '%Intern' THEN 'junior' ELSE 'unspecified' END AS title_seniority,
 (title LIKE '%Manager%')::INT::DOUBLE AS title_is_manager, len(string_split(title, ' '))::DOUBLE AS title_words, length(title)::DOUBLE AS title_chars,
 (coalesce(location, '') LIKE '%Remote%')::INT::DOUBLE AS location_is_remote, CASE WHEN location IS NULL THEN 0.0 ELSE 2.0 END::DOUBLE AS n_locations FROM feat"""))
def _(s, d):
    rows = V.labelled_panel(s, d).select("title", "location").distinct().withColumn("salary_min_clean", F.lit(None).cast("double"))
    return derive.with_derived(rows).drop("salary_min_clean", "salary_band")


@query("f3_salary_parse", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v END AS salary_min_clean, CASE p_partkey % 4 WHEN 0 THEN v WHEN 1 THEN v + 1000 WHEN 2 THEN v END AS salary_max_clean,
 CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS salary_currency_clean, CASE p_partkey % 4 WHEN 1 THEN 'yearly' WHEN 2 THEN 'hourly' ELSE 'unstated' END AS salary_period,
 true AS salary_stated, p_partkey % 4 <> 3 AS salary_parsed, p_partkey % 4 = 1 AS salary_is_range,
 CASE p_partkey % 4 WHEN 3 THEN 'unstated' ELSE CASE WHEN v < 100000 THEN 'under_100k' WHEN v < 150000 THEN '100k_150k' WHEN v < 200000 THEN '150k_200k' ELSE 'more' END END AS band
FROM (SELECT p_partkey, (floor(p_retailprice) * 100)::DOUBLE AS v FROM part)""")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    v = F.floor("p_retailprice") * 100
    dotted = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("$"), F.format_number(v, 0))).when(F.col("p_partkey") % 4 == 1, F.concat(dotted(v), F.lit(" € bis "), dotted(v + 1000), F.lit(" € / Jahr"))).when(F.col("p_partkey") % 4 == 2, F.concat(v.cast("string"), F.lit(".00 GBP per hour"))).otherwise("Competitive")
    raw = F.when(F.col("p_partkey") % 4 == 1, F.concat(raw, F.lit(" Jahr"))).otherwise(raw)
    raw = F.when(F.col("p_partkey") % 4 == 2, F.concat(raw, F.lit(" hourly"))).otherwise(raw)
    out = clean.with_salary(part.select("p_partkey", raw.alias("salary_raw")), unicode_form=False).drop("salary_raw")
    return out.withColumn("band", derive.salary_band(F.col("salary_min_clean")))


@query("f17_age_rules", V.sql("SELECT age_days > 30 AS old, age_days <= 7 AS fresh, count(*) AS n FROM feat GROUP BY ALL"))
def _(s, d):
    return V.labelled_panel(s, d).groupBy(derive.older_than_thirty_days(F.col("age_days")).alias("old"), derive.posted_this_week(F.col("age_days")).alias("fresh")).agg(F.count("*").alias("n"))


# ---- audits -------------------------------------------------------------------------------------------------------

for _name, _keys in (("cohort", ["cohort"]), ("first_seen_wave", ["first_seen_idx"]), ("runs_seen", ["runs_seen"]), ("source_cohort", ["source", "cohort"]), ("first_observation", ["first_observation"])):
    _sql = ", ".join("fs AS first_seen_idx" if k == "first_seen_idx" else k for k in _keys)

    @query(f"a2_rates_by_{_name}", V.sql(f"SELECT {_sql}, {RATES} FROM kc GROUP BY {', '.join('fs' if k == 'first_seen_idx' else k for k in _keys)}"))
    def _(s, d, keys=_keys):
        return rates(annotated(s, d).where("label_observable"), *keys)


@query("a2_source_by_cohort_cube", V.sql("SELECT source, cohort, count(*) AS rows, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate, grouping(source, cohort)::BIGINT AS level FROM kc GROUP BY CUBE (source, cohort)"))
def _(s, d):
    return audit.source_by_cohort(annotated(s, d).where("label_observable")).select("source", "cohort", "rows", "positives", r("rate"), "level")


@query("a3_age_quantiles", V.sql("SELECT cohort, count(age_days) AS n, quantile_cont(age_days, 0.0) AS p0, quantile_cont(age_days, 0.25) AS p25, quantile_cont(age_days, 0.5) AS p50, quantile_cont(age_days, 0.75) AS p75, quantile_cont(age_days, 1.0) AS p100 FROM kc GROUP BY cohort"))
def _(s, d):
    return audit.age_quantiles(annotated(s, d).where("label_observable"))


@query("a4_run_completeness", V.sql("SELECT source, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (pages_fetched >= page_cap) AS capped, min(day)::VARCHAR AS first_run, max(day)::VARCHAR AS last_run FROM log GROUP BY source"))
def _(s, d):
    return audit.run_completeness(V.run_log(V.seen(s, d)))


@query("a5_panel_shape", V.sql("SELECT source, count(*) AS jobs, round(avg(n), 6) AS mean_days, max(n) AS max_days, count(*) FILTER (n = 1) AS seen_once, round(100.0 * count(*) FILTER (n = 1) / count(*), 6) AS pct_seen_once FROM (SELECT source, user_id, count(DISTINCT day) AS n FROM obs0 GROUP BY ALL) GROUP BY source"))
def _(s, d):
    seen = V.seen(s, d).select("source", F.col("user_id").alias("job_id"), F.to_date("observed_at").alias("day"))
    return audit.panel_shape(seen).select("source", "jobs", r("mean_days"), "max_days", "seen_once", r("pct_seen_once"))


@query("a6_coverage_by_source", V.sql("SELECT source, round_even(100.0 * avg((requisition_id IS NOT NULL)::INT), 0)::DOUBLE AS requisition_id, round_even(100.0 * avg((location IS NOT NULL)::INT), 0)::DOUBLE AS location FROM feat GROUP BY source"))
def _(s, d):
    return audit.coverage_by_source(V.labelled_panel(s, d), ["requisition_id", "location"])


@query("a7_column_summary", V.sql("SELECT 'requisition_id' AS column_name, 'string' AS dtype, count(requisition_id) AS non_null, round(100.0 * (count(*) - count(requisition_id)) / count(*), 1) AS null_pct, count(DISTINCT requisition_id) AS n_unique FROM feat UNION ALL SELECT 'title', 'string', count(title), round(100.0 * (count(*) - count(title)) / count(*), 1), count(DISTINCT title) FROM feat"))
def _(s, d):
    return audit.column_summary(V.labelled_panel(s, d).select("requisition_id", "title"))


@query("a8_board_stability", V.sql(", n AS (SELECT source, t, count(DISTINCT source_id) AS n FROM panel GROUP BY ALL), f AS (SELECT *, (n - lag(n) OVER w)::DOUBLE / lag(n) OVER w AS fall FROM n WINDOW w AS (PARTITION BY source ORDER BY t)) SELECT source, count(*) AS days, min(n) AS fewest, max(n) AS most, round(min(fall), 6) AS worst_fall FROM f GROUP BY source"))
def _(s, d):
    return audit.board_stability(V.labelled_panel(s, d)).select("source", "days", "fewest", "most", r("worst_fall"))


@query("a9_removal_dispersion", V.sql("SELECT s.source, d.day::VARCHAR AS day, coalesce(h.n, 0) AS positives FROM (SELECT DISTINCT source FROM known) s CROSS JOIN (SELECT DISTINCT t AS day FROM known) d LEFT JOIN (SELECT source, t, count(*) AS n FROM known WHERE y = 1 GROUP BY ALL) h ON h.source = s.source AND h.t = d.day"))
def _(s, d):
    return audit.removal_dispersion(known(s, d))


@query("a10_lifespan", V.sql("SELECT CASE WHEN runs_seen <= 3 THEN runs_seen::VARCHAR WHEN runs_seen <= 5 THEN '4-5' ELSE '6+' END AS lifespan, count(*) AS rows, sum(y)::BIGINT AS removals, round(sum(y) / count(*), 4) AS rate FROM kc GROUP BY 1"))
def _(s, d):
    return audit.lifespan_concentration(annotated(s, d).where("label_observable"))


@query("a10_lifespan_verdict", V.sql(", a AS (SELECT sum(y) FILTER (runs_seen < 6)::DOUBLE / count(*) FILTER (runs_seen < 6) AS b, sum(y) FILTER (runs_seen >= 6)::DOUBLE / count(*) FILTER (runs_seen >= 6) AS s, sum(y) FILTER (runs_seen < 6)::DOUBLE / sum(y) AS h FROM kc) SELECT round(b, 6) AS brief_rate, round(s, 6) AS settled_rate, round(h, 6) AS brief_share, round(b / s, 6) AS ratio, CASE WHEN b / s >= 10 THEN 'concentrated' WHEN b / s >= 3 THEN 'leaning' WHEN b / s IS NULL THEN 'undefined' ELSE 'spread' END AS status FROM a"))
def _(s, d):
    return audit.lifespan_verdict(annotated(s, d).where("label_observable")).select(r("brief_rate"), r("settled_rate"), r("brief_share"), r("ratio"), "status")


for _name, _keys in (("requisition", ["requisition_id"]), ("title", ["title", "company"])):
    _on = " AND ".join(f"o.{k} = a.{k}" for k in _keys)
    _hit = f"EXISTS (SELECT 1 FROM known o WHERE o.source = a.source AND {_on} AND o.source_id <> a.source_id AND date_diff('second', a.t::TIMESTAMP, o.t::TIMESTAMP) > 0 AND date_diff('second', a.t::TIMESTAMP, o.t::TIMESTAMP) <= 138240)"

    @query(f"a11_relisting_{_name}", V.sql(f"""
, last AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY t DESC) = 1), rem AS (SELECT * FROM last WHERE y = 1),
con AS (SELECT k.* FROM known k WHERE y = 0 AND EXISTS (SELECT 1 FROM rem WHERE rem.source = k.source AND rem.t = k.t)),
x AS (SELECT (SELECT count(*) FROM rem a WHERE {_hit}) AS removed_hits, (SELECT count(*) FROM rem) AS removed_n, (SELECT count(*) FROM con a WHERE {_hit}) AS control_hits, (SELECT count(*) FROM con) AS control_n),
z AS (SELECT *, removed_hits::DOUBLE / nullif(removed_n, 0) AS p, control_hits::DOUBLE / nullif(control_n, 0) AS q FROM x)
SELECT removed_hits, removed_n, control_hits, control_n, round(p, 6) AS removed_rate, round(q, 6) AS control_rate, round(sqrt(p * (1 - p) / removed_n + q * (1 - q) / control_n), 6) AS standard_error FROM z"""))
    def _(s, d, keys=_keys):
        return audit.compare_relisting(known(s, d), keys).select("removed_hits", "removed_n", "control_hits", "control_n", r("removed_rate"), r("control_rate"), r("standard_error"))


@query("a14_resurrections", V.sql("SELECT source, source_id, string_agg(run_index::VARCHAR, ',' ORDER BY run_index) AS runs_list, max(nx - run_index - 1)::BIGINT AS max_absent FROM nxt GROUP BY source, source_id HAVING max(nx - run_index - 1) > 0"))
def _(s, d):
    return audit.resurrections(V.labelled_panel(s, d))


@query("a20_verdict_shares", V.sql("SELECT source, y::BIGINT AS verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS arm_total, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 4) AS share FROM known GROUP BY source, y"))
def _(s, d):
    return audit.verdict_shares(known(s, d).withColumn("verdict", F.col("y").cast("long")), "source", "verdict")


@query("a21_wilson", V.sql(", g AS (SELECT source, sum(y)::BIGINT AS hits, count(*) AS n, avg(y) AS p FROM known GROUP BY source) SELECT source, hits, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM g"))
def _(s, d):
    g = known(s, d).groupBy("source").agg(F.sum("y").cast("long").alias("hits"), F.count("*").alias("n"))
    return audit.wilson(g, "hits", "n").select("source", "hits", "n", r("low"), r("high"))


@query("t5_stratified_sample", V.sql(", one AS (SELECT source, source_id, md5('s|' || source || '|' || source_id) AS dr FROM known GROUP BY source, source_id), q AS (SELECT source, greatest(1, round_even(40.0 * count(*) / (SELECT count(*) FROM one), 0)) AS quota FROM one GROUP BY source), k AS (SELECT o.*, row_number() OVER (PARTITION BY source ORDER BY dr) AS rk FROM one o) SELECT source, source_id FROM (SELECT k.source, k.source_id, dr FROM k JOIN q ON q.source = k.source WHERE rk <= quota ORDER BY dr LIMIT 40)"))
def _(s, d):
    return audit.stratified_sample(known(s, d), 40).select("source", "source_id")


@query("j9_alive_at_end", V.sql(JOBS + ", lr AS (SELECT source, arg_max(id, day) AS id FROM log GROUP BY source) SELECT id, source, source_id FROM jobs WHERE id IN (SELECT job_id FROM obsj WHERE run_id IN (SELECT id FROM lr))"))
def _(s, d):
    t = crawl_tables(s, d)
    return audit.alive_at_end(t["job_observations"], t["runs"], t["jobs"]).select("id", "source", "source_id")


# ---- waves, cuts, folds -------------------------------------------------------------------------------------------

EMBARGO = 7 * 86_400.0


@query("w7_crawl_waves", "WITH t AS (SELECT DISTINCT epoch_us(ts) * 10 AS t FROM events), f AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) > 3600000000 THEN 1 ELSE 0 END AS n FROM t), w AS (SELECT t, sum(n) OVER (ORDER BY t)::BIGINT AS wave FROM f) SELECT wave, count(*) AS instants, max(t) AS wave_end FROM w GROUP BY wave")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    # ten times as far apart, so that there are pauses of an hour
    rows = s.read.parquet(f"{d}/events.parquet").select(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("t"))
    return waves.crawl_waves(rows).groupBy("wave").agg(F.count("*").alias("instants"), F.unix_micros(F.max("t")).alias("wave_end"))


@query("a13_max_run_gap", V.sql(", g AS (SELECT date_diff('second', lag(t) OVER (PARTITION BY source ORDER BY t)::TIMESTAMP, t::TIMESTAMP) AS g FROM (SELECT DISTINCT source, t FROM panel)) SELECT max(g)::DOUBLE AS gap_seconds FROM g"))
def _(s, d):
    return waves.max_run_gap(V.labelled_panel(s, d))


CUTS = """, att AS (SELECT t, count(*) AS n, sum(y)::BIGINT AS p FROM known GROUP BY t),
cuts AS (SELECT a.t AS te, b.t AS ve FROM att a JOIN att b ON a.t < b.t),
met AS (SELECT te, ve, n, p, CASE WHEN t > ve + 7 THEN 'test' WHEN t > te + 7 AND t <= ve THEN 'val' WHEN t <= te THEN 'train' ELSE 'embargo' END AS s FROM cuts CROSS JOIN att),
cut AS (SELECT te, ve, coalesce(sum(n) FILTER (s = 'train'), 0)::BIGINT AS train_rows, coalesce(sum(p) FILTER (s = 'train'), 0)::BIGINT AS train_positives, coalesce(sum(n) FILTER (s = 'val'), 0)::BIGINT AS val_rows, coalesce(sum(p) FILTER (s = 'val'), 0)::BIGINT AS val_positives,
  coalesce(sum(n) FILTER (s = 'test'), 0)::BIGINT AS test_rows, coalesce(sum(p) FILTER (s = 'test'), 0)::BIGINT AS test_positives, coalesce(sum(n) FILTER (s = 'embargo'), 0)::BIGINT AS embargoed FROM met GROUP BY te, ve),
vcut AS (SELECT *, CASE WHEN train_rows = 0 THEN 'train is empty' WHEN val_rows = 0 THEN 'val is empty' WHEN test_rows = 0 THEN 'test is empty' WHEN val_positives IN (0, val_rows) THEN 'val has one class' WHEN test_positives IN (0, test_rows) THEN 'test has one class' ELSE 'ok' END AS reason FROM cut)
"""


@query("l7_feasible_cuts", V.sql(CUTS + "SELECT te::VARCHAR AS train_end, ve::VARCHAR AS val_end, train_rows, train_positives, val_rows, val_positives, test_rows, test_positives, embargoed, reason FROM vcut"))
def _(s, d):
    return waves.feasible_cuts(V.labelled_panel(s, d), EMBARGO).withColumn("train_end", day("train_end")).withColumn("val_end", day("val_end")).drop("valid")


FOLDS = """, w AS (SELECT DISTINCT t FROM known), fo AS (SELECT a.t AS te, min(b.t) AS vs, row_number() OVER (ORDER BY a.t) - 1 AS fold FROM w a JOIN w b ON b.t > a.t + 7 GROUP BY a.t) """


@query("l13_wave_forward_folds", V.sql(FOLDS + "SELECT fold, count(*) FILTER (t <= te) AS train_rows, count(*) FILTER (t > te + 7 AND t <= vs) AS val_rows, coalesce(sum(y) FILTER (t > te + 7 AND t <= vs), 0)::BIGINT AS val_positives FROM fo JOIN known ON t <= te OR (t > te + 7 AND t <= vs) GROUP BY fold"))
def _(s, d):
    return waves.fold_sizes(V.labelled_panel(s, d), EMBARGO)


@query("a23_fold_census", V.sql(CUTS + FOLDS + "SELECT te::VARCHAR AS train_end, ve::VARCHAR AS val_end, (SELECT count(*) FROM fo WHERE fo.vs <= vcut.te) AS folds FROM vcut WHERE reason = 'ok'"))
def _(s, d):
    return waves.fold_census(V.labelled_panel(s, d), EMBARGO).select(day("train_end"), day("val_end"), "folds")


@query("t8_latest_cut", V.sql(CUTS + "SELECT ve::VARCHAR AS val_end, max(te)::VARCHAR AS train_end FROM vcut WHERE reason = 'ok' GROUP BY ve"))
def _(s, d):
    return waves.latest_cut_per_val_end(waves.feasible_cuts(V.labelled_panel(s, d), EMBARGO)).select(day("val_end"), day("train_end"))


@query("t7_best_cut", V.sql(CUTS + FOLDS + ", c AS (SELECT *, (SELECT count(*) FROM fo WHERE fo.vs <= vcut.te) AS folds, train_rows + val_rows + test_rows AS tot FROM vcut WHERE reason = 'ok') SELECT te::VARCHAR AS train_end, ve::VARCHAR AS val_end, folds FROM c ORDER BY (folds >= 3)::INT DESC, CASE WHEN folds >= 3 THEN round(abs(train_rows::DOUBLE / tot - 0.6) + abs(val_rows::DOUBLE / tot - 0.2) + abs(test_rows::DOUBLE / tot - 0.2), 9) END NULLS FIRST, folds DESC, te, ve LIMIT 1"))
def _(s, d):
    return waves.best_cut(V.labelled_panel(s, d), EMBARGO).select(day("train_end"), day("val_end"), "folds")


SPLIT = """, sp AS (SELECT *, CASE WHEN t > DATE '2024-01-13' + 7 THEN 'test' WHEN t > DATE '2024-01-05' + 7 AND t <= DATE '2024-01-13' THEN 'val' WHEN t <= DATE '2024-01-05' THEN 'train' ELSE 'embargo' END AS split FROM known),
ss AS (SELECT *, split <> 'train' AND EXISTS (SELECT 1 FROM sp x WHERE x.split = 'train' AND x.source = sp.source AND x.source_id = sp.source_id) AS sit FROM sp WHERE split <> 'embargo') """


def split_rows(s: SparkSession, d: str) -> DataFrame:
    cut = lambda x: F.lit(x).cast("timestamp")
    rows = known(s, d).withColumn("split", waves.split_column(cut("2024-01-05"), cut("2024-01-13"), EMBARGO)).where("split <> 'embargo'")
    return waves.with_seen_in_train(rows)


@query("l4_split_report", V.sql(SPLIT + "SELECT split, 'all' AS part, count(*) AS rows, count(DISTINCT source || '|' || source_id) AS postings, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate FROM ss GROUP BY split UNION ALL SELECT split, CASE WHEN sit THEN 'carried over' ELSE 'unseen' END, count(*), count(DISTINCT source || '|' || source_id), sum(y)::BIGINT, round(avg(y), 6) FROM ss GROUP BY 1, 2"))
def _(s, d):
    return waves.split_report(split_rows(s, d)).select("split", "part", "rows", "postings", "positives", r("rate"))


# ---- metrics ------------------------------------------------------------------------------------------------------


def rank_sql(rows: str, keys: str, extra: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f""", ds AS (SELECT {k}score, count(*) AS n, sum(y)::BIGINT AS p FROM {rows} GROUP BY {k}score),
cu AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (a) AS an, sum(p) OVER (a) AS ap FROM ds WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS ({part})),
rk AS (SELECT {k}sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, sum(p::DOUBLE / ap * cp / cn) AS ap, sum((n - p) * (cp - p + 0.5 * p)) / (max(ap) * max(an - ap)) AS roc FROM cu GROUP BY {keys or 'ALL'}) """ + extra


for _name, _keys in (("overall", []), ("by_source", ["source"]), ("by_cohort", ["cohort"])):
    _k = ", ".join(_keys)

    @query(f"m1_ranking_{_name}", V.sql(rank_sql("kc", _k) + f"SELECT {_k + ', ' if _k else ''}n, positives, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(positives::DOUBLE / n, 6) AS base_rate FROM rk"))
    def _(s, d, keys=_keys):
        rows = annotated(s, d).where("label_observable")
        return metrics.ranking(metrics.distinct_scores(rows, *keys), *keys).select(*keys, "n", "positives", r("pr_auc"), r("roc_auc"), r("base_rate"))


@query("m3_brier", V.sql("SELECT source, round(avg(pow(score - y, 2)), 6) AS brier FROM known GROUP BY source"))
def _(s, d):
    return metrics.brier(known(s, d), "source").select("source", r("brier"))


BIN = "(" + " + ".join(f"(score >= {e!r})::INT" for e in metrics.EDGES) + ")::BIGINT"


@query("m4_reliability", V.sql(f", b AS (SELECT {BIN} AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(y), 6) AS observed FROM known GROUP BY 1) SELECT g.bin, coalesce(b.n, 0) AS n, predicted, observed FROM (SELECT range AS bin FROM range(10)) g LEFT JOIN b ON b.bin = g.bin"))
def _(s, d):
    return metrics.reliability(known(s, d)).select("bin", "n", r("predicted"), r("observed"))


@query("m10_calibration", V.sql(f", b AS (SELECT source, {BIN} AS bin, count(*) AS n, avg(score) AS p, avg(y) AS o FROM known GROUP BY 1, 2), e AS (SELECT source, sum(abs(p - o) * n) / sum(n) AS ece FROM b GROUP BY source) SELECT k.source, round(avg(score), 6) AS mean_predicted, round(avg(y), 6) AS observed, round(avg(score) - avg(y), 6) AS gap, round(max(ece), 6) AS ece FROM known k JOIN e ON e.source = k.source GROUP BY k.source"))
def _(s, d):
    return metrics.calibration_summary(known(s, d), "source").select("source", r("mean_predicted"), r("observed"), r("gap"), r("ece"))


@query("m6_confusion", V.sql(", c AS (SELECT source, coalesce(sum(y) FILTER (score >= 0.5), 0)::BIGINT AS tp, count(*) FILTER (score >= 0.5) AS f, sum(y)::BIGINT AS p, count(*) AS n FROM known GROUP BY source) SELECT source, tp, f - tp AS fp, p - tp AS fn, n - p - f + tp AS tn, round(tp::DOUBLE / f, 6) AS precision, round(tp::DOUBLE / p, 6) AS recall, round(coalesce(2 * (tp::DOUBLE / f) * (tp::DOUBLE / p) / (tp::DOUBLE / f + tp::DOUBLE / p), 0), 6) AS f1 FROM c"))
def _(s, d):
    return metrics.confusion_at(known(s, d), 0.5, "source").select("source", "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("f1"))


SWEEP = rank_sql("known", "source") + ", th AS (SELECT source, b.budget, max(score) AS threshold, arg_max(cn, score)::BIGINT AS cn, arg_max(cp, score)::BIGINT AS cp, max(an)::BIGINT AS an, max(ap)::BIGINT AS ap FROM cu CROSS JOIN (SELECT unnest([5, 10, 20, 50, 100]) AS budget) b WHERE cn >= least(an, budget) GROUP BY source, b.budget) "


@query("t9_threshold_sweep", V.sql(SWEEP + "SELECT source, budget::BIGINT AS budget, threshold, cp AS tp, cn - cp AS fp, ap - cp AS fn, an - ap - cn + cp AS tn, round(cp::DOUBLE / cn, 6) AS precision, round(cp::DOUBLE / ap, 6) AS recall FROM th"))
def _(s, d):
    return metrics.budget_thresholds(metrics.distinct_scores(known(s, d), "source"), "source").select("source", "budget", "threshold", "tp", "fp", "fn", "tn", r("precision"), r("recall"))


@query("m7_at_budget", V.sql(SWEEP + ", fl AS (SELECT k.*, row_number() OVER (PARTITION BY k.source ORDER BY score DESC, source_id, t) AS pl FROM known k JOIN th ON th.source = k.source AND budget = 20 WHERE score >= threshold), gd AS (SELECT source, sum(y / log2(pl + 1.0)) AS dcg, sum(y)::BIGINT AS h FROM fl GROUP BY source) SELECT th.source, threshold, cp AS tp, cn - cp AS fp, round((cp::DOUBLE / cn) / (ap::DOUBLE / an), 6) AS lift, round(CASE WHEN h > 0 THEN dcg / list_sum(list_transform(range(1, h + 1), lambda i: 1 / log2(i + 1.0))) END, 6) AS ndcg FROM th JOIN gd ON gd.source = th.source WHERE budget = 20"))
def _(s, d):
    return metrics.at_budget(known(s, d), "source").select("source", "threshold", "tp", "fp", r("lift"), r("ndcg"))


@query("m8_full_record", V.sql(SWEEP + ", b AS (SELECT source, avg(pow(score - y, 2)) AS brier FROM known GROUP BY source) SELECT rk.source, rk.n, positives, round(rk.ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(brier, 6) AS brier, threshold, th.cp AS tp, th.cn - th.cp AS fp, th.ap - th.cp AS fn, round((th.cp::DOUBLE / th.cn) / (th.ap::DOUBLE / th.an), 6) AS lift FROM rk JOIN b ON b.source = rk.source JOIN th ON th.source = rk.source WHERE budget = 20"))
def _(s, d):
    return metrics.evaluate(known(s, d), "source").select("source", "n", "positives", r("pr_auc"), r("roc_auc"), r("brier"), "threshold", "tp", "fp", "fn", r("lift"))


BOOT = """, cl AS (SELECT source, source_id, row_number() OVER (ORDER BY substr(md5(source || '|' || source_id), 1, 4), source || '|' || source_id) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT source, source_id FROM known)),
dr AS (SELECT b.range AS b, ('0x' || substr(md5('b|' || b.range || '|' || i), 1, 8))::BIGINT % m AS i FROM cl CROSS JOIN range(50) b), wt AS (SELECT b, i, count(*) AS w FROM dr GROUP BY b, i),
bt AS (SELECT wt.b, k.score, sum(w)::BIGINT AS n, sum(w * y)::BIGINT AS p FROM wt JOIN cl ON cl.i = wt.i JOIN known k ON k.source = cl.source AND k.source_id = cl.source_id GROUP BY wt.b, k.score),
bc AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY b) AS ap FROM bt WINDOW w AS (PARTITION BY b ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
bo AS (SELECT b, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, sum(p::DOUBLE / ap * cp / cn) AS pr_auc, sum((n - p) * score * score + p * (1 - score) * (1 - score)) / sum(n) AS brier FROM bc GROUP BY b) """


@query("m11_cluster_bootstrap", V.sql(BOOT + "SELECT b, n, positives, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier FROM bo WHERE positives > 0"))
def _(s, d):
    return metrics.bootstrap(known(s, d), 50).select("b", "n", "positives", r("pr_auc"), r("brier"))


@query("m12_intervals", V.sql(BOOT + "SELECT 'pr_auc' AS metric, round(quantile_cont(pr_auc, 0.025), 6) AS low, round(quantile_cont(pr_auc, 0.975), 6) AS high, count(*) AS resamples FROM bo WHERE positives > 0"))
def _(s, d):
    return metrics.intervals(metrics.bootstrap(known(s, d), 50), ["pr_auc"]).select("metric", r("low"), r("high"), "resamples")


BOOT_BY = """, cl AS (SELECT source, source_id, row_number() OVER (PARTITION BY source ORDER BY substr(md5(source || '|' || source_id), 1, 4), source || '|' || source_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM (SELECT DISTINCT source, source_id FROM known)),
dr AS (SELECT source, b.range AS b, ('0x' || substr(md5('b|' || source || '|' || b.range || '|' || i), 1, 8))::BIGINT % m AS i FROM cl CROSS JOIN range(500) b), wt AS (SELECT source, b, i, count(*) AS w FROM dr GROUP BY ALL),
bt AS (SELECT wt.source, wt.b, k.score, sum(w)::BIGINT AS n, sum(w * y)::BIGINT AS p FROM wt JOIN cl ON cl.i = wt.i AND cl.source = wt.source JOIN known k ON k.source = cl.source AND k.source_id = cl.source_id GROUP BY ALL),
bc AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY source, b) AS ap FROM bt WINDOW w AS (PARTITION BY source, b ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
bo AS (SELECT source, b, sum(p)::BIGINT AS positives, sum(p::DOUBLE / ap * cp / cn) AS pr_auc FROM bc GROUP BY ALL),
ci AS (SELECT source, quantile_cont(pr_auc, 0.025) AS low, quantile_cont(pr_auc, 0.975) AS high, count(*) AS resamples FROM bo WHERE positives > 0 GROUP BY source) """


@query("m14_evidence_by_source", V.sql(rank_sql("known", "source") + BOOT_BY + ", ps AS (SELECT source, count(DISTINCT source_id) AS postings FROM known GROUP BY source) SELECT rk.source, n, positives, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, postings, round(low, 6) AS low, round(high, 6) AS high, resamples, positives < 30 AS fragile FROM rk JOIN ps ON ps.source = rk.source LEFT JOIN ci ON ci.source = rk.source"))
def _(s, d):
    return metrics.evaluate_with_evidence(known(s, d), "source", 500).select("source", "n", "positives", r("pr_auc"), r("roc_auc"), "postings", r("low"), r("high"), "resamples", "fragile")


@query("a15_constant_reference", V.sql("SELECT count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS base_rate, round(avg(y), 6) AS pr_auc, 0.5::DOUBLE AS roc_auc, round(avg(y) * (1 - avg(y)), 6) AS brier FROM known"))
def _(s, d):
    return metrics.constant_reference(known(s, d)).select("n", "positives", r("base_rate"), r("pr_auc"), "roc_auc", r("brier"))


@query("a16_prediction_days", V.sql("SELECT count(DISTINCT t) AS days FROM known"))
def _(s, d):
    return known(s, d).agg(F.count_distinct(F.to_date("t")).alias("days"))


@query("a17_class_weight", V.sql("SELECT round(count(*) FILTER (y = 0)::DOUBLE / count(*) FILTER (y = 1), 6) AS scale_pos_weight FROM known"))
def _(s, d):
    return metrics.class_weight(known(s, d)).select(r("scale_pos_weight"))


@query("a22_class_scores", "WITH c AS (SELECT lang AS a, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p FROM documents), l AS (SELECT a AS l FROM c UNION SELECT p FROM c), f AS (SELECT l, coalesce(2.0 * (SELECT count(*) FROM c WHERE a = l AND p = l) / ((SELECT count(*) FROM c WHERE a = l) + (SELECT count(*) FROM c WHERE p = l)), 0) AS f1 FROM l) SELECT round((SELECT avg((a = p)::INT) FROM c), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("actual"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    return metrics.class_scores(docs).select(r("accuracy"), r("macro_f1"))


@query("a22_majority", "SELECT lang AS commonest, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1")
def _(s, d):
    return metrics.majority(s.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("actual"))).select("commonest", r("share"))


PER_FOLD = FOLDS + ", fv AS (SELECT fold, source, source_id, t, y, score, age_days FROM fo JOIN known ON t > te + 7 AND t <= vs), "


def fold_metric(score: str) -> str:
    return f"(SELECT fold, sum(CASE WHEN ap > 0 THEN p::DOUBLE / ap * cp / cn END) AS pr_auc FROM (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY fold) AS ap FROM (SELECT fold, {score} AS s, count(*) AS n, sum(y)::BIGINT AS p FROM fv GROUP BY ALL) WINDOW w AS (PARTITION BY fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY fold)"


def per_fold(s: SparkSession, d: str, score: Column) -> DataFrame:
    rows = known(s, d)
    met = waves.fold_rows(rows, waves.fold_table(rows, EMBARGO), EMBARGO).where("part = 'val'").withColumn("score", score)
    return metrics.ranking(metrics.distinct_scores(met, "fold"), "fold")


@query("a18_fold_summary", V.sql(PER_FOLD + f"a AS {fold_metric('score')} SELECT count(*) AS folds, count(pr_auc) AS scored, round(avg(pr_auc), 6) AS mean, round(stddev_samp(pr_auc), 6) AS sd FROM a"))
def _(s, d):
    return metrics.fold_summary(per_fold(s, d, F.col("score"))).select("folds", "scored", r("mean"), r("sd"))


@query("a19_paired_difference", V.sql(PER_FOLD + f"a AS {fold_metric('score')}, b AS {fold_metric('age_days')} SELECT count(*) AS folds, round(avg(a.pr_auc - b.pr_auc), 6) AS mean_diff, round(stddev_samp(a.pr_auc - b.pr_auc), 6) AS sd_diff, count(*) FILTER (a.pr_auc > b.pr_auc) AS wins FROM a JOIN b ON a.fold = b.fold WHERE a.pr_auc IS NOT NULL AND b.pr_auc IS NOT NULL"))
def _(s, d):
    return metrics.paired_difference(per_fold(s, d, F.col("score")), per_fold(s, d, F.col("age_days"))).select("folds", r("mean_diff"), r("sd_diff"), "wins")


AGED = ", aged AS (SELECT source, y, coalesce(age_days, 'inf'::DOUBLE) AS score FROM known), young AS (SELECT source, y, -coalesce(age_days, 'inf'::DOUBLE) AS score FROM known)"


@query("w13_age_rank", V.sql(AGED + rank_sql("aged", "source") + rank_sql("young", "source").replace(" ds ", " ds2 ").replace("FROM ds ", "FROM ds2 ").replace(" cu ", " cu2 ").replace("cu AS", "cu2 AS").replace("FROM cu ", "FROM cu2 ").replace("rk AS", "rk2 AS") + "SELECT a.source, a.n, a.positives, round(a.positives::DOUBLE / a.n, 6) AS base_rate, round(a.ap, 6) AS oldest_first, round(b.ap, 6) AS youngest_first FROM rk a JOIN rk2 b ON a.source = b.source"))
def _(s, d):
    return experiments.age_rank(known(s, d), "source").select("source", "n", "positives", r("base_rate"), r("oldest_first"), r("youngest_first"))


ROLLED = CUTS + ", lt AS (SELECT ve, max(te) AS te FROM vcut WHERE reason = 'ok' GROUP BY ve), old AS (SELECT ve, y, coalesce(age_days, 'inf'::DOUBLE) AS score FROM lt JOIN known k ON k.t > te + 7 AND k.t <= ve), young AS (SELECT ve, y, -score AS score FROM old)"


def second(ranked: str) -> str:
    """The CTEs of rank_sql under other names."""
    for name in ("ds", "cu", "rk"):
        ranked = re.sub(rf"\b{name} AS|(?<=FROM ){name}\b", lambda m: m[0].replace(name, f"{name}2"), ranked)
    return ranked


@query("l14_rolling_age_rank", V.sql(ROLLED + rank_sql("old", "ve") + second(rank_sql("young", "ve")) + "SELECT a.ve::VARCHAR AS val_end, a.n, a.positives, round(a.ap, 6) AS oldest_first, round(b.ap, 6) AS youngest_first FROM rk a JOIN rk2 b ON a.ve = b.ve"))
def _(s, d):
    return experiments.rolling_age_rank(V.labelled_panel(s, d), EMBARGO).select(day("val_end"), "n", "positives", r("oldest_first"), r("youngest_first"))


@query("l15_cohort_verdict", V.sql(", g AS (SELECT cohort, sum(y)::DOUBLE AS p, avg(y) AS r FROM kc GROUP BY cohort), z AS (SELECT max(r) FILTER (cohort = 'entrant') AS e, max(r) FILTER (cohort = 'incumbent') AS i, max(p) FILTER (cohort = 'entrant') / sum(p) AS sh FROM g) SELECT round(e, 6) AS entrant_rate, round(i, 6) AS incumbent_rate, round(sh, 6) AS entrant_share, round(e / i, 6) AS ratio, CASE WHEN coalesce(e / i >= 10 OR (sh >= 0.9 AND i <= 0.1), false) THEN 'cohorts differ' ELSE 'cohorts alike' END AS status FROM z"))
def _(s, d):
    return experiments.cohort_verdict(audit.group_rates(annotated(s, d).where("label_observable"), "cohort")).select(r("entrant_rate"), r("incumbent_rate"), r("entrant_share"), r("ratio"), "status")


@query("x30_unseen_fold_rows", V.sql(FOLDS + "SELECT fold, count(*) AS n, sum(y)::BIGINT AS positives FROM fo JOIN known k ON k.t > te + 7 AND k.t <= vs WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.source = k.source AND x.source_id = k.source_id AND x.t <= te) GROUP BY fold"))
def _(s, d):
    rows = known(s, d)
    return experiments.unseen_fold_rows(rows, waves.fold_table(rows, EMBARGO), EMBARGO).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query("t3_rank_boards", V.sql("SELECT source, source_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, source_id) AS place, row_number() OVER (PARTITION BY source ORDER BY score DESC, source_id) <= 10 AS watch FROM feat WHERE t = (SELECT max(t) FROM feat)"))
def _(s, d):
    rows = V.labelled_panel(s, d)
    last = rows.agg(F.max("t").alias("_t"))
    board = rows.join(F.broadcast(last), F.col("t") == F.col("_t"), "left_semi")
    return metrics.rank_board(board, "source", budget=10, tie="source_id").select("source", "source_id", "place", "watch")


@query("a27_user_reading", V.sql(rank_sql("known", "") + ", th AS (SELECT max(score) AS s, arg_max(cn, score) AS cn, arg_max(cp, score) AS cp, max(an) AS an, max(ap) AS ap FROM cu WHERE cn >= 20) SELECT 20::BIGINT AS budget, cn::DOUBLE AS alerts_per_day, cp::DOUBLE AS caught_per_day, (cn - cp)::DOUBLE AS false_alarms_per_day, round(cp::DOUBLE / ap, 6) AS share_caught, round(cn * (ap::DOUBLE / an), 6) AS unaided_per_day FROM th"))
def _(s, d):
    at = metrics.budget_thresholds(metrics.distinct_scores(known(s, d)), budgets=(20,))
    return metrics.user_reading(at, 1).select("budget", "alerts_per_day", "caught_per_day", "false_alarms_per_day", r("share_caught"), r("unaided_per_day"))


# ---- baselines, models, scoring, streams --------------------------------------------------------------------------


@query("x5_board_hazard", V.sql(SPLIT + ", h AS (SELECT source, avg(y) AS hz FROM ss WHERE split = 'train' GROUP BY source) SELECT v.source, v.source_id, v.run_index, round(coalesce(hz, (SELECT avg(y) FROM ss WHERE split = 'train')), 6) AS score FROM ss v LEFT JOIN h ON h.source = v.source WHERE split = 'val'"))
def _(s, d):
    rows = split_rows(s, d)
    return models.GroupRates(F.col("source")).fit(rows.where("split = 'train'")).predict(rows.where("split = 'val'")).select("source", "source_id", "run_index", r("score"))


@query("x6_rule", V.sql(SPLIT + ", h AS (SELECT age_days > 30 AS k, avg(y) AS hz FROM ss WHERE split = 'train' GROUP BY 1) SELECT v.source_id, v.run_index, round(coalesce(hz, (SELECT avg(y) FROM ss WHERE split = 'train')), 6) AS score FROM ss v LEFT JOIN h ON h.k = (v.age_days > 30) WHERE split = 'val'"))
def _(s, d):
    rows = split_rows(s, d)
    return models.GroupRates(derive.older_than_thirty_days(F.col("age_days"))).fit(rows.where("split = 'train'")).predict(rows.where("split = 'val'")).select("source_id", "run_index", r("score"))


@query("a25_company_volume", V.sql(SPLIT + ", f AS (SELECT source, source_id, min(company) AS company FROM ss WHERE split = 'train' GROUP BY ALL) SELECT company, count(*) AS volume FROM f GROUP BY company"))
def _(s, d):
    return models.company_volume(split_rows(s, d).where("split = 'train'"))


@query("a26_lifetime_probe", V.sql("SELECT source_id, run_index, count(*) OVER w AS n_observations_total, (max(t) OVER w - min(t) OVER w)::DOUBLE AS days_on_board_total FROM feat WINDOW w AS (PARTITION BY source, source_id)"))
def _(s, d):
    return models.with_lifetime_probe(V.labelled_panel(s, d)).select("source_id", "run_index", "n_observations_total", "days_on_board_total")


@query("x1_learned_statistics", V.sql(SPLIT + "SELECT 'age_days' AS feature, round(median(age_days), 6) AS fill, round(avg(age_days), 6) AS mean, round(stddev_pop(age_days), 6) AS sd FROM ss WHERE split = 'train'"))
def _(s, d):
    return models.numeric_statistics(split_rows(s, d).where("split = 'train'"), ["age_days"]).select("feature", r("fill"), r("mean"), r("sd"))


@query("x7_single_feature_ceiling", V.sql(SPLIT + ", e AS (SELECT list_distinct(quantile_cont(age_days, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ss WHERE split = 'train'), bn AS (SELECT ss.*, CASE WHEN age_days IS NULL THEN -1 ELSE len(list_filter(e, lambda x: age_days > x)) END AS k FROM ss CROSS JOIN e), h AS (SELECT k, avg(y) AS hz FROM bn WHERE split = 'train' GROUP BY k) SELECT v.source, v.source_id, v.run_index, round(coalesce(hz, (SELECT avg(y) FROM bn WHERE split = 'train')), 6) AS score FROM bn v LEFT JOIN h ON h.k = v.k WHERE split = 'val'"))
def _(s, d):
    rows = split_rows(s, d)
    return models.QuantileRates("age_days").fit(rows.where("split = 'train'")).predict(rows.where("split = 'val'")).select("source", "source_id", "run_index", r("score"))


@query("p8_contract", V.sql("SELECT source_id, run_index, CASE WHEN title IS NULL OR title = '' THEN 'missing_title' ELSE 'ok' END AS error_code FROM feat"))
def _(s, d):
    return scoring.validate(V.labelled_panel(s, d).select("source_id", "run_index", "title", "location"), extra=("source_id", "run_index")).select("source_id", "run_index", "error_code")


@query("t4_board_snapshot", V.sql(", l AS (SELECT source, max(t) AS t FROM feat GROUP BY source) SELECT f.source, source_id, count(*) OVER (PARTITION BY f.source) AS board_size_at_t, count(*) OVER (PARTITION BY f.source, title) AS n_same_title_on_board, CASE WHEN requisition_id IS NOT NULL THEN count(*) OVER (PARTITION BY f.source, requisition_id) END AS n_same_req_on_board, count(*) OVER (PARTITION BY f.source) - length(f.source) AS board_growth FROM feat f JOIN l ON l.source = f.source AND l.t = f.t"))
def _(s, d):
    rows = V.labelled_panel(s, d)
    last = rows.groupBy("source").agg(F.max("t").alias("t"))
    before = last.select("source", F.length("source").cast("long").alias("previous_size"))
    return scoring.board_context(rows.join(last, ["source", "t"]), before).select("source", "source_id", "board_size_at_t", "n_same_title_on_board", "n_same_req_on_board", "board_growth")


@query("r1_stream_ingest", V.sql("SELECT source, day::VARCHAR AS day, count(*) AS postings FROM obs0 GROUP BY ALL"))
def _(s, d):
    return streams.ingest_counts(s, d)
