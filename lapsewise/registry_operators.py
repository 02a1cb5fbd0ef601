"""Further registered queries: readers and writers on real files, the whole panel, splits, folds, models and their records.

Queries on fitted models are in registry_models.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions import clean, derive
from lapsewise.operators import audit, experiments, features, metrics, models, panel, scoring, waves
from lapsewise.plans import crawl_view as V
from lapsewise.registry import BOOT, CUTS, EMBARGO, FOLDS, SPLIT, crawl_tables, known, query, r, rank_sql, split_rows
from lapsewise.registry import day as as_day
from lapsewise.sources import crawls
from lapsewise.sources.working import Working
from lapsewise.streaming import streams


def scored_by(score: str) -> Pipeline:
    """A pipeline whose only stage gives this score as the probability."""

    def add(df: DataFrame) -> DataFrame:
        p = F.expr(score).cast("double")
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    return Pipeline(stages=[models.Derive(add)])


def folder(s: SparkSession, name: str) -> str:
    return f"{streams.checkpoint(s)}-{name}"


def stored(s: SparkSession, df: DataFrame) -> DataFrame:
    """df written and read again, for what runs several jobs on it. The caller's result may read it later, so it stays."""
    return Working(s, "stored").table(df)


# ---- sources on files ---------------------------------------------------------------------------------------------


@query("s1_crawl_tables", V.sql("SELECT id, source, day::VARCHAR AS started, status, pages_fetched::BIGINT AS pages_fetched, rules_version::BIGINT AS rules_version FROM log"))
def _(s, d):
    at = folder(s, "tables")
    crawls.write_tables(crawl_tables(s, d), at)
    runs = crawls.load_tables(s, at)["runs"]
    return runs.select("id", "source", F.to_date("started_at").cast("string").alias("started"), "status", "pages_fetched", "rules_version")


@query("s3_coerced_csv", V.sql("SELECT source, source_id, day::VARCHAR AS day, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS remote, CASE WHEN user_id % 3 <> 0 THEN user_id * 1000 END AS salary_min FROM obs0"))
def _(s, d):
    at, u = folder(s, "logs"), F.col("user_id")
    raw = V.seen(s, d).select("observed_at", "source", "source_id", F.when(u % 4 == 0, "1.0").when(u % 4 == 1, "False").when(u % 4 == 2, "maybe").alias("remote"), F.when(u % 3 == 0, "n/a").otherwise(F.concat(u.cast("string"), F.lit("000.0"))).alias("salary_min"))
    raw.write.option("header", True).csv(at)
    rows = crawls.load_snapshot_rows(s, at)
    return rows.select("source", "source_id", F.to_date("observed_at").cast("string").alias("day"), "remote", "salary_min")


def archived(s: SparkSession, d: str) -> DataFrame:
    """The runs of a board as payload files, board/stamp.html, one for each day, read back."""
    u, raw, at = F.col("user_id"), folder(s, "raw"), folder(s, "archive")
    named = lambda *names: F.array(*[F.struct(F.lit(i).cast("long").alias("id"), n.alias("name")) for i, n in enumerate(names)])
    job = F.struct(
        u.alias("id"), F.concat(F.lit("https://jobs.example/"), F.substring("source", 7, 9), F.lit("/jobs/"), "source_id").alias("absolute_url"), F.concat(F.lit("company "), (u % 3).cast("string")).alias("company_name"),
        F.lit("2024-01-01T00:00:00Z").alias("first_published"), F.repeat(F.lit("x"), (u % 50).cast("int")).alias("content"), F.when(u % 3 > 0, named(F.lit(" Sales "), F.lit("Data"), F.lit(" "))).alias("departments"),
        F.array(F.struct(F.lit("Berlin").alias("name"), F.when(u % 2 == 0, " DE ").alias("location"))).alias("offices"),
        F.array(F.struct(F.lit("b").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("a").alias("name"), (u % 2).cast("string").alias("value")), F.struct(F.lit("b").alias("name"), F.lit("2").alias("value"))).alias("metadata"),
    )
    files = V.seen(s, d).groupBy("source", "observed_at").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value"))
    files = files.select(F.concat(F.lit("b"), F.substring("source", 7, 9)).alias("board"), F.date_format("observed_at", "yyyy-MM-dd'T'HH-mm-ss'Z'").alias("stamp"), "value")
    files.repartition("board", "stamp").write.partitionBy("board", "stamp").text(raw)
    path = s._jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(s._jsc.hadoopConfiguration())
    for board in fs.listStatus(path(raw)):  # names only: one file for each crawl
        if "=" in (name := board.getPath().getName()):
            fs.mkdirs(path(f"{at}/{name.partition('=')[2]}"))
            for stamp in fs.listStatus(board.getPath()):
                for part in fs.listStatus(stamp.getPath()):
                    if part.getPath().getName().startswith("part-"):
                        fs.rename(part.getPath(), path(f"{at}/{name.partition('=')[2]}/{stamp.getPath().getName().partition('=')[2]}.html"))
    return crawls.load_archive(s, at, include_content=True)


@query("s7_payloads", V.sql("SELECT day::VARCHAR AS fetched, 'b' || substr(source, 7) AS board_dir, substr(source, 7) AS board_token, source_id, 'company ' || (user_id % 3) AS company_name, CASE WHEN user_id % 3 > 0 THEN 'Data|Sales' END AS departments, CASE WHEN user_id % 3 > 0 THEN 3 ELSE 0 END AS n_departments, 'Berlin' AS offices, CASE WHEN user_id % 2 = 0 THEN 'DE' END AS office_locations, '{\"a\":\"' || (user_id % 2) || '\",\"b\":\"2\"}' AS metadata_json, 3 AS n_metadata, (user_id % 50)::INT AS content_chars FROM obs0"))
def _(s, d):
    return archived(s, d).select(F.to_date("fetched_at").cast("string").alias("fetched"), "board_dir", "board_token", "source_id", "company_name", "departments", "n_departments", "offices", "office_locations", "metadata_json", "n_metadata", "content_chars")


@query("s11_archive_written", V.sql("SELECT 'b' || substr(source, 7) AS board_dir, count(*) AS fields, count(*) AS bodies, sum(user_id % 50)::BIGINT AS body_chars, count(*) FILTER (user_id % 3 > 0) AS with_departments FROM obs0 GROUP BY source"))
def _(s, d):
    """Both tables read again and brought together by their key."""
    at = folder(s, "written")
    crawls.write_archive(archived(s, d), at)
    fields, bodies = (s.read.parquet(f"{at}/{name}") for name in ("fields", "bodies"))
    met = fields.join(bodies, ["fetched_at", "source_id"], "left")
    return met.groupBy("board_dir").agg(F.count("*").alias("fields"), F.count("content").alias("bodies"), F.sum(F.length("content")).cast("long").alias("body_chars"), F.count("departments").alias("with_departments"))


@query("s17_board_upload", "SELECT coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'c' || p_partkey END), ''), 'row-' || row_number() OVER (ORDER BY p_partkey)) AS client_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS location FROM part")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("  ").alias("location"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("client_id"), F.lit(1).alias("unknown"))
    return crawls.parse_board(part, ["client_id", "title", "location"], "p_partkey")


@query("j4_attach_source", V.sql("SELECT e.event_id, (SELECT min(source) FROM obs0 o WHERE o.source_id = (e.user_id + 3)::VARCHAR) AS source FROM events e"))
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("user_id") + 3).cast("string").alias("source_id"))
    return crawls.attach_source(e, V.seen(s, d)).select("event_id", "source")


@query("j5_first_observation", V.sql("SELECT source, source_id, run_index, cohort, first_observation FROM cohorts"))
def _(s, d):
    return audit.annotate(V.labelled_panel(s, d)).select("source", "source_id", "run_index", "cohort", "first_observation")


# ---- panel and cleaning -------------------------------------------------------------------------------------------


@query("l2_assemble", V.sql("""
, sz AS (SELECT source, run_index, count(*) AS n, count(*) - lag(count(*)) OVER (PARTITION BY source ORDER BY run_index) AS g FROM feat GROUP BY source, run_index)
SELECT f.source, f.source_id, f.run_index, y::BIGINT AS y, sz.n AS board_size_at_t, g AS board_growth, count(*) OVER (PARTITION BY f.source, f.run_index, title) AS n_same_title_on_board, age_days, (isodow(t) - 1)::BIGINT AS t_dow, 7::BIGINT AS horizon_days, 'calendar' AS horizon_basis
FROM feat f JOIN sz ON sz.source = f.source AND sz.run_index = f.run_index"""))
def _(s, d):
    rows = V.seen(s, d)
    attributed = V.with_attributes(rows.withColumn("t", F.col("observed_at"))).drop("t", "age_days", "score")
    out = panel.assemble(V.run_log(rows), attributed, None, 7)
    panel.single_horizon(out)
    return out.select("source", "source_id", "run_index", F.col("y").cast("long").alias("y"), "board_size_at_t", "board_growth", "n_same_title_on_board", "age_days", F.col("t_dow").cast("long").alias("t_dow"), F.col("horizon_days").cast("long").alias("horizon_days"), "horizon_basis")


@query("p2_labelled", V.sql("SELECT source, source_id, run_index, y::INT AS y FROM known"))
def _(s, d):
    return panel.labelled(V.labelled_panel(s, d)).select("source", "source_id", "run_index", "y")


@query("p11_target", V.sql(SPLIT + "SELECT split, count(*) AS n, sum(y)::DOUBLE AS positives FROM ss GROUP BY split"))
def _(s, d):
    return models.target(split_rows(s, d)).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("p12_horizon_banner", V.sql("SELECT count(*) AS n, 'removed within 7 days (calendar)' AS banner FROM feat"))
def _(s, d):
    rows = V.labelled_panel(s, d).withColumn("horizon_days", F.lit(7)).withColumn("horizon_basis", F.lit("calendar"))
    return rows.agg(F.count("*").alias("n")).withColumn("banner", F.lit(panel.single_horizon(rows)))


@query("p3_selected_features", V.sql("""
SELECT source_id, run_index, date_diff('day', first_published, DATE '2024-02-01')::DOUBLE AS age_days, (isodow(first_published) - 1)::VARCHAR AS posted_dow,
 CASE WHEN title LIKE '%Director%' THEN 'executive' WHEN title LIKE '%Staff%' THEN 'lead' WHEN title LIKE '%Senior%' THEN 'senior' WHEN title LIKE '%Junior%' OR title LIKE '%Intern' THEN 'junior' ELSE 'unspecified' END AS title_seniority,
 length(title)::DOUBLE AS title_chars, 0.0::DOUBLE AS salary_stated, 'unstated' AS salary_band, location FROM feat"""))
def _(s, d):
    rows = V.labelled_panel(s, d).select("source_id", "run_index", "title", "location", "first_published")
    ready = features.assert_known(scoring.model_rows(rows, "2024-02-01").drop("salary_is_range"))
    picked = features.allowed(only=("age_days", "posted_dow", "title_seniority", "title_chars", "salary_stated", "salary_band", "location"))
    keyed = (("source_id", "categorical", ""), ("run_index", "numeric", ""))
    return features.selected(ready, (*keyed, *picked)).withColumn("run_index", F.col("run_index").cast("long"))


@query("p7_context_withheld", V.sql("SELECT source_id, run_index, NULL::DOUBLE AS board_size_at_t, NULL::DOUBLE AS board_growth, false AS supplied FROM feat"))
def _(s, d):
    rows = features.without_board_context(panel.with_board_context(V.labelled_panel(s, d)))
    return scoring.context_supplied(rows).select("source_id", "run_index", "board_size_at_t", "board_growth", F.col("board_context_supplied").alias("supplied"))


@query("p8_contract_all", """
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'missing_title' WHEN event_id % 5 = 1 THEN 'bad_n_offices' WHEN event_id % 5 = 2 THEN 'bad_content_chars' WHEN event_id % 11 = 0 THEN 'bad_first_published' ELSE 'ok' END AS error_code,
 NOT (user_id % 7 = 0 OR event_id % 5 IN (1, 2) OR event_id % 11 = 0) AS valid FROM events""")
def _(s, d):
    e, k = s.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    rows = e.select("event_id", F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("title"), F.when(k % 5 == 1, "many").otherwise("3").alias("n_offices"), F.when(k % 5 == 2, "NaN").otherwise("10").alias("content_chars"), F.when(k % 11 == 0, "soon").otherwise("2024-01-01").alias("first_published"))
    return scoring.validate(rows, extra=("event_id",)).select("event_id", "error_code", "valid")


@query("f1_clean_jobs", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'fi 1/2'  WHEN 2 THEN NULL ELSE p_name END AS title_clean, CASE p_partkey % 3 WHEN 0 THEN 'senior' END AS seniority_clean,
 CASE p_partkey % 3 WHEN 0 THEN 5000.0 WHEN 1 THEN 40.0 END::DOUBLE AS salary_min_clean, CASE p_partkey % 3 WHEN 0 THEN 60000.0 WHEN 1 THEN 83200.0 END::DOUBLE AS salary_min_annual FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, "\uff33\uff45\uff4e\uff49\uff4f\uff52\u3000\u00a0 Engineer ").when(k % 4 == 1, F.concat(F.lit("\ufb01 1"), F.lit("/2"))).when(k % 4 == 2, " \t ").otherwise(F.col("p_name"))
    jobs = s.read.parquet(f"{d}/part.parquet").select("p_partkey", title.alias("title"), F.lit(None).cast("string").alias("company"), F.lit("x").alias("location"), F.when(k % 3 == 0, " SENIOR ").otherwise("chief").alias("seniority"), F.when(k % 3 == 0, "\uff04" + "5,000 per month monthly").when(k % 3 == 1, "40.00 EUR hourly").alias("salary_raw"))
    return clean.clean_jobs(jobs).select("p_partkey", "title_clean", "seniority_clean", "salary_min_clean", "salary_min_annual")


@query("a9_removal_pivot", V.sql("SELECT source, count(*) FILTER (t = DATE '2024-01-05') AS early, count(*) FILTER (t = DATE '2024-01-12') AS late FROM known WHERE y = 1 GROUP BY source"))
def _(s, d):
    out = audit.removal_pivot(known(s, d), ["2024-01-05", "2024-01-12"])
    return out.select("source", F.col("2024-01-05").alias("early"), F.col("2024-01-12").alias("late"))


def arm_sql(y: int, name: str) -> str:
    return f"SELECT '{name}' AS arm, source, source_id FROM (SELECT k{y}.source, k{y}.source_id, dr FROM k{y} JOIN q{y} ON q{y}.source = k{y}.source WHERE rk <= quota ORDER BY dr LIMIT 20)"


ARMS = "".join(f", one{y} AS (SELECT source, source_id, md5('s|' || source || '|' || source_id) AS dr FROM known WHERE y = {y} GROUP BY source, source_id), q{y} AS (SELECT source, greatest(1, round_even(20.0 * count(*) / (SELECT count(*) FROM one{y}), 0)) AS quota FROM one{y} GROUP BY source), k{y} AS (SELECT o.*, row_number() OVER (PARTITION BY source ORDER BY dr) AS rk FROM one{y} o)" for y in (1, 0))


@query("u3_sample_arms", V.sql(ARMS + f" {arm_sql(1, 'removed')} UNION ALL {arm_sql(0, 'present')}"))
def _(s, d):
    return audit.sample_arms(known(s, d), 20).select("arm", "source", "source_id")


# ---- splits, depth, readiness -------------------------------------------------------------------------------------

GAP = ", gp AS (SELECT max(g) AS g FROM (SELECT t - lag(t) OVER (PARTITION BY source ORDER BY t) AS g FROM (SELECT DISTINCT source, t FROM panel)))"


@query("l5_temporal_split", V.sql(GAP + """, sp AS (SELECT *, CASE WHEN t > DATE '2024-01-12' + (3 + g)::INT THEN 'test' WHEN t > DATE '2024-01-04' + (3 + g)::INT AND t <= DATE '2024-01-12' THEN 'val' WHEN t <= DATE '2024-01-04' THEN 'train' ELSE 'embargo' END AS split FROM known CROSS JOIN gp)
SELECT split, count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (split <> 'train' AND EXISTS (SELECT 1 FROM sp x WHERE x.split = 'train' AND x.source = sp.source AND x.source_id = sp.source_id)) AS seen_in_train FROM sp WHERE split <> 'embargo' GROUP BY split""", 3))
def _(s, d):
    split = waves.temporal_split(V.labelled_panel(s, d, 3), dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 12), 3)
    return split.frame.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.count_if("seen_in_train").alias("seen_in_train"))


DEPTH = GAP + """, wv AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS s FROM (SELECT DISTINCT t FROM feat)),
dp AS (SELECT (SELECT count(DISTINCT t) FROM known) AS waves, (SELECT median(s) FROM wv) AS s, (SELECT g FROM gp) AS g),
de AS (SELECT waves, s, floor((7 + g) / s)::BIGINT + 1 AS burnt FROM dp),
df AS (SELECT waves, s * 86400.0 AS spacing_seconds, burnt, 2 + 2 * burnt AS needed, 4 + 3 * burnt AS needed_for_folds FROM de)"""


@query("l9_depth", V.sql(DEPTH + " SELECT waves, spacing_seconds::DOUBLE AS spacing_seconds, burnt, needed, needed_for_folds, greatest(0, needed - waves) AS short, greatest(0, needed_for_folds - waves) AS short_for_folds FROM df"))
def _(s, d):
    found = waves.depth(stored(s, V.labelled_panel(s, d)), 7)
    return s.createDataFrame([found], "waves long, spacing_seconds double, burnt long, needed long, needed_for_folds long, short long, short_for_folds long")


@query("l8_rolling_origin_folds", V.sql(DEPTH + CUTS + " SELECT te::VARCHAR AS train_end, ve::VARCHAR AS val_end, greatest(0, (SELECT count(*) FROM att WHERE t <= te) - burnt) AS folds FROM vcut CROSS JOIN df WHERE reason = 'ok'"))
def _(s, d):
    rows = stored(s, V.labelled_panel(s, d))
    burnt = waves.depth(rows, 7)["burnt"]
    cuts = waves.feasible_cuts(rows, EMBARGO).where("valid").select("train_end", "val_end")
    at = waves.crawl_waves(rows.where("label_observable")).select("wave_t").distinct()
    n = cuts.join(at, F.col("wave_t") <= F.col("train_end")).groupBy("train_end", "val_end").agg(F.count("*").alias("n"))
    return n.select(as_day("train_end"), as_day("val_end"), F.greatest(F.lit(0), F.col("n") - burnt).alias("folds"))


@query("l10_accrual", V.sql(DEPTH + ", nw AS (SELECT max(t) AS newest FROM feat) SELECT newest::VARCHAR AS newest, 5 * 86400.0 > 2 * spacing_seconds AS stalled, floor(5 * 86400.0 / spacing_seconds)::BIGINT AS missed, CASE WHEN 5 * 86400.0 <= 2 * spacing_seconds OR short_ = 0 THEN NULL ELSE 'never while stalled' END AS clear FROM (SELECT *, greatest(0, needed - waves) AS short_ FROM df) CROSS JOIN nw"))
def _(s, d):
    rows = stored(s, V.labelled_panel(s, d))
    found, newest = waves.depth(rows, 7), rows.agg(F.max("t")).first()[0]
    status = waves.accrual_status(newest, found["spacing_seconds"], newest + dt.timedelta(days=5))
    clear = waves.projected_clear(newest, int(found["short"]), found["spacing_seconds"], bool(status["stalled"]))
    text = "never while stalled" if clear is None and found["short"] else None if clear is None else str(clear)
    return s.createDataFrame([(str(newest.date()), status["stalled"], status["missed"], text)], "newest string, stalled boolean, missed long, clear string")


def wider(sql: str) -> str:
    """The same SQL with the embargo that readiness takes: seven days and the widest gap."""
    return sql.replace("+ 7", "+ (7 + (SELECT g FROM gp))::INT")


@query("l12_readiness", V.sql(DEPTH + wider(CUTS) + wider(FOLDS) + """
SELECT waves, CASE WHEN needed > waves THEN 'too shallow' WHEN (SELECT count(*) FROM vcut WHERE reason = 'ok') = 0 THEN 'no legal cut' WHEN (SELECT max(f) FROM (SELECT (SELECT count(*) FROM fo WHERE fo.vs <= vcut.te) AS f FROM vcut WHERE reason = 'ok')) >= 3 THEN 'ready' ELSE 'no folds' END AS status FROM df"""))
def _(s, d):
    rows = stored(s, V.labelled_panel(s, d))
    now = rows.agg(F.max("t")).first()[0] + dt.timedelta(hours=12)
    return s.createDataFrame([(waves.depth(rows, 7)["waves"], waves.readiness(rows, 7, now))], "waves long, status string")


# ---- models around fixed scores -----------------------------------------------------------------------------------

@query("x2_prepared", V.sql(SPLIT + """, tr AS (SELECT * FROM ss WHERE split = 'train'), st AS (SELECT median(age_days) AS m, avg(age_days) AS a, stddev_pop(age_days) AS sd FROM tr),
lv AS (SELECT title FROM tr GROUP BY title HAVING count(*) >= 5), li AS (SELECT title, row_number() OVER (ORDER BY title) AS k FROM lv)
SELECT v.source_id, v.run_index, round((coalesce(age_days, m) - a) / sd, 6) AS age, coalesce(li.k, 0)::BIGINT AS level FROM ss v CROSS JOIN st LEFT JOIN li ON li.title = v.title WHERE split = 'val'"""))
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    rows = stored(s, split_rows(s, d))
    out = models.Prepare(["age_days"], ["title"]).fit(rows.where("split = 'train'")).transform(rows.where("split = 'val'")).withColumn("f", vector_to_array("features"))
    level = F.array_position(F.slice("f", 2, F.greatest(F.lit(1), F.size("f") - 1)), F.lit(1.0))
    return out.select("source_id", "run_index", F.round(F.get("f", F.lit(0)), 6).alias("age"), level.cast("long").alias("level"))


@query("x28_complexity_reading", V.sql(rank_sql("known", "source") + ", t AS (SELECT source AS rung, round(ap, 9) AS a FROM rk), f AS (SELECT max(a) AS b FROM t WHERE rung NOT IN ('board:0', 'board:1')), h AS (SELECT max(a) AS b FROM t WHERE rung IN ('board:0', 'board:1')), s AS (SELECT min(rung) AS r FROM t, f WHERE rung NOT IN ('board:0', 'board:1') AND a >= f.b - 0.01) SELECT (SELECT rung FROM t, f WHERE a = f.b AND rung NOT IN ('board:0', 'board:1')) AS best_fitted, round(f.b - h.b, 6) AS margin, s.r AS simplest, CASE WHEN f.b - h.b <= 0.01 THEN 'heuristics suffice' WHEN s.r = (SELECT rung FROM t, f WHERE a = f.b AND rung NOT IN ('board:0', 'board:1')) THEN 'complexity pays' ELSE 'simpler model suffices' END AS status FROM f, h, s"))
def _(s, d):
    table = metrics.ranking(metrics.distinct_scores(known(s, d), "source"), "source").select(F.col("source").alias("rung"), F.round("pr_auc", 9).alias("pr_auc"))
    out = experiments.complexity_reading(table, ["board:0", "board:1"], {f"board:{i}": i for i in range(5)}, 0.01)
    return out.select("best_fitted", r("margin"), "simplest", "status")


@query("t10_ranked_upload", "SELECT p_brand AS source, p_partkey::VARCHAR AS client_id, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey::VARCHAR) AS place, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey::VARCHAR) <= 5 AS watch FROM part WHERE trim(coalesce(p_name, '')) <> ''")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("client_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"))
    model = scored_by("title_chars / 1000").fit(part)
    return scoring.rank_upload(part, model, "2024-02-01", budget=5).select("source", "client_id", "place", "watch")


# ---- evidence -----------------------------------------------------------------------------------------------------

EIGHT = BOOT.replace("range(50)", "range(200)") + """, bn AS (SELECT b, BIN AS bin, sum(n) AS w, sum(n * score) AS sp, sum(p) AS o FROM bt GROUP BY 1, 2), ec AS (SELECT b, sum(abs(sp - o)) / sum(w) AS ece FROM bn GROUP BY b),
cf AS (SELECT b, sum(p) FILTER (score >= 0.5)::DOUBLE AS h, sum(n) FILTER (score >= 0.5)::DOUBLE AS f, sum(p)::DOUBLE AS a, sum(n)::DOUBLE AS m, avg(score) AS mean_score FROM bt GROUP BY b) """
EIGHT = EIGHT.replace("BIN AS bin", "(" + " + ".join(f"(score >= {e!r})::INT" for e in metrics.EDGES) + ") AS bin")


@query("m13_eight_statistics", V.sql(EIGHT + "SELECT bo.b, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, round(ece, 6) AS ece, round(h / f, 6) AS precision, round(h / a, 6) AS recall, round(coalesce(2 * (h / f) * (h / a) / (h / f + h / a), 0), 6) AS f1, round((h / f) / (a / m), 6) AS lift, round(mean_score, 6) AS mean_score FROM bo JOIN ec ON ec.b = bo.b JOIN cf ON cf.b = bo.b WHERE positives > 0"))
def _(s, d):
    mean = lambda table, by: table.groupBy(*by).agg(F.avg("score").alias("mean_score"))
    out = metrics.bootstrap(known(s, d), 200, threshold=0.5, statistic=mean)
    return out.select("b", *[r(c) for c in ("pr_auc", "brier", "ece", "precision", "recall", "f1", "lift", "mean_score")])


@query("m15_fragility", V.sql("SELECT source, run_index, sum(y)::BIGINT AS positives, CASE WHEN sum(y) < 30 THEN 'rests on ' || sum(y)::BIGINT || ' positives' END AS note FROM known GROUP BY source, run_index"))
def _(s, d):
    return metrics.fragility_note(known(s, d).groupBy("source", "run_index").agg(F.sum("y").cast("long").alias("positives")))


@query("m16_score_resolution", V.sql("SELECT source, count(DISTINCT score) AS distinct_scores FROM known GROUP BY source"))
def _(s, d):
    return metrics.score_resolution(known(s, d), "source")


@query("x27_company_volume", V.sql(SPLIT + ", f AS (SELECT source, source_id, min(company) AS company FROM ss WHERE split = 'train' GROUP BY ALL), v AS (SELECT company, count(*) AS n FROM f GROUP BY company) SELECT s.source_id, s.run_index, coalesce(n, 0)::DOUBLE AS company_posting_volume FROM ss s LEFT JOIN v ON v.company = s.company WHERE split = 'val'"))
def _(s, d):
    rows = stored(s, split_rows(s, d))
    return models.with_company_volume(rows.where("split = 'val'"), models.company_volume(rows.where("split = 'train'"))).select("source_id", "run_index", "company_posting_volume")


EVENTS = "WITH e AS (SELECT 'board:' || (user_id % 5) AS source, user_id, ts FROM events) "


#: sightings: each posting once a day, as the reference sizes a board (src/data/label_audit.py:165); events: all of them.
SIZES = "once AS (SELECT source, day::VARCHAR AS day, count(*) AS sightings FROM obs0 GROUP BY ALL), every AS (SELECT source, ts::DATE::VARCHAR AS day, count(*) AS events, count(DISTINCT user_id) AS postings, true AS close FROM e GROUP BY ALL)"


@query("r2_board_sizes", V.sql(", " + EVENTS.removeprefix("WITH ").rstrip() + ", " + SIZES + " SELECT o.source, o.day, sightings, events, postings, close FROM once o JOIN every v ON v.source IS NOT DISTINCT FROM o.source AND v.day IS NOT DISTINCT FROM o.day"))
def _(s, d):
    """The stream's sizes beside exact counts of the table, and whether the sketch is within two per cent."""
    sizes = streams.board_size_counts(s, d, streams.exact_board_sizes).select("source", F.to_date("w.start").cast("string").alias("day"), F.col("exact").alias("sightings"), F.col("sightings").alias("events"), F.col("postings").alias("estimate"))
    exact = streams.as_crawls(s.read.parquet(f"{d}/events.parquet")).groupBy(F.col("source").alias("of"), F.to_date("observed_at").cast("string").alias("on")).agg(F.count_distinct("source_id").alias("postings"))
    both = sizes.join(exact, F.col("of").eqNullSafe(F.col("source")) & (F.col("on") == F.col("day")))
    return both.select("source", "day", "sightings", "events", "postings", (F.abs(F.col("estimate") - F.col("postings")) <= 0.02 * F.col("postings")).alias("close"))


@query("r2_merged_sizes", EVENTS + "SELECT source, count(*) AS sightings, count(DISTINCT user_id) AS postings, true AS close FROM e GROUP BY source")
def _(s, d):
    """The days' sketches merged: distinct postings of a board over the whole time."""
    merged = streams.merged_sizes(streams.board_size_counts(s, d), "source").withColumnRenamed("postings", "estimate")
    exact = streams.as_crawls(s.read.parquet(f"{d}/events.parquet")).groupBy(F.col("source").alias("of")).agg(F.count_distinct("source_id").alias("postings"))
    return merged.join(exact, F.col("of").eqNullSafe(F.col("source"))).select("source", F.col("sightings").cast("long").alias("sightings"), "postings", (F.abs(F.col("estimate") - F.col("postings")) <= 0.02 * F.col("postings")).alias("close"))


@query("r3_crawl_sessions", "WITH n AS (SELECT epoch_us(ts) * 10 AS t, count(*) AS n FROM events GROUP BY ts), f AS (SELECT t, n, CASE WHEN t - lag(t) OVER (ORDER BY t) >= 3600000000 THEN 1 ELSE 0 END AS b FROM n), w AS (SELECT t, n, sum(b) OVER (ORDER BY t)::BIGINT AS wave FROM f) SELECT max(t) AS wave_end, sum(n)::BIGINT AS crawls FROM w GROUP BY wave")
def _(s, d):
    return streams.session_counts(s, d)


@query("r3_stalled", EVENTS.rstrip() + ", g AS (SELECT source, epoch_us(ts) AS last_us, lead(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts) AS resumed_us FROM (SELECT DISTINCT source, ts FROM e)) SELECT * FROM g WHERE resumed_us - last_us > 7200000000 OR resumed_us IS NULL")
def _(s, d):
    return streams.stalls(s, d, 3600)


# ---- what no other query returns ----------------------------------------------------------------------------------


@query("s13_panel_paths", V.sql("SELECT h::BIGINT AS horizon_days, 'calendar' AS horizon_basis, count(*) AS n, count(*) FILTER (y = 1) AS positives FROM (SELECT 7 AS h, y FROM lab UNION ALL SELECT 9, CASE WHEN y = 1 THEN 1 END FROM lab) GROUP BY h"))
def _(s, d):
    """Panels of two horizons written beside each other and read back, each in a folder of its own."""
    rows, at = V.labelled_panel(s, d).select("source", "source_id", "run_index", "y"), folder(s, "panels")
    for h, y in ((7, F.col("y")), (9, F.when(F.col("y") == 1, F.col("y")))):
        crawls.write_panel(rows.withColumn("y", y).withColumn("horizon_days", F.lit(h)).withColumn("horizon_basis", F.lit("calendar")), f"{at}/{h}")
    both = s.read.parquet(f"{at}/7").unionByName(s.read.parquet(f"{at}/9"))
    return both.groupBy(F.col("horizon_days").cast("long").alias("horizon_days"), "horizon_basis").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positives"))


@query("p13_contract_described", V.sql("SELECT 'source' AS name, count(*) AS n, 'category' AS kind, 'supplied' AS origin, false AS required FROM feat UNION ALL SELECT 'title', count(*), 'text', 'supplied', true FROM feat UNION ALL SELECT 'company', count(*), 'category', 'supplied', false FROM feat UNION ALL SELECT 'location', count(location), 'text', 'supplied', false FROM feat UNION ALL SELECT 'first_published', count(*), 'timestamp', 'supplied', false FROM feat"))
def _(s, d):
    """Which fields of the contract the panel fills, and in how many rows."""
    rows = V.labelled_panel(s, d)
    have = scoring.describe(s).where(F.col("name").isin(rows.columns))
    names = [r["name"] for r in have.select("name").collect()]  # the fields of the contract
    counts = rows.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "n")
    return have.join(counts, "name")


@query("f16_instants", V.sql("SELECT source_id, run_index, CASE user_id % 3 WHEN 0 THEN epoch_us(t::TIMESTAMP) WHEN 1 THEN epoch_us(t::TIMESTAMP) - 7200000000 END AS instant FROM feat"))
def _(s, d):
    """Instants as text of three kinds: in UTC, with an offset, and none at all."""
    rows, u = V.labelled_panel(s, d), F.col("user_id") % 3
    text = F.when(u == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(u == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.concat(F.lit("week "), F.weekofyear("t").cast("string")))
    return rows.select("source_id", "run_index", F.unix_micros(crawls.instant(text)).alias("instant"))


@query("f18_posting_keys", V.sql("SELECT source || '|' || source_id AS posting, count(*) AS n, sum(y)::BIGINT AS positives FROM feat GROUP BY ALL"))
def _(s, d):
    return V.labelled_panel(s, d).groupBy(derive.posting_key().alias("posting")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query("x29_lifespan_caveat", V.sql(", a AS (SELECT sum(y) FILTER (runs_seen < 6)::DOUBLE / count(*) FILTER (runs_seen < 6) AS b, sum(y) FILTER (runs_seen >= 6)::DOUBLE / count(*) FILTER (runs_seen >= 6) AS s FROM kc) SELECT round(b, 6) AS brief_rate, round(s, 6) AS settled_rate, coalesce(b >= 10 * s, false) AS caveat FROM a"))
def _(s, d):
    rows = audit.annotate(V.labelled_panel(s, d)).where("label_observable")
    return experiments.lifespan_caveat(audit.lifespan_verdict(rows)).select(r("brief_rate"), r("settled_rate"), "caveat")
