"""Audits of a labelled panel: cohorts, relisting, stability, lifespans, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.operators import quantiles

RELIST_DAYS = 1.6
LIFESPANS = ("1", "2", "3", "4-5", "6+")


def rate_of(positives: Column, rows: Column) -> Column:
    return F.try_divide(positives.cast("double"), rows)


def group_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, postings, positives, rate and mean_age of each group; null is a group."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_distinct("source_id").alias("postings"),
        F.sum("y").cast("long").alias("positives"),
        F.avg(F.col("y").cast("double")).alias("rate"),
        F.avg("age_days").alias("mean_age"),
    )


def annotate(panel: DataFrame) -> DataFrame:
    """panel plus first_seen_idx, cohort, runs_seen, first_observation."""
    posting = Window.partitionBy("source", "source_id")
    first = panel.groupBy("source").agg(F.min("run_index").alias("_first"))
    out = panel.withColumn("first_seen_idx", F.min("run_index").over(posting)).withColumn("runs_seen", F.count(F.lit(1)).over(posting)).join(first, "source")
    cohort = F.when(F.col("first_seen_idx") == F.col("_first"), "incumbent").otherwise("entrant")
    return out.withColumn("cohort", cohort).withColumn("first_observation", F.col("run_index") == F.col("first_seen_idx")).drop("_first")


def attach_cohort(rows: DataFrame, annotated: DataFrame) -> DataFrame:
    """rows plus cohort and first_observation looked up by (source, source_id, run_index); incumbent and false where unknown."""
    key = ["source", "source_id", "run_index"]
    looked = rows.join(annotated.select(*key, "cohort", "first_observation").dropDuplicates(key), key, "left")
    return looked.withColumn("cohort", F.coalesce("cohort", F.lit("incumbent"))).withColumn("first_observation", F.coalesce("first_observation", F.lit(False)))


def source_by_cohort(rows: DataFrame) -> DataFrame:
    """Rates by source, by cohort and by both in one pass over grouping sets."""
    out = rows.cube("source", "cohort").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"), F.avg(F.col("y").cast("double")).alias("rate"), F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("long"))


def age_quantiles(rows: DataFrame, key: str = "cohort") -> DataFrame:
    """key, n and the quartiles of age; a group without any age has n = 0 and nulls."""
    cuts = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = quantiles.exact_quantiles(rows, ["age_days"], cuts, key).drop("feature", "n")
    out = rows.groupBy(key).agg(F.count("age_days").alias("n")).join(found.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "n", *[F.get("q", F.lit(i)).alias(f"p{int(100 * c)}") for i, c in enumerate(cuts)])


def run_completeness(runs: DataFrame) -> DataFrame:
    capped = F.coalesce(F.col("pages_fetched") >= F.col("page_cap"), F.lit(False))
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(capped).alias("capped"), F.min(F.to_date("started_at")).cast("string").alias("first_run"), F.max(F.to_date("started_at")).cast("string").alias("last_run"),
    )


def panel_shape(seen: DataFrame) -> DataFrame:
    """Per source: jobs, mean and most days seen, seen once, share seen once. seen: source, job_id, day."""
    days = seen.groupBy("source", "job_id").agg(F.count_distinct("day").alias("days"))
    out = days.groupBy("source").agg(F.count("*").alias("jobs"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days"), F.count_if(F.col("days") == 1).alias("seen_once"))
    return out.withColumn("pct_seen_once", 100.0 * F.col("seen_once") / F.col("jobs"))


def coverage_by_source(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole per cent of non-null values, half to even."""
    return df.groupBy("source").agg(*[F.bround(100.0 * F.avg(F.col(c).isNotNull().cast("double"))).alias(c) for c in columns])


def column_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, dtype, non_null, null_pct, n_unique of every column, from one pass."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    kinds = dict(df.dtypes)
    aggs = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.count(c).alias("non_null"), F.round(100.0 * (F.count("*") - F.count(c)) / F.nullif(F.count("*"), F.lit(0)), 1).alias("null_pct"), distinct(c).alias("n_unique")).alias(f"_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(df.columns))])).alias("s")).select("s.*")


def board_stability(rows: DataFrame) -> DataFrame:
    """Per source: days, fewest and most postings of a day, worst daily fall."""
    day = rows.groupBy("source", F.to_date("t").alias("day")).agg(F.count_distinct("source_id").alias("n"))
    before = F.lag("n").over(Window.partitionBy("source").orderBy("day"))
    fall = F.try_divide((F.col("n") - before).cast("double"), before)
    return day.withColumn("fall", fall).groupBy("source").agg(F.count("*").alias("days"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.min("fall").alias("worst_fall"))


def removal_dispersion(rows: DataFrame) -> DataFrame:
    """source, day, positives: zero where a source had none on a day that any source had rows."""
    days = rows.select(F.to_date("t").cast("string").alias("day")).distinct()
    sources = rows.select("source").distinct()
    hits = rows.where("y = 1").groupBy("source", F.to_date("t").cast("string").alias("day")).agg(F.count("*").alias("positives"))
    grid = sources.join(F.broadcast(days), F.lit(True))
    return grid.join(hits, ["source", "day"], "left").na.fill(0, ["positives"])


def removal_pivot(rows: DataFrame, days: list[str]) -> DataFrame:
    """One row per source, one column per day: its removals. days: as removal_dispersion names them."""
    return rows.where("y = 1").withColumn("_day", F.to_date("t").cast("string")).groupBy("source").pivot("_day", days).count().na.fill(0)


def lifespan_bin(runs_seen: Column) -> Column:
    return F.when(runs_seen <= 3, runs_seen.cast("string")).when(runs_seen <= 5, "4-5").otherwise("6+")


def lifespan_concentration(annotated: DataFrame) -> DataFrame:
    out = annotated.groupBy(lifespan_bin(F.col("runs_seen")).alias("lifespan")).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("removals"))
    return out.withColumn("rate", F.round(F.col("removals") / F.col("rows"), 4))


def lifespan_verdict(annotated: DataFrame) -> DataFrame:
    """brief (under 6 runs) against settled: rates, ratio, share of removals, status at ratios 10 and 3."""
    brief = F.col("runs_seen") < 6
    out = annotated.agg(
        rate_of(F.sum(F.when(brief, F.col("y"))), F.count_if(brief)).alias("brief_rate"), rate_of(F.sum(F.when(~brief, F.col("y"))), F.count_if(~brief)).alias("settled_rate"),
        rate_of(F.sum(F.when(brief, F.col("y"))), F.sum("y")).alias("brief_share"),
    )
    out = out.withColumn("ratio", F.try_divide("brief_rate", "settled_rate"))
    return out.withColumn("status", F.when(F.col("ratio") >= 10, "concentrated").when(F.col("ratio") >= 3, "leaning").when(F.col("ratio").isNull(), "undefined").otherwise("spread"))


def relisted(arm: DataFrame, panel: DataFrame, key: list[str], days: float = RELIST_DAYS) -> DataFrame:
    """arm plus hit: a row of the same source and key, but another posting, lies within (t, t + days].

    Rows meet on (source, key, bucket of the window's width) instead of by a range join.
    """
    width = int(days * 86_400)
    seconds = F.unix_micros(F.col("t").cast("timestamp")) / 1_000_000
    other = panel.where(" and ".join(f"{k} is not null" for k in key)).select("source", *key, F.col("source_id").alias("_other"), seconds.alias("_later"), F.floor(seconds / width).alias("_bucket")).distinct()
    mine = arm.withColumn("_at", seconds).withColumn("_bucket", F.explode(F.array(F.floor(F.col("_at") / width), F.floor(F.col("_at") / width) + 1)))
    met = mine.join(other, ["source", *key, "_bucket"]).where((F.col("_other") != F.col("source_id")) & (F.col("_later") > F.col("_at")) & (F.col("_later") <= F.col("_at") + width))
    hits = met.select("source", "source_id", "t").distinct().withColumn("hit", F.lit(True))
    return arm.join(hits, ["source", "source_id", "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def last_sightings(rows: DataFrame) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy("source", "source_id").orderBy(F.desc("t")))
    return rows.withColumn("_n", latest).where("_n = 1").drop("_n")


def compare_relisting(rows: DataFrame, key: list[str]) -> DataFrame:
    """Removed postings against standing ones seen at the same instants: hits, rates, standard error, verdict."""
    last = last_sightings(rows)
    removed = last.where("y = 1")
    standing = rows.where("y = 0").join(removed.select("source", "t").distinct(), ["source", "t"], "left_semi")
    a = relisted(removed, rows, key).agg(F.count_if("hit").alias("removed_hits"), F.count("*").alias("removed_n"))
    b = relisted(standing, rows, key).agg(F.count_if("hit").alias("control_hits"), F.count("*").alias("control_n"))
    out = a.join(F.broadcast(b), F.lit(True))
    p, q = rate_of(F.col("removed_hits"), F.col("removed_n")), rate_of(F.col("control_hits"), F.col("control_n"))
    out = out.withColumn("removed_rate", p).withColumn("control_rate", q)
    spread = F.sqrt(F.try_divide(F.col("removed_rate") * (1 - F.col("removed_rate")), "removed_n") + F.try_divide(F.col("control_rate") * (1 - F.col("control_rate")), "control_n"))
    out = out.withColumn("standard_error", spread)
    return out.withColumn("indistinguishable", F.abs(F.col("removed_rate") - F.col("control_rate")) <= 2 * F.col("standard_error"))


def resurrections(panel: DataFrame) -> DataFrame:
    """Postings that came back after an absence: runs seen and longest absence."""
    rows = panel.select("source", "source_id", "run_index").distinct()
    gap = F.lead("run_index").over(Window.partitionBy("source", "source_id").orderBy("run_index")) - F.col("run_index") - 1
    per = rows.withColumn("_gap", gap).groupBy("source", "source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("run_index")), lambda x: x.cast("string")), ",").alias("runs_list"), F.max("_gap").alias("max_absent"))
    return per.where("max_absent > 0")


def wilson(df: DataFrame, hits: str, n: str, z: float = 1.96) -> DataFrame:
    """df plus low and high; null where n is 0."""
    p, m = F.try_divide(F.col(hits).cast("double"), n), F.nullif(F.col(n), F.lit(0)).cast("double")
    centre, spread = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return df.withColumn("low", F.when(m.isNotNull(), F.greatest(F.lit(0.0), centre - spread))).withColumn("high", F.when(m.isNotNull(), F.least(F.lit(1.0), centre + spread)))


def verdict_shares(rows: DataFrame, arm: str, verdict: str) -> DataFrame:
    out = rows.groupBy(arm, verdict).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(arm))
    return out.withColumn("arm_total", total).withColumn("share", F.round(F.col("n") / F.col("arm_total"), 4))


def stratified_sample(rows: DataFrame, cap: int, seed: str = "s") -> DataFrame:
    """One row per posting, proportional quotas by source (half to even, one at least), in order of a seeded hash."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("source"), F.col("source_id")))
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source", "source_id").orderBy("t"))).where("_n = 1").drop("_n").withColumn("_draw", draw)
    sizes = one.groupBy("source").agg(F.count("*").alias("_size"))
    total = one.agg(F.count("*").alias("_all"))
    quota = sizes.join(F.broadcast(total), F.lit(True)).select("source", F.greatest(F.lit(1), F.bround(F.lit(float(cap)) * F.col("_size") / F.col("_all")).cast("int")).alias("_quota"))
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy("_draw"))).join(quota, "source")
    return ranked.where("_rank <= _quota").orderBy("_draw").limit(cap).drop("_rank", "_quota", "_draw")


def sample_arms(rows: DataFrame, cap: int, seed: str = "s") -> DataFrame:
    """Both arms of the label check in one frame: removed postings and those still there, sampled alike; arm names them."""
    arm = lambda y, name: stratified_sample(rows.where(F.col("y") == y), cap, seed).withColumn("arm", F.lit(name))
    return arm(1, "removed").unionByName(arm(0, "present"))


def validation_report(tables: dict[str, DataFrame]) -> DataFrame:
    """check, n: row counts and structural defects of the three crawl tables."""
    jobs, runs, obs = tables["jobs"], tables["runs"], tables["job_observations"]

    def repeated(*cols: str) -> Column:
        return (F.count("*") - F.count_distinct(F.struct(*cols))).alias("n")

    dup = lambda name, *cols: jobs.agg(repeated(*cols)).select(F.lit(name).alias("check"), "n")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(f"rows_{name}").alias("check"), "n") for name, df in sorted(tables.items())]
    parts += [dup("duplicate_posting", "source", "source_id"), dup("duplicate_content_hash", "content_hash"), dup("duplicate_title_company", "title", "company")]
    parts.append(obs.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_observations").alias("check"), "n"))
    parts.append(jobs.agg(F.count_if(F.col("last_seen") < F.col("first_seen")).alias("n")).select(F.lit("seen_backwards").alias("check"), "n"))
    parts.append(jobs.agg(F.count_if(F.col("salary_min") > F.col("salary_max")).alias("n")).select(F.lit("salary_backwards").alias("check"), "n"))
    parts.append(runs.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("runs_"), "status").alias("check"), "n"))
    parts.append(runs.agg(F.count_if(F.col("pages_fetched") >= F.col("page_cap")).alias("n")).select(F.lit("truncated_runs").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alive_at_end(observations: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that the last run of their source saw."""
    last = runs.groupBy("source").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"))
    seen = observations.join(last.select("run_id"), "run_id", "left_semi")
    return jobs.join(seen.select(F.col("job_id").alias("id")), "id", "left_semi")
