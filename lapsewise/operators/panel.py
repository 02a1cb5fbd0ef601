"""From crawls to a labelled panel: one row for each posting and complete crawl that saw it.

Every window ends at the row's own crawl, apart from the label, which is a statement about later ones. Runs are few and
are joined as such; rows are partitioned by posting or by run, never by source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions.derive import with_row_local

TOLERANCE_SECONDS = 15 * 60


def complete_runs(runs: DataFrame) -> DataFrame:
    """run_id, source, t, run_index of runs that ended well under the newest rules; run_index counts from 0 by source."""
    newest = runs.agg(F.max("rules_version").alias("newest"))
    kept = runs.where("status = 'ok'").join(F.broadcast(newest), F.col("rules_version") == F.col("newest"), "left_semi")
    index = F.row_number().over(Window.partitionBy("source").orderBy("started_at", "id")) - 1
    return kept.select(F.col("id").alias("run_id"), "source", F.col("started_at").alias("t"), index.cast("long").alias("run_index"))


def unrecorded_runs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Complete runs without a single snapshot row."""
    seen = rows.select("source", F.col("observed_at").alias("t")).distinct()
    return runs.join(seen, ["source", "t"], "left_anti")


def observations(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshot rows of complete runs, with run_id, t and run_index."""
    r = runs.withColumnRenamed("source", "_source")
    return rows.join(r, (rows["source"] == r["_source"]) & (rows["observed_at"] == r["t"])).drop("_source", "observed_at")


def gone_index(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """source, source_id, gone_index: first of two consecutive absences after a sighting, if there is one.

    Between two sightings three or more runs apart lie two absences; after the last sighting they need two more runs.
    """
    last = runs.groupBy("source").agg(F.max("run_index").alias("last_index"))
    rows = panel.select("source", "source_id", "run_index").distinct()
    after = F.lead("run_index").over(Window.partitionBy("source", "source_id").orderBy("run_index"))
    rows = rows.withColumn("after", after).join(last, "source")
    gap = (F.col("after") >= F.col("run_index") + 3) | (F.col("after").isNull() & (F.col("run_index") + 2 <= F.col("last_index")))
    return rows.where(gap).groupBy("source", "source_id").agg((F.min("run_index") + 1).alias("gone_index"))


def with_labels(panel: DataFrame, runs: DataFrame, horizon_days: int, basis: str = "calendar", strict_future: bool = False) -> DataFrame:
    """panel plus y (null where unknown) and label_observable.

    A row is settled if its source has a complete run at or after the deadline. It is then 1 if the posting went by the
    deadline (as soon as it was gone once, even if it came back; strict_future asks for a later moment than the row's),
    0 if the posting itself was seen at or after the deadline, unknown otherwise.
    """
    moments = runs.select("source", F.col("run_index").alias("gone_index"), F.col("t").alias("t_gone"))
    gone = gone_index(panel, runs).join(moments, ["source", "gone_index"])
    last_seen = panel.groupBy("source", "source_id").agg(F.max("t").alias("last_seen"))
    by_posting = last_seen.join(gone.select("source", "source_id", "t_gone"), ["source", "source_id"], "left")
    last_run = runs.groupBy("source").agg(F.max("t").alias("last_run"))
    day = (lambda c: F.to_date(c)) if basis == "calendar" else (lambda c: c.cast("timestamp"))
    deadline = F.date_add(F.to_date("t"), horizon_days) if basis == "calendar" else F.timestamp_micros(F.unix_micros(F.col("t").cast("timestamp")) + horizon_days * 86_400_000_000)
    rows = panel.join(last_run, "source").join(by_posting, ["source", "source_id"])
    future = (F.col("t_gone") > F.col("t")) if strict_future else F.lit(True)
    y = F.when(day(F.col("t_gone")).isNotNull() & (day(F.col("t_gone")) <= deadline) & future, 1).when(day(F.col("last_seen")) >= deadline, 0)
    y = F.when(day(F.col("last_run")) >= deadline, y).cast("byte")
    return rows.withColumn("y", y).withColumn("label_observable", F.col("y").isNotNull()).drop("last_run", "last_seen", "t_gone")


def attach_nearest(panel: DataFrame, archive: DataFrame, tolerance_seconds: int = TOLERANCE_SECONDS, key: str = "source_id") -> DataFrame:
    """Each panel row with the archive record of its key fetched nearest to t within the tolerance, the earlier on ties.

    What is nearest follows from key and t alone, so each (key, t) is looked up once, and rows find their answer by
    the two. Time is cut into buckets as wide as the tolerance; an archive record is offered to its own and the two
    buckets beside it, so the join is a plain equality on (key, bucket). Rows without a record, a key or a t keep nulls.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    width = max(1, tolerance_seconds)
    names = [c for c in archive.columns if c not in (key, "fetched_at") and c not in panel.columns]
    right = archive.select(F.col(key).alias("_key"), "fetched_at", *names, F.explode(F.array(*[(F.floor(seconds(F.col("fetched_at")) / width) + d) for d in (-1, 0, 1)])).alias("_bucket"))
    asked = panel.select(F.col(key).alias("_key"), F.col("t").alias("_t")).distinct().withColumn("_bucket", F.floor(seconds(F.col("_t")) / width))
    gap = F.abs(F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    near = asked.join(right, ["_key", "_bucket"]).withColumn("_gap", gap).where(F.col("_gap") <= tolerance_seconds * 1_000_000)
    best = near.groupBy("_key", "_t").agg(F.min(F.struct("_gap", "fetched_at", *names)).alias("_best"))
    out = panel.join(best, (panel[key] == best["_key"]) & (panel["t"] == best["_t"]), "left")
    return out.select(*[panel[c] for c in panel.columns], "_best.fetched_at", *[f"_best.{c}" for c in names])


def with_board_context(panel: DataFrame) -> DataFrame:
    """Counts of the posting's board at its own run, growth since the run before, and sightings so far."""
    run = ["source", "run_index"]
    # counted first and joined, so that no task holds a whole board; null titles are one title
    titles = panel.groupBy(*run, F.coalesce("title", F.lit("")).alias("_title"), F.col("title").isNull().alias("_none")).agg(F.count("*").alias("n_same_title_on_board"))
    requisitions = panel.where("requisition_id is not null").groupBy(*run, "requisition_id").agg(F.count("*").alias("n_same_req_on_board"))
    sizes = panel.groupBy(*run).agg(F.count("*").alias("board_size_at_t"))
    before = F.lag("board_size_at_t").over(Window.partitionBy("source").orderBy("run_index"))
    sizes = sizes.withColumn("board_growth", F.col("board_size_at_t") - before)
    so_far = F.row_number().over(Window.partitionBy("source", "source_id").orderBy("run_index"))
    out = panel.withColumn("n_complete_runs_observed", so_far.cast("long")).withColumn("_title", F.coalesce("title", F.lit(""))).withColumn("_none", F.col("title").isNull())
    out = out.join(titles, [*run, "_title", "_none"]).drop("_title", "_none").join(requisitions, [*run, "requisition_id"], "left")
    return out.join(sizes, run)


class SnapshotLogBehind(RuntimeError):
    """Complete runs have no snapshot rows."""


def assemble(runs: DataFrame, rows: DataFrame, archive: DataFrame | None, horizon_days: int, basis: str = "calendar", guard: bool = True) -> DataFrame:
    """The whole panel as one lazy plan; guard runs one check first."""
    complete = complete_runs(runs)
    if guard and not (behind := unrecorded_runs(complete, rows)).isEmpty():
        raise SnapshotLogBehind(str([tuple(r) for r in behind.limit(5).collect()]))
    panel = with_labels(observations(complete, rows), complete, horizon_days, basis)
    if archive is not None:
        panel = attach_nearest(panel, archive)
    for name, kind in (("requisition_id", "string"), ("first_published", "timestamp"), ("updated_at", "timestamp"), ("salary_raw", "string")):
        if name not in panel.columns:
            panel = panel.withColumn(name, F.lit(None).cast(kind))
    panel = with_row_local(with_board_context(panel))
    return panel.withColumn("horizon_days", F.lit(horizon_days)).withColumn("horizon_basis", F.lit(basis))


def single_horizon(panel: DataFrame) -> Column | str:
    """The one horizon and basis of a panel, as text; refuses a mixed one."""
    found = panel.select("horizon_days", "horizon_basis").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("a panel needs exactly one horizon and basis")
    return f"removed within {found[0][0]} days ({found[0][1]})"


def labelled(panel: DataFrame) -> DataFrame:
    return panel.where("label_observable").withColumn("y", F.col("y").cast("int"))
