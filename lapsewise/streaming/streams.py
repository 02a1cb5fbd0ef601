"""Structured Streaming forms of the daily append: ingest, board sizes, crawl waves.

What comes later than the watermark is dropped here; the batch panel stays the authority.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lapsewise.sources.working import shared_folder

LATENESS = "2 days"
#: Binary logarithm of the buckets of a distinct sketch: a standard error of 0.3 per cent after merging. Two per cent are seven of those.
SKETCH = 17
#: Batches in which the events of a query come, before the row that closes them.
BATCHES = 3


def ingest(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Rows once per (source, observed_at, source_id)."""
    return rows.withWatermark("observed_at", lateness).dropDuplicatesWithinWatermark(["source", "observed_at", "source_id"])


def board_sizes(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """w (a day), source, sightings, and the postings seen as a sketch and its estimate; late rows within the watermark still count.

    Sketches can be merged: see merged_sizes.
    """
    sized = rows.withWatermark("observed_at", lateness).groupBy(F.window("observed_at", "1 day").alias("w"), "source").agg(F.hll_sketch_agg("source_id", F.lit(SKETCH)).alias("sketch"), F.count("*").alias("sightings"))
    return sized.withColumn("postings", F.hll_sketch_estimate("sketch"))


def exact_board_sizes(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """board_sizes with exact, the postings themselves: each is counted once a day, however often and in whichever batches it comes.

    A posting waits in the state for each day on which it is seen, until the watermark has passed that day.
    """
    once = rows.withWatermark("observed_at", lateness).groupBy(F.window("observed_at", "1 day").alias("day"), "source", "source_id").agg(F.count("*").alias("seen"))
    sized = once.groupBy(F.window("day", "1 day").alias("w"), "source").agg(F.hll_sketch_agg("source_id", F.lit(SKETCH)).alias("sketch"), F.sum("seen").alias("sightings"), F.count("*").alias("exact"))
    return sized.withColumn("postings", F.hll_sketch_estimate("sketch"))


def merged_sizes(sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, postings, sightings over any number of days: distinct postings by merging their sketches, without the rows."""
    out = sizes.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("sightings").alias("sightings"))
    return out.select(*keys, F.hll_sketch_estimate("sketch").alias("postings"), "sightings")


def crawl_sessions(runs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Waves as sessions that end after an hour without a crawl."""
    # sessions need a key beside the window: one that all crawls share
    keyed = runs.withWatermark("t", lateness).groupBy(F.session_window("t", "1 hour").alias("w"), F.col("t").isNotNull().alias("_all"))
    return keyed.agg(F.count("*").alias("crawls"), F.max("t").alias("wave_t")).drop("_all")


def stalled(waves: DataFrame, now: str, spacing_seconds: float) -> DataFrame:
    newest = waves.agg(F.max("wave_t").alias("newest"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("newest")
    return newest.withColumn("stalled", age > 2 * spacing_seconds)


def joined_runs(runs: np.ndarray, width: int) -> np.ndarray:
    """Rows (start, end) in order, with those no more than width apart made one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    until = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(runs)), bool), runs[1:, 0] - until[:-1] > width]))
    return np.stack([runs[first, 0], until[np.append(first[1:], len(runs)) - 1]], axis=1)


def stall_monitor(runs: DataFrame, spacing_seconds: float, lateness: str = LATENESS) -> DataFrame:
    """source, last_us, resumed_us (microseconds): a row when a source has had no crawl for two spacings, and one when it is crawled again.

    runs: a stream of (source, t). A source's crawls wait in its state until the watermark has passed them, and are then
    looked at in order, however they arrived; a timer on event time reports a source from which nothing more comes, with
    resumed_us null. Both rows of one stall have the same last_us. Crawls no more than two spacings apart wait as one
    stretch, of which the start and the end alone can matter: the state of a source is its last crawl and the stretches
    within the lateness, one more than the stalls there.
    """
    width = round(2 * spacing_seconds * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, pending = state.get if state.exists else (None, False, [])
        waiting = np.array(pending, np.int64).reshape(-1, 2)
        if not state.hasTimedOut:
            for frame in frames:
                us = frame["us"].dropna().to_numpy(np.int64)
                waiting = joined_runs(np.concatenate([waiting, np.stack([us, us], axis=1)]), width)
        mark = state.getCurrentWatermarkMs() * 1000
        out: list[tuple] = []
        if key[0] is None:
            return
        under_way = False  # a stretch that the watermark has not passed to its end: no stall now
        for start, end in waiting[waiting[:, 0] <= mark].tolist():
            if last is not None and start - last > width:
                out.append((key[0], last, start))
            under_way = end > mark
            seen = start if under_way else end
            if last is None or seen > last:
                last, told = seen, False
        waiting = waiting[waiting[:, 1] > mark]
        if last is not None and not told and not under_way and mark >= last + width:  # whatever waits came later still
            out.append((key[0], last, None))
            told = True
        state.update((last, told, waiting.ravel().tolist()))
        ahead = int(waiting[0, under_way * 1]) if len(waiting) else None if told or last is None else last + width
        if ahead is not None:
            state.setTimeoutTimestamp(max(ahead, mark) // 1000 + 1)
        yield pd.DataFrame({"source": pd.Series([x[0] for x in out], dtype=object), "last_us": pd.array([x[1] for x in out], "Int64"), "resumed_us": pd.array([x[2] for x in out], "Int64")})

    # rows without a source stay in: they move the watermark, and a filter would be pushed below it
    keyed = runs.withWatermark("t", lateness).select("source", "t", F.unix_micros("t").alias("us"))
    return keyed.groupBy("source").applyInPandasWithState(step, "source string, last_us long, resumed_us long", "last long, told boolean, stretches array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by source and day of the streamed events, each counted once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = raw.select(F.concat(F.lit("board:"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("user_id").cast("string").alias("source_id"), day.alias("observed_at"))
    out = f"{checkpoint(spark)}-out"
    q = ingest(rows, "40 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint(spark)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("source", F.to_date("observed_at").cast("string").alias("day")).agg(F.count("*").alias("postings"))


def written(stream: DataFrame, lateness_mark: str, mode: str = "append") -> DataFrame:
    """The finished rows of a stream, written to the shared folder and read again. Rows of windows that the watermark has not passed yet stay out."""
    spark = stream.sparkSession
    out = f"{checkpoint(spark)}-{lateness_mark}"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint(spark)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def marked(spark: SparkSession, sf_dir: str, late: str) -> DataFrame:
    """The events as a stream, followed by one row far ahead, source null, whose time closes every window before it.

    They come in BATCHES batches, however many files there are: each batch visits the state of every partition.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = f"{checkpoint(spark)}-events"
    events.write.parquet(f"{at}/a")
    ahead = events.agg((F.max("ts") + F.expr(f"interval {late}")).alias("ts"))
    ahead.select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit(None).cast("string").alias("event_type")).coalesce(1).write.parquet(f"{at}/b")
    at_once = max(1, -(-len(spark.read.schema(events.schema).parquet(f"{at}/a").inputFiles()) // BATCHES))
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", True).parquet(at)
    return raw


def closed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """marked, and a lateness in days that covers all events, in whatever order they come; the row lies further ahead than that."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    days = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.ceil((F.max(us) - F.min(us)) / 86_400_000_000)).first()[0] or 0
    return marked(spark, sf_dir, f"{2 * days + 40} days"), days + 10


def as_crawls(raw: DataFrame) -> DataFrame:
    """Events as sightings of postings on boards."""
    source = F.concat(F.lit("board:"), (F.col("user_id") % 5).cast("string"))
    return raw.select(source.alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("observed_at"))


def board_size_counts(spark: SparkSession, sf_dir: str, sized: Callable[[DataFrame, str], DataFrame] = board_sizes) -> DataFrame:
    """sized of the events, from windows that the watermark has closed: all but that of the row far ahead."""
    raw, late = closed(spark, sf_dir)
    return written(sized(as_crawls(raw), f"{late} days"), "sizes")


def stalls(spark: SparkSession, sf_dir: str, spacing_seconds: float) -> DataFrame:
    """stall_monitor of the events as crawls of boards."""
    raw, late = closed(spark, sf_dir)
    runs = as_crawls(raw).select("source", F.col("observed_at").alias("t"))
    return written(stall_monitor(runs, spacing_seconds, f"{late} days"), "stalls")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of the events as closed sessions: their last instant and number of instants."""
    # ten times as far apart, so that there are pauses of an hour
    raw, late = closed(spark, sf_dir)
    out = written(crawl_sessions(raw.select(F.timestamp_micros(F.unix_micros("ts") * 10).alias("t")), f"{10 * late} days"), "sessions")
    return out.select(F.unix_micros("wave_t").alias("wave_end"), "crawls")
