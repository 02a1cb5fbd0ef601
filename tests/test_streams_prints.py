"""The stall monitor against plain order, merged sketches, and the board fingerprint on boards that a column gives away."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lapsewise.operators import fingerprint, waves
from lapsewise.streaming import streams

T0 = dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc)


def stream_of(spark, tmp_path, batches, schema):
    """A stream whose files come one in a batch, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")


def test_stalls_are_told_once_and_again_when_over(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    # b comes out of order within the lateness; c stops; a resumes after its stall has been told
    batches = [[("a", at(0)), ("b", at(5)), ("c", at(0))], [("b", at(0)), ("b", at(2)), ("a", at(1))], [("c", at(1)), ("b", at(8))], [(None, at(40))], [("a", at(41))], [(None, at(90))]]
    out = streams.written(streams.stall_monitor(stream_of(spark, tmp_path, batches, "source string, t timestamp"), 3600, "12 hours"), "stalls")
    hour = lambda us: None if us is None else round((us / 1e6 - T0.timestamp()) / 3600)
    got = sorted(((r["source"], hour(r["last_us"]), hour(r["resumed_us"])) for r in out.collect()), key=str)
    # a is told at once when nothing comes for two hours, and again with the crawl that ended it; then it stops for good
    assert got == sorted([("a", 1, None), ("a", 1, 41), ("a", 41, None), ("b", 2, 5), ("b", 5, 8), ("b", 8, None), ("c", 1, None)], key=str)


def test_sketches_merge(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    rows = [("b", f"p{k}", day(d)) for d in range(3) for k in range(100 * d, 100 * d + 150)]
    live = stream_of(spark, tmp_path, [rows, [("z", "x", day(60))]], "source string, source_id string, observed_at timestamp")
    sizes = streams.written(streams.board_sizes(live, "2 days"), "sizes")
    assert [(r["postings"], r["sightings"]) for r in sizes.orderBy("w").collect()] == [(pytest.approx(150, abs=2), 150)] * 3
    assert streams.merged_sizes(sizes, "source").first()["postings"] == pytest.approx(350, abs=4)


def test_fingerprint_by_hand(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        board = f"b{k % 3}"
        rows.append((board, "remote" if board == "b1" else rng.choice(["x", "y"]), None if board == "b2" else rng.random(), rng.random(), float(k % 3)))
    df = spark.createDataFrame(rows, "source string, location string, pay double, noise double, board_size_at_t double")
    train, val = df.limit(200), df.subtract(df.limit(200))
    f = fingerprint.fingerprint(train, val, ["pay", "noise", "board_size_at_t"], ["location"])
    scores = {r["variant"]: r for r in f.scores.collect()}
    assert scores["all"]["accuracy"] == 1.0 and scores["without board context"]["accuracy"] > 0.95 and scores["all"]["rows"] == 100
    stumps = {r["feature"]: r["accuracy"] for r in f.stumps.collect()}
    assert stumps["board_size_at_t"] == 1.0 and stumps["location"] > 0.6 and stumps["noise"] < 0.6
    assert scores["nulls alone"]["accuracy"] == pytest.approx(stumps["pay"], abs=0.4) and scores["nulls alone"]["accuracy"] > 0.6
    assert {r["removed"]: round(r["drop"], 6) for r in f.drop_one.collect()}["noise"] == 0
    assert {r["actual"] for r in f.confusion.collect()} == {r["board"] for r in f.recall.collect()} == {"b0", "b1", "b2"}


def test_fingerprint_of_values_never_seen(spark):
    train = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "source string, location string")
    val = spark.createDataFrame([("a", "new"), ("b", "y"), (None, "y")], "source string, location string")
    f = fingerprint.fingerprint(train, val, [], ["location"], context=())
    assert {(r["actual"], r["predicted"], r["n"]) for r in f.confusion.collect()} == {("a", "b", 1), ("b", "b", 1)} or f.recall.count() == 2
    assert f.stumps.first()["accuracy"] == 1.0  # a value never seen goes to the commonest board


def test_sums_up_to_any_moment(spark):
    rng = random.Random(8)
    data = [(float(rng.randint(0, 400_000)), rng.randint(0, 5), rng.randint(0, 3)) for _ in range(300)]
    asked = [(i, float(rng.randint(-10, 500_000))) for i in range(60)] + [(99, data[0][0])]
    at = spark.createDataFrame(data, "at double, n long, pos long")
    got = {r["k"]: (r["n"], r["pos"]) for r in waves.sums_up_to(at, spark.createDataFrame(asked, "k long, until double")).collect()}
    assert got == {k: (sum(n for a, n, _ in data if a <= u), sum(p for a, _, p in data if a <= u)) for k, u in asked}


def test_first_wave_beyond_a_width(spark):
    moments = [0, 5, 6, 7, 20, 27]
    at = lambda h: T0 + dt.timedelta(hours=h)
    df = spark.createDataFrame([(at(h),) for h in moments], "wave_t timestamp")
    got = {(r["a"] - at(0).replace(tzinfo=None)).total_seconds() / 3600: (r["b"] - at(0).replace(tzinfo=None)).total_seconds() / 3600 for r in waves.first_beyond(df, 7 * 3600.0).collect()}
    assert got == {a: min(b for b in moments if b > a + 7) for a in moments if any(b > a + 7 for b in moments)}
    plan = waves.first_beyond(df, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stall_state_is_one_stretch_whatever_it_holds(spark, tmp_path):
    rng = random.Random(4)
    crawls = [T0 + dt.timedelta(seconds=rng.randrange(86_400)) for _ in range(1500)] + [T0 + dt.timedelta(hours=h) for h in (30, 31, 40)]
    rng.shuffle(crawls)
    batches = [[("a", t) for t in crawls[:700]], [("a", t) for t in crawls[700:]], [("a", T0 + dt.timedelta(hours=12, minutes=1))], [(None, T0 + dt.timedelta(days=9))]]
    state = f"file://{tmp_path}/state"
    monitor = streams.stall_monitor(stream_of(spark, tmp_path, batches[:3], "source string, t timestamp"), 3600, "3 days")
    monitor.writeStream.format("parquet").option("path", f"{state}-out").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").load(state).select("value.*").collect()
    assert max(len(x) for r in held for x in r.asDict(True)["groupState"].values() if isinstance(x, list)) == 6  # a day, an evening and an hour of it
    live = stream_of(spark, tmp_path / "all", batches, "source string, t timestamp")
    out = streams.written(streams.stall_monitor(live, 3600, "3 days"), "stalls").collect()
    order = sorted({t for b in batches[:3] for _, t in b})
    us = lambda t: round(t.timestamp() * 1_000_000)
    expected = {("a", us(x), us(y)) for x, y in zip(order, order[1:]) if y - x > dt.timedelta(hours=2)} | {("a", us(order[-1]), None)}
    assert {tuple(r) for r in out} == expected and len(out) == len(expected) == 3


def test_watermark_within_a_stretch(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    # the watermark stops inside 0..10 hours of crawls an hour apart, again and again, before they end
    batches = [[("a", at(h)) for h in range(11)], [(None, at(14.5))], [(None, at(17))], [("a", at(11))], [(None, at(25))], [("a", at(30))], [(None, at(60))]]
    out = streams.written(streams.stall_monitor(stream_of(spark, tmp_path, batches, "source string, t timestamp"), 3600, "10 hours"), "stalls")
    hour = lambda us: None if us is None else round((us / 1e6 - T0.timestamp()) / 3600)
    assert sorted(((hour(r["last_us"]), hour(r["resumed_us"])) for r in out.collect()), key=str) == sorted([(11, None), (11, 30), (30, None)], key=str)


def test_events_come_in_few_batches(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("x").alias("event_type"))
    rows.repartition(20).write.parquet(f"file://{tmp_path}/events.parquet")
    raw = streams.marked(spark, f"file://{tmp_path}", "100 days")
    q = raw.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert sum(sizes) == 41 and len(sizes) <= streams.BATCHES + 1


def test_postings_count_once_a_day_across_batches(spark, tmp_path):
    at = lambda d, h: T0 + dt.timedelta(days=d, hours=h)
    # p comes twice in a batch, again in the next and on another day; r comes late, but within the lateness; one has no name
    batches = [[("b", "p", at(0, 1)), ("b", "p", at(0, 2)), ("b", "q", at(0, 3)), ("b", None, at(0, 3))], [("b", "p", at(0, 4)), ("b", "p", at(1, 0)), ("b", None, at(0, 5))], [("b", "r", at(0, 6)), ("c", "p", at(1, 1))], [("z", "x", at(60, 0))]]
    live = stream_of(spark, tmp_path, batches, "source string, source_id string, observed_at timestamp")
    sizes = streams.written(streams.exact_board_sizes(live, "2 days"), "sizes")
    got = [(r["w"]["start"].day, r["source"], r["exact"], r["sightings"], r["postings"]) for r in sizes.orderBy("w", "source").collect()]
    assert got == [(1, "b", 4, 7, 3), (2, "b", 1, 1, 1), (2, "c", 1, 1, 1)]


def test_merged_sketch_keeps_two_per_cent(spark):
    n, k = 97560, 106  # with 2 ** 14 buckets the estimate of these ids is 2.4 per cent off
    ids = spark.range(n * k, n * (k + 1)).select((F.col("id") % 4).alias("part"), F.lit("b").alias("source"), F.col("id").cast("string").alias("source_id"))
    sketches = ids.groupBy("source", "part").agg(F.hll_sketch_agg("source_id", F.lit(streams.SKETCH)).alias("sketch"), F.count("*").alias("sightings"))
    assert streams.merged_sizes(sketches, "source").first()["postings"] == pytest.approx(n, rel=0.02)


@pytest.mark.parametrize("query", ["r2_board_sizes", "r2_merged_sizes", "r3_crawl_sessions", "r3_stalled"])
def test_streams_lose_no_event_of_a_long_table(spark, tmp_path, query):
    rng = random.Random(3)
    rows = [(None if query.startswith("r2") and rng.random() < 0.05 else rng.randrange(40), T0 + dt.timedelta(seconds=rng.randrange(200 * 86400)), "x") for _ in range(4000)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").repartition(6).write.parquet(f"file://{tmp_path}/events.parquet")
    at = duckdb.connect()
    at.sql(f"CREATE VIEW events AS SELECT user_id, epoch_us(ts)::BIGINT AS us, make_timestamp(us) AS ts, event_type FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = at.sql(entry.oracle_sql()[query])
    # a task for each file, so that there are batches enough: rows are too late only from the third batch on
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4mb")
    try:
        got = entry.queries()[query](spark, f"file://{tmp_path}")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
