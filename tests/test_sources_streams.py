import json

import pytest

from lapsewise.operators import audit
from lapsewise.sources import crawls, schemas
from lapsewise.streaming import streams


def test_missing_columns_are_named(spark):
    with pytest.raises(schemas.SchemaError, match="run_id"):
        schemas.require(spark.createDataFrame([(1,)], "job_id long"), ("job_id", "run_id"), "job_observations")


def test_coercion_keeps_three_states(spark):
    df = spark.createDataFrame([("1", "2026-09-01T00:00:00Z", "x"), ("0", "bad", "7"), (None, None, None)], "remote string, posted_at string, salary_min string")
    out = schemas.coerced(df, schemas.JOBS).collect()
    assert [r["remote"] for r in out] == [True, False, None]
    assert out[0]["posted_at"] is not None and out[1]["posted_at"] is None and out[1]["salary_min"] == 7


def test_payloads(spark, tmp_path):
    job = {"id": 5, "absolute_url": "https://h/tok/jobs/5", "content": "abc", "first_published": "2026-09-01T00:00:00Z", "departments": [{"id": 1, "name": " B "}, {"id": 2, "name": "A"}], "offices": [], "metadata": [{"id": 1, "name": "k", "value": "old", "value_type": "s"}, {"id": 2, "name": "k", "value": "new", "value_type": "s"}]}
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "2026-09-03T03-45-01Z.html").write_text(json.dumps({"jobs": [job], "meta": {}}))
    (tmp_path / "acme" / "readme.html").write_text("{}")
    r = crawls.load_archive(spark, f"file://{tmp_path}", include_content=True).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["board_dir"], r["board_token"], r["source_id"], r["departments"], r["offices"], r["n_offices"], r["content_chars"]) == ("acme", "tok", "5", "A|B", None, 0, 3)
    assert json.loads(r["metadata_json"]) == {"k": "new"}


def test_round_trip_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4)], "job_id long, run_id long")
    crawls.write_tables({"job_observations": df}, f"file://{tmp_path}")
    back = spark.read.parquet(f"file://{tmp_path}/job_observations.parquet")
    assert crawls.manifest({"a": df}).first()[1:] == crawls.manifest({"a": back.orderBy("job_id", ascending=False)}).first()[1:]


def test_upload(spark):
    df = spark.createDataFrame([("a", " ", "z"), ("b", "x", None)], "title string, location string, other string")
    out = crawls.parse_board(df, ["title", "location"], "title").collect()
    assert [(r["client_id"], r["title"], r["location"]) for r in out] == [("row-1", "a", None), ("row-2", "b", "x")]


def test_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    df = spark.createDataFrame([("b", "1", "2026-09-01T00:00:00"), ("b", "1", "2026-09-01T00:00:00"), ("b", "2", "2026-09-01T00:30:00")], "source string, source_id string, at string").selectExpr("source", "source_id", "cast(at as timestamp) observed_at")
    df.write.parquet(path)
    live = spark.readStream.schema(df.schema).parquet(path)
    assert streams.written(streams.ingest(live), "ingest").count() == df.distinct().count()


def test_relisting_window(spark):
    rows = [("b", "1", "2026-09-01", "r", 1), ("b", "2", "2026-09-02", "r", 0), ("b", "3", "2026-09-05", "r", 0), ("b", "4", "2026-09-01", None, 1)]
    df = spark.createDataFrame(rows, "source string, source_id string, d string, requisition_id string, y int").selectExpr("*", "cast(d as timestamp) t").drop("d")
    got = {r["source_id"]: r["hit"] for r in audit.relisted(df, df, ["requisition_id"]).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": False}
