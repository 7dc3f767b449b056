import datetime as dt
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from fernweave.sources import remote, schemas, snapshots
from fernweave.streaming import customers as streams


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing required columns: customer_id, model"):
        schemas.require_columns(spark.createDataFrame([(1,)], "purchase_id long"), ["purchase_id", "customer_id", "model"])


def test_snapshots(spark, tmp_path):
    root, df = f"file://{tmp_path}/s", spark.range(3).select(F.col("id").alias("purchase_id"))
    first = snapshots.write_snapshot({"purchases": df}, root, dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc), "db")
    assert first.endswith("2026-01-02T000000")
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot({"purchases": df}, root, dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc))
    snapshots.write_snapshot({"customers": df}, root, dt.datetime(2026, 1, 3, tzinfo=dt.timezone.utc))
    assert snapshots.latest_snapshot(spark, root) == first
    assert json.loads(spark.read.text(f"{first}/metadata").first()[0])["rows"] == {"purchases": 3}
    assert snapshots.read_snapshot(spark, first, {"purchases": ["purchase_id"]})["purchases"].count() == 3
    with pytest.raises(FileNotFoundError):
        snapshots.latest_snapshot(spark, f"{root}/none")


def test_codes_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿model,name\n49166_008,a\n\n49166_013,b\n49166_008,c\n")
    rows = snapshots.read_codes(spark, str(tmp_path / "c.csv")).orderBy("position").collect()
    assert [r.model for r in rows] == ["49166_008", "49166_013"]


def test_upsert_and_last_rows(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    live = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, snapshots.upsert(base, live, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, snapshots.last_rows(base.unionByName(live), ["k"], ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_payload_jobs(spark):
    body = json.dumps({"models": [{"model_id": 1, "model": "A", "images": {"main": "https://x/a.jpg", "side": "http://x/s.jpg"}}, {"model_id": 2, "model": "B", "images": {"main": " "}}]})
    jobs, errors = snapshots.payload_jobs(spark.createDataFrame([(body,)], "payload string"))
    assert sorted(r.image_type for r in jobs.collect()) == ["main", "side"]
    assert [(r.model, r.error) for r in errors.collect()] == [("B", "INVALID_URL")]


def test_remote_payloads(spark):
    bodies = ['{"data":[{"a":1,"b":"x"}]}', '[{"a":2,"b":"y"}]', '{"fields":["a","b"],"values":[["3","z"]]}', '"scalar"', ""]
    got = snapshots.unwrap_payload(spark.createDataFrame([(b,) for b in bodies], "body string"), "struct<a:int,b:string>")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_retries(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(remote.time, "sleep", waits.append)

    def send(request):
        calls.append(request)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return b"[1]"

    assert remote.fetch("http://u", {}, {}, send=send) == [1] and waits == [0.5, 1.0]

    def refuse(request):
        raise urllib.error.HTTPError("u", 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("http://u", {}, {}, send=refuse)
    with pytest.raises(RuntimeError, match="not JSON"):
        remote.fetch("http://u", {}, {}, send=lambda r: b"<html>")


def test_streamed_sessions(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{source}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(source)
    out = streams.last_purchases(stream.select(F.col("user_id").cast("string").alias("customer_id"), F.col("ts").alias("purchase_date")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("last").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        want = streams.last_purchases(spark.read.parquet(f"{source}/events.parquet").select(F.col("user_id").cast("string").alias("customer_id"), F.col("ts").alias("purchase_date")))
        assert sorted(map(tuple, spark.sql("select * from last").collect())) == sorted(map(tuple, want.collect()))
    finally:
        q.stop()


def test_datasets_by_split(spark, tmp_path):
    from fernweave.sources import datasets as D

    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "x int, split string")
    root = str(tmp_path / "made")
    D.write_dataset(rows, root, {"rows": 3})
    assert sorted(r.x for r in D.load_split(spark, root, "train").collect()) == [1, 3]
    assert D.load_split(spark, root, "validation").columns == ["x"] and D.load_split(spark, root, "validation").collect() == []
    assert D.load_metadata(spark, root) == {"rows": 3}
    with pytest.raises(ValueError):
        D.load_split(spark, root, "all")
    with pytest.raises(Exception, match="exists"):
        D.write_dataset(rows, root, {})


def test_documents_pages_and_cached_catalogs(spark, tmp_path):
    from fernweave.sources import datasets as D

    path = tmp_path / "cases.json"
    path.write_text('{"cases": [{"case_key": "a"}, {"case_key": "b"}]}')
    assert [r.case_key for r in D.load_cases(spark, str(path)).collect()] == ["a", "b"]
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        D.load_cases(spark, str(path))
    assert D.records_to_frame(spark, []).columns == [] and D.records_to_frame(spark, [{"x": 1}]).first().x == 1
    df = spark.range(10)
    assert [r.id for r in D.select(df, ["id"], ["-id"], 3, 2).collect()] == [7, 6, 5]
    with pytest.raises(ValueError):
        D.select(df, where="id = 1")
    cache, built = str(tmp_path / "cache"), []

    def build():
        built.append(1)
        return spark.range(4).withColumn("n", F.lit(len(built)))

    for source, refresh, times in (("a", False, 1), ("a", False, 1), ("b", False, 2), ("b", True, 3)):
        got = D.cached_catalog(spark, cache, source, "m", build, refresh)
        assert len(built) == times and got.count() == 4 and got.columns == ["id", "n"]
    with pytest.raises(ValueError):
        D.cached_catalog(spark, cache, "c", "m", lambda: spark.range(0))


def test_small_lookups(spark):
    from fernweave.operators import lookups as L

    df = spark.createDataFrame([("b", "main"), ("a", "side"), ("a", "main")], "model string, image_type string")
    assert [(r.model, r.image_type) for r in L.selected_rows(df, ["a"], 1).collect()] == [("a", "main")] and L.selected_rows(df).count() == 3
    with pytest.raises(Exception, match="BAD_CUSTOMER_ID"):
        spark.createDataFrame([("1x",)], "c string").select(L.customer_number(F.col("c"))).collect()
    odd = spark.sql("select double('NaN') as a, double('Infinity') as b, 1.5D as c, timestamp '2026-01-02 03:04:05' as d, date '2026-01-02' as e")
    assert tuple(L.json_safe(odd).first()) == (None, None, 1.5, "2026-01-02T03:04:05", "2026-01-02")
