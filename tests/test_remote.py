"""The remote sources and the sink against a small table service."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from fernweave.operators import integrity
from fernweave.sources import procs, remote, rows, snapshots

TESTS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}


class Service:
    """Views that are read in pages, a table that is written in jobs, and a procedure."""

    def __init__(self):
        self.views, self.table, self.staged, self.asked, self.fail_on = {}, {}, {}, [], None

    def answer(self, body):
        self.asked.append(body)
        kind = body.get("type")
        if kind == "stage":
            if self.fail_on and any(self.fail_on in map(str, r["values"]) for r in body["rows"]):
                raise KeyError("refused")
            self.staged.setdefault((body["job"], body["part"]), []).extend(body["rows"])
            return {"ok": True}
        if kind == "publish":
            for part in body["parts"]:
                for r in self.staged.pop((body["job"], part), []):
                    values = dict(zip(r["fields"], r["values"]))
                    at = r.get("row_id") or next((i for i, old in self.table.items() if all(old.get(k) == values[k] for k in ("model_id", "image_type"))), max(self.table, default=0) + 1)
                    self.table[at] = self.table.get(at, {}) | values
            return {"ok": True}
        if kind == "drop":
            self.staged = {k: v for k, v in self.staged.items() if k[0] != body["job"]}
            return {"ok": True}
        if kind == "proc":
            return {"data": [{"name": body["procName"], "value": body["value"]}]}
        found = [r for r in self.views[body["view"]] if all(r[c] is not None and TESTS[o](r[c], v) if o in TESTS else r[c] is not None for c, o, v in body["where"])]
        if "bounds" in body:
            keys = [r[body["bounds"]] for r in found]
            return {"min": min(keys, default=None), "max": max(keys, default=None)}
        return sorted((r for r in found if body["afterId"] < r["id"] < body["beforeId"]), key=lambda r: r["id"])[: body["limit"]]


@pytest.fixture
def service():
    made = Service()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            try:
                status, out = 200, made.answer(body)
            except KeyError as error:
                status, out = 400, {"error": str(error)}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    made.url = f"http://127.0.0.1:{server.server_port}"
    yield made
    server.shutdown()


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_filters_are_pushed_and_ranges_come_from_the_view(spark, service, pushing):
    service.views["v"] = [{"id": 1000 + i, "kind": "ab"[i % 2], "n": None if i % 5 == 0 else i} for i in range(200)]
    df = remote.read_view(spark, service.url, "v", "id long, kind string, n long", "id", partitions=4, page=7)
    assert df.count() == 200
    pages = [b for b in service.asked if "afterId" in b]
    # four ranges between the view's bounds, none up to the largest number
    assert len({b["beforeId"] for b in pages}) == 4 and max(b["beforeId"] for b in pages) == 1200
    service.asked.clear()
    some = df.filter("kind = 'a' and n > 20 and id >= 1050 and id < 1100")
    assert sorted(r.id for r in some.collect()) == [1000 + i for i in range(50, 100) if i % 2 == 0 and i % 5]
    pages = [b for b in service.asked if "afterId" in b]
    assert all(["kind", "=", "a"] in b["where"] and ["n", ">", 20] in b["where"] for b in pages)
    assert min(b["afterId"] for b in pages) >= 1049 and max(b["beforeId"] for b in pages) <= 1100
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # all was pushed, or folded into what was
    odd = df.filter("n % 2 = 0 and kind = 'a'")
    assert "% 2" in odd._jdf.queryExecution().executedPlan().toString() and odd.count() == 80
    assert df.filter("id > 5000").collect() == [] and df.filter("id in (1001, 1002)").count() == 2


def test_three_views_in_one_snapshot(spark, service, tmp_path):
    service.views = {
        "p": [{"id": i, "model": "m"} for i in range(5)],
        "c": [{"id": 1, "age": 3}],
        "m": [{"id": 1, "model_id": 7, "model": " x "}, {"id": 2, "model_id": 7, "model": "y"}, {"id": 3, "model_id": 8, "model": ""}],
    }
    views = {
        "purchases": remote.read_view(spark, service.url, "p", "id long, model string", "id"),
        "customers": remote.read_view(spark, service.url, "c", "id long, age int", "id"),
        "models": remote.read_view(spark, service.url, "m", "id long, model_id long, model string", "id"),
    }
    with pytest.raises(ValueError, match="nope"):
        remote.fetch_training_views(views, {"purchases": ["id"], "customers": ["nope"], "models": ["id"]}, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()
    path = remote.fetch_training_views(views, {n: ["id"] for n in views}, str(tmp_path / "s"), "db")
    got = snapshots.read_snapshot(spark, path, {n: ["id"] for n in views})
    assert [got[n].count() for n in ("purchases", "customers", "models")] == [5, 1, 3]
    images = spark.createDataFrame([(7, "main"), (8, "main"), (9, "side"), (None, "side")], "model_id long, image_type string")
    coded = remote.with_codes(images, got["models"].withColumnRenamed("id", "row_id"))
    assert sorted((r.model_id or 0, r.model) for r in coded.collect()) == [(0, ""), (7, "y"), (8, ""), (9, "")]


def stored(service):
    service.table = {i: {"model_id": i, "image_type": "main", "image_hash": f"h{i}", "embedding": "[0.0,0.0]"} for i in range(1, 6)}


def images_of(spark, service):
    rows = [(f"m{r['model_id']}", r["image_type"], i, r["model_id"], r["image_hash"]) for i, r in service.table.items()]
    return spark.createDataFrame(rows, "model string, image_type string, row_id long, model_id long, image_hash string")


def test_stale_images_are_refreshed_or_nothing_is(spark, service):
    stored(service)
    now = [(f"m{i}", "main", f"h{i}" if i % 2 else f"new{i}", None) for i in range(1, 6)] + [("m9", "side", "h9", None)]
    current = spark.createDataFrame(now, "model string, image_type string, image_hash string, error string")
    images = images_of(spark, service).unionByName(spark.createDataFrame([("m9", "side", None, 9, None)], "model string, image_type string, row_id long, model_id long, image_hash string"))
    audited = integrity.audit(images, current)
    assert {r.model for r in audited.filter("stale").collect()} == {"m2", "m4", "m9"}
    encoded = spark.createDataFrame([(m, t, [1.0, float(len(m))]) for m, t, _, _ in now], "model string, image_type string, embedding array<double>")
    before = json.dumps(service.table)
    # a vector of another dimension, and a service that refuses a row: neither leaves anything
    with pytest.raises(Exception, match="INVALID_VECTOR"):
        rows.write_rows(integrity.refreshed_rows(audited, encoded.withColumn("embedding", F.slice("embedding", 1, 1)), "e", 2), service.url, "images")
    service.fail_on = "new4"
    with pytest.raises(Exception):
        rows.write_rows(integrity.refreshed_rows(audited, encoded, "e", 2).repartition(3), service.url, "images")
    assert json.dumps(service.table) == before and not service.staged
    service.fail_on = None
    made = integrity.refreshed_rows(audited, encoded, "e", 2)
    rows.write_rows(made.repartition(3), service.url, "images", unique="model_id,image_type")
    assert len(service.table) == 6 and service.table[2]["image_hash"] == "new2" and json.loads(service.table[2]["embedding"]) == [1.0, 2.0]
    assert service.table[1]["image_hash"] == "h1" and service.table[6]["model_id"] == 9 and not service.staged
    again = integrity.audit(images_of(spark, service), current)
    assert again.filter("stale").isEmpty() and again.count() == 6


def test_audit_names_what_failed(spark):
    images = spark.createDataFrame([(c, "main", 1, 1, "h") for c in "abcd"], "model string, image_type string, row_id long, model_id long, image_hash string")
    current = spark.createDataFrame([("a", "main", None, "invalid"), ("b", "main", None, "timeout"), ("c", "main", "h", None)], "model string, image_type string, image_hash string, error string")
    got = {r.model: (r.stale, r.error) for r in integrity.audit(images, current).collect()}
    assert got == {"a": (True, "INVALID_IMAGE"), "b": (True, "DOWNLOAD_FAILED"), "c": (False, None), "d": (True, "IMAGE_NOT_FOUND")}
    lost = integrity.refreshed_rows(integrity.audit(images.withColumns({"row_id": F.lit(None).cast("long"), "model_id": F.lit(None).cast("long"), "image_hash": F.lit("")}).filter("model = 'c'"), current), spark.createDataFrame([("c", "main", [1.0])], "model string, image_type string, embedding array<double>"), "e", 1)
    with pytest.raises(Exception, match="missing model_id"):
        lost.collect()


def test_procedures(spark, service):
    procs.remote_procedure(spark, "best_models", "name string, value string", service.url)
    asked = [procs.called(spark, "best_models", v).first() for v in (None, {"a": 1, "b": [2]}, [1, 2], "text")]
    assert [r.value for r in asked] == ["{}", '{"a":1,"b":[2]}', "[1,2]", "text"] and asked[0].name == "best_models"
    assert spark.sql("SELECT value FROM best_models(NULL)").first().value == "{}"
    with pytest.raises(ValueError):
        procs.procedure(" ", "a int", lambda v: [])
    spark.range(10).selectExpr("id", "id % 3 as k", "if(id = 4, null, 'x') as t").createOrReplaceTempView("some_rows")
    spark.udtf.register("rows_like", procs.filtering("id long, k long"))
    assert sorted(r.id for r in spark.sql("""SELECT * FROM rows_like(TABLE(some_rows), '{"k":1}')""").collect()) == [1, 4, 7]
    assert spark.sql("SELECT * FROM rows_like(TABLE(some_rows), NULL)").count() == 10
    assert [r.id for r in spark.sql("""SELECT * FROM rows_like(TABLE(some_rows), '{"t":null}')""").collect()] == [4]
    assert spark.sql("""SELECT * FROM rows_like(TABLE(some_rows), '{"other":1}')""").count() == 0
