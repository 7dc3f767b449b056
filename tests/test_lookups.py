import json

import pytest
from pyspark.sql import functions as F

from fernweave.functions import vectors as V
from fernweave.operators import lookups, retrieval
from fernweave.plans import queries
from fernweave.sources import datasets, snapshots


def test_nested_vectors(spark):
    given = ["[[1, 2], [3]]", "[[1], []]", "[[]]", "[[1], [null]]", "[1, [2]]", " [4] "]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    assert [r.v for r in df.select("i", V.parse_vector(F.col("g")).alias("v")).orderBy("i").collect()] == [[1, 2, 3], [1], None, None, None, [4]]


def test_codes_of_several_files_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿model\r\nB,x\r\n\r\nA\r\n")
    (tmp_path / "b.csv").write_text('"C"\nB\n')
    rows = snapshots.read_codes(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.model for r in rows] == ["B", "A", "C"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text("sku\n\n")
    with pytest.raises(ValueError, match="no model codes"):
        snapshots.read_codes(spark, str(tmp_path / "none"))


def test_small_boxes_and_missing_views(spark):
    boxes = [(0, 0, 8, 8), (0, 0, 7, 50), (10, 10, 400, 12), (-20, -5, 30, 300), (199, 0, 300, 90)]
    df = spark.createDataFrame(boxes, "l int, t int, r int, b int").select(F.struct(F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom")).alias("box"))
    got = [r.c and tuple(r.c) for r in df.select(lookups.clamp_box(F.col("box"), F.lit(200), F.lit(100)).alias("c")).collect()]
    assert got == [(0, 0, 8, 8), None, None, (0, 0, 30, 100), None]
    hits = spark.createDataFrame([("q", 1, "A"), ("q", 2, "B")], "request_id string, rank int, model string")
    views = spark.createDataFrame([("A", "side"), ("A", "main")], "model string, image_type string")
    assert [(s.model, s.views) for s in lookups.verifier_requests(hits, views).first().slots] == [("A", ["main", "side"]), ("B", ["main"])]


def test_crop_boxes_has_every_line(spark):
    """Lines whose box has a side of less than 8 pixels too."""
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    got = queries.crop_boxes(spark, d)
    small = got.filter('right - `left` < 8 or bottom - top < 8')
    assert got.count() == lines.count() and small.count() > 0
    assert small.filter('`left` < 0 or right <= `left` or right > 200 or top < 0 or bottom <= top or bottom > 100 or not isolates').count() == 0


def test_tables_and_json_of_hits(spark):
    images = spark.createDataFrame([("q", 1, "A", "main", 0.5), ("q", 2, "B", "side", 0.25)], "query_id string, rank int, model string, image_type string, similarity double")
    models = spark.createDataFrame([("q", 1, "A", 0.5, "main"), ("p", 1, "C", 0.1, "pers")], "query_id string, rank int, model string, model_score double, best_image_type string")
    assert [r.line for r in lookups.image_table(images).orderBy("rank").collect()] == ["rank | model | image_type | similarity", "1 | A | main | 0.500000", "2 | B | side | 0.250000"]
    assert [r.line for r in lookups.model_table(models.filter("query_id = 'q'")).orderBy("rank").collect()][1] == "1 | A | 0.500000 | main | 0.500000"
    got = {r.query_id: json.loads(r.json) for r in lookups.hits_json(images, models).collect()}
    assert got["p"] == {"images": [], "models": [{"rank": 1, "model": "C", "model_score": 0.1, "best_image_type": "pers", "best_image_similarity": 0.1}]}
    assert [h["model"] for h in got["q"]["images"]] == ["A", "B"]


def test_last_rows_count(spark):
    rows = spark.createDataFrame([(1, " A ", "main", 1.0), (2, "A", "main", 2.0), (3, "A", "side", 3.0), (4, " ", "main", 4.0), (5, None, "main", 5.0)], "row_id int, model string, image_type string, x double")
    assert sorted((r.model, r.image_type, r.x) for r in retrieval.load_catalog(rows).collect()) == [("A", "main", 2.0), ("A", "side", 3.0)]
    catalog = spark.createDataFrame([(1, "A", None, "x"), (2, "A", [1.0], None)], "model_id int, model string, visual array<double>, color string")
    asked = spark.createDataFrame([("A",), ("Z",)], "model string")
    lacks = F.array_compact(F.array(F.when(F.col("color").isNull(), "color")))
    assert sorted(map(tuple, lookups.model_status(asked, catalog, lacks).collect())) == [("A", True, ["color"]), ("Z", False, ["not_in_catalog"])]


def test_many_queries_and_bounds(spark):
    candidates = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    queries = spark.createDataFrame([("1", [3.0, 0.0]), ("2", [0.0, 2.0])], "query_id string, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id) for r in retrieval.rank_for_queries(queries, candidates, 2).collect())
    assert got == [("1", 1, "a"), ("1", 2, "b"), ("2", 1, "c"), ("2", 2, "a")]
    for bad, code in (([(" ", [1.0, 0.0])], "BLANK"), ([("a", [1.0, 1.0])], "DUPLICATE"), ([("z", [0.0, 0.0])], "ZERO_VECTOR")):
        with pytest.raises(Exception, match=code):
            retrieval.rank_for_queries(queries, candidates.unionByName(spark.createDataFrame(bad, candidates.schema)), 2).collect()
    retrieval.check_request(64, 5000, 100)
    for bad in ((65, 1, 1), (1, 5001, 1), (1, 1, 101), (0, 1, 1)):
        with pytest.raises(ValueError):
            retrieval.check_request(*bad)


def test_failed_build_leaves_the_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = datasets.cached_catalog(spark, cache, "a", "m", lambda: spark.range(3))

    def broken():
        raise OSError("gone")

    with pytest.raises(OSError):
        datasets.cached_catalog(spark, cache, "a", "m", broken, refresh=True)
    with pytest.raises(ValueError):
        datasets.cached_catalog(spark, cache, "a", "m", lambda: spark.range(0), refresh=True)
    assert first.count() == 3 and datasets.cached_catalog(spark, cache, "a", "m", broken).count() == 3


def test_ranks_of_several_targets_over_blocks(spark, monkeypatch):
    import numpy as np

    from fernweave.operators import ranking

    monkeypatch.setattr(ranking, "MODELS", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[5] = x[9]  # a tie
    images = spark.createDataFrame([(f"m{i % 8}", "main", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, image_type string, position int, embedding array<double>")
    q = np.round(rng.normal(size=(6, 3)), 1)
    queries = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(q)], "query_id string, vector array<double>")
    targets = spark.createDataFrame([(str(i), m) for i in range(7) for m in ("m1", "m5", "m1", "gone")], "query_id string, model string")
    got = {(r.query_id, r.position): r["rank"] for r in retrieval.view_ranks(queries, targets, images).collect()}
    s = q @ x.T
    want = {(str(i), j): 1 + sum((s[i, k], -k) > (s[i, j], -j) for k in range(40)) for i in range(6) for j in range(40) if j % 8 in (1, 5)}
    assert got == want


def test_ranks_of_targets_send_no_vectors_by_pair(spark, monkeypatch):
    import numpy as np

    rng, tables, kept = np.random.default_rng(4), [], retrieval.kept
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[60:] = x[:60]  # ties, in blocks of their own and in others
    images = spark.createDataFrame([(f"m{i % 2}", "main", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, image_type string, position int, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    queries = spark.createDataFrame([(str(i), [float(v) for v in x[i]]) for i in range(20)], "query_id string, vector array<float>")
    targets = spark.createDataFrame([(str(i), m) for i in range(20) for m in (f"m{i % 2}", "gone")], "query_id string, model string")
    monkeypatch.setattr(retrieval, "kept", lambda df: tables.append(out := kept(df)) or out)
    s = [[sum(a * b for a, b in zip(x[i], r)) for r in x] for i in range(20)]
    want = {(str(i), j): 1 + sum((s[i][k], -k) > (s[i][j], -j) for k in range(120)) for i in range(20) for j in range(i % 2, 120, 2)}
    for numbers, rows in ((8 << 20, 1 << 20), (100, 200)):  # one block of images, and four
        monkeypatch.setattr(retrieval, "NUMBERS", numbers, raising=False)
        monkeypatch.setattr(retrieval, "ROWS", rows, raising=False)
        tables.clear()
        got = retrieval.view_ranks(queries, targets, images).collect()
        assert len(got) == len(want) and {(r.query_id, r.position): r["rank"] for r in got} == want
        assert all(abs(r.similarity - s[int(r.query_id)][r.position]) < 1e-9 and r.model == f"m{r.position % 2}" for r in got)
        # a row a query and a row an image, not one a query and target's image
        assert sum(t.count() for t in tables) <= 20 + 120


def test_moments_dont_depend_on_the_zone(spark):
    from fernweave.functions import scalars as S

    given = ["2020-01-02", "2020-01-02 03:04:05", "2020-01-02T03:04:05Z", "2020-01-02 03:04:05+02:00", "2020-01-02T03:04:05-0500", "x", None, ""]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    results = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        results.append([r.s for r in df.select("i", F.unix_seconds(S.as_utc(F.col("g"))).alias("s")).orderBy("i").collect()])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = 1577934245
    assert results[0] == results[1] == [1577923200, base, base, base - 7200, base + 18000, None, None, None]
