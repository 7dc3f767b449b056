import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.functions import scalars as S
from fernweave.operators import artifact, matching, metrics, towers
from fernweave.sources.versions import VersionStore


def made(spark):
    catalog = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "y")], "model_id int, color string, theme string")
    people = spark.createDataFrame([("1", "18-24"), ("2", "35-44"), ("3", "")], "customer_id string, age_group string")
    numeric = spark.createDataFrame([tuple(float(i * j) for j in range(len(S.NUMERIC_FEATURES))) for i in range(4)], ", ".join(f"{c} double" for c in S.NUMERIC_FEATURES))
    vocabularies, scaler = artifact.fit_encoders(catalog, people, numeric, ("color", "theme"))
    n = artifact.sizes(vocabularies)
    weights = towers.random_weights(4, 8, {"color": n["color"], "theme": n["theme"]}, n["age_group"], len(S.NUMERIC_FEATURES), seed=1)
    return catalog, numeric, artifact.Artifact(vocabularies, scaler, weights, {"recall_10": 0.5}, {"model_version": "v"})


def test_round_trip(spark, tmp_path):
    catalog, numeric, own = made(spark)
    artifact.save_artifact(own, str(tmp_path / "a"))
    got = artifact.load_artifact(spark, str(tmp_path / "a"))
    assert (got.metrics, got.metadata, got.weights.fields) == ({"recall_10": 0.5}, {"model_version": "v"}, ("color", "theme"))
    assert sorted(got.vocabularies.collect()) == sorted(own.vocabularies.collect())
    for name, a in own.weights.arrays.items():
        np.testing.assert_array_equal(got.weights[name], a)
    rows = got.indexed(catalog, ("color", "theme")).orderBy("model_id").collect()
    assert [(r._color, r._theme) for r in rows] == [(2, 2), (3, 1), (2, 3)]
    values = numeric.select(F.array(*S.NUMERIC_FEATURES).alias("v")).select(got.scaled("v").alias("v")).collect()
    x = np.array([r.v for r in values])
    np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
    with pytest.raises(Exception):
        artifact.save_artifact(own, str(tmp_path / "a"))


def test_parts_that_dont_belong_together_are_refused(spark, tmp_path):
    _, _, own = made(spark)
    gaps = own.vocabularies.withColumn("index", F.when((F.col("field") == "color") & (F.col("index") == 3), 5).otherwise(F.col("index")))
    twice = own.vocabularies.withColumn("token", F.when(F.col("field") == "color", "a").otherwise(F.col("token")))
    more = own.vocabularies.unionByName(spark.createDataFrame([("color", "new", 4)], "field string, token string, index int"))
    for i, (vocabularies, scaler) in enumerate([(gaps, own.scaler), (twice, own.scaler), (more, own.scaler), (own.vocabularies.filter("field <> 'theme'"), own.scaler), (own.vocabularies, own.scaler.limit(2))]):
        artifact.save_artifact(artifact.Artifact(vocabularies, scaler, own.weights), str(tmp_path / str(i)))
        with pytest.raises(ValueError):
            artifact.load_artifact(spark, str(tmp_path / str(i)))


def test_bad_vectors_stop_the_write(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "t"))
    good = [(i, [0.6, 0.8]) for i in range(50)] + [(99, None)]
    df = lambda rows: spark.createDataFrame(rows, "i int, v array<double>").repartition(4)
    name = store.write_vectors(df(good), "v", 2)
    assert store.segment(name).count() == 51
    for bad, word in (([1.0], "dimension"), ([float("nan"), 1.0], "finite"), ([2.0, 0.0], "length"), ([None, 1.0], "finite")):
        with pytest.raises(ValueError, match=word):
            store.write_vectors(df([*good, (7, bad)]), "v", 2)
    assert [p.name for p in (tmp_path / "t").iterdir()] == [name]
    assert store.segment(store.write_vectors(df([]), "v", 2)).count() == 0


def test_benchmark_pairs_and_verdict(spark):
    images = spark.createDataFrame([("A", "main", 0, [1.0, 0.0]), ("B", "main", 1, [0.0, 1.0]), ("A", "side", 2, [0.6, 0.8])], "model string, image_type string, position int, embedding array<double>")
    cases = [("1", "screenshot", "B", [1.0, 0.1], [0.0, 1.0]), ("2|x", "packshot", "A", [1.0, 0.0], [1.0, 0.0]), ("3", "other", "C", None, [1.0, 0.0])]
    df = spark.createDataFrame(cases, "case_id string, kind string, expected string, original array<double>, isolated array<double>")
    paired = metrics.paired_ranks(df, images)
    rows = {r.case_id: r for r in paired.collect()}
    assert (rows["1"].original_top1, rows["1"].original_rank, rows["1"].isolated_rank) == ("A", 2, 1) and rows["1"].isolated_margin == pytest.approx(0.2)
    assert (rows["2|x"].original_rank, rows["3"].original_top1, rows["3"].isolated_rank) == (1, None, None)
    out = metrics.benchmark_verdict(paired).first()
    assert (out.cases, out.original_recall_1, out.isolated_recall_1, out.verdict) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), "not_required")
    worse = metrics.benchmark_verdict(metrics.paired_ranks(df.withColumn("isolated", F.array(F.lit(1.0), F.lit(0.0))), images)).first()
    assert worse.verdict == "warranted"
    assert metrics.benchmark_verdict(paired.limit(0)).first().verdict == "not_required"


def test_images_matched_whole(spark):
    catalog = spark.createDataFrame([("A", "main", 0, [1.0, 0.0, 0.0]), ("B", "side", 1, [0.0, 1.0, 0.0])], "model string, image_type string, position int, embedding array<double>")
    axis = lambda i: (tuple(float(i == j) for j in range(3)),)
    prompts = matching.Prompts(footwear=axis(0), junk=axis(2), order=((-1.0, 0.0, 0.0),), delivery=((0.0, -1.0, 0.0),))
    crops = [
        ("shoe", 0, 1.0, [0.7, 0.1, 0.1]), ("shoe", 1, 0.5, [0.0, 1.0, 0.0]), ("shoe", 2, 0.01, [1.0, 0.0, 0.0]),
        ("tie", 0, 1.0, [1.0, 0.0, 0.0]), ("tie", 1, 0.5, [1.0, 0.0, 0.0]), ("tie", 2, 0.3, [1.0, 0.0, 0.0]),
        ("junk", 0, 1.0, [0.0, 0.0, 1.0]), ("scene", 0, 1.0, [-1.0, 0.0, 0.0]),
        ("near", 0, 1.0, [0.10, 0.1, 0.11]), ("near", 1, 0.05, [0.3, 0.4, 0.9]), ("order", 0, 1.0, [1.0, 0.0, 0.0]), ("blind", 0, 1.0, None),
    ]
    texts = [("shoe", None), ("tie", ""), ("junk", ""), ("scene", ""), ("near", ""), ("order", "Thank you for your order #12345"), ("blind", None), ("bare", "order confirmation")]
    out = matching.match_images(spark.createDataFrame(texts, "image_id string, text string"), spark.createDataFrame(crops, "image_id string, crop int, area_share double, vector array<double>"), catalog, prompts, top=1, verify_top=2)
    got = {r.image_id: (r.kind, r.status, r.crop, r.isolated, [c.model for c in r.candidates]) for r in out.collect()}
    assert got == {
        "shoe": ("shoe", "needs_verification", 1, True, ["B", "A"]), "tie": ("shoe", "needs_verification", 2, True, ["A", "B"]),
        "junk": ("garbage", "garbage", 0, False, []), "scene": ("order", "order", 0, False, []), "order": ("order", "order", 0, False, []),
        "near": ("garbage", "garbage", 0, False, []), "blind": ("unknown", "uncertain", 0, False, []), "bare": ("order", "order", None, False, []),
    }


def test_requests_to_a_verifier(spark):
    hits = "array<struct<rank:int,model:string,model_score:double,best_image_type:string>>"
    matched = spark.createDataFrame([("i", "needs_verification", [(1, "A", 0.9, "main"), (2, "B", 0.8, "side"), (3, "C", 0.7, "main")]), ("j", "garbage", [])], f"image_id string, status string, candidates {hits}")
    views = spark.createDataFrame([("A", "side", "http://a/side"), ("A", "main", None)], "model string, image_type string, url string")
    rows = matching.verifier_request(matched, views, 2, "http://base").collect()
    assert [r.image_id for r in rows] == ["i"]
    assert [tuple(s) for s in rows[0].slots] == [("customer", None, None, None), ("candidate_1", "A", "main", "http://base/A.jpg"), ("candidate_1", "A", "side", "http://a/side"), ("candidate_2", "B", "main", "http://base/B.jpg")]
    assert [s.url for s in matching.verifier_request(matched, views, 2).first().slots] == [None, None, "http://a/side", None]
