import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.functions import vectors as V
from fernweave.operators import calibration, customers, decisions, encoders, integrity, metrics, ranking, retrieval, towers
from fernweave.operators import purchases as P

BOUGHT = "purchase_id long, customer_id string, model string, purchase_date string, season string, discount double, quantity double, size string, last_name string"


def bought(spark, rows):
    base = dict(customer_id="1", season="W22", discount=0.0, quantity=1.0, size="36", last_name="Test")
    names = [c.split()[0] for c in BOUGHT.split(", ")]
    df = spark.createDataFrame([tuple({**base, "purchase_id": i, **r}[c] for c in names) for i, r in enumerate(rows)], BOUGHT)
    return df.withColumn("purchase_date", F.col("purchase_date").cast("timestamp"))


def catalog(spark, **visuals):
    return spark.createDataFrame([(k, v) for k, v in visuals.items()], "model string, visual array<double>")


def test_no_leakage(spark):
    df = bought(spark, [dict(model="A", purchase_date="2022-01-01"), dict(model="B", purchase_date="2023-01-01", season="W23", discount=50.0), dict(model="C", purchase_date="2024-01-01")])
    b, c = P.sequences(P.prepare_purchases(df)).orderBy("place").collect()
    assert (b.history, b.purchases_before, b.full_prices_before, b.discounts_before) == (["A"], 1, 1, 0)
    assert (c.history, c.purchases_before, c.full_prices_before, c.discounts_before) == (["A", "B"], 2, 1, 1)
    assert c.avg_discount_before == 25 and b.recency_days == 365


def test_season_counts(spark):
    df = bought(spark, [dict(model="A", purchase_date="2022-01-01"), dict(model="B", purchase_date="2023-01-01", season=""), dict(model="C", purchase_date="2024-01-01")])
    rows = P.sequences(P.prepare_purchases(df)).orderBy("place").select(P.season_counts(F.col("seasons_before"))).collect()
    assert [r[0] for r in rows] == [{"W22": 1}, {"W22": 1}]


def test_same_day_order(spark):
    df = bought(spark, [dict(purchase_id=20, model="B", purchase_date="2022-01-01"), dict(purchase_id=10, model="A", purchase_date="2022-01-01"), dict(purchase_id=30, model="C", purchase_date="2022-01-02")])
    rows = {r.model: r.history for r in P.sequences(P.prepare_purchases(df)).collect()}
    assert rows == {"B": ["A"], "C": ["A", "B"]}


def test_excluded_targets_stay_in_histories(spark):
    df = bought(spark, [dict(model="A", purchase_date="2022-01-01"), dict(model="MISSING", purchase_date="2023-01-01"), dict(model="NOVIS", purchase_date="2023-06-01"), dict(model="C", purchase_date="2024-01-01")])
    rows = {r.model: r for r in P.with_targets(P.sequences(P.prepare_purchases(df)), catalog(spark, A=[1.0], C=[1.0], NOVIS=None)).collect()}
    assert {m: r.reason for m, r in rows.items()} == {"MISSING": "missing_model", "NOVIS": "missing_visual", "C": "ok"}
    assert rows["C"].history == ["A", "MISSING", "NOVIS"]


def test_cleaning(spark):
    nan = float("nan")
    rows = [
        dict(model="OLD", purchase_date="2018-05-01", customer_id="3"), dict(model="A", purchase_date="2019-06-01", customer_id="3.0"), dict(model="B", purchase_date="2020-06-01", customer_id="3"),
        dict(model="A", purchase_date="2021-01-01", customer_id="99999999"), dict(model="A", purchase_date="2021-01-01", quantity=0.0), dict(model="A", purchase_date="2021-01-01", quantity=nan), dict(model=None, purchase_date="2021-01-01"),
    ]
    prepared = P.prepare_purchases(bought(spark, rows))
    (row,) = P.sequences(prepared).collect()
    assert prepared.count() == 2 and (row.customer_id, row.model, row.history, row.tenure_days) == ("3", "B", ["A"], 366)


def test_splits(spark):
    dates = spark.createDataFrame([("2024-01-01",), ("2025-01-01",), ("2025-05-31",)], "d string").select(F.col("d").cast("timestamp").alias("purchase_date"))
    (given,) = P.split_bounds(dates, train_end="2024-06-01", validation_end="2025-03-01").collect()
    assert given.strategy == "configured"
    (default,) = P.split_bounds(dates).collect()
    assert (str(default.train_end), str(default.validation_end), default.strategy) == ("2025-01-31 00:00:00", "2025-04-01 00:00:00", "default_calendar")
    days = spark.range(10).select((F.lit("2025-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("purchase_date"))
    (few,) = P.split_bounds(days).collect()
    assert (few.train_end.day, few.validation_end.day, few.strategy) == (8, 9, "default_quantiles")
    with pytest.raises(ValueError, match="together"):
        P.split_bounds(dates, train_end="2024-01-01")
    with pytest.raises(ValueError, match="before"):
        P.split_bounds(dates, train_end="2025-01-01", validation_end="2024-01-01")
    assert P.split_bounds(dates.limit(0)).collect() == []


def test_current_customers(spark):
    rows = [
        dict(customer_id="100", model="OLD1", purchase_date="2021-01-01", size="37", last_name="Ann"), dict(customer_id="100", model="NEW1", purchase_date="2022-01-01", size="38", last_name=" "),
        dict(customer_id="200", model="NEW1", purchase_date="2022-01-01"), dict(customer_id="400", model="GONE", purchase_date="2022-01-01"),
    ]
    known = spark.createDataFrame([("100", "35-44"), ("200", None), ("300", None), ("99999999", None)], "customer_id string, age_group string")
    now = customers.current_customers(P.prepare_purchases(bought(spark, rows)), known, catalog(spark, OLD1=[1.0], NEW1=[1.0]), "2022-01-31", ["NEW1"])
    by = {r.customer_id: r for r in now.collect()}
    assert (by["100"].history, by["100"].customer_name, by["100"].last_purchased_size, by["100"].recency_days) == (["OLD1"], "Ann", "38", 30)
    assert str(by["100"].last_purchase_date) == "2022-01-01" and by["100"].excluded is None
    assert dict(customers.exclusions(now, known).collect()) == {"encoded": 1, "no_purchases": 2, "no_catalog_history": 1, "anonymous": 1}


def test_rankings(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], "2026-01-01"), ("b", [0.6, 0.8], "2026-02-01"), ("c", [0.0, 1.0], None)], "customer_id string, vector array<double>, last_purchase_date string")
    m = spark.createDataFrame([("M1", [1.0, 0.0]), ("M2", [0.0, 1.0])], "model string, vector array<double>")
    got = [(r.model, r.customer_rank, r.customer_id) for r in ranking.rank_customers(c, m, 2).orderBy("model", "customer_rank").collect()]
    assert got == [("M1", 1, "a"), ("M1", 2, "b"), ("M2", 1, "c"), ("M2", 2, "b")]
    got = [(r.customer_id, r.model) for r in ranking.rank_models(c, m, 1).orderBy("customer_id").collect()]
    assert got == [("a", "M1"), ("b", "M2"), ("c", "M2")]
    got = [(r.model, r.customer_id) for r in ranking.rank_eligible(c, m, "2026-03-02", 3).orderBy("model", "customer_rank").collect()]
    assert got == [("M1", "a"), ("M1", "c"), ("M2", "c"), ("M2", "a")]
    assert ranking.rank_customers(c, m.limit(0), 3).collect() == []


def test_ties_beyond_k_and_blocks_of_models(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MODELS", 4)
    monkeypatch.setattr(ranking, "CUSTOMERS", 7)
    c = spark.range(40).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("customer_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    m = spark.range(9).select(F.concat(F.lit("m"), "id").alias("model"), F.array(F.lit(1.0), F.lit(1.0)).alias("vector"))
    got = ranking.rank_customers(c, m, 3).filter("model = 'm4'").orderBy("customer_rank").collect()
    assert [r.customer_id for r in got] == ["00", "01", "02"]
    assert ranking.rank_models(c, m, 2).filter("customer_id = '07'").orderBy("rank_for_customer").collect()[1].model == "m1"


def test_several_rankings_of_one_product(monkeypatch):
    curve, rng = calibration.Calibrator((0.10, 0.40, 0.55, 0.70), (0.0, 1 / 3, 1.0, 1.0)), np.random.default_rng(5)
    for n, m, k in ((211, 7, 5), (90, 13, 40), (3, 4, 6)):
        x, y = np.repeat(rng.normal(size=(n, 9)), 3, axis=0) / 4, rng.normal(size=(m, 9))  # three times each, so that ties are everywhere
        x[4] = np.nan
        some = rng.random(len(x)) < 0.7
        monkeypatch.setattr(ranking, "TILE", 16 * m)
        found = ranking.best_of_columns(x, y, k, [(np.ones(len(x), bool), None), (some, curve)])
        for (rows, columns, worth, dots), (among, values) in zip(found, ((some | True, lambda v: v), (some, curve.values))):
            for j in range(m):
                value = values(np.array([np.einsum("ij,ij->i", x[i : i + 1], y[j : j + 1])[0] for i in range(len(x))]))
                want = sorted(np.flatnonzero(among), key=lambda i: (np.inf if np.isnan(value[i]) else -value[i], i))[:k]
                assert sorted(rows[columns == j]) == sorted(want)
                assert np.array_equal(worth[columns == j], value[rows[columns == j]], equal_nan=True)


def test_equal_customers_tie_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    v = [float(x) for x in rng.normal(size=64)]
    for n in (5, 17, 101):
        c = spark.createDataFrame([(f"{i:03d}", v) for i in range(n)], "customer_id string, vector array<double>")
        m = spark.createDataFrame([(f"m{i}", [float(x) for x in rng.normal(size=64)]) for i in range(13)], "model string, vector array<double>")
        got = ranking.rank_customers(c, m, 3).collect()
        assert {(r.customer_rank, r.customer_id) for r in got} == {(1, "000"), (2, "001"), (3, "002")}


def test_what_a_curve_isnt_above():
    rng = np.random.default_rng(7)
    for _ in range(40):
        curve = calibration.Calibrator(tuple(np.sort(rng.random(6))), tuple(np.sort(np.round(rng.random(6), rng.integers(1, 9)))))
        at = np.concatenate([rng.random(400) * 1.4 - 0.2, curve.x])
        value, most = curve.values(at), curve.up_to(curve.values(at))
        assert not any(((at <= t) & (value > v)).any() for t, v in zip(most, value))


def test_both_rankings_read_the_purchases_once(spark, monkeypatch):
    from fernweave.plans import queries, tables

    d, read, made = "/root/testdata/sf0.001", [], []
    prepared, best = tables.prepared, ranking.by_blocks
    monkeypatch.setattr(tables, "prepared", lambda *a: read.append(a) or prepared(*a))
    monkeypatch.setattr(ranking, "by_blocks", lambda *a: made.append(a) or best(*a))
    out = queries.like_score_report(spark, d)
    assert len(read) == len(made) == 1 and {r.ranking for r in out.collect()} == {"similarity", "like_score"}
    people, models = queries._vectors(spark, d), queries._models(spark, d)
    both = ranking.rank_both(people, models, tables.AS_OF, 5, queries.CURVE).collect()
    alone = {"similarity": ranking.rank_customers(people, models, 5), "like_score": ranking.rank_eligible(people, models, tables.AS_OF, 5, queries.CURVE)}
    for name, ranked in alone.items():
        assert {(r.model, r.customer_rank, r.customer_id, r.score) for r in both if r.ranking == name} == {(r.model, r.customer_rank, r.customer_id, r.score) for r in ranked.collect()}
    now = queries._current(spark, d).filter("excluded is null")
    now = {(r.customer_id, r.last_purchase_date, tuple(r.catalog_history[-3:])) for r in now.collect()}
    assert {(r.customer_id, r.last_purchase_date, tuple(r.catalog_history)) for r in customers.recent_histories(prepared(spark, d), tables.catalog(spark, d), tables.TIES, 3).collect()} == now


def test_violations_make_the_histories_once(spark, monkeypatch):
    from fernweave.plans import queries, tables

    read, prepared = [], tables.prepared
    monkeypatch.setattr(tables, "prepared", lambda *a: read.append(a) or prepared(*a))
    got = {(r.model, r.problem) for r in queries.ranking_violations(spark, "/root/testdata/sf0.001").collect()}
    assert len(read) == 1 and {p for _, p in got} == {"rank", "order", "repeated", "anonymous", "absent", "history"} and (None, "history") in got


def test_histories_where_the_catalog_is_sent_to_all_tasks_or_not(spark, monkeypatch):
    rows = [dict(customer_id=str(i % 3), model=m, purchase_date=f"2021-01-{1 + i:02d}", size=str(i), discount=float(i % 2)) for i, m in enumerate(["A", "GONE", "B", "A", "C", "GONE", "B", "5.0", "A", "GONE"])]
    known, prepared = catalog(spark, A=[1.0], B=[1.0], C=None, **{"5": [1.0]}), P.prepare_purchases(bought(spark, rows))
    profiles, found = spark.createDataFrame([(str(i), "35-44") for i in range(3)], "customer_id string, age_group string"), []
    for most in (200_000, 0):
        monkeypatch.setattr(customers, "KNOWN", most, raising=False)
        now = customers.current_customers(prepared, profiles, known, "2022-01-31")
        found.append((sorted(now.collect()), sorted(customers.recent_histories(prepared, known, max_history=2).collect())))
    assert found[0] == found[1]
    assert {r.customer_id: r.catalog_history for r in found[0][1]} == {"0": ["A", "B"], "1": ["5"], "2": ["B", "A"]}
    assert {r.customer_id: str(r.last_purchase_date) for r in found[0][1]} == {"0": "2021-01-10", "1": "2021-01-08", "2": "2021-01-09"}


def test_amounts_and_ids_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    for kind, values in (("double", [1.0, 0.0, -1.0, nan, inf, None, 1e-300]), ("string", ["1", "0", "-1", "NaN", "Infinity", None, "1e-300", "x"])):
        df = spark.createDataFrame([("1", str(i), v) for i, v in enumerate(values)], f"customer_id string, model string, quantity {kind}").withColumn("purchase_date", F.lit("2021-01-01").cast("timestamp"))
        assert {r.model for r in P.prepare_purchases(df).collect()} == {"0", "6"}
    from fernweave.functions import scalars as S

    ids = {"12.0": "12", " 7.0 ": "7", "1.05": "1.05", "--3.0": "--3", "a.0": "a.0", "1.0.0": "1.0.0", "None": None, "": None, "8": "8"}
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", S.normalize_id(F.col("i")).alias("n")).collect()
    assert {r.i: r.n for r in got} == ids


def test_target_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MODELS", 2)
    models = spark.createDataFrame([("A", 0, [1.0, 0.0]), ("B", 1, [0.0, 1.0]), ("C", 2, [1.0, 0.0]), ("D", 3, [2.0, 0.0])], "model string, position long, vector array<double>")
    people = spark.createDataFrame([("x", [1.0, 0.0], "C", 2, [1.0, 0.0]), ("y", [0.0, 1.0], "B", 1, [0.0, 1.0])], "customer_id string, vector array<double>, target string, target_position long, target_vector array<double>")
    assert dict(ranking.target_ranks(people, models).collect()) == {"x": 3, "y": 1}


def test_overlap_and_violations(spark):
    rows = [(m, 1, "1", 0.9) for m in "ABC"] + [(m, 2, m, 0.5) for m in "ABC"]
    ranked = spark.createDataFrame(rows, "model string, customer_rank int, customer_id string, score double")
    (row,) = ranking.overlap(ranked).collect()
    assert (row.unique_customers, row.most_models, row.most_repeated, row.average_models) == (4, 3, "1", 1.5)
    assert ranking.violations(ranked).collect() == []
    bad = spark.createDataFrame([("A", 1, "1", 0.1), ("A", 3, "1", 0.9)], ranked.schema)
    assert {r.problem for r in ranking.violations(bad).collect()} == {"rank", "order", "repeated"}


def test_calibrator():
    x, y = calibration.thin([0.10, 0.25, 0.40, 0.55, 0.70], [0.0, 0.0, 1 / 3, 1.0, 1.0])
    assert x == [0.10, 0.40, 0.55, 0.70] and y == [0.0, 1 / 3, 1.0, 1.0]
    curve = calibration.Calibrator(tuple(x), tuple(y))
    assert calibration.Calibrator.loads(curve.dumps()) == curve
    for bad in (((0.1,), (0.0,)), ((0.2, 0.1), (0.0, 1.0)), ((0.1, 0.2), (1.0, 0.0))):
        with pytest.raises(ValueError):
            calibration.Calibrator(*bad)


def test_calibrator_fit(spark):
    pairs = [(0.70, 1)] * 40 + [(0.55, 1)] * 30 + [(0.40, 1)] * 10 + [(0.10, 0)] * 200 + [(0.25, 0)] * 80 + [(0.40, 0)] * 20
    curve = calibration.fit(spark.createDataFrame(pairs, "similarity double, label int"))
    assert curve.x == (0.10, 0.40, 0.55, 0.70) and curve.y == pytest.approx((0, 1 / 3, 1, 1))
    values = [0.0, 0.25, 0.30, 0.55, 0.9]
    df = spark.createDataFrame([(v,) for v in values], "s double").select(curve.transform(F.col("s")))
    assert [r[0] for r in df.collect()] == pytest.approx([0, 1 / 6, 2 / 9, 1, 1])


def test_negative_sample(spark):
    examples = spark.range(50).select(F.col("id").alias("example_id"), F.concat(F.lit("m"), F.col("id") % 30).alias("target"))
    models = spark.range(30).select(F.concat(F.lit("m"), "id").alias("model"))
    got = calibration.negative_sample(examples, models, 8).collect()
    assert all(r.negative != r.target for r in got) and len({(r.example_id, r.negative) for r in got}) == len(got)
    assert all(sum(r.example_id == i for r in got) == 8 for i in range(50))
    few = calibration.negative_sample(examples, models.limit(9), 8).groupBy("example_id").count().collect()
    assert all(r["count"] == 8 for r in few)


def test_image_ranking(spark):
    rows = [("52792_006", "side", [1.0, 0.0], 0), ("52160_001", "pers", [0.8, 0.6], 1), ("52792_006", "main", [0.0, 1.0], 2), ("9", "main", [0.8, 0.6], 3)]
    images = spark.createDataFrame(rows, "model string, image_type string, embedding array<double>, position int")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    got = [(r.model, r.image_type) for r in retrieval.rank_images(asked, images).orderBy("rank").collect()]
    assert got[:3] == [("52792_006", "side"), ("52160_001", "pers"), ("9", "main")]
    best = retrieval.rank_models_by_best(asked, images).orderBy("rank").collect()
    assert [(r.model, r.best_image_type) for r in best] == [("52792_006", "side"), ("52160_001", "pers"), ("9", "main")]


def test_text_candidates(spark):
    df = spark.createDataFrame([("a", [0.2, 0.8]), ("b", [1.0, 0.0]), ("c", [0.7, 0.3])], "id string, embedding array<double>")
    got = retrieval.rank_candidates(df, V.literal([1.0, 0.0]), 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c"]
    tied = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], df.schema)
    assert [r.id for r in retrieval.rank_candidates(tied, V.literal([1.0, 0.0])).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="BLANK_CANDIDATE_ID"):
        retrieval.rank_candidates(spark.createDataFrame([(" ", [1.0, 0.0])], df.schema), V.literal([1.0, 0.0])).collect()
    assert [r.id for r in retrieval.repeated_ids(df.unionByName(df.limit(1))).collect()] == ["a"]


def test_memory(spark):
    base = ("customer_success", "unreviewed", "text", "text", "", [1.0, 0.0], [1.0, 0.0], "w1")
    schema = "case_key string, role_id string, review_status string, recognition_text string, case_text string, case_summary string, recognition_vector array<double>, case_vector array<double>, wa_id string"
    rows = [("k1", *base), ("k0", "", "approved", "text", "text", "", [1.0, 0.0], [1.0, 0.0], "w2"), ("k2", "sales", *base[1:]), ("k3", base[0], base[1], "", "", "", *base[5:]), ("k4", base[0], base[1], " ", "", "summary", [0.0, 0.0], [0.0, 0.0], "w3")]
    cases = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    got = [(r.query_id, r.case_key, round(r.score, 6)) for r in retrieval.memory_search(cases, asked).orderBy("rank").collect()]
    assert got == [("q", "k0", 1.1), ("q", "k1", 1.0), ("q", "k4", -1.0)]
    left = retrieval.memory_search(cases, asked, "case", exclude={"wa_id": ["w2", " "]}, k=0).collect()
    assert [r.case_key for r in left] == ["k1"]


def test_failure_classes(spark):
    rows = [(True, 0.90, 0.70, "e", "c", "c"), (True, 0.66, 0.69, "e", "c", "c"), (False, 0.9, 0.7, "e", "c", "c"), (None, 0.9, 0.7, "e", "c", "e"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ok boolean, e double, c double, em string, cm string, p string")
    assert [r[0] for r in df.select(retrieval.failure_class(*[F.col(c) for c in df.columns])).collect()] == ["A", "C", "B", "ok", "C"]


def test_rank_metrics(spark):
    df = spark.createDataFrame([(1,), (5,), (11,), (20,)], "rank int")
    (m,) = metrics.ranking_metrics(df).collect()
    assert (m.recall_5, m.recall_10, m.recall_20, m.examples) == (0.5, 0.5, 1.0, 4)
    assert m.ndcg_10 == pytest.approx((1 + 1 / math.log2(6)) / 4) and m.mrr == pytest.approx((1 + 1 / 5 + 1 / 11 + 1 / 20) / 4)
    (none,) = metrics.ranking_metrics(df.limit(0)).collect()
    assert (none.recall_5, none.mrr, none.examples) == (0, 0, 0)
    scores = spark.createDataFrame([("q", 0, 0.5, False), ("q", 1, 0.5, True), ("q", 2, 0.5, False), ("q", 3, 0.9, False)], "query_id string, position int, score double, is_target boolean")
    assert metrics.target_ranks(scores).first().rank == 3


def test_retrieval_and_decision_metrics(spark):
    found = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "query_id string, case_key string, rank int")
    expected = spark.createDataFrame([("a", "case", ["y"]), ("b", "case", []), ("c", "recognition", ["x"])], "query_id string, mode string, keys array<string>")
    got = {r.mode: (r.queries, r.hit_1, r.hit_3, r.recall_5) for r in metrics.retrieval_metrics(found, expected).collect()}
    assert got == {None: (3, 0, pytest.approx(1 / 3), pytest.approx(2 / 3)), "case": (2, 0, 0.5, 1), "recognition": (1, 0, 0, 0)}
    results = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None)], "expected string, predicted string")
    (d,) = metrics.decision_metrics(results).collect()
    assert (d.precision, d.coverage) == (0.5, pytest.approx(2 / 3))
    assert metrics.confusion(results, ["a", "b"]).orderBy("expected").collect()[0].a == 1
    assert metrics.smallest_good(spark.createDataFrame([(64, 0.094), (128, 0.1018), (32, 0.05)], "dimension int, recall_10 double")).first()[0] == 64


def test_encoders(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None), (5, "nan")], "position int, c string")
    words = encoders.vocabulary(df, "c", "position")
    assert dict(words.collect()) == {"a": 2, "b": 3}
    assert [r.i for r in encoders.index_of(df, "c", words, "i").orderBy("position").collect()] == [2, 3, 3, 1, 1]
    numbers = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    scaler = encoders.numeric_scaler(numbers, ["x", "y"])
    assert tuple(scaler.first()) == (2, 1, 5, 1)
    assert [tuple(r) for r in encoders.scaled(numbers, scaler, ["x", "y"]).collect()] == [(-1, 0), (1, 0)]
    assert [encoders.embedding_width(n) for n in (2, 10, 100)] == [4, 5, 16] and encoders.hidden_width(64) == 128


def test_towers(spark, tmp_path):
    w = towers.random_weights(4, 8, {"c": 5}, 3, 2, seed=1)
    models = spark.createDataFrame([("A", [1.0, 0.0, 0.0, 0.0], [2]), ("B", [0.0, 1.0, 0.0, 0.0], [3])], "model string, visual array<double>, categories array<int>")
    vectors = towers.model_vectors(models, w)
    people = spark.createDataFrame([("x", ["A", "B", "GONE"], 2, [0.1, 0.2]), ("y", [], 1, [0.0, 0.0])], "customer_id string, catalog_history array<string>, age int, numeric array<double>")
    got = {r.customer_id: np.array(r.vector) for r in towers.customer_vectors(people, vectors, w).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    m = towers.encode_models(np.eye(4)[:2], np.array([[2], [3]]), w)
    s = m @ w["attention.w"][:, 0] + w["attention.b"][0]
    pooled = (np.exp(s) / np.exp(s).sum()) @ m
    hidden = np.maximum(np.concatenate([pooled, w["age"][2], [0.1, 0.2]]) @ w["customer.0.w"] + w["customer.0.b"], 0)
    out = hidden @ w["customer.1.w"] + w["customer.1.b"]
    assert got["x"] == pytest.approx(out / np.linalg.norm(out))
    towers.save(w, str(tmp_path / "w.npz"))
    assert all((towers.load(str(tmp_path / "w.npz"))[k] == v).all() for k, v in w.arrays.items())
    assert towers.in_batch_loss(np.eye(3), np.eye(3)) < towers.in_batch_loss(np.eye(3), np.eye(3)[::-1])


def verdict(model, v="same", shape=0.9, pattern=0.9, material=0.9, details=0.9, contradictions=(), reason=""):
    return (model, v, str(shape), str(pattern), str(material), str(details), "1", list(contradictions), reason)


def test_identity(spark):
    rows = [
        ([verdict("A"), verdict("B", "different")], ["A", "B"]), ([verdict("A"), verdict("B")], ["A", "B"]), ([verdict("A", details=0.3)], ["A"]),
        ([verdict("X")], ["A"]), ([verdict("X", reason="why", shape="2")], []), ([], ["A"]), (None, ["A"]), ([verdict("A", shape=0.4, contradictions=["strap"])], ["A"]), ([verdict("A", "SAME ", contradictions=["strap"])], ["A"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"request_id int, candidates {decisions.ROWS}, retrieved array<string>")
    got = [(r.status, r.model, r.reason) for r in decisions.decide_identity(df).orderBy("request_id").collect()]
    assert got == [
        ("match", "A", "unique_same_model"), ("uncertain", None, "ambiguous_same_models:A,B"), ("uncertain", None, "no_unique_same_model"), ("uncertain", None, "no_unique_same_model"), ("match", "X", "why"),
        ("uncertain", None, "verifier_empty"), ("uncertain", None, "verifier_failed"), ("uncertain", None, "no_unique_same_model"), ("match", "A", "unique_same_model"),
    ]


def test_best_crop(spark):
    crops = [
        [(0.5, 100.0, True), (0.5 + 1e-8, 50.0, False)], [(0.5, 100.0, True), (0.4, 50.0, False)], [(0.5, 90.0, False), (0.5, 50.0, False)], [(float("nan"), 1.0, True), (float("nan"), 1.0, False)], [(None, 100.0, True), (-0.2, 5.0, False)], [],
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(crops)], "i int, c array<struct<score:double,area:double,full:boolean>>")
    assert [r[0] for r in df.orderBy("i").select(decisions.best_crop(F.col("c"))).collect()] == [1, 0, 1, 0, 1, None]


def test_routing(spark):
    rows = [("thank you for your order #12345", True, "shoe", 0.9, 0.1), ("on the way 123456789", True, "shoe", 0.9, 0.1), ("", True, "order", 0.9, 0.1), ("", False, "order", 0.1, 0.1), ("", False, "garbage", 0.9, 0.1), ("", False, "unknown", 0.22, 0.24), ("", False, "unknown", 0.1, 0.4), (None, False, "shoe", 0.1, 0.4)]
    df = spark.createDataFrame(rows, "t string, s boolean, scene string, f double, j double")
    got = [r[0] for r in df.select(decisions.route(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["order", "delivery_notice", "shoe", "order", "garbage", "unknown", "garbage", "unknown"]
    kinds = spark.createDataFrame([("unknown", 1), ("unknown", 0), ("shoe", 2), ("shoe", 0), ("order", 0)], "k string, n int")
    assert [r[0] for r in kinds.select(decisions.status_of(F.col("k"), F.col("n"))).collect()] == ["needs_verification", "uncertain", "needs_verification", "garbage", "order"]


def test_integrity(spark):
    u = [1.0, 0.0]
    rows = [("A", "main", u, "m"), ("A", "main", [0.0, 1.0], "m"), ("B", "main", u, "other"), ("C", "side", [2.0, 0.0], "m")]
    images = spark.createDataFrame(rows, "model string, image_type string, embedding array<double>, embedding_model string")
    got = {(r.model, r.issue) for r in integrity.catalog_issues(images, "m", 2).collect()}
    assert got == {("A", "duplicate_key"), ("A", "duplicate_vector"), ("B", "embedding_model"), ("C", "norm")}
    assert tuple(integrity.catalog_counts(images).first()) == (4, 3)
    table = integrity.VersionedTable(images)
    assert not table.refresh(lambda: images.limit(0), lambda df: not df.isEmpty()) and table.current is images and table.error
    assert table.refresh(lambda: images.limit(1), lambda df: True) and table.current.count() == 1
    scores = spark.createDataFrame([("A", "main", "A", "main", 0.9), ("A", "main", "B", "main", 0.95), ("B", "main", "B", "main", 1.0)], "query_model string, query_type string, model string, image_type string, similarity double")
    assert [r.query_model for r in integrity.self_retrieval(scores).collect()] == ["A"]
