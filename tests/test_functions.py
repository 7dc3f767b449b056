import math

import pytest
from pyspark.sql import functions as F

from fernweave.functions import extraction as E
from fernweave.functions import scalars as S
from fernweave.functions import vectors as V


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_ids_and_categories(spark):
    given = [" 12 ", "123.0", "-7.0", "1.50", "None", "NaN", "nat", "", None, "null"]
    assert column(spark, given, "string", S.normalize_id) == ["12", "123", "-7", "1.50", None, None, None, None, None, "null"]
    assert column(spark, given, "string", S.category)[4:] == [S.UNKNOWN] * 6
    assert column(spark, [123.0], "double", S.normalize_id) == ["123"]


def test_numbers(spark):
    given = ["0.5", "x", "NaN", "Infinity", None, "-1", "2"]
    assert column(spark, given, "string", S.finite) == [0.5, None, None, None, None, -1.0, 2.0]
    assert column(spark, given, "string", S.unit) == [0.5, 0, 0, 0, 0, 0, 1]
    assert column(spark, ["0", "50", None, "x"], "string", S.is_discount) == [False, True, False, False]


def test_recency(spark):
    days = [59, 60, 180, 181, 364, 365, 1094, 1095, None, -3]
    assert column(spark, days, "int", S.recency_bucket) == ["<60d", "60-180d", "60-180d", "181-365d", "181-365d", "1-3y", "1-3y", "3y+", "unknown", "<60d"]
    assert column(spark, days, "int", S.is_recent) == [True, False, False, False, False, False, False, False, False, True]
    dates = ["2026-01-01", "2026-01-01T10:00:00", "", "none", None, "2026-03-02"]
    assert column(spark, dates, "string", lambda c: S.days_since(c, F.lit("2026-03-01").cast("date"))) == [59, 59, None, None, None, -1]


def test_small_functions(spark):
    assert column(spark, ["approved", " Draft ", "unreviewed", ""], "string", S.review_weight) == [1.10, 1.02, 1.0, 1.0]
    assert column(spark, ["main", "side"], "string", lambda c: S.image_url("u", F.lit("5_1"), c)) == ["u/5_1.jpg", "u/5_1_side.jpg"]
    assert column(spark, ["data:image/png;base64,aGk=", "aGk=", "", "*"], "string", lambda c: S.image_bytes(c).cast("string"))[:3] == ["hi", "hi", None]
    assert column(spark, [["a", "", None], None], "array<string>", S.positive_list) == [["a"], []]
    assert column(spark, ['{"a":"1"}', "", None], "string", S.json_map) == [{"a": "1"}, {}, {}]
    assert column(spark, [list(range(30))], "array<int>", lambda c: S.last_items(c, 8)) == [list(range(22, 30))]


def test_parse_vectors(spark):
    given = ["[1, 2, 3]", "null", "[]", "nope", None, '[1, "NaN"]', "[1, null]"]
    assert column(spark, given, "string", V.parse_vector) == [[1, 2, 3], None, None, None, None, None, None]


@pytest.mark.parametrize("views, want", [
    (([1, 0, 0], [0, 1, 0], [0, 0, 1]), [1 / math.sqrt(3)] * 3),
    (([3, 0, 4], None, None), [0.6, 0, 0.8]),
    ((None, None, None), None),
    (([0, 0], None, [0, 0]), None),
    (([1, 0], [1, 0, 0], [0, 1, 0]), [1 / math.sqrt(2), 1 / math.sqrt(2), 0]),
    (([2, 0], [1, 0, 0], None), [1, 0]),
])
def test_combine_views(spark, views, want):
    df = spark.createDataFrame([tuple([float(x) for x in v] if v else None for v in views)], "a array<double>, b array<double>, c array<double>")
    (row,) = df.select(V.combine_views(*[F.col(c) for c in "abc"]).alias("out")).collect()
    assert row.out is None if want is None else row.out == pytest.approx(want)


def test_cosine_errors(spark):
    pair = spark.createDataFrame([([1.0, 0.0], [1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert pair.select(V.cosine(F.col("a"), F.col("a"))).first()[0] == 1
    for other, name in (("b", "VECTOR_DIMENSION_MISMATCH"), ("z", "ZERO_VECTOR")):
        with pytest.raises(Exception, match=name):
            pair.select(V.cosine(F.col("a"), F.col(other))).collect()


def test_scene_ties(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.5, 0.1), (0.4, 0.5, 0.1)], "f double, g double, o double")
    f, g, o = (F.col(c) for c in "fgo")
    got = rows.select(V.scene_kind(f, g, o), V.relevance(f, g), V.non_shoe_kind(g, o, f)).collect()
    assert [tuple(r) for r in got] == [("order", "footwear", "order"), ("shoe", "footwear", "delivery_notice"), ("garbage", "irrelevant", "garbage")]


def test_vector_flags(spark):
    unit = [1.0] + [0.0] * 3
    given = [unit, [2.0, 0.0, 0.0, 0.0], [1.0], [], [float("nan"), 0.0, 0.0, 0.0]]
    got = column(spark, given, "array<double>", lambda c: V.vector_flags(c, F.lit("m"), "m", 4))
    assert got == [[], ["norm"], ["dimension"], ["dimension", "empty"], ["non_finite", "norm"]]
    assert column(spark, [[1.0], unit], "array<float>", lambda c: V.fits(c, 4)) == [[0, 0, 0, 0], unit]


def test_order_text(spark):
    given = [
        "New Order #87610 from a customer - 38.5 model 53698_003385",
        "CS5224717794 or CS224717794 or CS2247177794".replace("CS5224717794", "5224717794"),
        "C52247177794", "8S12345678", "מידה 38,5", "nothing", None, "Order number: AB123456", "#12345",
    ]
    assert column(spark, given, "string", E.order_number) == ["87610", "CS2247177794", "CS2247177794", "BS12345678", None, None, None, "AB123456", "12345"]
    assert column(spark, given, "string", E.model_code)[0] == "53698_003"
    assert [column(spark, given, "string", E.shoe_size)[i] for i in (0, 4, 5)] == ["38.5", "38.5", None]


def test_delivery_text(spark):
    given = ["On The Way! your parcel 102312132 comes", "parcel 102312132", "Tracking number: 12345678", "מספר משלוח 123456789", None]
    assert column(spark, given, "string", E.tracking_number) == ["102312132", None, "12345678", "123456789", None]
    assert column(spark, given, "string", E.delivery_status) == ["on_the_way", None, None, None, None]
    kinds = ["Thank you for your order, it is on the way", "אישור הזמנה", "hello", " ", None]
    assert column(spark, kinds, "string", E.document_kind) == ["delivery_notice", "order", None, None, None]
    assert column(spark, ["thank you for your order #12345", "#12345", "CS12345678"], "string", E.strong_order) == [True, False, True]
    assert column(spark, ["on the way 123456789", "packed 123456789"], "string", E.strong_delivery) == [True, False]
