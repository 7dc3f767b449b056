"""Answers and payloads of many shapes against plain readings of them."""

import json

from pyspark.sql import functions as F

from fernweave.operators import decisions
from fernweave.sources import snapshots

ROWS = {"candidates": [{"model": "A", "verdict": "same", "shape": 0.9}]}
TEXT = json.dumps(ROWS)
ANSWERS = [
    (TEXT, "A"), (f"```json\n{TEXT}\n```", "A"), (f"well: {TEXT} done", "A"), (json.dumps(TEXT), "A"),
    (json.dumps({"text": TEXT}), "A"), (json.dumps({"text": " ", "output_text": f"```{TEXT}```"}), "A"), (json.dumps({"result": "failed", **ROWS}), None),
    (json.dumps([{"content": [{"text": TEXT[:20]}, TEXT[20:30], {"other": 1}, 7]}, "skipped", {"text": TEXT[30:]}]), "A"),
    (json.dumps([{"content": "no list", "text": TEXT}]), "A"), (json.dumps([{"content": [{"text": {"deep": 1}}, {"text": TEXT}]}]), "A"),
    ("[]", None), ("{}", None), (json.dumps({"text": 5}), None), ("", None), (None, None), ("no json {", None), ('{"candidates": []}', ""), ("17", None), ("[[1]]", None),
]


def test_answers_of_all_forms(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").repartition(3)
    got = {r.i: r.c for r in df.select("i", decisions.parse_output(F.col("a")).alias("c")).collect()}
    for i, (answer, want) in enumerate(ANSWERS):
        assert (got[i] is None) == (want is None), answer
        assert want is None or [r.model for r in got[i]] == ([want] if want else []), answer


def test_payloads_of_all_forms(spark):
    good = {"model_id": 1, "model": "A", "images": {"main": "https://x/a", "side": " ", "pers": None, "back": "https://x/b"}}
    odd = [7, {"model": "B"}, {"model_id": 2, "model": None, "images": {}}, {"model_id": {"x": 1}, "model": 5, "images": {"main": ["l"]}}, {"model": "C", "images": {}}, {"model": " ", "images": {"main": "http://y"}}]
    bodies = [json.dumps({"models": [good, *odd]}), "{broken", None, "[]", '{"models": {"a": 1}}', json.dumps({"models": []})]
    jobs, errors = snapshots.payload_jobs(spark.createDataFrame([(b,) for b in bodies], "payload string").repartition(2))
    assert [tuple(r) for r in jobs.collect()] == [("1", "A", "main", "https://x/a")]
    assert sorted((r.error, r.model or "", r.image_type or "") for r in errors.collect()) == sorted(
        [("INVALID_URL", "A", "side"), ("INVALID_URL", "A", "pers"), ("INVALID_MODEL_ENTRY", "", ""), ("INVALID_MODEL_ENTRY", "B", ""), ("INVALID_MODEL_ENTRY", "", ""), ("INVALID_URL", "5", "main"), ("INVALID_MODEL", "", "main")]
        + [("MALFORMED_JSON", "", "")] * 2 + [("UNSUPPORTED_PAYLOAD", "", "")] * 2
    )
