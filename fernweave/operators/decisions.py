"""Decisions: identity verification and routing of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extraction as E
from ..functions import scalars as S

#: Fixed values.
LEAST = {"shape": 0.5, "pattern": 0.5, "material": 0.55, "details": 0.55}
MEASURES = ("shape", "pattern", "material", "details", "color_placement")
CATALOG_SHOE_MIN, GARBAGE_MARGIN, MIN_PANEL_AREA, SCORE_TIE = 0.62, 0.05, 0.12, 1e-6

ROWS = "array<struct<model:string,verdict:string,shape:string,pattern:string,material:string,details:string,color_placement:string,contradictions:array<string>,reason:string>>"


def parse_verdicts(output: Column) -> Column:
    """candidates of a verifier's text: plain JSON, fenced JSON, or what is between the first and the last brace; null if none."""
    schema = f"struct<candidates:{ROWS}>"
    fenced = F.regexp_extract(output, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    inner = F.regexp_extract(output, r"(?s)(\{.*\})", 1)
    found = [F.from_json(F.when(x != "", x), schema)["candidates"] for x in (fenced, F.trim(output), inner)]
    return F.coalesce(*found)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY and others: the outermost type of a variant; null for none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _said(part: Column) -> Column:
    """The text of a part of an answer: the part itself, or its field text, if that is a text; else nothing."""
    inner = F.try_variant_get(part, "$.text", "variant")
    return F.when(_kind(part) == "STRING", F.try_variant_get(part, "$", "string")).when((_kind(part) == "OBJECT") & (_kind(inner) == "STRING"), F.try_variant_get(inner, "$", "string")).otherwise("")


def _list(value: Column, path: str) -> Column:
    """The items of an array of any items; none where it is anything else."""
    held = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.when(_kind(held) == "ARRAY", F.try_variant_get(held, "$", "array<variant>")), F.array().cast("array<variant>"))


def output_text(output: Column) -> Column:
    """The text of a verifier's answer to read verdicts from; null where it failed.

    An answer is a text, an object with candidates (itself), an object with a text in text or output_text, or a list of items, whose
    contents and own texts are joined. An object whose result is "failed" is a failure, and so is null.
    """
    value = F.try_parse_json(output)
    items = F.filter(_list(value, "$"), lambda i: _kind(i) == "OBJECT")
    chunks = F.flatten(F.transform(items, lambda i: F.array_append(F.transform(_list(i, "$.content"), _said), _said(i))))
    told = lambda name: F.when(_kind(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(value, f"$.{name}", "string")), F.lit("")))
    whole = F.when(F.try_variant_get(value, "$.result", "string") == "failed", F.lit(None).cast("string"))
    whole = whole.when(_kind(F.try_variant_get(value, "$.candidates", "variant")) == "ARRAY", output).otherwise(F.coalesce(told("text"), told("output_text")))
    quoted = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "OBJECT", whole).when(_kind(value) == "ARRAY", F.array_join(chunks, "")).when(_kind(value) == "STRING", quoted).otherwise(output)


def parse_output(output: Column) -> Column:
    """candidates of a verifier's answer in any of its forms (output_text); null where it failed or holds none."""
    return parse_verdicts(output_text(output))


def normalize_verdict(row: Column) -> Column:
    verdict = F.lower(F.trim(F.coalesce(row["verdict"], F.lit("uncertain"))))
    return F.struct(
        F.trim(F.coalesce(row["model"], F.lit(""))).alias("model"),
        F.when(verdict.isin("same", "different", "uncertain"), verdict).otherwise("uncertain").alias("verdict"),
        *[S.unit(row[c]).alias(c) for c in MEASURES],
        F.filter(F.coalesce(row["contradictions"], F.array().cast("array<string>")), lambda c: c.isNotNull() & (F.trim(c) != "")).alias("contradictions"),
        F.coalesce(row["reason"], F.lit("")).alias("reason"),
    )


def excluded(row: Column) -> Column:
    """A contradiction beside a low measure, or "same" in spite of low material or details."""
    low = {c: row[c] < least for c, least in LEAST.items()}
    weak = low["material"] | low["details"]
    return ((F.size(row["contradictions"]) > 0) & (weak | low["shape"] | low["pattern"])) | ((row["verdict"] == "same") & weak)


def decide_identity(requests: DataFrame) -> DataFrame:
    """requests (request_id, candidates, retrieved) with status, model, confidence, reason.

    candidates: verdict rows, null if the verifier failed. retrieved: models that were asked about; others are dropped
    unless it is empty. One "same" that isn't excluded is a match, more are ambiguous.
    """
    rows = F.transform("candidates", normalize_verdict)
    known = F.filter(rows, lambda r: (r["model"] != "") & ((F.size("retrieved") == 0) | F.array_contains("retrieved", r["model"])))
    out = requests.withColumn("_same", F.filter(known, lambda r: (r["verdict"] == "same") & ~excluded(r)))
    same, n = F.col("_same"), F.size("_same")
    first = F.get(same, 0)
    names = F.array_join(F.transform(same, lambda r: r["model"]), ",")
    reason = (
        F.when(F.col("candidates").isNull(), "verifier_failed")
        .when(F.size("candidates") == 0, "verifier_empty")
        .when(n == 1, F.coalesce(F.nullif(first["reason"], F.lit("")), F.lit("unique_same_model")))
        .when(n > 1, F.concat(F.lit("ambiguous_same_models:"), names))
        .otherwise("no_unique_same_model")
    )
    one = F.coalesce(n == 1, F.lit(False))
    confidence = F.when(one, F.least(first["shape"], first["pattern"], first["details"]))
    return out.withColumns({"status": F.when(one, "match").otherwise("uncertain"), "model": F.when(one, first["model"]), "confidence": confidence, "reason": reason}).drop("_same")


def best_crop(crops: Column) -> Column:
    """The index of the best crop of an array of (score, area, full): higher score, else isolated, else smaller.

    Scores within SCORE_TIE are equal; that relation isn't transitive, so crops are compared one by one in their order.
    """

    def prefer(best: Column, x: Column) -> Column:
        tie = F.when(x["full"] != best["full"], ~x["full"]).otherwise(x["area"] < best["area"])
        better = F.when(F.coalesce(F.isnan(x["score"]) | (F.abs(x["score"]) == float("inf")), F.lit(True)), False).when(x["score"] > best["score"] + SCORE_TIE, True).when(x["score"] < best["score"] - SCORE_TIE, False).otherwise(tie)
        return F.when(better, x).otherwise(best)

    numbered = F.transform(crops, lambda c, i: F.struct(F.coalesce(c["score"].cast("double"), F.lit(float("-inf"))).alias("score"), c["area"].cast("double").alias("area"), c["full"].alias("full"), i.alias("at")))
    return F.when(F.size(crops) > 0, F.aggregate(F.slice(numbered, 2, F.greatest(F.size(crops) - 1, F.lit(0))), F.get(numbered, 0), prefer)["at"])


def is_shoe(relevance: Column, catalog_score: Column, area_share: Column, full: Column) -> Column:
    """Footwear by its prompt or by the catalog, on a crop that isn't tiny."""
    return (full | (area_share >= MIN_PANEL_AREA)) & ((relevance == "footwear") | (catalog_score >= CATALOG_SHOE_MIN))


def confident_garbage(scene: Column, footwear: Column, junk: Column) -> Column:
    """A garbage scene, or an unknown one whose junk score leads by the margin; a missing score counts as 0."""
    score = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    lead = score(junk) >= score(footwear) + GARBAGE_MARGIN
    return F.when(scene.isin("shoe", "order", "delivery_notice"), False).when(scene == "garbage", True).otherwise(lead)


def route(text: Column, shoe: Column, scene: Column, footwear: Column, junk: Column) -> Column:
    """The image's kind by ordered rules: strong order, strong delivery, shoe, wording or scene, garbage, unknown."""
    told = F.coalesce(E.document_kind(text), scene)
    return (
        F.when(E.strong_order(text), "order")
        .when(E.strong_delivery(text), "delivery_notice")
        .when(shoe, "shoe")
        .when(told.isin("order", "delivery_notice"), told)
        .when(confident_garbage(scene, footwear, junk), "garbage")
        .otherwise("unknown")
    )


def status_of(kind: Column, candidates: Column) -> Column:
    """The answer's status; shoes and unknown images with candidates need a verifier."""
    without = F.when(kind == "unknown", "uncertain").otherwise("garbage")
    return F.when(kind.isin("unknown", "shoe"), F.when(candidates > 0, "needs_verification").otherwise(without)).otherwise(kind)
