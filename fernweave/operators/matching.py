"""From an image's crops to its kind and nearest models: retrieval for every crop, folded to the best crop of each image."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extraction as E
from ..functions import scalars as S
from ..functions import vectors as V
from ..sources.shared import kept
from .decisions import best_crop, confident_garbage, is_shoe, status_of
from .lookups import WHOLE_SHARE
from .retrieval import rank_models_by_best


@dataclass(frozen=True)
class Prompts:
    """Vectors of the prompts that tell images apart: a few each."""

    footwear: tuple[tuple[float, ...], ...]
    junk: tuple[tuple[float, ...], ...]
    order: tuple[tuple[float, ...], ...]
    delivery: tuple[tuple[float, ...], ...]

    def best(self, vector: Column, name: str) -> Column:
        return V.best_of(vector, F.array(*[V.literal(list(p)) for p in getattr(self, name)]))


HITS = "array<struct<rank:int,model:string,model_score:double,best_image_type:string>>"


def match_images(images: DataFrame, crops: DataFrame, catalog: DataFrame, prompts: Prompts, top: int = 10, verify_top: int = 10) -> DataFrame:
    """image_id, kind, status, relevance, crop, isolated, catalog_score, candidates: one row an image.

    images: image_id, text (recognised in the whole image). crops: image_id, crop (from 0, which is the whole image),
    area_share, vector. catalog: model, image_type, position, embedding.

    Each crop's models are retrieved, max(top, verify_top) of them. The kind follows from ordered rules: strong wording of an
    order or a delivery; else a shoe, if any crop that isn't tiny looks like footwear or resembles the catalog; else
    weak wording, or the whole image's scene; else garbage, if that is sure; else unknown. A shoe has the candidates of its best crop, an
    unknown image those of the crop that resembles the catalog most; others have none, and the whole image as crop.

    An image without crops is told by its text alone. Null texts are empty; null vectors resemble nothing. Crops of an image are few.
    """
    n = max(top, verify_top)
    key = F.concat_ws("|", F.col("image_id").cast("string"), F.col("crop").cast("string"))
    asked = crops.select(key.alias("query_id"), "image_id", "crop", "area_share", "vector")
    asked = kept(asked)
    found = rank_models_by_best(asked.filter("vector is not null").select("query_id", "vector"), catalog, n)
    hit = F.struct("rank", "model", "model_score", "best_image_type")
    hits = found.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).cast(HITS).alias("hits"))
    best = {name: F.when(F.col("vector").isNotNull(), prompts.best(F.col("vector"), name)) for name in ("footwear", "junk", "order", "delivery")}
    seen = asked.join(hits, "query_id", "left").select("image_id", "crop", "area_share", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), *[c.alias(name) for name, c in best.items()])
    score = F.when(F.size("hits") > 0, F.get("hits", 0)["model_score"])
    full = F.col("crop") == 0
    relevance = V.relevance(F.col("footwear"), F.col("junk"))
    shoe = F.coalesce(is_shoe(relevance, F.coalesce(score, F.lit(float("-inf"))), F.col("area_share"), full), F.lit(False))
    crop = F.struct("crop", score.alias("score"), F.col("area_share").alias("area"), full.alias("full"), shoe.alias("shoe"), "hits", "footwear", "junk", "order", "delivery")
    folded = seen.groupBy("image_id").agg(F.sort_array(F.collect_list(crop)).alias("crops"))
    rows = images.select("image_id", F.coalesce("text", F.lit("")).alias("text")).join(folded, "image_id", "left")
    shoes = F.filter("crops", lambda c: c["shoe"])
    rows = rows.withColumns({"_best": F.get(shoes, best_crop(shoes)), "_near": F.get("crops", best_crop(F.col("crops"))), "_whole": F.get(F.filter("crops", lambda c: c["full"]), 0)})
    whole, text = F.col("_whole"), F.col("text")
    told = F.coalesce(E.document_kind(text), V.non_shoe_kind(whole["junk"], whole["order"], whole["delivery"]))
    scene = V.scene_kind(whole["footwear"], whole["junk"], whole["order"])
    # without a vector of the whole image there is no scene
    scene = F.when(whole["footwear"].isNotNull(), scene).otherwise("unknown")
    told = F.when(whole["footwear"].isNotNull() | E.document_kind(text).isNotNull(), told)
    kind = (
        F.when(E.strong_order(text), "order")
        .when(E.strong_delivery(text), "delivery_notice")
        .when(F.col("_best").isNotNull(), "shoe")
        .when(told.isin("order", "delivery_notice"), told)
        .when(confident_garbage(scene, whole["footwear"], whole["junk"]), "garbage")
        .otherwise("unknown")
    )
    rows = rows.withColumn("kind", kind)
    chosen = F.when(F.col("kind") == "shoe", F.col("_best")).when(F.col("kind") == "unknown", F.col("_near")).otherwise(whole)
    searched = F.col("kind").isin("shoe", "unknown")
    candidates = F.coalesce(F.when(searched, chosen["hits"]), F.array().cast(HITS))
    return rows.withColumns({"_chosen": chosen, "candidates": candidates}).select(
        "image_id",
        "kind",
        status_of(F.col("kind"), F.size("candidates")).alias("status"),
        F.when(F.col("kind") == "shoe", "footwear").otherwise("irrelevant").alias("relevance"),
        F.col("_chosen.crop").alias("crop"),
        F.coalesce(F.col("_chosen.area") < WHOLE_SHARE, F.lit(False)).alias("isolated"),
        F.when(searched, F.coalesce("_chosen.score", F.lit(0.0))).alias("catalog_score"),
        "candidates",
    )


def verifier_request(matched: DataFrame, views: DataFrame, verify_top: int = 10, base_url: str | None = None) -> DataFrame:
    """image_id, slots: what a verifier is asked about each image that needs it: the customer's crop, then its first models with their views.

    matched: of match_images. views: model, image_type, url. A slot is label, model, image_type, url; the customer's has
    neither. A model without known views is asked about by its main one. Where an address isn't known, it is that under base_url, if given.
    """
    some = matched.filter("status = 'needs_verification'").select("image_id", F.explode(F.filter("candidates", lambda c: c["rank"] <= verify_top)).alias("c"))
    order = F.array_position(F.array(*map(F.lit, ("main", "pers", "side"))), F.col("image_type"))
    known = views.select("model", F.struct(order.alias("at"), "image_type", "url").alias("view"))
    per = some.select("image_id", F.col("c.rank").alias("rank"), F.col("c.model").alias("model")).join(known, "model", "left")
    url = F.col("view.url")
    if base_url is not None:
        url = F.coalesce(url, S.image_url(base_url, F.col("model"), F.coalesce("view.image_type", F.lit("main"))))
    slot = F.struct("rank", F.coalesce("view.at", F.lit(1).cast("long")).alias("at"), "model", F.coalesce("view.image_type", F.lit("main")).alias("image_type"), url.alias("url"))
    gathered = per.groupBy("image_id").agg(F.sort_array(F.collect_list(slot)).alias("s"))
    models = F.transform("s", lambda x: F.struct(F.concat(F.lit("candidate_"), x["rank"].cast("string")).alias("label"), x["model"].alias("model"), x["image_type"].alias("image_type"), x["url"].alias("url")))
    customer = F.array(F.struct(F.lit("customer").alias("label"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("image_type"), F.lit(None).cast("string").alias("url")))
    return gathered.select("image_id", F.concat(customer, models).alias("slots"))
