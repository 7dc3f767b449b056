"""Scalar functions on columns: identifiers, numbers, dates, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNKNOWN = "<UNK>"
ANONYMOUS_CUSTOMER = "99999999"
RECENT_DAYS = 60
REVIEW_WEIGHTS = {"approved": 1.10, "draft": 1.02}
IMAGE_TYPES = ("main", "pers", "side")

INTEGRAL = r"^(-*[0-9]+)\.0$"


def _token(value: Column, nulls: tuple[str, ...]) -> Column:
    text = F.trim(value.cast("string"))
    whole = F.when(F.contains(text, F.lit(".0")), F.regexp_replace(text, INTEGRAL, "$1")).otherwise(text)  # few need the slow expression
    return F.when((text == "") | F.lower(text).isin(*nulls), F.lit(None)).otherwise(whole)


def normalize_id(value: Column) -> Column:
    """The id as text: 123.0 is 123; blank, none, nan and nat are null."""
    return _token(value, ("none", "nan", "nat"))


def category(value: Column) -> Column:
    """The category's token; missing ones are UNKNOWN."""
    return F.coalesce(_token(value, ("none", "nan", "nat", "null", "<na>")), F.lit(UNKNOWN))


def finite(value: Column) -> Column:
    """The value as a double; what isn't a finite number is null."""
    number = value.cast("string").try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def is_discount(discount: Column) -> Column:
    return F.coalesce(finite(discount) > 0, F.lit(False))


def discount_value(discount: Column) -> Column:
    return F.coalesce(finite(discount), F.lit(0.0))


def as_utc(value: Column) -> Column:
    """A moment from text, whatever the session's zone: text without a zone is UTC, bad text null. Dates are midnights."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"^(\d{4}-\d\d-\d\d) ", "$1T")
    zoned = text.rlike(r"T.*(?:[Zz]|[+-]\d\d:?\d\d)$")
    whole = F.when(zoned, text).when(text.contains("T"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(whole))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def tenure_days(at: Column, first: Column) -> Column:
    """Days since the first observed purchase, 0 at least; null without one."""
    return F.when(first.isNotNull(), F.greatest(days_between(at, first), F.lit(0.0)))


def days_since(day: Column, as_of: Column) -> Column:
    """Whole days from the date in the first ten characters to as_of; null for what isn't a date."""
    return F.datediff(as_of, F.to_date(F.try_to_timestamp(F.substring(F.trim(day.cast("string")), 1, 10), F.lit("yyyy-MM-dd"))))


def is_recent(days: Column) -> Column:
    return F.coalesce(days < RECENT_DAYS, F.lit(False))


def recency_bucket(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unknown")
        .when(days < 60, "<60d")
        .when(days <= 180, "60-180d")
        .when(days < 365, "181-365d")
        .when(days < 1095, "1-3y")
        .otherwise("3y+")
    )


def review_weight(status: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in REVIEW_WEIGHTS.items():
        out = F.when(F.lower(F.trim(status)) == name, F.lit(weight)).otherwise(out)
    return out


def unit(value: Column) -> Column:
    """Clamped to 0..1; what isn't a number is 0."""
    return F.least(F.greatest(F.coalesce(finite(value), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def share(value: Column) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def image_url(base: str, model: Column, image_type: Column) -> Column:
    """The main view has the model's code alone."""
    return F.concat(F.lit(f"{base}/"), model, F.when(image_type == "main", F.lit("")).otherwise(F.concat(F.lit("_"), image_type)), F.lit(".jpg"))


def image_bytes(encoded: Column) -> Column:
    """Bytes of base64 text, with or without a data URL's prefix; empty or bad text gives null."""
    plain = F.regexp_replace(F.trim(encoded), r"^data:[^,]*,", "")
    return F.when(plain != "", F.try_to_binary(plain, F.lit("base64")))


def positive_list(values: Column) -> Column:
    """A list without nulls and empty strings; null is the empty list."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def json_map(value: Column) -> Column:
    """A map from JSON text; null, blank and bad text give an empty one."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


def last_items(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, n)


#: Names of the features below, in their order.
NUMERIC_FEATURES = ("log_purchases", "log_history", "log_recency", "log_tenure", "tenure_missing", "full_price_ratio", "discount_ratio", "avg_discount")


def numeric_features(purchases: Column, history: Column, recency: Column, tenure: Column, full_ratio: Column, discount_ratio: Column, avg_discount: Column) -> list[Column]:
    def log(x: Column) -> Column:
        return F.log1p(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))

    missing = F.when(tenure.isNull(), 1.0).otherwise(0.0)
    made = [log(purchases), log(F.coalesce(history, purchases)), log(recency), log(tenure), missing, share(full_ratio), share(discount_ratio), share(avg_discount)]
    return [x.alias(name) for x, name in zip(made, NUMERIC_FEATURES)]
