"""Fields of order confirmations and delivery notices from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wordings and number formats, in English and Hebrew.
LABELLED_ORDER = r"(?iu)(?:new\s*order|order\s*(?:number|confirmation)|אישור\s*הזמנה|מספר\s*הזמנה|הזמנה)\s*[:#\s]*([A-Z]{0,3}\d{5,12})\b"
HASH_ORDER = r"#(\d{5,6})\b"
APP_ORDERS = (r"(?i)\b(CS\d{8,12})\b", r"(?i)\b(BS\d{8,12})\b")
MISREAD_ORDER = r"(?i)\b([CB][5S]|8S)(\d{8,12})\b"
MODEL_CODE = r"(?<!\d)(\d{5}_\d{3})(?:\d{2,3})?(?!\d)"
LABELLED_SIZE = r"(?iu)(?:[-–—−]|size|מידה)\s*((?:3[5-9]|4[0-2])(?:[.,][05])?)"
DECIMAL_SIZE = r"(?<!\d)((?:3[5-9]|4[0-2])[.,][05])(?!\d)"
LABELLED_TRACKING = r"(?iu)(?:מספר\s*משלוח|tracking(?:\s*(?:number|no\.?))?|shipment(?:\s*number)?)\s*[:#\s]*(\d{8,14})"
BARE_TRACKING = r"(?<!\d)(\d{9,12})(?!\d)"
ON_THE_WAY = r"(?iu)on the way|בדרך אליך|בדרך|packed|ארוז"
ORDER_WORDING = r"(?iu)thank you for your order|new order|order confirmation|your order number|אישור\s*הזמנה|מספר\s*הזמנה|הזמנתך(?:\s*התקבלה)?"
DELIVERY_WORDING = r"(?iu)on the way|מספר משלוח|מעקב משלוח|track shipment"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _app_order(text: Column) -> Column:
    """The longest readable app order number; of equally long ones the first, CS before BS."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in APP_ORDERS])
    ranked = F.transform(found, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), F.upper(t).alias("t")))
    return F.array_max(ranked)["t"]


def order_number(text: Column) -> Column:
    """A readable app number first, then one whose letters were misread, then the labelled, then the hashed number."""
    text = F.coalesce(text, F.lit(""))
    prefix = F.upper(_first(text, MISREAD_ORDER))
    repaired = F.concat(F.when(prefix.isin("CS", "C5"), "CS").otherwise("BS"), _first(text, MISREAD_ORDER, 2))
    return F.coalesce(_app_order(text), F.when(prefix.isNotNull(), repaired), _first(text, LABELLED_ORDER), _first(text, HASH_ORDER))


def model_code(text: Column) -> Column:
    return _first(F.coalesce(text, F.lit("")), MODEL_CODE)


def shoe_size(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.coalesce(_first(text, LABELLED_SIZE), _first(text, DECIMAL_SIZE)), F.lit(","), F.lit("."))


def tracking_number(text: Column) -> Column:
    """The labelled number; a bare one only beside wording that something is on its way."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(_first(text, LABELLED_TRACKING), F.when(text.rlike(ON_THE_WAY), _first(text, BARE_TRACKING)))


def delivery_status(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(ON_THE_WAY), "on_the_way")


def document_kind(text: Column) -> Column:
    """delivery_notice before order, by wording; null for other text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(DELIVERY_WORDING), "delivery_notice").when(text.rlike(ORDER_WORDING), "order")


def strong_order(text: Column) -> Column:
    """An order number with order wording, a label or the app's own form."""
    number = order_number(text)
    told = F.coalesce(document_kind(text) == "order", F.lit(False))
    return number.isNotNull() & (told | F.coalesce(text, F.lit("")).rlike(LABELLED_ORDER) | number.rlike(r"(?i)^CS\d{8,12}$"))


def strong_delivery(text: Column) -> Column:
    return tracking_number(text).isNotNull() & F.coalesce(document_kind(text) == "delivery_notice", F.lit(False))


def order_fields(text: Column) -> Column:
    return F.struct(order_number(text).alias("order_number"), model_code(text).alias("model"), shoe_size(text).alias("size"))


def delivery_fields(text: Column) -> Column:
    return F.struct(tracking_number(text).alias("tracking_number"), delivery_status(text).alias("status"))
