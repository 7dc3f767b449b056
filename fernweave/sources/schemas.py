"""Tables of the engine: their schemas and the check of required columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: The columns of the three input tables.
PURCHASES = (
    "purchase_id long, invoice_number string, purchase_date timestamp, customer_id string, model string, sku string,"
    " size string, quantity double, discount double, season string, last_name string"
)
CUSTOMERS = (
    "customer_id string, birthday_year int, age_group string, preferred_size string, agent_id int, join_date timestamp,"
    " join_shop_id int, purchase_count int, invoice_count int, unique_models int, first_purchase_date timestamp,"
    " last_purchase_date timestamp, days_since_last_purchase double, history_confidence double,"
    " full_price_purchase_count int, discount_purchase_count int, full_price_ratio double, discount_purchase_ratio double,"
    " avg_discount double, season_count int"
)
MODEL_FIELDS = ("main_category", "sub_category", "material", "material_1", "material_2", "theme", "color", "season", "last_type")
MODELS = (
    "model_id long, model string, model_name string, " + ", ".join(f"{c} string" for c in MODEL_FIELDS) + ","
    " embedding_model string, embedding_dimension int, main_embedding string, pers_embedding string, side_embedding string"
)
IMAGES = (
    "model string, image_type string, embedding array<float>, model_id long, row_id long, embedding_model string,"
    " embedding_dimension int, image_hash string, source_url string"
)


def missing_columns(have: Iterable[str], need: Iterable[str]) -> list[str]:
    have = set(have)
    return [c for c in need if c not in have]


def require_columns(df: DataFrame, need: Iterable[str]) -> DataFrame:
    """df; raises ValueError that names the missing columns in the order of need."""
    if missing := missing_columns(df.columns, need):
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
