"""Declared schemas of the state tables and sources, and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



LISTING = "listing_id string, title string, price double, currency string, url string, seller_name string, seller_rating double, images array<string>, description string, condition string, location string"
PRODUCT = "pos long, id_product long, name string, number string, expansion_name string, id_expansion long, rarity string"
PRICE = "id_product long, low double, sell double, trend double, avg1 double, avg7 double, avg30 double"
TABLES = {
    "seen_listings": "listing_id string, title string, price double, url string, first_seen timestamp",
    "card_mappings": "id long, title string, fingerprint string, card_name string, collector_number string, set_code string, tokens array<string>, url string, product_name string, confidence double, date_added timestamp",
    "review_queue": "listing_id string, title string, price double, currency string, url string, reason string, attempts array<struct<step:string,message:string,error:string,method:string,result:string,detail:string>>, message_id string, status string, created_at timestamp, resolved_at timestamp, resolved_by string, resolved_url string",
    "error_log": "id long, listing_id string, failure_step string, error_message string, http_status int, price double, currency string, message_id string, created_at timestamp",
    "correction_log": "id long, listing_id string, generated_url string, corrected_url string, failed_slug string, correct_slug string, learned_prefix string, created_at timestamp",
    "slug_prefix_rules": "id long, set_code string, set_name string, prefix string, uses_successful long, uses_failed long, confidence double, updated_at timestamp",
    "slug_overrides": "fingerprint string, url string, preferred_slug string, created_at timestamp",
    "catalog_id_slugs": "id long, id_product long, product_slug string, id_expansion long, set_slug string, match_count long",
    "filter_settings": "key string, value string",
    "deal_messages": "message_id string, listing_id string, channel_type string, url string, price double, created_at timestamp",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL({"listing": LISTING, "product": PRODUCT, "price": PRICE, **TABLES}[name])


def migrated(df: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with every column of table ``name``: missing ones come as null or their default."""
    have, defaults = set(df.columns), defaults or {}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name)])
