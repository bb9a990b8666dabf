"""Purchase cost against a reference price.

Money is DECIMAL with half-up rounding. ``binary_fee`` and ``binary_total`` round
doubles as Python does, for comparisons with records made that way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The fee model and the bounds of shipping.
FEE_RATE, FEE_FIXED = "0.05", "0.70"
SHIPPING_MIN, SHIPPING_MAX = "2.89", "7.09"
BID_RATE = "0.80"


def amount(value: Column, scale: int = 2) -> Column:
    return value.cast(f"decimal(14,{scale})")


def _fixed(text: str) -> Column:
    return F.lit(text).cast("decimal(6,2)")


def fee(price: Column) -> Column:
    return F.round(amount(price) * _fixed(FEE_RATE) + _fixed(FEE_FIXED), 2).cast("decimal(14,2)")


def total(price: Column, shipping: str) -> Column:
    return (amount(price) + fee(price) + _fixed(shipping)).cast("decimal(14,2)")


def compared(price: Column, reference: Column) -> Column:
    """struct: fee, total_min, total_max, is_profitable, difference, percent. Without a positive reference nothing is profitable and both are 0."""
    most = total(price, SHIPPING_MAX)
    known = F.coalesce(amount(reference), F.lit(0)) > 0
    gap = F.when(known, amount(reference) - most).otherwise(F.lit(0)).cast("decimal(14,2)")
    return F.struct(
        fee(price).alias("fee"), total(price, SHIPPING_MIN).alias("total_min"), most.alias("total_max"),
        (known & (most < amount(reference))).alias("is_profitable"), gap.alias("difference"),
        F.when(known, gap.cast("double") / amount(reference).cast("double") * 100).otherwise(F.lit(0.0)).alias("percent"),
    )


def bid(price: Column, reference: Column) -> Column:
    """struct: bid (80 % of the price), bid_total, bid_profitable, saving."""
    offer = F.round(amount(price) * _fixed(BID_RATE), 2).cast("decimal(14,2)")
    cost = total(offer, SHIPPING_MAX)
    return F.struct(offer.alias("bid"), cost.alias("bid_total"), (cost < amount(reference)).alias("bid_profitable"), (amount(reference) - cost).cast("decimal(14,2)").alias("saving"))


@F.pandas_udf(DoubleType())
def binary_fee(price: pd.Series) -> pd.Series:
    return price.map(lambda p: None if p is None or p != p else round(p * 0.05 + 0.70, 2))


@F.pandas_udf(DoubleType())
def binary_total(price: pd.Series, shipping: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or p != p else round(p + round(p * 0.05 + 0.70, 2) + s, 2) for p, s in zip(price, shipping, strict=True)], dtype="float64")
