"""Configuration: nested lookup with defaults, environment overrides, and overrides kept as rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    # The filter defaults and thresholds.
    min_price: float = 0.50
    max_price: float = 500.00
    review_days: int = 3
    slug_confidence_threshold: float = 0.6
    fuzzy_threshold: float = 80.0
    cheap_price_per_card: float = 0.01
    max_results: int = 30
    catalogue_hours: float = 24.0


#: Keys that are seeded into the settings table where they are missing.
SEEDED = ("min_price", "max_price", "review_days", "slug_confidence_threshold")


def deep_get(tree: Mapping[str, Any], path: str, default: Any = None) -> Any:
    at: Any = tree
    for key in path.split("."):
        if not isinstance(at, Mapping) or key not in at:
            return default
        at = at[key]
    return default if at is None else at


def load(tree: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "OFFERLENS_") -> Settings:
    """Defaults, then the tree (as of YAML or JSON), then the environment."""
    out = Settings()
    for f in fields(Settings):
        value = deep_get(tree or {}, f.name)
        value = (environment or {}).get(prefix + f.name.upper(), value)
        if value is not None:
            out = replace(out, **{f.name: type(getattr(out, f.name))(float(value))})
    return out


def with_overrides(settings: Settings, rows: DataFrame) -> Settings:
    """Rows (key, value) of the settings table set what they name; with a point a value is a float, else whole; bad ones are ignored. Read anew for each batch."""
    known = {f.name for f in fields(Settings)}
    latest = rows.where(rows["key"].isin(*known)).groupBy("key").agg(F.max("value").alias("value"))  # a row for each known key at most
    for row in latest.collect():
        if row["value"] is not None:
            try:
                value = float(row["value"]) if "." in row["value"] else int(float(row["value"]))
            except (TypeError, ValueError):
                continue
            settings = replace(settings, **{row["key"]: value})
    return settings


def _parsed(value: Column) -> Column:
    """A row's value as a number: with a point a float, else whole; null if it is neither."""
    number = F.regexp_replace(value, r"(?<=\d)_(?=\d)", "").try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
    return F.when(value.contains("."), number).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double"))


def as_row(rows: DataFrame, base: Settings = Settings()) -> DataFrame:
    """One row: ``base`` with what the settings table (key, value) says at the time it is read; a struct ``_settings`` of doubles."""
    names = [f.name for f in fields(Settings)]
    latest = rows.agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names])
    return latest.select(F.struct(*[F.coalesce(_parsed(F.col(n)), F.lit(float(getattr(base, n)))).alias(n) for n in names]).alias("_settings"))


class Live:
    """Settings as columns of rows that ``with_live`` has joined: nothing is fixed when a plan is built."""

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"_settings.{name}")


def with_live(df: DataFrame, rows: DataFrame, base: Settings = Settings()) -> DataFrame:
    """``df`` with the settings of now beside each row."""
    return df.crossJoin(F.broadcast(as_row(rows, base)))  # one row
