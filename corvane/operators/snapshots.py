"""Upkeep of derived tables: differences between two states of a table, and replacement of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, status (new, changed, unchanged, removed) between two manifests of one row for each key.

    A stamp is compared exactly; two nulls are equal. Null keys are left out.
    """
    a = old.where(F.col(key).isNotNull()).select(key, F.col(stamp).alias("__old"), F.lit(True).alias("__was"))
    b = new.where(F.col(key).isNotNull()).select(key, F.col(stamp).alias("__new"), F.lit(True).alias("__is"))
    status = F.when(F.col("__was").isNull(), "new").when(F.col("__is").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def replace_keys(existing: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """existing with all rows of the keys in changed replaced by the rows of changed; applying it twice changes nothing more."""
    return existing.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed)
