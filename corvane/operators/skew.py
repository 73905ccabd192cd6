"""Equi-joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys
#: whatever the input's size; this is the bound that lets the table of hot keys be broadcast.
HOT_SHARE = 256


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """keys plus __salts: the hot keys of df and into how many parts each is to be cut (fewer than `share` rows).

    The count is pre-aggregated on the map side, so no hot key travels as rows. An empty df gives no rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total")).scalar()  # from the same counts, so df is read once
    part = F.greatest(F.floor(total / F.lit(share)), F.lit(1))
    return counts.where(F.col("__n") > part).select(*keys, F.ceil(F.col("__n") / part).cast("int").alias("__salts"))


def salts_of(counts: DataFrame, keys: Sequence[str], total: int, share: int = HOT_SHARE) -> DataFrame:
    """hot_keys from rows that are already counted: counts has keys and __n, which add up to total at most."""
    part = max(total // share, 1)
    return counts.where(F.col("__n") > part).select(*keys, F.ceil(F.col("__n") / part).cast("int").alias("__salts"))


def salt_rows(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """df with __salt: 0, or for hot keys a number under __salts that follows the hash of `by`."""
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__salts")).cast("int"), F.lit(0)))
        .drop("__salts")
    )


def replicate_rows(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with __salt: rows of hot keys once for each part, all others once."""
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
        .drop("__salts")
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], by: Column, how: str = "inner", share: int = HOT_SHARE
) -> DataFrame:
    """left join right on keys, with hot keys of left spread over several tasks; how is inner, left, left_semi or left_anti."""
    return join_around(hot_keys(left, keys, share), left, right, keys, by, how)


def join_around(hot: DataFrame | None, left: DataFrame, right: DataFrame, keys: Sequence[str], by: Column, how: str = "inner") -> DataFrame:
    """salted_join with the hot keys given; None for no hot keys."""
    if hot is None:
        return left.join(right, list(keys), how)
    return salt_rows(left, hot, keys, by).join(replicate_rows(right, hot, keys), [*keys, "__salt"], how).drop("__salt")
