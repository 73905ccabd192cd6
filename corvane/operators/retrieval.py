"""What turns distances of a search into answers: calibrated confidence, scores and the fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calibrate(related: DataFrame, unrelated: DataFrame, distance: str = "distance") -> DataFrame:
    """high, medium, low (one row) from the distances of probes to their nearest neighbour.

    high and medium are the quartiles of probes that have an answer, low the lower quartile of those that have none.
    No probes give nulls.
    """
    both = related.select(F.col(distance).alias("__near"), F.lit(None).cast("double").alias("__far")).unionByName(
        unrelated.select(F.lit(None).cast("double").alias("__near"), F.col(distance).alias("__far"))
    )
    return both.agg(F.percentile("__near", F.lit(0.25)).alias("high"), F.percentile("__near", F.lit(0.75)).alias("medium"), F.percentile("__far", F.lit(0.25)).alias("low"))


def profile(distances: DataFrame, groups: list[str], distance: str = "distance") -> DataFrame:
    """groups, n, least, p25, p50, p75, most of the distances of each group; null distances count nowhere."""
    at = lambda p: F.percentile(distance, F.lit(p))
    return distances.where(F.col(distance).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(distance).alias("least"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max(distance).alias("most")
    )


def confidence(distance: Column, high: Column, medium: Column, low: Column) -> Column:
    """HIGH, MEDIUM, LOW or NO MATCH."""
    return F.when(distance < high, "HIGH").when(distance < medium, "MEDIUM").when(distance < low, "LOW").otherwise("NO MATCH")


def score(distance: Column, high: Column, medium: Column, low: Column) -> Column:
    """A per cent of 100 at no distance, falling to 85, 55 and 15 at the thresholds and to 0 at 1.2 times the last."""
    between = lambda a, b: F.when(b > a, (distance - a) / (b - a)).otherwise(0.0)
    return (
        F.when(distance <= 0, 100.0)
        .when(distance <= high, 100 - 15 * distance / high)
        .when(distance <= medium, 85 - 30 * between(high, medium))
        .when(distance <= low, 55 - 40 * between(medium, low))
        .when(distance <= 1.2 * low, 15 - 15 * (distance - low) / (0.2 * low))
        .otherwise(0.0)
    )


def fuse_ranks(lists: list[DataFrame], keys: list[str], rank: str = "rank", k: int = 60) -> DataFrame:
    """keys and fused: the sum of 1 / (k + rank) over the lists that hold a key; null ranks add nothing."""
    parts = [x.select(*keys, (1.0 / (F.col(rank) + k)).alias("__part")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("__part").alias("fused"))
