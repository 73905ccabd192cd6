"""References to records that do not exist at the time of the reference.

References and parent keys are co-partitioned by key and sorted by time; one linear merge of the two streams (a running
sum over the sorted partition) then knows for each reference whether some parent interval is open. Keys that hold a
large share of the references are cut into parts, with the parent's few intervals repeated for each part.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.keys import normal_guid
from corvane.operators.skew import HOT_SHARE, hot_keys, replicate_rows, salt_rows


def parent_intervals(
    parents: Iterable[DataFrame], key: str = "guid", valid_from: str = "added_at", valid_to: str = "removed_at"
) -> DataFrame:
    """key, valid_from, valid_to of all parent tables; empty keys and empty intervals are left out, repeats are merged."""
    one = [
        p.select(
            normal_guid(F.col(key)).alias("__key"),
            F.col(valid_from).cast("timestamp_ntz").alias("__from"),
            F.col(valid_to).cast("timestamp_ntz").alias("__to"),
        )
        for p in parents
    ]
    rows = reduce(DataFrame.unionByName, one).where("__key <> ''")
    return rows.where("__from is null or __to is null or __from < __to").distinct()


def orphan_references(
    refs: DataFrame,
    parents: Iterable[DataFrame],
    ref_id: str = "mb_no",
    ref_key: str = "script_guid",
    ref_time: str = "seen_at",
    parent_key: str = "guid",
    valid_from: str = "added_at",
    valid_to: str = "removed_at",
    share: int = HOT_SHARE,
) -> DataFrame:
    """References without a valid parent: ref_id, ref_key (normal form), ref_time, status.

    A parent row is valid at t if valid_from is null or <= t and valid_to is null or > t. status is `missing` (no
    parent row of that key), `deleted` (every interval that began has ended) or `late` (all begin after t). Null, empty
    and all-zero keys refer to nothing and are left out; malformed keys are missing. A reference without a time is
    valid only with a parent row that is valid for ever, else `missing` or `undated`. Repeated rows come out once;
    no parents or no references give no crash, and other columns are ignored.
    """
    r = refs.select(
        F.col(ref_id).alias("__id"), normal_guid(F.col(ref_key)).alias("__key"), F.col(ref_time).cast("timestamp_ntz").alias("__t")
    ).where("__key is not null and not (__key rlike '^0*$')")
    hot = hot_keys(r, ["__key"], share)
    p = replicate_rows(parent_intervals(parents, parent_key, valid_from, valid_to), hot, ["__key"])
    always = F.expr("__from is null and __to is null").cast("int")
    nothing = F.lit(None).cast(r.schema["__id"].dataType)
    opens = p.select("__key", "__salt", F.col("__from").alias("__t"), F.lit(1).alias("__step"), always.alias("__always"), F.lit(0).alias("__ref"), nothing.alias("__id"))
    ends = p.where("__to is not null").select("__key", "__salt", F.col("__to").alias("__t"), F.lit(-1).alias("__step"), F.lit(0).alias("__always"), F.lit(0).alias("__ref"), nothing.alias("__id"))
    asks = salt_rows(r, hot, ["__key"], F.struct("__id", "__t")).select(
        "__key", "__salt", "__t", F.lit(0).alias("__step"), F.lit(0).alias("__always"), F.lit(1).alias("__ref"), "__id"
    )
    group = W.partitionBy("__key", "__salt")
    merge = group.orderBy(F.col("__t").asc_nulls_first(), F.col("__ref")).rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = (
        opens.unionByName(ends)
        .unionByName(asks)
        .withColumn("__open", F.sum("__step").over(merge))
        .withColumn("__began", F.sum((F.col("__step") > 0).cast("int")).over(merge))
        .withColumn("__any", F.max("__step").over(group))
        .withColumn("__ever", F.max("__always").over(group))
    )
    valid = F.when(F.col("__t").isNull(), F.col("__ever") > 0).otherwise(F.col("__open") > 0)
    status = (
        F.when(F.col("__any") <= 0, "missing").when(F.col("__t").isNull(), "undated").when(F.col("__began") > 0, "deleted").otherwise("late")
    )
    return (
        merged.where((F.col("__ref") == 1) & ~valid)
        .select(F.col("__id").alias(ref_id), F.col("__key").alias(ref_key), F.col("__t").alias(ref_time), status.alias("status"))
        .distinct()
    )


def orphan_report(orphans: DataFrame, ref_table: str, ref_id: str = "mb_no", ref_time: str = "seen_at") -> DataFrame:
    """ref_table, period (month as yyyy-MM, null without a time), status, n_refs: distinct referring records."""
    period = F.date_format(F.col(ref_time), "yyyy-MM")
    once = orphans.select(period.alias("period"), "status", ref_id).distinct()
    return once.groupBy("period", "status").agg(F.count(F.lit(1)).alias("n_refs")).select(F.lit(ref_table).alias("ref_table"), "period", "status", "n_refs")
