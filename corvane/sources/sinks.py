"""Tables of an index on disk, by repository: replaced, upserted and deleted by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.snapshots import replace_keys


def write_partitions(rows: DataFrame, path: str, by: str = "repo") -> None:
    """Write rows below path, one folder for each value of by; folders of values that rows don't hold stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(spark: SparkSession, changed: DataFrame, path: str, keys: list[str], by: str = "repo") -> None:
    """Replace the rows of changed's keys in the table at path; only the partitions that changed touches are rewritten.

    The partitions are read and written again in one job by way of a table beside them, as a folder can't be read while
    it is overwritten. A table that isn't there yet is made.
    """
    touched = changed.select(by).distinct()
    try:
        old = spark.read.parquet(path).join(touched, by, "left_semi").select(*changed.columns)
    except Exception as e:  # noqa: BLE001 - Spark tells a missing path only by this
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_partitions(changed, path, by)
        return
    aside = f"{path.rstrip('/')}.next"
    replace_keys(old, changed, keys).write.mode("overwrite").parquet(aside)
    write_partitions(spark.read.parquet(aside), path, by)


def delete_keys(spark: SparkSession, gone: DataFrame, path: str, keys: list[str], by: str = "repo") -> None:
    """Delete the rows of the keys in gone (which has by among its columns) from the partitions that gone names.

    The folder of a partition of which nothing is left is removed.
    """
    kept = spark.read.parquet(path).join(gone.select(by).distinct(), by, "left_semi").join(gone.select(*keys).distinct(), keys, "left_anti")
    aside = f"{path.rstrip('/')}.next"
    kept.write.mode("overwrite").parquet(aside)
    left = spark.read.schema(kept.schema).parquet(aside)
    write_partitions(left, path, by)
    for row in gone.select(by).distinct().join(left.select(by).distinct(), by, "left_anti").toLocalIterator():
        drop_partition(spark, path, by, row[by])


def drop_partition(spark: SparkSession, path: str, by: str, value: object) -> None:
    """Remove the folder of one value of the partition column."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{by}={value}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
