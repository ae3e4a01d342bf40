"""Tables whose order is part of their meaning: sorted when written, numbered when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """Write rows sorted by ``order``: ranges to tasks, sorted within, one file after the other.

    The order is that of the file numbers, then that of the rows in a file. Rows
    that are equal in ``order`` may stand in any order among themselves.
    """
    df.orderBy(*order).write.mode("error").parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their ``position``, from 0, as ``write_sorted`` left them."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("bigint")
    rows = spark.read.parquet(path)
    columns = rows.columns
    rows = rows.select("*", number("^part-([0-9]+)-").alias("_part"), number("-c([0-9]+)[.]").alias("_piece"), F.col("_metadata.row_index").alias("_row"))
    # One row per file.
    files = rows.groupBy("_part", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_part", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), ["_part", "_piece"]).select((F.col("_start") + F.col("_row")).alias("position"), *columns)
