"""Lines of text files with their place, from byte ranges: a large file is read by many tasks.

Spark cuts files into byte ranges and reads the lines of a range in order, so a line's place is the number of lines in the
ranges before it, a running sum over a small table of a row a range, and its place within its range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordinals(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, bucket: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """The rows with their place (from 0) among those of their keys, by bucket and then by order. A task orders a bucket, and counts of buckets give what stands before it."""
    part = (*keys, *bucket)
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys, F.lit(0)).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*part, F.coalesce(before, F.lit(0)).alias("_before"))
    held = rows.withColumn("_within", within).alias("r").join(counts.alias("c"), F.expr(" and ".join(f"r.{k} <=> c.{k}" for k in part)))
    return held.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("_before") + F.col("_within")).alias(name))


def ranged(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, bucket (the first byte of the line's range), at (grows with the line inside its range), line."""
    text = spark.read.options(**options).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("bucket"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, bucket, line_no (from 0), line."""
    return ordinals(ranged(spark, path, **options), ("file",), ("at",), "line_no").select("file", "bucket", "line_no", "line")


def json_places(spark: SparkSession, path: str, schema: str, of: Callable[[Column], Column] = lambda r: r) -> DataFrame:
    """ord, record: the records of JSON lines and their place among those that parse, files by name; other lines are left out and count for nothing.

    of: what of a record is kept. A record is parsed where its line is read, so that only this much of it is moved.
    """
    good = ranged(spark, path).where(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    held = good.select("file", "bucket", "at", of(F.from_json("line", schema)).alias("record"))
    return ordinals(held, (), ("at",), "ord", ("file", "bucket")).select("ord", "record")
