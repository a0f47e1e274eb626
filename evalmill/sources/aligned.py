"""Rows of two datasets that belong together, by an index of their own or by their places in the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def numbered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of Parquet files with their places, from 0: files by name, rows as they stand in their file.

    The place in a file is what the reader says; before it come the rows of earlier files, so only counts are ordered, one
    a file.  Nothing depends on how files are split or in which order tasks run.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = F.sum("_n").over(W.Window.orderBy("_file").rowsBetween(W.Window.unboundedPreceding, -1))
    files = files.select(F.col("_file").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(files, F.col("_file") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_row"))
    return placed.drop("_file", "_row", "_of", "_before")


def align(one: DataFrame, other: DataFrame, gold: Column, other_gold: Column, place: str = "position", tolerance: float = 1e-6) -> DataFrame:
    """Every row of ``one`` with that of ``other`` at its place (a column of both, whose names else differ), and what comes of
    it: ``kept``, or dropped as ``unmatched`` (none there), ``no gold`` (that row's gold cannot be read), or ``mismatched``.

    The place may be an index that the data brings, or that of ``numbered``.
    """
    joined = one.withColumn("_gold", gold).join(other.withColumnsRenamed({place: "_place"}).withColumn("_other", other_gold), F.col(place) == F.col("_place"), "left")
    what = (
        F.when(F.col("_place").isNull(), "unmatched")
        .when(F.col("_other").isNull(), "no gold")
        .when(F.abs(F.col("_other") - F.col("_gold")) <= tolerance, "kept")
        .otherwise("mismatched")
    )
    return joined.withColumn("what", what).drop("_gold", "_other", "_place")
