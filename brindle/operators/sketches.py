"""Profiles from stored sketches: one small row a day and column, merged over any range of days (H2, H4, H5).

A sketch is written once for each day and answers for every range that holds the day, so a profile of a year reads the
year's sketches and not its rows. Distinct values, quantiles and frequent values have mergeable sketches with a known
error; rows, nulls, minimum, maximum and sums are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .profiling import _number, _value

#: log2 of the registers of the distinct counts, size of the quantile sketches, values tracked for the frequent ones.
DISTINCT_BITS, QUANTILE_K, TRACKED = 12, 200, 1024
#: Error bounds of the estimates: four standard errors, rank error of two quantiles' size, share of all values.
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 4 * 1.04 / math.sqrt(2**DISTINCT_BITS), 0.03, 3.5 / TRACKED


def _cells(df: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """(day, column, v, x): the values of all columns unpivoted, as texts and as numbers."""
    cells = [F.struct(F.lit(c).alias("column"), _value(df, c).cast("string").alias("v"), (_number(df, c) + F.lit(0.0)).alias("x")) for c in columns]
    return df.select(F.to_date(F.col(f"`{at}`")).alias("day"), F.explode(F.array(*cells)).alias("u")).select("day", "u.*")


def day_sketches(df: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """(day, column, exact measures, distinct, quantiles, frequent): a row for each day of ``at`` and column.

    All columns are unpivoted into one grouping, whose partial aggregates are sketches: a task ships a few kilobytes a day
    and column, however many rows it read. Nan counts as null; rows without a day are under a null day. A column without
    values on a day has null sketches.
    """
    v, x = F.col("v"), F.col("x")
    return _cells(df, at, columns).groupBy("day", "column").agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(v)).alias("nulls"), F.count(x).alias("numbers"), F.sum(x).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.when(F.count(v) > 0, F.hll_sketch_agg(v, DISTINCT_BITS)).alias("distinct"), F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, QUANTILE_K)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(v, {TRACKED})").alias("frequent"),
    )


def day_counts(df: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """(day, column, v, n): how often each value (null: none) occurs on a day; a row for each different value of a day and column.

    The exact counterpart of the frequent values: where more than TRACKED values are about equally frequent, a sketch cannot
    tell the most frequent one, or its count. Counts are stored and read like sketches, and add up over days.
    """
    return _cells(df, at, columns).groupBy("day", "column", "v").agg(F.count(F.lit(1)).alias("n"))


def write_days(sketches: DataFrame, path: str) -> None:
    """Store sketches or counts in a folder for each day. A day that is written again replaces its own folder only, so a repeated delivery
    counts once."""
    sketches.write.option("partitionOverwriteMode", "dynamic").partitionBy("day").mode("overwrite").parquet(path)


def read_days(spark: SparkSession, path: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Stored sketches or counts of the days from ``since`` on and ``before`` another: only their folders are read."""
    d = spark.read.parquet(path)
    d = d.filter(F.col("day") >= F.lit(since).cast("date")) if since else d
    return d.filter(F.col("day") < F.lit(before).cast("date")) if before else d


def merged(sketches: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Sketches of days merged for each column, and each of ``by`` (say, the month)."""
    return sketches.groupBy(*(by or []), "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("numbers").alias("numbers"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def estimated(sketches: DataFrame, k: int = 10, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches (of days or merged) read out: exact measures, ``unique_count``, ``q`` and ``top`` (array of item and count).

    ``unique_count`` is within DISTINCT_ERROR of the number of distinct values, each of ``q`` within RANK_ERROR of its rank, each count of
    ``top`` within COUNT_ERROR of all values; a column of at most 3/4 TRACKED values has exact counts.
    """
    kept = [c for c in sketches.columns if c not in ("distinct", "quantiles", "frequent", "total")]
    some = F.col("rows") > F.col("nulls")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return sketches.select(
        *kept, F.try_divide("total", "numbers").alias("mean"), F.when(some, F.hll_sketch_estimate("distinct")).otherwise(0).alias("unique_count"),
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", wanted)).alias("q"),
        F.when(some, F.filter(F.expr(f"approx_top_k_estimate(frequent, {k + 1})"), lambda e: e["item"].isNotNull())).otherwise(F.array().cast("array<struct<item:string,count:bigint>>")).alias("found"),
    ).withColumn("top", F.slice("found", 1, k)).drop("found")
