"""Stages of jobs with several passes: results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most so many.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session, as in tests, may do without: it gets a folder of its own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor recomputes nothing above it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a staged ``df``, given only if its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` split into ranges of its order, staged, with the number of the range in ``part``.

    There are spark.sql.shuffle.partitions ranges, balanced by Spark's sample; rows of equal order share a range. Results
    do not depend on the cuts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def running(parts: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``parts`` (a ``ranged`` frame by ``by``, then ``order``) with the sum of ``value`` over all rows up to each one.

    Sums per range are added up over the ranges, of which there are few; within a range a window goes on from there, so
    no key is gathered in one task.
    """
    sums = parts.groupBy("part", *by).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", *by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.withColumn(name, F.sum(value).over(within))
    return inner.join(small(staged(offsets)), ["part", *by]).withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def first_after(parts: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``parts`` (as for ``running``) with the first ``value`` that isn't null in the rows from each one on.

    The windows go backwards, from the start of their frame to each row: Spark adds one row at a time to such frames, but
    takes up a frame that reaches to the end anew for each row, which costs the square of a range's rows.
    """
    heads = parts.withColumn("__v", value).filter("__v IS NOT NULL").groupBy("part", *by).agg(F.min_by("__v", F.struct(*order)).alias("__head"))
    every = parts.select("part", *by).distinct().join(heads, ["part", *by], "left")
    later = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = every.select("part", *by, F.last("__head", ignorenulls=True).over(later).alias("__ahead"))
    within = Window.partitionBy("part", *by).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.withColumn(name, F.last(value, ignorenulls=True).over(within))
    return inner.join(small(staged(ahead)), ["part", *by]).withColumn(name, F.coalesce(name, "__ahead")).drop("__ahead")
