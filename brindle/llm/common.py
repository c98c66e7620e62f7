"""What the corpus operators share: word rules, tables, and the shared folder that cuts lineage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import shared_dir

#: The six white-space characters that separate words, as a Java regular expression class body.
WS = r" \x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

#: A side is broadcast only after its rows were counted and found to be at most so many.
BROADCAST_ROWS = 20_000


def ships(module: str) -> None:
    """Send this module's functions to the tasks by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, beside ``more``: so no column of the caller meets one of the operator."""
    return docs.select(F.struct(*[at(c) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``packed`` put into ``row``, those named in ``changed`` replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in columns])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors recompute nothing above it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a materialized ``df``, given only if its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than white space; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS}]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: CRC-32 of an ASCII or UTF-8 blob in DuckDB: a table of 256 steps and a fold over the bytes.
CRC_TABLE = """crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({x}))),
  lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, v: xor(c >> 8, steps[1 + (xor(c, v) & 255)])))"""
