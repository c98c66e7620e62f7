"""Exact duplicates (operator 11), in DataFrame functions only: skew-safe combining.

1. Every map task combines its own rows of equal digest and equal text: one row is left of each (partial aggregation).
2. These local winners meet by digest, salt and text; the salt comes from the map partition, so that the copies of one
   text, however many, are spread over ``salts`` groups.
3. The salt winners, at most ``salts`` for a text, meet by digest and text: one global winner with the size of its group.

The text itself is part of the key in every stage, so texts are compared in full and not by their digest. Rows find
their winner by digest. That is exact where one text only has the digest, which stage 3 shows; digests of several
texts go once more through the stages, and their rows are joined by digest and text. Groups with a thousandth of all
rows or more, of which there are at most a thousand, are joined by broadcast: none lands in one task.

Defined results: null counts as the empty text; very long texts are hashed and compared whole; rows that repeat id and
text are counted one by one and are all marked as kept if theirs is the largest id (``deduplicate`` leaves one of
them); a row without an id stays only where no row of its group has one, and then ``keep_id`` is null; an empty table
gives an empty result; other columns, whatever their names, are ignored, and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Groups that the copies of one text are spread over in the second stage.
SALTS = 64
#: A group is hot if it has one of so many rows; so there are at most so many hot groups.
HOT = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased, empty for null. Pure ASCII goes through ``lower``, which is the same there and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size), one row for each text of ``rows`` (id, digest, text)."""
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of ``docs``.

    ``keep_id`` is the largest id among the rows of equal text, ``group_size`` their number. Any ``digest`` gives the
    same groups; a weak one only costs time.
    """
    rows = docs.select(column(id_col).alias("id"), normalised(column(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    winners = materialize(_combined(rows, salts).select("digest", "keep_id", "group_size"))
    ids = materialize(rows.select("id", "digest"))

    several = winners.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    some = bool(several.take(1))
    alone = winners.join(several, "digest", "left_anti") if some else winners
    limit = F.lit(max(1, -(-ids.count() // hot)))
    large = F.broadcast(alone.filter(F.col("group_size") >= limit))
    # a digest of several texts has no place among the large groups either: alone is without them
    found = ids.join(large, "digest").unionByName(ids.join(large, "digest", "left_anti").join(alone.filter(F.col("group_size") < limit), "digest"))
    if some:
        mixed = rows.join(several, "digest")
        found = found.unionByName(mixed.join(_combined(mixed, salts), ["digest", "text"]).select("digest", "id", "keep_id", "group_size"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each text, that of the largest id; rows are carried whole, so any column names do."""
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), normalised(F.col("row")[text_col]).alias("text")).withColumn("digest", sha256(F.col("text")))
    stay = exact_groups(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("id"), "digest").distinct()
    same = rows["id"].eqNullSafe(stay["id"]) & (rows["digest"] == stay["digest"])
    mine = rows.join(stay, same, "left_semi")
    # rows that repeat id and text: the least hash of the row decides
    key = F.xxhash64("row")
    return mine.groupBy("id", "digest", "text").agg(F.min_by("row", key).alias("row")).select("row.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = {"op11_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""}
