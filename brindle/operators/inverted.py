"""A stored inverted index of several fields, and BM25 over it.

One pass over the records yields the terms of all fields. The index is a folder of Parquet tables:

- ``postings`` (bucket, field, term, doc, tf, dl) and ``terms`` (bucket, field, term, df, raw), partitioned by bucket,
  the CRC-32 of the term modulo the number of buckets; postings of a bucket are spread over several files by document,
  so that a term of every document doesn't end in one task;
- ``fields`` (field, keyword, buckets, n_docs, avgdl, mean_idf, n_terms), one row a field.

A query reads the folders of its terms' buckets only. A keyword field isn't split: a record's value is one term, a
query's whole text is looked up, and its length doesn't count.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import EPSILON, K1, B, block, tokens, top_k
from .stages import staged

BUCKETS = 64
#: Files that the postings of a bucket are spread over.
SPREAD = 8


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def field_terms(docs: DataFrame, id_col: str, fields: dict[str, bool]) -> DataFrame:
    """(doc, field, keyword, t): terms of each field of each record; ``fields`` maps a column to whether it is a keyword field.

    A keyword column is text or an array of texts; null has no terms.
    """
    kinds = dict(docs.dtypes)
    values = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array_compact(F.array(F.col(c)))
    each = [F.struct(F.lit(f).alias("field"), F.lit(whole).alias("keyword"), (F.filter(values(f), lambda x: x.isNotNull()) if whole else tokens(f)).alias("t")) for f, whole in fields.items()]
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array(*each)).alias("e")).select("doc", "e.*")


def write_index(docs: DataFrame, id_col: str, fields: dict[str, bool], path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``fields`` to the new folder ``path``; the texts are read once."""
    said = staged(field_terms(docs, id_col, fields).withColumn("dl", F.size("t")))
    sizes = said.groupBy("field", "keyword").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    each = said.select("field", "doc", "dl", F.explode("t").alias("term"))
    tf = staged(each.groupBy("field", "term", "doc", "dl").agg(F.count("*").alias("tf")).withColumn("bucket", bucket(F.col("term"), buckets)))
    spread = tf.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    df = tf.groupBy("bucket", "field", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "field")  # one row a field
    df = staged(df.select("bucket", "field", "term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    df.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    mean = df.groupBy("field").agg(F.avg("raw").alias("mean_idf"), F.count("*").alias("n_terms"))
    sizes.join(mean, "field", "left").withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/fields")


def asked_terms(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, field, term, qtf) of a block of at most QUERY_BLOCK queries."""
    asked = block(queries.select("query_id", "query_text"))
    text = F.coalesce("query_text", F.lit(""))
    said = asked.crossJoin(F.broadcast(fields.select("field", "keyword"))).select("query_id", "field", F.explode(F.when(F.col("keyword"), F.array(text)).otherwise(tokens("query_text"))).alias("term"))
    return said.groupBy("query_id", "field", "term").agg(F.count("*").alias("qtf"))


def stored_scores(spark: SparkSession, path: str, queries: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc, field, score): BM25 of each field's stored postings for the terms asked for.

    The terms of the block, which is bounded, go to the driver, where they choose the buckets that are read.
    """
    fields = spark.read.parquet(f"{path}/fields")
    if boosts:
        fields = fields.filter(F.col("field").isin(list(boosts)))
    n = fields.first()["buckets"]
    asked = spark.createDataFrame(asked_terms(queries, fields).collect(), f"query_id {dict(queries.dtypes)['query_id']}, field string, term string, qtf long")
    wanted = sorted({zlib.crc32(r[0].encode()) % n for r in asked.select("term").distinct().collect()})
    chosen = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("bucket").isin(wanted))
    # terms and postings of a block: at most as many (field, term) pairs as were asked for
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    known = chosen("terms").join(F.broadcast(asked), ["field", "term"]).join(F.broadcast(fields), "field").select("query_id", "field", "term", "qtf", "keyword", "avgdl", idf.alias("idf"))
    norm = F.when(F.col("keyword"), F.lit(K1)).otherwise(K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = chosen("postings").join(F.broadcast(known), ["field", "term"])
    part = F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return hit.groupBy("query_id", "doc", "field").agg(F.round(part, 6).alias("score"))


def stored_top(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` records above 0 of each query, from an index of one field."""
    scores = stored_scores(spark, path, queries).drop("field")
    return top_k(scores.filter("score > 0"), k, [F.desc("score"), F.col("doc")])


def stored_field_search(spark: SparkSession, path: str, queries: DataFrame, boosts: dict[str, float], k: int) -> DataFrame:
    """Best boosted score of a single field, first ``k`` of each query."""
    boost = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
    best = stored_scores(spark, path, queries, boosts).groupBy("query_id", "doc").agg(F.round(F.max(boost[F.col("field")] * F.col("score")), 6).alias("score"))
    return top_k(best.filter("score > 0"), k, [F.desc("score"), F.col("doc")])
