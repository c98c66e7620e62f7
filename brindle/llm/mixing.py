"""Mixing sources to target weights (operator 6), in DataFrame functions only.

Every document gets a hash-random key. Within a source the keys are split into ranges of some thousand
documents; sums per range, then sums within each range, give distributed prefix sums of the sizes, and the
mix is cut where a source's budget ends. A source whose budget exceeds its size is repeated whole first.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own, last in
order; repeated rows are mixed as rows of their own (equal keys are ordered by id, then size); an empty table
gives an empty result; other columns are ignored, and kept by ``mixed_documents``, which carries each row whole, so
that null and repeated ids neither lose rows nor share copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, small, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
DOCS_PER_RANGE = 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, sidx, n_docs, source_size, target): one row a source. ``sizes`` has source and size.

    Water filling: sources sorted by size a weight reach their limit in that order, so the common level of the
    others follows from running sums; no iteration. The windows are over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sidx", F.row_number().over(order))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("sidx") - 1) % len(weights) + 1).cast("int")))
    everyone = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") / F.col("w"), "sidx").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "s_all": F.sum("source_size").over(everyone), "w_all": F.sum("w").over(everyone),
        "s_full": F.coalesce(F.sum("source_size").over(filled), F.lit(0)), "w_full": F.coalesce(F.sum("w").over(filled), F.lit(0)),
    })
    level = (F.lit(share) * F.col("s_all") - F.lit(float(most)) * F.col("s_full")) / (F.col("w_all") - F.col("w_full"))
    per = per.withColumns({"level": level, "cap": F.col("source_size") * F.lit(float(most))})
    free = F.col("cap") >= F.col("level") * F.col("w")
    per = per.withColumn("level", F.min(F.when(free, F.struct(F.col("source_size") / F.col("w"), "sidx", "level"))).over(everyone)["level"])
    reached = F.col("level") * F.col("w")
    return per.select("source", "sidx", "n_docs", "source_size", F.when(reached <= F.col("cap"), reached).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``; taken counts words, repeats included."""
    return _taken(docs, [], id_col, text_col, source_col, weights, share, most, seed)


def _taken(docs: DataFrame, carried: list[Column], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``mix``, with further columns of the rows; these order what has equal keys, ids and sizes."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *carried)
    sizes = materialize(sizes)
    extra = sizes.columns[3:]
    targets = small(materialize(source_targets(sizes, weights, share, most)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "size", "sidx", "source_size", "target", "n_docs", key.alias("key"), *extra)
    bits = F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.col("n_docs") / F.lit(DOCS_PER_RANGE), F.lit(1.0))))).cast("int")
    top = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(top / F.pow(F.lit(2.0), 60 - bits)).cast("long")).drop("n_docs")
    sums = rows.groupBy("sidx", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("sidx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sidx", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sidx", "range").orderBy("key", "doc_id", "size", *[F.xxhash64(c) for c in extra]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["sidx", "range"]).withColumn("prefix", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, in whole copies: each row as often as its taken words fill it (halves go up)."""
    rows = _taken(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")], **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    out = rows.withColumn("copies", copies).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {"op6_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS sidx FROM d GROUP BY source),
q AS (SELECT *, CAST(CASE (sidx - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM p),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS s_all, CAST(sum(w) OVER () AS DOUBLE) AS w_all,
  CAST(coalesce(sum(source_size) OVER o, 0) AS DOUBLE) AS s_full, CAST(coalesce(sum(w) OVER o, 0) AS DOUBLE) AS w_full FROM q
  WINDOW o AS (ORDER BY source_size / w, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * s_all - 2.0::DOUBLE * s_full) / (w_all - w_full) AS lvl, source_size * 2.0::DOUBLE AS cap FROM f),
v AS (SELECT arg_min(lvl, source_size / w) AS level FROM l WHERE cap >= lvl * w),
t AS (SELECT source, source_size, CASE WHEN level * w <= cap THEN level * w ELSE cap END AS target FROM l CROSS JOIN v),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken FROM e
"""}
