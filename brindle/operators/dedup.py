"""Record deduplication and set operations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import staged


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """The first row of each key (F1, F3, F4). A limit below the shuffle keeps one row a key and task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def best_by_fingerprint(df: DataFrame, fingerprint: str = "dataset_fingerprint", seq: str = "seq") -> DataFrame:
    """Most complete record of each fingerprint, first on ties (F1)."""
    return first_by(df, [fingerprint], [F.desc("metadata_completeness"), F.col(seq)])


def first_by_either(df: DataFrame, fingerprint: str = "dataset_fingerprint", key: str = "canonical_id", seq: str = "seq", exact: bool = False) -> DataFrame:
    """First row by fingerprint and by id (F2).

    Two window passes. They differ from taking rows in turn only where a row that was dropped for its id would have
    hidden a later one of its fingerprint; ``exact`` takes them in turn (``greedy_first``).
    """
    if not exact:
        return first_by(first_by(df, [fingerprint], [F.col(seq)]), [key], [F.col(seq)])
    return df.join(greedy_first(df, [fingerprint, key], seq), seq, "left_semi")


def _folded(keys: list[str], seq: str):
    """Rows in turn: each is kept unless a kept one has one of its keys."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen, kept = [set() for _ in keys], []
        for r in rows.sort_values(seq).itertuples(index=False):
            own = [getattr(r, k) for k in keys]
            if not any(v is not None and v in s for v, s in zip(own, seen, strict=True)):
                for v, s in zip(own, seen, strict=True):
                    if v is not None:
                        s.add(v)
                kept.append(getattr(r, seq))
        return pd.DataFrame({seq: kept})

    return run


def greedy_first(df: DataFrame, keys: list[str], seq: str = "seq", few: int = 20_000) -> DataFrame:
    """``seq`` of the rows that stay if rows are taken in turn and each that shares a key with one taken before is left out.

    Conflicts are resolved in rounds: an undecided row without an earlier undecided row under any of its keys is taken,
    and all that share a key with a row taken are left out. A round decides at least the first row of every group of
    linked rows, most often nearly all; least ``seq`` by key has partial sums, so a key with a third of all rows costs no
    task more than others. Once at most ``few`` rows are undecided they are taken in turn in one task. Null keys link
    nothing; an empty table gives an empty result; ``seq`` must be distinct.
    """
    names = [f"k{i}" for i in range(len(keys))]
    left = staged(df.select(F.col(seq).alias("seq"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]))
    taken = []
    while (n := left.count()) > few:
        first = left
        for k in names:
            least = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("seq").alias(f"least_{k}"))
            first = first.join(least, k, "left")
        now = staged(first.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(f"least_{k}") == F.col("seq"), F.lit(True)) for k in names])).select("seq", *names))
        taken.append(now.select("seq"))
        left = left.join(now.select("seq"), "seq", "left_anti")
        for k in names:
            left = left.join(now.filter(F.col(k).isNotNull()).select(k), k, "left_anti")
        left = staged(left.select("seq", *names))
    if n:
        kind = dict(left.dtypes)["seq"]
        text = left.select("seq", *[F.col(k).cast("string").alias(k) for k in names])
        taken.append(text.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_folded(names, "seq"), f"seq {kind}"))  # at most ``few`` rows
    if not taken:
        return df.select(seq).limit(0)
    return reduce(lambda a, b: a.unionByName(b), taken).select(F.col("seq").alias(seq))


def by_id_or_title(df: DataFrame, seq: str = "seq") -> DataFrame:
    """First row by id, or by title where there is no id."""
    return first_by(df, [F.coalesce("canonical_id", "title")], [F.col(seq)])


def mark(df: DataFrame, fingerprint: str = "dataset_fingerprint", key: str = "canonical_id", seq: str = "seq") -> DataFrame:
    """All rows, with is_duplicate and duplicate_of."""
    firsts = df.groupBy(fingerprint).agg(F.min_by(F.col(key), F.col(seq)).alias("__first"), F.min(seq).alias("__seq"))
    dup = F.col(seq) > F.col("__seq")
    return df.join(firsts, fingerprint).withColumn("is_duplicate", dup).withColumn("duplicate_of", F.when(dup, F.col("__first"))).drop("__first", "__seq")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of several providers, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_ids(*frames: DataFrame) -> DataFrame:
    """Distinct rows of several candidate lists."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: repeated rows, their percentage, whether 5 % is reached (F8), and the uniqueness score (H22). Counts per distinct row have partial sums."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    n, dup = F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
    return per.agg(n.alias("total_rows"), dup.alias("duplicate_count"), F.round(F.coalesce(F.try_divide(dup * 100.0, n), F.lit(0.0)), 2).alias("duplicate_percentage")).withColumns({"warning": F.col("duplicate_percentage") >= 5, "uniqueness_score": F.round(100.0 - F.col("duplicate_percentage"), 2)})


def duplicate_hashes(df: DataFrame, value: str = "hash") -> DataFrame:
    """One row: repeated hashes over all classes, with levels at 3 % and 10 %."""
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    n, dup = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    share = F.round(F.coalesce(F.try_divide(dup * 100.0, n), F.lit(0.0)), 2)
    return per.agg(n.alias("total"), dup.alias("duplicate_count"), share.alias("duplicate_percentage")).withColumn("level", F.when(F.col("duplicate_percentage") >= 10, "high").when(F.col("duplicate_percentage") >= 3, "some").otherwise("none"))


def modality_sets(have: Column, need: Column) -> Column:
    """struct<matched, missing, any> of two arrays."""
    return F.struct(F.array_intersect(need, have).alias("matched"), F.array_except(need, have).alias("missing"), F.coalesce(F.arrays_overlap(need, have), F.lit(False)).alias("any"))
