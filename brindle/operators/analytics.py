"""Counts and rollups of the catalog, search logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper edges of cumulative histograms of seconds and of completeness.
SECONDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
SHARES = tuple(i / 10 for i in range(11))


def total(catalog: DataFrame, duplicates: bool = True) -> DataFrame:
    """One row with the number of records."""
    return (catalog if duplicates else catalog.filter(~F.col("is_duplicate"))).agg(F.count(F.lit(1)).alias("total"))


def count_by(catalog: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """Records by a column."""
    d = catalog if nulls else catalog.filter(F.col(column).isNotNull())
    return d.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def completeness_by_source(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("source").agg(F.round(F.avg("metadata_completeness"), 3).alias("avg_completeness"))


def rollup_by_source(catalog: DataFrame) -> DataFrame:
    """Records by source, and in all (source null) (I9): one job."""
    return catalog.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("is_total"))


def stale(catalog: DataFrame, before: Column, n: int, at: str = "crawled_at") -> DataFrame:
    """The ``n`` records that were crawled longest ago (I5): a top-k."""
    return catalog.filter(F.col(at) < before).orderBy(at, "canonical_id").limit(n)


def update_analysis(catalog: DataFrame, found: DataFrame, columns: tuple[str, ...], key: str = "canonical_id") -> DataFrame:
    """Records with analysis columns replaced where the new value is not null."""
    n = found.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    d = catalog.join(n, key, "left")
    return d.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def recent(log: DataFrame, n: int, at: str = "searched_at", key: str = "request_id") -> DataFrame:
    """The ``n`` newest searches (I8)."""
    return log.orderBy(F.desc(at), key).limit(n)


def metric_summary(events: DataFrame, name: str = "name", value: str = "value", ts: str = "ts", key: str | None = None) -> DataFrame:
    """(name, count, total, mean, last)."""
    order = F.struct(ts, *([key] if key else []))
    return events.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.max_by(value, order).alias("last"))


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """Events by any labels."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def histogram(events: DataFrame, by: str, value: str, edges: tuple[float, ...] = SECONDS) -> DataFrame:
    """(by, edge, count): events at or below each edge; the last row counts all (I12). One aggregation."""
    per = events.groupBy(by).agg(*[F.count_if(F.col(value) <= e).alias(f"e{i}") for i, e in enumerate(edges)], F.count(value).alias("all"))
    each = F.array(*[F.struct(F.lit(str(e)).alias("edge"), F.col(f"e{i}").alias("count")) for i, e in enumerate(edges)], F.struct(F.lit("+Inf").alias("edge"), F.col("all").alias("count")))
    return per.select(by, F.explode(each).alias("h")).select(by, "h.*")
