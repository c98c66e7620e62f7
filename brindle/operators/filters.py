"""Hard gates with the reason of the first one that fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

NON_COMMERCIAL = ("cc_by_nc", "cc_by_nc_sa")


@dataclass(frozen=True)
class Gates:
    """Which gates are on. Empty and zero values leave a gate off; null sizes and dates pass."""

    exclude_duplicates: bool = False
    sources: tuple[str, ...] = ()
    require_description: bool = False
    min_rows: int = 0
    max_rows: int = 0
    min_completeness: float = 0.0
    min_quality: float = 0.0
    commercial: bool = False
    excluded_licenses: tuple[str, ...] = ()
    licenses: tuple[str, ...] = ()
    required_modalities: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    updated_after: str | None = None
    strict_task: str | None = None
    #: Opt-in gates that a request may name.
    min_columns: int = 0
    formats: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    require_schema: bool = False
    require_license: bool = False
    extra: tuple = field(default=())

    def active(self) -> list[tuple[str, Column]]:
        """(reason, condition that fails), in order."""
        none_of = lambda c, xs: ~F.coalesce(F.col(c).isin(*xs), F.lit(False))
        apart = lambda c, xs: ~F.coalesce(F.arrays_overlap(F.col(c), F.array(*[F.lit(x) for x in xs])), F.lit(False))
        yes = lambda c: F.coalesce(c, F.lit(False))
        tried = (
            (self.exclude_duplicates, "duplicate", lambda: yes(F.col("is_duplicate"))),
            (self.sources, "source", lambda: none_of("source", self.sources)),
            (self.require_description, "description", lambda: ~F.col("has_description")),
            (self.min_rows, "min_rows", lambda: yes(F.col("row_count") < self.min_rows)),
            (self.max_rows, "max_rows", lambda: yes(F.col("row_count") > self.max_rows)),
            (self.min_completeness, "min_completeness", lambda: yes(F.col("metadata_completeness") < self.min_completeness)),
            (self.min_quality, "min_quality", lambda: yes(F.col("metadata_completeness") * 100 < self.min_quality)),
            (self.commercial, "non_commercial", lambda: yes(F.col("license_type").isin(*NON_COMMERCIAL))),
            (self.excluded_licenses, "excluded_license", lambda: yes(F.col("license_type").isin(*self.excluded_licenses))),
            (self.licenses, "license", lambda: none_of("license_type", self.licenses)),
            (self.required_modalities, "required_modality", lambda: apart("modalities", self.required_modalities)),
            (self.modalities, "modality", lambda: apart("modalities", self.modalities)),
            (self.updated_after, "updated_after", lambda: yes(F.col("last_updated") < F.lit(self.updated_after).cast("timestamp_ntz"))),
            (self.strict_task and self.strict_task != "other", "task", lambda: yes((F.size("modalities") > 0) & (rules.needs_met(F.lit(self.strict_task), "modalities") < 0.5))),
            (self.min_columns, "min_columns", lambda: yes(F.col("column_count") < self.min_columns)),
            (self.formats, "format", lambda: none_of("data_format", self.formats)),
            (self.domains, "domain", lambda: none_of("data_domain", self.domains)),
            (self.tasks, "task_type", lambda: apart("task_types", self.tasks)),
            (self.languages, "language", lambda: none_of("language", self.languages)),
            (self.require_schema, "schema", lambda: ~F.col("has_schema_info")),
            (self.require_license, "no_license", lambda: ~F.col("has_license_info")),
        )
        return [(reason, fails()) for on, reason, fails in tried if on]


def judge(catalog: DataFrame, gates: Gates) -> DataFrame:
    """``catalog`` with reject_reason, null for rows that pass all gates: one scan serves both outputs."""
    active = gates.active()
    reason = F.coalesce(*[F.when(fails, name) for name, fails in active]) if active else F.lit(None).cast("string")
    return catalog.withColumn("reject_reason", reason)


def passed(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNotNull())


def summary(judged: DataFrame) -> DataFrame:
    """One row: totals, pass rate and counts per reason."""
    per = judged.groupBy("reject_reason").count()
    n, ok = F.sum("count"), F.sum(F.when(F.col("reject_reason").isNull(), F.col("count")).otherwise(0))
    return per.agg(F.coalesce(n, F.lit(0)).alias("total_input"), F.coalesce(ok, F.lit(0)).alias("passed"), F.coalesce(n - ok, F.lit(0)).alias("rejected"), F.round(F.coalesce(F.try_divide(ok, n), F.lit(0.0)), 3).alias("pass_rate"))


def relevance_gate(ranked: DataFrame, gate: float = 0.25, top: float = 0.05) -> DataFrame:
    """Queries whose first five hits all miss the description gate and whose best score is tiny."""
    five = ranked.filter("rank <= 5").groupBy("query_id").agg(F.max("description_match").alias("best_match"), F.min_by("composite", "rank").alias("top_score"))
    return five.withColumn("no_results", (F.coalesce("best_match", F.lit(0.0)) < gate) & (F.col("top_score") < top))


def first_reasons(judged: DataFrame, each: int = 3) -> DataFrame:
    """Up to ``each`` example records per reason."""
    w = Window.partitionBy("reject_reason").orderBy("canonical_id")
    return rejected(judged).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each).select("reject_reason", "canonical_id")
