"""Fields derived once at ingest, and checks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals, text
from .stages import small

#: Tiers of a score.
TIERS = ((0.85, "gold"), (0.65, "silver"), (0.45, "bronze"))
SOURCES = ("kaggle", "huggingface", "openml")


def completeness() -> Column:
    """Share of the ten tracked fields that are filled in."""
    some = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    known = lambda c: F.coalesce(~F.lower(F.trim(F.col(c))).isin("", "none", "unknown"), F.lit(False))
    above = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    filled = [some("title"), some("description"), F.coalesce(F.size("tags") > 0, F.lit(False)), some("source_url"), above("row_count"), above("column_count"), above("file_size_bytes"), known("license_type"), known("data_format"), F.col("last_updated").isNotNull()]
    return F.round(sum((f.cast("int") for f in filled[1:]), filled[0].cast("int")) / 10.0, 3)


def tier(score: Column | str) -> Column:
    """gold, silver, bronze or incomplete."""
    s = text.col(score)
    out = F.when(s >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(s >= least, name)
    return out.otherwise("incomplete")


def derive(records: DataFrame, include_source: bool = True) -> DataFrame:
    """Records with their derived fields: one projection, no shuffle."""
    optional = ("row_count", "column_count", "file_size_bytes", "data_format", "license_type", "data_domain", "last_updated", "author", "language")
    return records.withColumns({
        "canonical_id": F.concat_ws(":", "source", "source_id"),
        "dataset_fingerprint": text.fingerprint("title", "source", "row_count", "column_names", include_source),
        "description_clean": text.sentence_cut("description"),
        "description_short": text.word_cut("description"),
        "tags_primary": text.primary_tags("tags"),
        "metadata_completeness": completeness(),
        "has_description": F.coalesce(F.trim("description") != "", F.lit(False)),
        "has_schema_info": F.coalesce(F.size("column_names") > 0, F.lit(False)),
        "has_size_info": F.col("row_count").isNotNull() | F.col("file_size_bytes").isNotNull(),
        "has_license_info": F.coalesce(F.col("license_type") != "unknown", F.lit(False)),
        "description_length": F.coalesce(F.length("description"), F.lit(0)),
        "tag_count": F.coalesce(F.size("tags"), F.lit(0)),
        "missing_fields_count": sum((F.col(c).isNull().cast("int") for c in optional[1:]), F.col(optional[0]).isNull().cast("int")),
    })


def joined_text() -> Column:
    """Title, clean description and primary tags with single spaces between; records without tags end in the description."""
    tags = F.when(F.size("tags_primary") > 0, F.array_join("tags_primary", " "))
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description_clean", F.lit("")), tags)


def searchable_text() -> Column:
    """Title three times, short description and primary tags: the text that both indexes see."""
    parts = F.array("title", "title", "title", "description_short", F.array_join("tags_primary", " "))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def reject_reason() -> Column:
    """Why a record's lineage or ranges are invalid, null for a valid one."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    major = lambda c: F.get(F.split(F.col(c), r"\."), 0)
    checks = [
        F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown source"),
        F.when(blank("source_url"), "no url"), F.when(blank("source_id"), "no id"), F.when(blank("ingestion_version"), "no version"),
        F.when(major("pipeline_version") != major("schema_version"), "versions differ"),
        F.when(~F.coalesce(F.col("dataset_fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad fingerprint"),
        F.when(~F.coalesce(F.col("metadata_completeness").between(0, 1), F.lit(False)), "completeness out of range"),
    ]
    reasons = F.concat_ws(",", *checks)
    return F.when(reasons != "", reasons)


def validate(records: DataFrame, strict: bool = False) -> DataFrame:
    """Strict: fail on the first invalid record. Else clamp ranges and mark with reject_reason."""
    out = records.withColumn("reject_reason", reject_reason())
    if strict:
        return out.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.col("reject_reason"))).otherwise(F.lit(None).cast("string")))
    return out.withColumn("metadata_completeness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("metadata_completeness", F.lit(0.0)))))


def _issues(*rules: tuple[Column, str | Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(said) if isinstance(said, str) else said) for bad, said in rules]), lambda x: x.isNotNull())


def is_image() -> Column:
    return F.coalesce(F.array_contains("modalities", "image"), F.lit(False))


def metadata_quality(min_description: int = 20) -> Column:
    """struct<completeness, consistency, validity, composite, issues>."""
    comp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("metadata_completeness", F.lit(0.0))))
    both = F.col("column_count").isNotNull() & F.col("column_names").isNotNull()
    have = F.size("column_names")
    cons = F.when(both & (F.col("column_count") != have), F.greatest(F.lit(0.0), 1 - F.abs(F.col("column_count") - have) / F.greatest(F.col("column_count"), have, F.lit(1)))).otherwise(1.0)
    desc = F.length(F.trim(F.coalesce("description", F.lit(""))))
    ok = [desc >= min_description, F.coalesce(F.size("tags") >= 1, F.lit(False)), F.col("license_type").isNotNull(), ~is_image() & F.coalesce(F.size("column_names") > 0, F.lit(False))]
    valid = sum((x.cast("int") for x in ok[1:]), ok[0].cast("int")) / F.when(is_image(), 3).otherwise(4)
    issues = _issues((comp < 0.5, "low completeness"), (cons < 1, "column count mismatch"), (desc == 0, "no description"), ((desc > 0) & (desc < min_description), "short description"), (~ok[1], "no tags"), (~ok[2], "no license"), (~is_image() & ~ok[3], "no schema"))
    return F.struct(comp.alias("completeness"), cons.alias("consistency"), valid.alias("validity"), F.round(comp * 0.4 + cons * 0.3 + valid * 0.3, 4).alias("composite"), issues.alias("issues"))


def metadata_score() -> Column:
    """Points for description, schema, size, license and tags, and for the scale of image sets."""
    points = lambda c, n: F.when(F.col(c), float(n)).otherwise(0.0)
    n = F.coalesce(signals.described_counts("title", "description")["total_images"], F.lit(0))
    scale = F.when(~is_image(), 0.0).when(n >= 50_000, 20.0).when(n >= 10_000, 15.0).when(n >= 1_000, 10.0).when(n >= 100, 5.0).otherwise(0.0)
    return F.round(points("has_description", 30) + points("has_schema_info", 20) + points("has_size_info", 20) + points("has_license_info", 15) + F.least(F.col("tag_count") / 10.0 * 15.0, F.lit(15.0)) + scale, 2)


def metadata_gaps() -> Column:
    """Which of seven things a record lacks."""
    lacks = lambda c: F.col(c).isNull()
    return _issues((~F.col("has_description"), "description"), (~F.col("has_license_info"), "license"), (lacks("row_count"), "row count"), (~F.col("has_schema_info"), "schema"), (lacks("last_updated"), "update date"), (F.coalesce(F.size("task_types"), F.lit(0)) <= 0, "task types"), (F.col("tag_count") == 0, "tags"))


def risk_signals(score: str = "composite") -> Column:
    """Risks that score and metadata show."""
    return _issues((F.col(score) < 0.4, "low score"), (~F.col("has_license_info"), "license unknown"), (F.coalesce(F.col("row_count") < 1000, F.lit(False)), "small"), (F.col("metadata_completeness") < 0.5, "incomplete metadata"))


#: Levels of detail of an explanation that a request may ask for.
DETAILS = ("minimal", "standard", "detailed")


def clamp_requests(queries: DataFrame, most_chars: int = 500, most_results: int = 50, strict: bool = False) -> DataFrame:
    """Queries stripped, cut and bounded, with a reject reason where a value makes no sense, null for valid ones.

    Checked beside the text: sources, min_completeness, min_rows against max_rows, result_diversity, explanation_detail and
    priority, each if the column is there; null passes. All reasons are told, in this order. ``strict`` rejects texts that
    are too long instead of cutting them. One projection.
    """
    stripped = text.stripped("raw_query")
    have = lambda c: F.col(c) if c in queries.columns else F.lit(None)
    wrong = lambda c: F.coalesce(c, F.lit(False))
    outside = lambda c, low, high: wrong(~have(c).cast("double").between(low, high))
    foreign = F.filter(have("sources").cast("array<string>"), lambda s: ~F.coalesce(s.isin(*SOURCES), F.lit(False)))
    reasons = _issues(
        (stripped == "", "empty query"), (F.lit(strict) & (F.length(stripped) > most_chars), "query too long"), (F.coalesce(F.size(foreign), F.lit(0)) > 0, "unknown sources"),
        (outside("min_completeness", 0.0, 1.0), "completeness out of range"), (wrong(have("min_rows").cast("long") > have("max_rows").cast("long")), "more rows at least than at most"),
        (outside("result_diversity", 0.0, 1.0), "diversity out of range"), (wrong(~have("explanation_detail").cast("string").isin(*DETAILS)), "unknown detail"), (outside("priority", 1, 10), "priority out of range"),
    )
    bounded = F.greatest(F.lit(1), F.least(F.lit(most_results), F.coalesce("max_results", F.lit(10))))
    out = {"raw_query": F.substring(stripped, 1, most_chars), "max_results": bounded, "reject_reason": F.when(F.size(reasons) > 0, F.array_join(reasons, ","))}
    if "result_diversity" in queries.columns:
        out["result_diversity"] = F.round("result_diversity", 2)
    return queries.withColumns(out)


def token_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of logged model calls: rates has model, prompt_rate and completion_rate; unknown models cost nothing."""
    return usage.join(small(rates), "model", "left").withColumn("cost", F.coalesce(F.col("prompt_tokens") * F.col("prompt_rate") + F.col("completion_tokens") * F.col("completion_rate"), F.lit(0.0)))
