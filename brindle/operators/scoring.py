"""Scores of a record for a query, and per-dimension metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, vocab
from ..functions.text import age_days

#: Weights, gates and normalisers of the score.
WEIGHTS = {"task_relevance": 0.35, "quality": 0.20, "popularity": 0.15, "freshness": 0.10, "description_match": 0.20}
GATE = 0.25
HALF_LIFE = 365.0
DOWNLOADS, UPVOTES = 100_001.0, 1_001.0
SUPERVISED = ("classification", "binary_classification", "multi_label_classification", "regression", "image_classification", "object_detection", "semantic_segmentation", "text_classification", "sentiment_analysis", "ner")
LABELS = ((0.85, "Excellent"), (0.70, "Good"), (0.50, "Fair"), (0.30, "Weak"))


def half_up(c: Column, n: int = 4) -> Column:
    """Rounded with ties upwards, whatever the last bits of the sum say: the same in every engine."""
    return F.round(c + 1e-9, n)


def normalized(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that sum to 1; all zero gives equal ones."""
    full = {k: (weights or WEIGHTS).get(k, 0.0) for k in WEIGHTS}
    total = sum(full.values())
    return {k: v / total for k, v in full.items()} if total else dict.fromkeys(full, 1 / len(full))


def task_relevance(task: Column) -> Column:
    """1 exact, 0.7 same family, else how modalities fit, 0.4 if nothing is known, 0.5 without a task (G1)."""
    known = F.coalesce(F.size("task_types"), F.lit(0)) > 0
    same = F.exists("task_types", lambda t: rules.family(t) == rules.family(task))
    fit = rules.needs_met(task, "modalities")
    return (
        F.when(task.isNull() | task.isin("other", "unknown"), 0.5)
        .when(known & F.coalesce(F.array_contains("task_types", task), F.lit(False)), 1.0)
        .when(known & F.coalesce(same, F.lit(False)), 0.7)
        .when(F.coalesce(F.size("modalities"), F.lit(0)) > 0, F.when(fit >= 0.5, fit).otherwise(0.1))
        .otherwise(0.4)
    )


def quality() -> Column:
    flag = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    return half_up(F.least(F.col("metadata_completeness") * 0.60 + flag("has_description", 0.20) + flag("has_schema_info", 0.10) + flag("has_license_info", 0.10), F.lit(1.0)))


def _log_share(c: str, norm: float) -> Column:
    return F.when(F.col(c) > 0, F.log(F.col(c) + 1.0) / F.log(F.lit(norm))).otherwise(0.0)


def popularity() -> Column:
    both = F.col("download_count").isNull() & F.col("upvote_count").isNull()
    return F.when(both, 0.3).otherwise(half_up(F.least(_log_share("download_count", DOWNLOADS) * 0.7 + _log_share("upvote_count", UPVOTES) * 0.3, F.lit(1.0))))


def freshness(as_of: str, variant: str = "half_life") -> Column:
    """Half every 365 days (G4), or 1 / (1 + days / 90) (G34); unknown dates give 0.5."""
    days = age_days("last_updated", as_of)
    score = F.pow(F.lit(2.0), -days / HALF_LIFE) if variant == "half_life" else 1.0 / (1.0 + days / 90.0)
    return F.when(F.col("last_updated").isNull(), 0.5).otherwise(half_up(F.least(score, F.lit(1.0))))


def with_match_text(catalog: DataFrame) -> DataFrame:
    """``catalog`` with the text that keywords are looked for in, and its distinct words of five letters or more.

    Added on the side of the records, before they are joined to queries, so that each text is lowered and split once.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description_short", "description")] + [F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("tags_primary", "task_types", "modalities")]
    d = catalog.withColumn("match_text", F.lower(F.concat_ws(" ", *parts)))
    return d.withColumn("match_words", F.array_distinct(F.filter(F.split("match_text", r"\s+"), lambda t: F.length(t) >= 5)))


def description_match(keywords: Column) -> Column:
    """Share of the keywords that the record's text holds: 1 for the word or a synonym, 0.5 for its first five letters."""
    generic = vocab.GENERIC_WORDS
    low = F.transform(keywords, lambda k: F.lower(k))
    special = F.filter(low, lambda k: ~k.isin(generic))
    used = F.when(F.size(special) > 0, special).otherwise(low)
    synonyms = F.create_map(*[x for k, vs in vocab.MATCH_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])

    def points(text: Column, tokens: Column, k: Column) -> Column:
        near = F.exists(F.coalesce(synonyms[k], F.array().cast("array<string>")), lambda s: F.contains(text, s))
        start = F.exists(tokens, lambda t: F.contains(t, F.substring(k, 1, 5)))
        return F.when(F.contains(text, k) | near, 1.0).when(start, 0.5).otherwise(0.0)

    def matched(x: Column) -> Column:
        total = F.aggregate(x["used"], F.lit(0.0), lambda s, k: s + points(x["text"], x["tokens"], k))
        return F.when(F.coalesce(F.size(x["used"]), F.lit(0)) <= 0, 0.5).when(F.trim(x["text"]) == "", 0.0).otherwise(half_up(F.least(total / F.size(x["used"]), F.lit(1.0))))

    return F.transform(F.array(F.struct(F.col("match_text").alias("text"), F.col("match_words").alias("tokens"), used.alias("used"))), matched)[0]


def modality_factor(modality: Column) -> Column:
    """1 if the modality fits, 0.9 if the record has none, 0.4 if not; multimodal records always fit."""
    have = lambda m: F.coalesce(F.array_contains("modalities", m), F.lit(False))
    return F.when(modality.isNull() | (modality == "unknown"), 1.0).when(F.coalesce(F.size("modalities"), F.lit(0)) <= 0, 0.90).when(have(modality) | have("multimodal"), 1.0).otherwise(0.40)


def score(pairs: DataFrame, as_of: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of (query, record) with the five dimensions, the composite and whether the row is gated.

    ``pairs`` holds record columns, best with those of ``with_match_text``, and the query's query_id, task, modality and
    keywords. One projection.
    """
    w = normalized(weights)
    known = "match_text" in pairs.columns
    d = (pairs if known else with_match_text(pairs)).withColumns({"task_relevance": task_relevance(F.col("task")), "quality": quality(), "popularity": popularity(), "freshness": freshness(as_of), "description_match": description_match(F.col("keywords"))})
    total = sum((F.col(k) * F.lit(v) for k, v in list(w.items())[1:]), F.col("task_relevance") * F.lit(w["task_relevance"]))
    gated = (F.coalesce(F.size("keywords"), F.lit(0)) > 0) & (F.col("description_match") < GATE)
    d = d.withColumn("gated", gated).drop("match_text", "match_words")
    return d.withColumn("composite", F.when(F.col("gated"), 0.0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * modality_factor(F.col("modality")))))))


def freshness_metric(as_of: str) -> Column:
    """struct<score, days, decay, bonus, explanation>."""
    days = age_days("last_updated", as_of)
    decay = half_up(F.least(F.pow(F.lit(2.0), -days / HALF_LIFE), F.lit(1.0)))
    bonus = F.when(days <= 90, half_up(0.1 * (1 - days / 90.0))).otherwise(0.0)
    said = F.when(days == 0, "Updated today").when(days <= 30, F.format_string("Updated %d days ago: very fresh", days)).when(days <= 180, F.format_string("Updated %d days ago: current", days)).when(days <= 365, F.format_string("Updated %d days ago: nearly a year old", days)).otherwise(F.format_string("Updated %d days ago: may be stale", days))
    none = F.col("last_updated").isNull()
    return F.struct(F.when(none, 0.5).otherwise(half_up(F.least(decay + bonus, F.lit(1.0)))).alias("score"), F.when(~none, days).alias("days"), F.when(none, 0.5).otherwise(decay).alias("decay"), F.when(none, 0.0).otherwise(bonus).alias("bonus"), F.when(none, "Update date unknown").otherwise(said).alias("explanation"))


def popularity_metric() -> Column:
    """struct<score, downloads, upvotes, bonus, tier>; zero counts as missing."""
    missing = (F.coalesce("download_count", F.lit(0)) == 0) & (F.coalesce("upvote_count", F.lit(0)) == 0)
    down, up = (F.least(half_up(_log_share(c, n)), F.lit(1.0)) for c, n in (("download_count", DOWNLOADS), ("upvote_count", UPVOTES)))
    bonus = F.coalesce(half_up(F.col("usability_rating") * 0.05), F.lit(0.0))
    s = F.when(missing, 0.3).otherwise(half_up(F.least(down * 0.7 + up * 0.3 + bonus, F.lit(1.0))))
    tier = F.when(missing, "no data").when(s >= 0.8, "extremely popular").when(s >= 0.6, "widely adopted").when(s >= 0.4, "moderately popular").when(s >= 0.2, "niche community").otherwise("limited adoption")
    return F.struct(s.alias("score"), down.alias("downloads"), up.alias("upvotes"), F.when(missing, 0.0).otherwise(bonus).alias("bonus"), tier.alias("tier"))


def bias_signals() -> Column:
    """array<struct<type, severity, penalty>> of risks that metadata shows."""
    ratio = F.when(F.col("minority_class_size") > 0, F.col("majority_class_size") / F.col("minority_class_size"))
    cells = F.col("row_count") * F.greatest(F.coalesce(F.col("column_count"), F.lit(1)), F.lit(1))
    missing = F.when((F.col("missing_values") > 0) & (F.col("row_count") > 0), F.col("missing_values") / cells)
    signal = lambda on, kind, severity, penalty: F.when(on, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(penalty).alias("penalty")))
    found = [
        signal(~F.col("has_license_info"), "no_license", "medium", 0.05), signal(~F.col("has_description"), "no_description", "high", 0.10), signal(~F.col("has_size_info"), "no_size_info", "low", 0.03),
        signal(ratio > 20, "class_imbalance", "high", 0.08), signal((ratio > 5) & (ratio <= 20), "class_imbalance", "medium", 0.05),
        signal(missing > 0.20, "high_missing_values", "high", 0.08), signal((missing > 0.05) & (missing <= 0.20), "moderate_missing_values", "low", 0.02),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def quality_metric() -> Column:
    """struct<score, raw, description, annotation, penalty, signals>: five weighted parts less a tenth of the penalty."""
    n = F.coalesce(F.col("description_length"), F.lit(0))
    desc = F.when(n >= 500, 1.0).when(n >= 100, half_up(0.5 + 0.5 * (n - 100) / 400.0)).otherwise(half_up(0.3 * n / 100.0))
    some = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1.0).otherwise(0.0)
    notes = half_up(F.least(F.col("tag_count") / 5.0, F.lit(1.0)) * 0.4 + some("task_types") * 0.4 + some("modalities") * 0.2)
    signals = bias_signals()
    penalty = half_up(F.least(F.aggregate(signals, F.lit(0.0), lambda s, x: s + x["penalty"]), F.lit(0.3)))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    raw = half_up(F.col("metadata_completeness")) * 0.35 + desc * 0.20 + flag("has_schema_info") * 0.15 + flag("has_license_info") * 0.10 + notes * 0.10
    raw = F.greatest(F.lit(0.0), F.least(raw - penalty * 0.10, F.lit(1.0)))
    return F.struct(half_up(raw).alias("score"), raw.alias("raw"), desc.alias("description"), notes.alias("annotation"), penalty.alias("penalty"), signals.alias("signals"))


def task_metric(task: Column) -> Column:
    """struct<score, match_type, bonus>: as task relevance, with 0.05 for supervised tasks with a schema."""
    base = task_relevance(task)
    exact = F.coalesce(F.array_contains("task_types", task), F.lit(False))
    kind = F.when(task.isNull() | task.isin("other", "unknown"), "unknown").when(exact, "exact").when(base == 0.7, "family").when((F.coalesce(F.size("modalities"), F.lit(0)) > 0) & (base > 0.1), "modality").otherwise("none")
    bonus = F.when(kind.isin("exact", "family", "modality") & task.isin(*SUPERVISED) & F.col("has_schema_info"), 0.05).otherwise(0.0)
    return F.struct(half_up(F.least(base + bonus, F.lit(1.0))).alias("score"), kind.alias("match_type"), bonus.alias("bonus"))


def score_label(c: Column | str) -> Column:
    """``Good (71%)`` and the like."""
    s = F.col(c) if isinstance(c, str) else c
    tier = F.when(s >= LABELS[0][0], LABELS[0][1])
    for least, name in LABELS[1:]:
        tier = tier.when(s >= least, name)
    return F.concat(tier.otherwise("Poor"), F.lit(" ("), F.round(s * 100).cast("int").cast("string"), F.lit("%)"))
