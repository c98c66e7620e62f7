"""What titles, tags and descriptions say about a record: modality, counts, regions, target columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import col

KINDS = ("image", "tabular", "text", "audio", "video")
#: Score of a tag, of a title or description pattern, and the caps of tags, title, description, metadata.
TAG_POINTS = {"image": 0.15, "tabular": 0.10, "text": 0.15, "audio": 0.20, "video": 0.20}
PATTERN_POINTS = {"image": (0.08, 0.40), "tabular": (0.07, 0.35), "text": (0.08, 0.40), "audio": (0.12, 0.40)}
CAPS = (0.40, 0.25, 0.25, 0.10)
THRESHOLD, OPENML_FLOOR, OPENML_BELOW = 0.20, 0.30, 0.3


def _hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns the text matches."""
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in patterns[1:]), F.when(text.rlike(patterns[0]), 1).otherwise(0))


def _points_to(kind: str):
    """Whether a tag, or the tag with underscores, holds a word of the kind."""
    words = "|".join(re.escape(w) for w in getattr(vocab, f"TAG_{kind.upper()}"))
    return lambda t: F.lower(t).rlike(words) | F.translate(F.lower(t), "- ", "__").rlike(words)


def modality_scores(tags: Column | str, title: Column | str, description: Column | str, source: Column | str | None = None, extra: dict[str, Column] | None = None) -> dict[str, Column]:
    """Score of each modality: capped sums over tags, title, description and metadata."""
    title, text = F.lower(F.coalesce(col(title), F.lit(""))), F.lower(F.coalesce(col(description), F.lit("")))
    out = {}
    for kind in KINDS:
        n = F.size(F.filter(F.coalesce(col(tags), F.array().cast("array<string>")), _points_to(kind)))
        score = F.least(n * F.lit(TAG_POINTS[kind]), F.lit(CAPS[0]))
        if kind in PATTERN_POINTS:
            each, most = PATTERN_POINTS[kind]
            for body, place, cap in ((title, "TITLE", CAPS[1]), (text, "DESC", CAPS[2])):
                score = score + F.least(_hits(body, getattr(vocab, f"{place}_{kind.upper()}")) * F.lit(each), F.lit(min(most, cap)))
        if extra and kind in extra:
            score = score + F.least(extra[kind], F.lit(CAPS[3]))
        out[kind] = F.round(score, 6)
    if source is not None:
        weak = (col(source) == "openml") & (out["image"] < OPENML_BELOW)
        out["tabular"] = F.when(weak, F.greatest(out["tabular"], F.lit(OPENML_FLOOR))).otherwise(out["tabular"])
    return out


def detect_modality(tags: Column | str, title: Column | str, description: Column | str, source: Column | str | None = None, extra: dict[str, Column] | None = None) -> Column:
    """struct<modality, confidence>: best score if at least 0.2, and its share of all scores."""
    scores = modality_scores(tags, title, description, source, extra)
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, s) in enumerate(scores.items())]))
    total = sum(list(scores.values())[1:], scores["image"])
    low = best["score"] < THRESHOLD
    return F.struct(F.when(low, "other").otherwise(best["name"]).alias("modality"), F.when(low, 0.0).otherwise(F.round(best["score"] / total, 3)).alias("confidence"))


#: Words of counts in descriptions, and the ranges in which a count is believed.
COUNTED = r"\s*(?:images?|photos?|samples?|pictures?|files?)"
IMAGE_COUNTS = (r"(?i)(\d[\d,]+)" + COUNTED, r"(?i)(\d+\.?\d*)\s*k" + COUNTED, r"(?i)(?:over|around|about|~)\s*(\d[\d,]+)")
CLASS_COUNTS = (r"(?i)(\d+)\s*(?:different\s+)?(?:classes?|categories?|labels?|types?|folders?|species)", r"(?i)(?:categorized|classified|grouped)\s+into\s+(\d+)")
IMAGES, CLASSES = (50, 10_000_000), (2, 1000)


def described_counts(title: Column | str, description: Column | str) -> Column:
    """struct<total_images, num_classes> that the text names, null where none is believable."""
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit("")))

    def found(pattern: str, within: tuple[int, int]) -> Column:
        whole = F.regexp_extract(text, pattern, 0)
        n = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        n = F.floor(n * F.when(whole.rlike(r"(?i)\d+\.?\d*\s*k"), 1000).otherwise(1))
        return F.when((n >= within[0]) & (n <= within[1]), n.cast("bigint"))

    return F.struct(F.coalesce(*[found(p, IMAGES) for p in IMAGE_COUNTS]).alias("total_images"), F.coalesce(*[found(p, CLASSES) for p in CLASS_COUNTS]).alias("num_classes"))


def region_bias(fields: dict[str, Column | str], word_boundary: bool = False) -> Column:
    """struct<regions, evidence, confidence, single_region> from region words in named text fields."""
    texts = {name: F.lower(F.coalesce(col(c), F.lit(""))) for name, c in fields.items()}
    has = lambda t, w: t.rlike(rf"\b{re.escape(w)}\b") if word_boundary else F.contains(t, F.lit(w))
    named = F.filter(F.array(*[F.when(has(t, w), F.struct(F.lit(region).alias("region"), F.lit(f"Found '{w}' in {name}").alias("evidence"))) for region, words in vocab.REGIONS.items() for name, t in texts.items() for w in words]), lambda x: x.isNotNull())
    return F.transform(F.array(named), lambda x: F.struct(F.array_distinct(F.transform(x, lambda y: y["region"])).alias("regions"), F.transform(x, lambda y: y["evidence"]).alias("evidence"), F.when(F.size(x) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(0.3 + F.size(x) * 0.1, 6))).alias("confidence"), (F.size(F.array_distinct(F.transform(x, lambda y: y["region"]))) == 1).alias("single_region")))[0]


#: Names of target columns, endings of such, and their confidence.
TARGETS = ("target", "label", "class", "y", "output", "outcome", "result")
ENDINGS = ("_label", "_class", "_target")


def target_columns(names: Column | str) -> Column:
    """array<struct<confidence, column>> of likely targets: exact names, then endings, shorter first."""
    low = lambda x: F.lower(F.trim(x))
    ends = lambda x: F.exists(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: low(x).endswith(e) & (F.length(low(x)) > F.length(e)))
    each = F.transform(col(names), lambda x, i: F.struct(F.when(low(x).isin(*TARGETS), -0.95).when(ends(x), -0.75).alias("c"), F.length(x).alias("n"), i.alias("i"), x.alias("column")))
    return F.transform(F.array_sort(F.filter(each, lambda x: x["c"].isNotNull())), lambda x: F.struct((-x["c"]).alias("confidence"), x["column"].alias("column")))


def class_count_tags(tags: Column | str, classes: Column | str) -> Column:
    """Tags with the task that the number of classes implies: 2 is binary, more is multi-class."""
    return F.array_union(col(tags), F.when(col(classes) == 2, F.array(F.lit("binary_classification"))).when(col(classes) > 2, F.array(F.lit("classification"))).otherwise(F.array().cast("array<string>")))


def subject_words(description: Column | str, stop: tuple[str, ...] = ("dataset", "images", "image", "with", "from", "this", "that", "contains", "collection")) -> Column:
    """Up to three longer words of a description."""
    return F.concat_ws(" ", F.slice(F.filter(F.regexp_extract_all(F.lower(col(description)), F.lit("[a-z]{4,}"), 0), lambda x: ~x.isin(*stop)), 1, 3))
