"""Explanations of ranked rows as ordered rule lists.

Rows may carry what an analysis of the records' own data found (``ANALYSED``, as of ``profiling.group_signals``); its scores
and fixes then come first, and take the place of what metadata alone would say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import bias_signals, score_label

DIMENSIONS = {"task_relevance": "task relevance", "quality": "data quality", "popularity": "popularity", "freshness": "freshness", "description_match": "description match"}


def _listed(*rules: tuple[Column, str | Column], most: int) -> Column:
    """Texts of the rules that hold, in order, at most ``most``."""
    each = [F.when(on, F.lit(said) if isinstance(said, str) else said) for on, said in rules]
    return F.slice(F.filter(F.array(*each), lambda x: x.isNotNull()), 1, most)


#: What an analysis adds to a row; all null where there was none. ``partial``: the data could not be read.
ANALYSED = {"deep_score": "double", "completeness_score": "double", "balance_score": "double", "uniqueness_score": "double", "fixes": "array<string>", "partial": "boolean", "analysis_error": "string"}


def _score(c: str, on: Column) -> Column:
    """Whether the data were read and the score fits; false where it is null."""
    return F.coalesce(~F.coalesce("partial", F.lit(True)) & F.col(c).isNotNull() & on, F.lit(False))


def _whole(c: str) -> Column:
    return F.bround(c).cast("int").cast("string")


def _tenth(x: Column) -> Column:
    return x.cast("decimal(5,1)").cast("string")


def _fixed(*words: str) -> Column:
    """Whether a fix speaks of one of the words."""
    return F.exists(F.coalesce("fixes", F.array().cast("array<string>")), lambda f: F.lower(f).rlike("|".join(words)))


def strengths(most: int = 7) -> Column:
    c = F.col
    return _listed(
        (_score("completeness_score", c("completeness_score") >= 90), F.concat(F.lit("data nearly complete: "), _tenth(100 - c("completeness_score")), F.lit("% missing"))),
        (_score("uniqueness_score", c("uniqueness_score") >= 98), "hardly any duplicate rows"), (_score("balance_score", c("balance_score") >= 75), F.concat(F.lit("balanced classes: "), _whole("balance_score"), F.lit("/100"))),
        (_score("deep_score", c("deep_score") >= 75), F.concat(F.lit("good data: "), _whole("deep_score"), F.lit("/100"))),
        (c("task_relevance") >= 0.80, "highly relevant task"), ((c("task_relevance") >= 0.65) & (c("task_relevance") < 0.80), "good task alignment"), (c("description_match") >= 0.75, "well described"),
        (c("popularity") >= 0.70, F.concat(F.lit("widely used: "), F.coalesce(c("download_count").cast("string"), F.lit("many")), F.lit(" downloads"))), (c("freshness") >= 0.75, "recently updated"),
        ((c("quality") >= 0.75) & c("deep_score").isNull(), "high quality"), (c("has_schema_info"), "schema available"), (c("license_type").isNotNull(), F.concat(F.lit("license: "), c("license_type"))),
        (F.coalesce(c("row_count") >= 10_000, F.lit(False)), "substantial size"), (F.coalesce(c("match_type") == "exact", F.lit(False)), "exact task match"), most=most,
    )


def weaknesses(most: int = 6) -> Column:
    c = F.col
    limited = F.concat(F.lit("data could not be analysed"), F.when(F.length("analysis_error") > 0, F.concat(F.lit(": "), F.substring("analysis_error", 1, 80))).otherwise(""))
    own = _listed(
        (_score("completeness_score", c("completeness_score") < 70) & ~_fixed("missing", "null"), F.concat(F.lit("many missing values: only "), _whole("completeness_score"), F.lit("% there"))),
        (_score("balance_score", c("balance_score") < 50) & ~_fixed("balance", "samples"), F.concat(F.lit("classes out of balance: "), _whole("balance_score"), F.lit("/100"))),
        (_score("uniqueness_score", c("uniqueness_score") < 95) & ~_fixed("duplicate"), F.concat(F.lit("duplicate rows: "), _tenth(100 - c("uniqueness_score")), F.lit("%"))), (F.coalesce("partial", F.lit(False)), limited),
        (c("freshness") < 0.35, "may be outdated"), ((c("quality") < 0.40) & c("deep_score").isNull(), "low quality"), (c("license_type").isNull() & ~_fixed("license"), "license not specified"),
        ((c("description_length") < 20) & ~_fixed("description"), "minimal description"), (~c("has_schema_info") & ~_fixed("schema", "column"), "no column schema"), (F.coalesce(c("row_count") < 500, F.lit(False)), "small"), (c("task_relevance") < 0.40, "limited task alignment"), most=most,
    )
    return F.slice(F.concat(F.slice(F.coalesce("fixes", F.array().cast("array<string>")), 1, 4), own), 1, most)


def warnings(most: int = 4) -> Column:
    tag = lambda *ts: F.exists("tags", lambda t: F.lower(t).isin(*ts))
    places = F.slice(F.filter(F.coalesce("fixes", F.array().cast("array<string>")), lambda f: F.lower(f).rlike("region|geographic|geography")), 1, 1)
    shown = _listed((_score("balance_score", F.col("balance_score") < 40), F.concat(F.lit("class imbalance in the data: "), _whole("balance_score"), F.lit("/100"))), most=1)
    unknown = F.col("balance_score").isNull() | F.coalesce("partial", F.lit(True))
    own = _listed((tag("synthetic"), "synthetic data"), (tag("imbalanced", "class imbalance") & unknown, "possible class imbalance"), (tag("demographic", "sensitive"), "sensitive features"), most=most)
    return F.slice(F.concat(places, shown, F.transform(bias_signals(), lambda x: x["type"]), own), 1, most)


def top_dimensions(n: int = 2) -> Column:
    """Names and percentages of the ``n`` highest dimensions above 0."""
    dims = F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.concat(F.lit(v + " ("), F.round(F.col(k) * 100).cast("int").cast("string"), F.lit("%)")).alias("t")) for i, (k, v) in enumerate(DIMENSIONS.items())])
    return F.transform(F.filter(F.slice(F.array_sort(dims), 1, n), lambda x: x["s"] < 0), lambda x: x["t"])


def extremes() -> Column:
    """struct<best, worst> dimension of a row."""
    dims = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(DIMENSIONS)]))
    return F.struct(F.get(dims, 0)["name"].alias("best"), F.element_at(dims, -1)["name"].alias("worst"))


def why_selected() -> Column:
    suffix = F.when(F.col("rank") == 1, "st").when(F.col("rank") == 2, "nd").when(F.col("rank") == 3, "rd").otherwise("th")
    first = F.concat(F.col("title"), F.lit(" ranks "), F.col("rank").cast("string"), suffix, F.lit(" with "), score_label("composite"), F.lit("."))
    return F.concat_ws(" ", first, F.when(F.size(top_dimensions()) > 0, F.concat(F.lit("Strongest: "), F.array_join(top_dimensions(), " and "), F.lit("."))))


def narrative() -> Column:
    """struct<why_ranked, score_narrative> (G32): the strongest dimension, how far task and freshness carry."""
    two = lambda c: F.col(c).cast("decimal(5,2)").cast("string")
    dims = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k.replace("_", " ")).alias("name"), two(k).alias("t")) for i, k in enumerate(DIMENSIONS)]))
    best = F.get(dims, 0)
    why = F.concat(F.lit("Ranked #"), F.col("rank").cast("string"), F.lit(" with a composite score of "), two("composite"), F.lit(". Strongest signal: "), best["name"], F.lit(" ("), best["t"], F.lit(")."))
    task = F.concat(F.lit("Task relevance "), two("task_relevance"), F.lit(": "), F.when(F.col("task_relevance") > 0.6, "strong").otherwise("moderate"), F.lit(" alignment."))
    fresh = F.concat(F.lit("Freshness "), two("freshness"), F.lit(": "), F.when(F.col("freshness") > 0.6, "recent maintenance").otherwise("potentially older data"), F.lit("."))
    return F.struct(why.alias("why_ranked"), F.concat_ws(" ", task, fresh).alias("score_narrative"))


def explain(ranked: DataFrame, analysis: DataFrame | None = None, on: str = "canonical_id") -> DataFrame:
    """Ranked rows with labels, strengths, weaknesses, warnings and a paragraph (G18-G20): one projection.

    ``analysis`` has a row for each value of ``on`` that was analysed, with columns of ``ANALYSED``.
    """
    if analysis is not None:
        ranked = ranked.join(analysis, on, "left")
    absent = {**ANALYSED, "match_type": "string"}.items()
    ranked = ranked.withColumns({c: F.lit(None).cast(t) for c, t in absent if c not in ranked.columns})
    return ranked.withColumns({"strengths": strengths(), "weaknesses": weaknesses(), "warnings": warnings(), "why_selected": why_selected(), "extremes": extremes(), "label": score_label("composite")})


def bias_report(catalog: DataFrame) -> DataFrame:
    """One row for each risk of each record that has any."""
    return catalog.select("canonical_id", F.explode(bias_signals()).alias("s")).select("canonical_id", "s.type", "s.severity", "s.penalty")
