"""Ranking of scored rows, confidence, diversity and result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .profiling import weighted_score
from .retrieval import QUERY_BLOCK
from .stages import staged

PENALTY = 0.7


def ordered(seq: str = "seq") -> list[Column]:
    """Gated rows last, then by composite, then by arrival."""
    return [F.col("gated"), F.desc("composite"), F.col(seq)]


def rank(scored: DataFrame, k: int, seq: str = "seq", diversity: bool = True) -> DataFrame:
    """The ``k`` best rows of each query with rank and adjusted score.

    The nth row of a source counts 0.7 ** (n - 1) of its score, if a query has more than ``k`` rows (G10). Ranks are
    partitioned by query, so the work of many queries is spread. ``candidates`` counts k + 1 rows of a source at most,
    which tells whether there are more than ``k`` without a second pass over all rows.
    """
    if diversity:
        of_source = Window.partitionBy("query_id", "source").orderBy(*ordered(seq))
        # a query keeps at most k rows of one source, so the first window can drop the others before the next shuffle
        d = scored.withColumn("nth", F.row_number().over(of_source)).filter(F.col("nth") <= k + 1)
        d = d.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).filter(F.col("nth") <= k)
        d = d.withColumn("adjusted", F.when(F.col("candidates") > k, F.col("composite") * F.pow(F.lit(PENALTY), F.col("nth") - 1)).otherwise(F.col("composite"))).drop("nth")
    else:
        d = scored.withColumn("adjusted", F.col("composite"))
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), *ordered(seq))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def confidence(ranked: DataFrame, score: str = "adjusted") -> DataFrame:
    """(query_id, confidence): by the gap of the best two scores; a single row is certain."""
    two = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.when(F.col("rank") <= 2, F.col(score))), asc=False), 1, 2).alias("s"))
    gap = F.round(F.get("s", 0) - F.get("s", 1), 10)
    return two.select("query_id", F.when(F.col("n") == 1, "high").when(gap >= 0.20, "high").when(gap >= 0.10, "medium").otherwise("low").alias("confidence"))


def confidence_label(n: Column, top: Column) -> Column:
    """Label from the number of hits and the best score."""
    return F.when(n == 0, "low").when((top >= 0.70) & (n >= 3), "high").when((top >= 0.45) | (n >= 2), "medium").otherwise("low")


def with_ranks(diagnostics: DataFrame, ranked: DataFrame) -> DataFrame:
    """Diagnostics of all rows with the rank of those in the top k, null for others."""
    return diagnostics.join(ranked.select("query_id", "canonical_id", "rank"), ["query_id", "canonical_id"], "left")


def traced(ranked: DataFrame, most: int = 20) -> DataFrame:
    """Rows with the decision trace of the first ``most`` ranks."""
    dims = ("task_relevance", "quality", "popularity", "freshness", "description_match")
    return ranked.withColumn("trace", F.when(F.col("rank") <= most, F.struct("canonical_id", "composite", "rank", F.struct(*dims).alias("breakdown"))))


def image_scale(n: Column) -> Column:
    return F.when(n >= 50_000, 0.90).when(n >= 10_000, 0.75).when(n >= 1_000, 0.55).when(n >= 100, 0.35).when(n > 0, 0.15)


def quality_adjusted(ranked: DataFrame, profiles: DataFrame, on: str | list[str] = "canonical_id") -> DataFrame:
    """Half base score, half the weighted mean of the profile signals that are there; without any, the base."""
    d = ranked.join(profiles, on, "left")
    parts = [(F.col("deep_score") / 100, 0.35), (F.col("balance_score") / 100, 0.25), (F.col("uniqueness_score") / 100, 0.20), (F.col("completeness_score") / 100, 0.10), (image_scale(F.col("total_images")), 0.25)]
    held = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    new = F.when(held > 0, F.round(F.col("composite") * 0.5 + total / held * 0.5, 4)).otherwise(F.col("composite"))
    w = Window.partitionBy("query_id").orderBy(F.desc("quality_adjusted"), "rank")
    return d.withColumn("quality_adjusted", new).withColumn("new_rank", F.row_number().over(w))


def dataset_signals(profiles: DataFrame) -> DataFrame:
    """(dataset, completeness_score, deep_score) of profiled tables (G26): mean share of values that are there, and the
    weighted score of that and of the share of columns that are neither ids nor constant."""
    told = 100.0 - F.avg(F.when((F.col("type") == "id") | (F.col("unique_count") <= 1), 100.0).otherwise(0.0))
    d = profiles.groupBy("dataset").agg((100.0 - F.avg("missing_percentage")).alias("c"), told.alias("m"))
    return d.select("dataset", F.round("c", 2).alias("completeness_score"), weighted_score(completeness=F.col("c"), metadata=F.col("m")).alias("deep_score"))


def two_stage(ranked: DataFrame, light: DataFrame, deep: DataFrame, most: int = 2) -> DataFrame:
    """Rank by the light signals of all hits, then again with the deep ones of the new first ``most``.

    Both have canonical_id and the signals of ``quality_adjusted``; deep signals take the place of light ones.
    """
    first = quality_adjusted(ranked, light)
    top = first.filter(F.col("new_rank") <= most).select("query_id", "canonical_id")
    again = ranked.select("query_id", "canonical_id").join(light, "canonical_id")
    better = top.join(deep, "canonical_id")
    chosen = again.join(better, ["query_id", "canonical_id"], "left_anti").unionByName(better)
    return quality_adjusted(ranked, chosen, ["query_id", "canonical_id"])


def spread_sources(ranked: DataFrame, each: int = 2, order: str = "rank") -> DataFrame:
    """At least ``each`` hits of every source first, in order of the sources' best hits; then the rest."""
    src = Window.partitionBy("query_id", "source").orderBy(order)
    d = ranked.withColumns({"nth": F.row_number().over(src), "best": F.min(order).over(Window.partitionBy("query_id", "source"))})
    front = F.col("nth") <= each
    w = Window.partitionBy("query_id").orderBy(~front, F.when(front, F.col("best")), F.when(front, F.col("nth")), order)
    return d.withColumn("place", F.row_number().over(w)).drop("nth", "best")


def capped(catalog: DataFrame, most: int = 50) -> DataFrame:
    """The most complete records, before scoring (G28): a top-k, not a sort of all."""
    return catalog.orderBy(F.desc("metadata_completeness"), "canonical_id").limit(most)


def final_order(scored: DataFrame) -> list[Column]:
    """Score, then title without case."""
    return [F.desc("composite"), F.lower("title"), F.col("canonical_id")]


def evaluate_results(ranked: DataFrame) -> DataFrame:
    """For each query: rows, best and mean score, rows below 0.4, whether the results suffice, and the issues found."""
    d = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("composite").alias("top_score"), F.round(F.round(F.avg("composite"), 6), 3).alias("avg_score"), F.count_if(F.col("composite") < 0.4).alias("low_scores"))
    low_top, most_low = F.col("top_score") < 0.4, F.col("low_scores") > F.floor(F.col("n") / 2)
    issues = F.array_compact(F.array(F.when(low_top, F.format_string("Top score (%.2f) below minimum threshold (0.40)", "top_score")), F.when(most_low, F.format_string("Majority of results (%d/%d) below threshold", "low_scores", "n"))))
    return d.withColumns({"sufficient": ~low_top & (F.col("low_scores") < F.col("n")), "issues": issues})


def diagnostics(judged: DataFrame, ranked: DataFrame, filters_applied: list[str], scored: DataFrame | None = None) -> DataFrame:
    """For each query: rows at each stage, pass rate, filters, confidence, and whether sources were spread.

    ``judged`` holds the catalog with reject_reason, ``ranked`` the top k of each query; ``scored`` has a row for each
    query and record that was scored, all passing records if it is None.
    """
    rows = judged.agg(F.count("*").alias("total_input"), F.count_if(F.col("reject_reason").isNull()).alias("total_after_filter"))
    rows = rows.withColumns({"filter_pass_rate": F.round(F.coalesce(F.try_divide("total_after_filter", "total_input"), F.lit(0.0)), 3), "filters_applied": F.lit(",".join(filters_applied))})
    top = ranked.groupBy("query_id").agg(F.count("*").alias("total_ranked"), F.max("candidates").alias("candidates"))
    top = top.join(confidence(ranked), "query_id").withColumn("diversity_applied", F.col("candidates") > F.col("total_ranked")).drop("candidates")
    d = top.crossJoin(F.broadcast(rows))  # rows has one
    if scored is None:
        return d.withColumn("total_scored", F.col("total_after_filter"))
    return d.join(scored.groupBy("query_id").agg(F.count("*").alias("total_scored")), "query_id")


def observed_run(judged: DataFrame, k: int, filters_applied: list[str], query_ids: list) -> tuple[DataFrame, DataFrame]:
    """(ranked, diagnostics) of one run: rows and time of each stage are observed in flight.

    ``judged`` has a row for each query and record with reject_reason. Nothing is computed again to be counted: rows are
    counted as they pass, and the first and last time a row passed a stage give its elapsed milliseconds (a task that
    is run again counts again). ``query_ids`` names the block of queries, of bounded number.
    """
    if len(query_ids) > QUERY_BLOCK:
        raise ValueError(f"rank at most {QUERY_BLOCK} queries at a time")
    ok = F.col("reject_reason").isNull()
    span = [F.min("__at").alias("began"), F.max("__at").alias("ended")]
    clock = F.expr("CAST(reflect('java.lang.System', 'currentTimeMillis') AS LONG)")
    seen, kept = Observation(), Observation()
    per = [F.count_if(ok & F.col("query_id").eqNullSafe(F.lit(q))).alias(f"q{i}") for i, q in enumerate(query_ids)]
    d = judged.withColumn("__at", clock).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), *span, *per).drop("__at")
    d = rank(d.filter(ok).drop("reject_reason"), k)
    ranked = staged(d.withColumn("__at", clock).observe(kept, F.count(F.lit(1)).alias("n"), *span).drop("__at"))
    a, b, n = seen.get, kept.get, len(query_ids)
    took = lambda x: (x["ended"] - x["began"]) if x["began"] is not None else 0
    rows = [(q, a["n"] // n, a["passed"] // n, a[f"q{i}"], round(a["passed"] / a["n"], 3) if a["n"] else 0.0, ",".join(filters_applied), took(a), took(b)) for i, q in enumerate(query_ids)]
    kind = dict(judged.dtypes)["query_id"]
    out = judged.sparkSession.createDataFrame(rows, f"query_id {kind}, total_input long, total_after_filter long, total_scored long, filter_pass_rate double, filters_applied string, score_ms long, rank_ms long")
    top = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_ranked"))
    d = out.join(top, "query_id", "left").join(confidence(ranked), "query_id", "left").withColumn("total_ranked", F.coalesce("total_ranked", F.lit(0)))
    return ranked, d.withColumn("diversity_applied", F.col("total_scored") > F.col("total_ranked"))


def result_summary(ranked: DataFrame) -> DataFrame:
    """For each query: hits by source, most first; mean completeness; number of sources."""
    per = ranked.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.sum("metadata_completeness").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "source", "n")))
    return per.groupBy("query_id").agg(F.transform(listed, lambda x: F.concat_ws(":", x["source"], x["n"].cast("string"))).alias("by_source"), F.round(F.sum("s") / F.sum("n"), 3).alias("avg_completeness"), F.count("*").alias("n_sources"))


def common_warnings(ranked: DataFrame, column: str = "warnings", most: int = 5) -> DataFrame:
    """For each query: distinct warnings of its hits in order of first appearance."""
    each = ranked.select("query_id", "rank", F.posexplode(column).alias("i", "text"))
    first = each.groupBy("query_id", "text").agg(F.min(F.struct("rank", "i")).alias("at"))
    return first.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), 1, most).alias("warnings"))
