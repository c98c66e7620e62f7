"""Profiles from stored sketches, requests out of range, and the strict mode of validation."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.operators import derive, sketches
from brindle.plans import query_sketch


def _rows(n: int, seed: int = 3) -> list[tuple]:
    """A hot value with a third of all rows, many rare ones, nulls and nan."""
    r = random.Random(seed)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 7, seconds=i)
    return [(day(i), "hot" if i % 3 == 0 else None if i % 11 == 0 else f"w{r.randrange(n)}", float("nan") if i % 13 == 0 else r.gauss(0, 10)) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, `a.word` string, x double")


def test_merged_days_stay_within_their_bounds(spark, tmp_path):
    rows, path = _rows(20_000), str(tmp_path / "days")
    sketches.write_days(sketches.day_sketches(_frame(spark, rows), "ts", ["a.word", "x"]), path)
    got = {r["column"]: r for r in sketches.estimated(sketches.merged(sketches.read_days(spark, path)), k=3).collect()}
    words, numbers = [w for _, w, _ in rows if w is not None], sorted(x for *_, x in rows if x == x)
    w, x = got["a.word"], got["x"]
    assert (w.rows, w.nulls, w.numbers) == (20_000, 20_000 - len(words), 0) and w.q is None
    assert abs(w.unique_count - len(set(words))) <= sketches.DISTINCT_ERROR * len(set(words))
    assert w.top[0]["item"] == "hot" and abs(w.top[0]["count"] - words.count("hot")) <= sketches.COUNT_ERROR * len(words)
    assert x.nulls == 20_000 - len(numbers) and (x["min"], x["max"]) == (numbers[0], numbers[-1]) and x["mean"] == pytest.approx(sum(numbers) / len(numbers))
    for p, q in zip((0.25, 0.5, 0.75), x.q, strict=True):
        assert abs(sum(v <= q for v in numbers) / len(numbers) - p) <= sketches.RANK_ERROR


def test_a_day_delivered_again_counts_once_and_only_asked_days_are_read(spark, tmp_path):
    rows, path = _rows(700), str(tmp_path / "days")
    d = sketches.day_sketches(_frame(spark, rows), "ts", ["a.word"])
    for part in (d, d.filter("day = '2024-01-02'"), d):
        sketches.write_days(part, path)
    assert sketches.merged(sketches.read_days(spark, path)).first()["rows"] == 700
    some = sketches.read_days(spark, path, since="2024-01-02", before="2024-01-04")
    assert sketches.merged(some).first()["rows"] == 200
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan


def test_the_most_frequent_of_many_values_is_counted_exactly(spark, tmp_path):
    """3,000 users with two or three events a week each, more than a sketch tracks; in the second week asked most have no user."""
    at = lambda day, i: dt.datetime(2024, 1, day) + dt.timedelta(days=i % 7, seconds=i)
    rows = [(at(d, i), None if d == 15 and i < 40 else i % 3000, "odd" if i % 2 else "even") for d in (1, 8, 15) for i in range(6000)] + [(at(8, 5), 7, "odd")]
    frame = spark.createDataFrame([(i, *r, 1.0, "p") for i, r in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["column"], r.week): (r.rows, r.distinct_within, r.most) for r in query_sketch.sketch_weeks(spark, str(tmp_path)).collect()}
    assert got == {
        ("user_id", "2024-01-08"): (6001, True, 3), ("user_id", "2024-01-15"): (6000, True, 40), ("event_type", "2024-01-08"): (6001, True, 3001), ("event_type", "2024-01-15"): (6000, True, 3000),
    }


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, float("nan")), (None, None, None)], "ts timestamp, `a.word` string, x double")
    got = sketches.estimated(sketches.merged(sketches.day_sketches(none, "ts", ["a.word", "x"]))).collect()
    assert [(r["rows"], r["nulls"], r["unique_count"], r["q"], r["top"], r["mean"]) for r in got] == [(2, 2, 0, None, [], None)] * 2
    assert sketches.estimated(sketches.merged(sketches.day_sketches(none.limit(0), "ts", ["a.word"]))).count() == 0


def test_requests_out_of_range(spark):
    schema = "raw_query string, max_results int, sources array<string>, min_completeness double, min_rows long, max_rows long, result_diversity double, explanation_detail string, priority int"
    rows = [
        ("\t cats \n", None, None, None, None, None, None, None, None), ("x" * 501, 99, ["kaggle"], 1.0, 5, 5, 0.126, "minimal", 10), (None, 0, [], 0.0, 0, None, 0.0, "detailed", 1),
        ("a", 5, ["kaggle", None], -0.1, 6, 5, 1.01, "long", 11),
    ]
    d = spark.createDataFrame(rows, schema)
    got = derive.clamp_requests(d).collect()
    assert [(r.raw_query[:5] if r.raw_query else r.raw_query, len(r.raw_query), r.max_results) for r in got] == [("cats", 4, 10), ("xxxxx", 500, 50), ("", 0, 1), ("a", 1, 5)]
    assert [r.reject_reason for r in got] == [None, None, "empty query", "unknown sources,completeness out of range,more rows at least than at most,diversity out of range,unknown detail,priority out of range"]
    assert got[1].result_diversity == 0.13
    assert [r.reject_reason for r in derive.clamp_requests(d.select("raw_query", "max_results"), strict=True).collect()] == [None, "query too long", "empty query", None]


def test_strict_validation_fails_and_lenient_clamps(spark):
    good = ("kaggle", "u", "1", "v1", "1.0", "1.2", "a" * 64, 1.0)
    schema = "source string, source_url string, source_id string, ingestion_version string, pipeline_version string, schema_version string, dataset_fingerprint string, metadata_completeness double"
    assert derive.validate(spark.createDataFrame([good], schema), strict=True).first().reject_reason is None
    bad = spark.createDataFrame([good, ("kaggle", " ", None, "v1", "2.0", "1.2", "z", 1.5)], schema)
    got = {r.source_url: r for r in derive.validate(bad).collect()}
    assert got[" "].reject_reason == "no url,no id,versions differ,bad fingerprint,completeness out of range" and got[" "].metadata_completeness == 1.0
    with pytest.raises(PySparkException, match="no url"):
        derive.validate(bad, strict=True).select(F.col("reject_reason")).collect()
