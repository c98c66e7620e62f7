"""Blocks of queries that are broadcast are counted first; labels of images are small or joined by a shuffle."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import images, retrieval


@pytest.fixture
def many(spark):
    return spark.range(retrieval.QUERY_BLOCK + 1).select(F.col("id").alias("query_id"), F.lit("red fox").alias("query_text"))


def test_too_many_queries_are_refused(spark, many):
    docs = spark.createDataFrame([(1, "red fox"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "query_id long, id int, score double, rank int")
    catalog = spark.createDataFrame([("a", "red", 1)], "canonical_id string, title string, row_count long")
    for run in (
        lambda q: retrieval.bm25_scores(q, docs, "id", "text"), lambda q: retrieval.hybrid(q, none, none, 3, 2), lambda q: retrieval.keyword_match(q, catalog, 3),
        lambda q: retrieval.vector_top(q, docs, 3),
    ):
        with pytest.raises(ValueError, match="in blocks"):
            run(many)
    assert retrieval.block(many.limit(retrieval.QUERY_BLOCK)).count() == retrieval.QUERY_BLOCK


def test_keyword_match_tries_again_with_short_tokens(spark):
    catalog = spark.createDataFrame([("a", "le chat", 1), ("b", "a fox", 9), ("c", None, 5)], "canonical_id string, title string, row_count long")
    q = spark.createDataFrame([(1, "zz le"), (2, "fox le"), (3, None)], "query_id int, query_text string")
    got = {(r.query_id, r.canonical_id) for r in retrieval.keyword_match(q, catalog, 5).collect()}
    assert got == {(1, "a"), (2, "b")}  # 2 has a hit at once, so its short token is not looked for


@pytest.mark.parametrize("twice", [False, True])
def test_labels_that_images_do_not_show(spark, twice):
    rows = [("cat", [1.0, 0.0]), ("cat", [0.0, 1.0]), ("dog", [0.0, 1.0]), ("none", [1.0, 1.0])]
    labels = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.1, 1.0])], "class string, v array<double>")
    got = {r["class"]: (r.mismatch_percentage, r.flagged) for r in images.label_mismatch(spark.createDataFrame(rows * (1 + twice), "class string, v array<double>"), labels).collect()}
    assert got == {"cat": (50.0, True), "dog": (0.0, False)}
