"""Charsets over whole files, rows that meet by their place, cards, signal words, explanations from analysed data."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import explain, profiling
from brindle.sources import files, hubs


@pytest.fixture
def splits(spark):
    """Splits of 256 KB, so that files of megabytes have many."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_charset_is_judged_over_whole_files(spark, splits, tmp_path):
    line = b"1,abcdefghijklmnopqrstuvwxyz\n"
    head = "id,naïve\n".encode()
    late = head + line * (5 * 2**20 // len(line)) + "2,café\n".encode("latin-1")
    (tmp_path / "late.csv").write_bytes(late)
    d = files.read_csv(spark, str(tmp_path / "late.csv"))
    assert d.rdd.getNumPartitions() > 5 and d.filter("id = 2").first()[1] == "café" and d.count() == late.count(b"\n") - 1
    at = 2**20 - len(head) - 1  # the letter's two bytes are the last of the first megabyte and the first of the next
    across = head + b"1," + b"x" * (at - 2) + "é\n2,z\n".encode()
    assert across[2**20 - 1 : 2**20 + 1] == "é".encode()
    (tmp_path / "across.csv").write_bytes(across)
    d = files.read_csv(spark, str(tmp_path / "across.csv"))
    assert d.columns == ["id", "naïve"] and d.filter("id = 1").first()["naïve"].endswith("xé")


def test_each_file_has_its_own_charset(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("id,x\n1,ü\n".encode())
    (tmp_path / "c[1].csv").write_bytes("id,x\n2,ü\n".encode("latin-1"))
    got = files.read_table(spark, str(tmp_path), "csv")
    assert got.columns == ["id", "x"] and sorted(map(tuple, got.collect())) == [(1, "ü"), (2, "ü")]


@pytest.mark.parametrize("limit", [None, 10, 0])
def test_features_meet_their_target_over_several_splits(spark, splits, tmp_path, limit):
    n = 120_000
    for name, cuts in (("x", (0, 70_000, n)), ("y", (0, 1, 30_000, n))):
        (tmp_path / name).mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rows = (f"{i},{'p' * (i % 7)}" if name == "x" else f"c{i},other" for i in range(a, b))
            (tmp_path / name / f"part-{k}.csv").write_text(("i,pad\n" if name == "x" else "y,z\n") + "\n".join(rows) + "\n")
    d = files.with_target(spark, str(tmp_path / "x"), str(tmp_path / "y"), "cls", limit)
    assert d.columns == ["i", "pad", "cls"]
    r = d.agg(F.count("*"), F.count_if(F.concat(F.lit("c"), "i") == F.col("cls")), F.max("i")).first()
    k = n if limit is None else limit
    assert tuple(r) == (k, k, k - 1 if k else None)
    if limit == 10:
        assert "pad" not in files.with_target(spark, str(tmp_path / "x"), str(tmp_path / "y"), "i", 5).drop("pad").columns
        s = {x["i"] for x in files.first_rows(spark, str(tmp_path / "x"), 10).collect()}
        assert len(s) == 10 and {0, 1, 2, 3, 4} <= s <= set(range(20))
        (tmp_path / "y" / "part-9.csv").write_text("y,z\nmore,\n")
        with pytest.raises(ValueError, match="target"):
            files.with_target(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_cards_with_lists_maps_and_configurations(spark, tmp_path):
    one = {"splits": [{"name": "a", "num_examples": 3}, {"name": "b", "num_examples": "4"}], "features": [{"name": "x", "dtype": "string"}]}
    cards = {"u/list": one, "u/map": {"splits": {"train": {"num_examples": 5}, "test": {"num_examples": 6}}}, "u/many": [{"splits": {"t": {"num_examples": 2}}}, one], "u/none": None, "u/zero": {"splits": []}, "u/odd": {"splits": "x"}}
    (tmp_path / "h.json").write_text("".join(json.dumps({"id": k, "cardData": {"dataset_info": v}}) + "\n" for k, v in cards.items()))
    good, bad = hubs.read_dump(spark, str(tmp_path / "h.json"), hubs.schemas.HUGGINGFACE)
    got = {r["source_id"]: (r["row_count"], r["column_names"]) for r in hubs.huggingface(good).collect()}
    assert bad.count() == 0 and got == {"u/list": (7, ["x"]), "u/map": (11, None), "u/many": (2, None), "u/none": (None, None), "u/zero": (None, None), "u/odd": (None, None)}


def test_words_that_speak_for_a_modality(spark, tmp_path):
    rows = [("o/a", "Crop leaves", "of many kinds", []), ("o/b", "House prices", "quarterly revenue of firms", []), ("o/c", "Notes", "nothing said", []), ("o/d", "Scans", "fundus, from a clinic", ["tabular"]), ("o/e", None, None, None)]
    (tmp_path / "k.json").write_text("".join(json.dumps(dict(zip(("ref", "title", "description", "tags"), r, strict=True))) + "\n" for r in rows))
    got = {r["source_id"]: r["modalities"] for r in hubs.kaggle(hubs.read_dump(spark, str(tmp_path / "k.json"), hubs.schemas.KAGGLE)[0]).collect()}
    assert "image" in got["o/a"] and got["o/b"] == ["tabular"] and "image" not in got["o/c"]
    assert got["o/d"] == ["tabular", "image"]


def test_signals_of_groups_of_rows(spark):
    rows = [("a", 1, "x", "t")] * 3 + [("a", None, "y", "u"), ("b", 2, "x", None), ("b", 2, None, "")]
    d = spark.createDataFrame(rows, "g string, n int, cls string, body string")
    got = {r["g"]: r for r in profiling.group_signals(d, "g", ["n", "cls"], "cls", "body").collect()}
    assert (got["a"]["completeness_score"], got["a"]["balance_score"], got["a"]["uniqueness_score"]) == (87.5, 33.33, 50.0)
    assert got["a"]["fixes"] == ["Column 'n' has 1 null values", "2 duplicate rows"]
    assert (got["b"]["completeness_score"], got["b"]["balance_score"], got["b"]["uniqueness_score"]) == (75.0, 0.0, 50.0)
    assert got["b"]["fixes"] == ["Column 'cls' has 1 null values", "Class imbalance: 'x' dominates", "1 duplicate rows"]
    assert profiling.group_signals(d.limit(0), "g", ["n", "cls"], "cls", "body").count() == 0


def test_explanations_take_what_the_data_show_first(spark):
    ids = spark.createDataFrame([(c, i + 1) for i, c in enumerate("abcd")], "canonical_id string, rank int")
    ranked = ids.selectExpr(
        "*", "'T' AS title", "0.9D AS composite", "0.9D AS task_relevance", "0.8D AS quality", "0.1D AS popularity", "0.9D AS freshness", "0.1D AS description_match", "CAST(NULL AS BIGINT) AS download_count",
        "false AS has_schema_info", "CAST(NULL AS STRING) AS license_type", "5 AS description_length", "CAST(9 AS BIGINT) AS row_count", "array('imbalanced') AS tags", "'' AS description", "'' AS description_clean", "'s' AS source", "false AS has_license_info", "false AS has_description", "false AS has_size_info", "0.5D AS metadata_completeness", "CAST(NULL AS BIGINT) AS missing_values",
        "CAST(NULL AS BIGINT) AS majority_class_size", "CAST(NULL AS BIGINT) AS minority_class_size", "array('text') AS modalities", "CAST(NULL AS TIMESTAMP) AS last_updated", "'d' AS description_short", "CAST(NULL AS BIGINT) AS file_size_bytes", "CAST(NULL AS BIGINT) AS column_count",
    )
    found = spark.createDataFrame([("a", 80.0, 95.06, 90.0, 99.0, [], False, None), ("b", 30.0, 60.0, 20.0, 80.0, ["Column 'x' has 9 null values", "poor geographic spread"], False, None), ("c", None, None, None, None, [], True, "gone")],
                                  "canonical_id string, " + ", ".join(f"{k} {t}" for k, t in explain.ANALYSED.items()))
    got = {r["canonical_id"]: r for r in explain.explain(ranked, found).withColumn("told", explain.narrative()).collect()}
    assert got["a"]["strengths"] == ["data nearly complete: 4.9% missing", "hardly any duplicate rows", "balanced classes: 90/100", "good data: 80/100", "highly relevant task", "recently updated"]
    assert got["b"]["weaknesses"] == ["Column 'x' has 9 null values", "poor geographic spread", "classes out of balance: 20/100", "duplicate rows: 20.0%", "license not specified", "minimal description"]
    assert got["b"]["warnings"][:2] == ["poor geographic spread", "class imbalance in the data: 20/100"] and "possible class imbalance" not in got["a"]["warnings"]
    assert got["c"]["weaknesses"][0] == "data could not be analysed: gone" and "possible class imbalance" in got["c"]["warnings"]
    assert got["d"]["strengths"] == ["highly relevant task", "recently updated", "high quality"] and got["d"]["weaknesses"][:2] == ["license not specified", "minimal description"]
    assert got["d"]["told"]["why_ranked"] == "Ranked #4 with a composite score of 0.90. Strongest signal: task relevance (0.90)."
