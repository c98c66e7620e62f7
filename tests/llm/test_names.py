"""Columns of the caller under names that operators use, names with dots, ids that are no numbers, rules without literals."""

import random

import pytest

from brindle.llm import minhash, quality_classifier, secrets, sharding, url_filter

HIDDEN = ["row", "text_", "__t", "__found", "__base", "__runs", "__w", "__x", "__lines", "__keep", "__kept", "__hash", "__id", "__run", "run", "a.b", "doc.id", "component"]
KEY = "Zx8Kq2Lm9Wp4R//t7Yv1Bn6Qc3Ud5Xe0Ga8Hi2Jk"


def hostile(spark, texts, kind="long", make=int):
    """Rows with a column for each name above, filled with that name and the row's number."""
    rows = [(make(i), t, *[f"{h} {i}" for h in HIDDEN]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, " + ", ".join(f"`{h}` string" for h in HIDDEN))


def untouched(rows):
    return all(r[h] == f"{h} {str(r['doc_id']).removeprefix('d')}" for r in rows for h in HIDDEN)


def copies():
    rng = random.Random(5)
    base = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(3)]
    return [base[0], base[0], base[1], base[1] + " more", None, "", base[2]]


def test_redaction_keeps_columns_of_any_name(spark):
    d = hostile(spark, [f"a {KEY} b", None, "", "plain"])
    out = secrets.redact(d)
    assert out.columns == d.columns and untouched(out.collect())
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "a [SECRET] b", 1: None, 2: "", 3: "plain"}
    other = secrets.redact(d.withColumnRenamed("text", "te.xt"), text_col="te.xt")
    assert "te.xt" in other.columns and other.filter("doc_id = 0").first()["te.xt"] == "a [SECRET] b"
    assert secrets.redact(d.limit(0)).count() == 0


def test_query_and_redaction_share_one_scan(spark):
    keys = [KEY, "/Zx8Kq2Lm9Wp4Rt7Yv1Bn6Qc3Ud5Xe0Ga8Hi2Jk4", "Zx..8Kq2Lm9Wp4Rt7Yv1Bn6Qc3Ud5Xe0Ga8Hi2Jk4", "password: Zx8Kq2Lm9Wp4Rt7Yv1Bn6Qc3Ud5Xe0Ga8Hi2Jk4"]
    clean = ["/usr/local/lib64/python3/site-packages/foo", "a/" * 30_000 + "b1", "a-" * 30_000 + "b1"]
    d = hostile(spark, keys + clean)
    found = {r["doc_id"]: len(r["found"]) for r in secrets.scan(d).collect()}
    masked = {r["doc_id"]: "[SECRET]" in r["text"] for r in secrets.redact(d).collect()}
    assert all(bool(found[i]) == masked[i] for i in found)
    assert all(masked[i] for i in range(len(keys))) and not any(masked[i] for i in range(len(keys), len(found)))


def test_acceptance_keeps_columns_of_any_name(spark):
    d = hostile(spark, ["a good text. " * 20, "", None])
    flat = quality_classifier.Ranker((0.0,) * 9, (0.0,) * 9, (1.0,) * 9, 0.0)
    out = quality_classifier.accepted(d, flat)
    assert out.columns == d.columns and len(out.collect()) == 3 and untouched(out.collect())


@pytest.mark.parametrize(("kind", "make"), [("long", int), ("int", int), ("string", lambda i: f"d{i}")])
def test_deduplication_keeps_columns_and_takes_any_ids(spark, kind, make):
    d = hostile(spark, copies(), kind, make)
    out = minhash.deduplicate(d, percent=80)
    rows = out.collect()
    assert out.schema == d.schema and untouched(rows)
    assert {r["doc_id"] for r in rows} == {make(i) for i in (0, 2, 4, 5, 6)}
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, percent=80).collect()}
    assert got[make(1)] == (make(0), False) and got[make(3)] == (make(2), False) and got[make(6)] == (make(6), True)


def test_store_keeps_columns_of_any_name(spark, tmp_path):
    d, root = hostile(spark, ["x", "y", None]), f"file://{tmp_path}/store"
    sharding.append(d, root, sharding.arrivals())
    sharding.append(d, root)
    sharding.compact(spark, root, d.schema, fan_in=2, similar=100.0)
    for v in sharding.versions(spark, root)[1:]:
        back = sharding.read(spark, root, d.schema, v, run_col="in_run")
        assert back.columns == [*d.columns, "in_run"] and untouched(back.collect()) and back.count() == 6
    assert sharding.read(spark, root, d.schema, 1, run_col=None).columns == d.columns
    with pytest.raises(ValueError, match="run"):
        sharding.read(spark, root, d.schema, 1)


def test_rules_with_and_without_literals(spark):
    rules = (
        url_filter.word_rule("deep", "block", r"(?:/[^/]*){6,}"), url_filter.word_rule("b rare", "block", r"/rare\.", "common", "rare"),
        url_filter.word_rule("a tie", "allow", r"/tie", "tie"), url_filter.word_rule("b tie", "block", r"/tie", "tie"),
    )
    urls = ["http://h/1/2/3/4/5/6/7", "http://common/rare.html", "http://common/tie", "http://common/tie", "http://common/" + "x" * 200_000, "http://common/b"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, `u.rl` string").unionByName(spark.createDataFrame([(1, urls[1])], "page_id long, `u.rl` string"))
    rows = url_filter.filter_urls(d, rules, url_col="u.rl").collect()
    got = {r["page_id"]: (r["pattern_rule"], r["verdict"]) for r in rows}
    assert len(rows) == 7 and got == {0: ("deep", "block"), 1: ("b rare", "block"), 2: ("b tie", "block"), 3: ("b tie", "block"), 4: (None, "allow"), 5: (None, "allow")}
    with pytest.raises(ValueError, match="odd"):
        url_filter.filter_urls(d, (url_filter.word_rule("odd", "block", "x", "A-b"),), url_col="u.rl")


def test_own_url_rules_and_the_order_of_equal_ranks(spark):
    urls = ["http://a.net/x/print.html", "http://a.net/print", "http://a.net/printer", "http://porn.net/login/", "http://a.net/cart/items", "https://m.a.net/en/100.html"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    assert [r.pattern_rule for r in sorted(got)] == ["page for printing", "page for printing", None, "login page", "shopping cart", None]
