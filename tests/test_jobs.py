"""Jobs of several passes against brute force, replays, failures and their streams."""

import datetime as dt
import os
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import dedup, inverted, profiling, ranking, stages
from brindle.plans import catalog_view, query_jobs
from brindle.streaming import breakers, snapshots, streams

T0 = dt.datetime(2024, 1, 1)


def test_prefix_sums_and_lookups_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(("hot" if rng.random() < 0.6 else f"k{int(rng.integers(0, 4))}"), int(t), int(rng.integers(0, 5))) for t in rng.permutation(400)]
    parts = stages.ranged(spark.createDataFrame(rows, "k string, t int, v int").repartition(6), "k", "t")
    assert parts.select("part").distinct().count() > 1
    total = {(r.k, r.t): r.s for r in stages.running(parts, ["k"], ["t"], F.col("v").cast("long"), "s").collect()}
    ahead = {(r.k, r.t): r.a for r in stages.first_after(parts, ["k"], ["t"], F.when(F.col("v") == 4, F.col("t")), "a").collect()}
    for k, t, _ in rows:
        assert total[k, t] == sum(v for q, u, v in rows if q == k and u <= t)
        assert ahead[k, t] == min((u for q, u, v in rows if q == k and u >= t and v == 4), default=None)


def test_lookups_ahead_take_each_row_of_a_range_once(spark):
    """A frame that reaches to the end of a range is taken up anew for each of its rows; a frame from its start isn't."""
    n = 30_000
    parts = stages.ranged(spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("t")), "k", "t")
    d = stages.first_after(parts, ["k"], ["t"], F.when(F.col("t") % 7000 == 6999, F.col("t")), "a")
    assert "unboundedfollowing" not in d._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.t: r.a for r in d.collect()} == {t: a if (a := t // 7000 * 7000 + 6999) < n else None for t in range(n)}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_dir(Far)


def test_quantiles_by_rank_selection(spark):
    rng = np.random.default_rng(2)
    data = {"even": rng.integers(0, 10, 1000).astype(float), "skewed": np.concatenate([np.zeros(700), rng.lognormal(0, 5, 301)]), "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), "same": np.full(50, 7.0)}
    rows = [(c, float(x)) for c, xs in data.items() for x in xs]
    counts = spark.createDataFrame(rows, "column string, x double").groupBy("column", "x").agg(F.count("*").alias("n"))
    got = {r["column"]: list(r["q"]) for r in profiling.exact_quantiles(counts, ["column"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for c, xs in data.items():
        assert np.allclose(got[c], np.quantile(xs, (0.0, 0.25, 0.5, 0.9, 1.0)), rtol=1e-12), c


def test_profiles_of_many_tables_equal_single_ones(spark):
    a = spark.createDataFrame([(1, 1.0, "yes", None), (2, float("nan"), "no", None), (3, -2.0, "yes", None), (4, 0.0, None, None)], "id int, x double, b string, nothing string")
    b = spark.createDataFrame([("1", dt.date(2020, 1, 1)), ("2.5", None), ("2.5", None)], "n string, day date")
    many = profiling.profile_many({"a": a, "b": b})
    single = profiling.profile(a).withColumn("dataset", F.lit("a")).unionByName(profiling.profile(b).withColumn("dataset", F.lit("b")))
    assert sorted(map(tuple, many.select(sorted(many.columns)).collect()), key=repr) == sorted(map(tuple, single.select(sorted(single.columns)).collect()), key=repr)
    got = {r["column"]: r for r in many.collect()}
    assert got["b"].type == "boolean" and got["nothing"].type == "unknown" and got["nothing"].missing_percentage == 100 and got["day"].type == "datetime"
    assert (got["x"].null_count, got["x"].unique_count) == (1, 3) and got["n"].total_count == 3
    empty = profiling.profile(a.limit(0)).collect()
    assert len(empty) == 4 and all(r.total_count == 0 and r.type == "unknown" and r.missing_percentage == 100 for r in empty)


def test_exact_profile_has_no_percentile_aggregate(spark):
    q = profiling.exact_quantiles(spark.range(100).select(F.lit("c").alias("column"), F.col("id").cast("double").alias("x"), F.lit(1).cast("long").alias("n")), ["column"])
    assert "percentile" not in q._jdf.queryExecution().toString().lower()


def test_stored_index_reads_only_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red fish, blue fish", ["fish"], "n"), (2, "one fish two fish", ["red fish", None], "n"), (3, None, None, "n"), (4, "red red wine", [], "n")], "id int, text string, tags array<string>, term string")
    inverted.write_index(docs, "id", {"text": False, "tags": True}, f"{tmp_path}/i", buckets=8)
    ask = spark.createDataFrame([(1, "red"), (2, "red fish"), (3, "unheard"), (4, None)], "query_id int, query_text string")
    found = {(r.query_id, r.doc, r.field) for r in inverted.stored_scores(spark, f"{tmp_path}/i", ask).collect()}
    assert found == {(1, 1, "text"), (1, 4, "text"), (2, 1, "text"), (2, 2, "text"), (2, 4, "text"), (2, 2, "tags")}
    plan = inverted.stored_scores(spark, f"{tmp_path}/i", ask.filter("query_id = 1"))._jdf.queryExecution().executedPlan().toString()
    wanted = [line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert wanted and all("(bucket" in line or "bucket#" in line.split("PartitionFilters")[1] for line in wanted)
    top = inverted.stored_top(spark, f"{tmp_path}/i", ask, 1).collect()
    assert [(r.query_id, r["rank"]) for r in top] == [(2, 1)]  # red is in half of the texts, so its idf is 0
    with pytest.raises(ValueError, match="at most"):
        inverted.stored_scores(spark, f"{tmp_path}/i", spark.range(1001).select(F.col("id").alias("query_id"), F.lit("red").alias("query_text")))


def in_turn(rows):
    seen, kept = [set(), set()], []
    for s, *ks in sorted(rows):
        if not any(k is not None and k in x for k, x in zip(ks, seen)):
            kept.append(s)
            for k, x in zip(ks, seen):
                if k is not None:
                    x.add(k)
    return kept


@pytest.mark.parametrize("few", [0, 10_000])
def test_conflicts_in_turn(spark, few):
    rng = np.random.default_rng(3)
    chain = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(12)]  # each row shares a key with the next
    hot = [(100 + i, "hot", f"c{int(rng.integers(0, 30))}") for i in range(200)]
    odd = [(1000 + i, None if rng.random() < 0.3 else f"d{int(rng.integers(0, 20))}", None if rng.random() < 0.3 else f"e{int(rng.integers(0, 20))}") for i in range(150)]
    rows = chain + hot + odd
    frame = spark.createDataFrame(rows, "seq long, fp string, `id` string").repartition(4)
    assert sorted(r[0] for r in dedup.greedy_first(frame, ["fp", "id"], few=few).collect()) == in_turn(rows)
    assert dedup.greedy_first(frame.limit(0), ["fp", "id"], few=few).count() == 0


def machine(calls, opens, wait, until):
    """The breaker call by call: (ts, status) of one source."""
    state, fails, opened, out = "closed", 0, None, []
    for ts, _, failed in sorted(calls):
        if state == "closed":
            fails = fails + 1 if failed else 0
            if fails >= opens:
                state, opened = "open", ts
                out.append((ts, "open"))
        elif ts >= opened + wait:
            out += [(opened + wait, "probe_due"), (ts, "half_open")]
            if failed:
                opened = ts
                out.append((ts, "open"))
            else:
                state, fails = "closed", 0
                out.append((ts, "closed"))
    if state == "open" and opened + wait <= until:
        out.append((opened + wait, "probe_due"))
    return out


def call_log(n=500, seed=4):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(0, 40, n))
    return [(f"s{int(rng.integers(0, 2))}" if rng.random() < 0.4 else "hot", T0 + dt.timedelta(seconds=int(t)), i, bool(rng.random() < 0.6)) for i, t in enumerate(at)]


def test_breakers_batch(spark):
    log, until = call_log(), T0 + dt.timedelta(days=1)
    frame = spark.createDataFrame(log, "source string, ts timestamp, key long, failed boolean").repartition(5)
    got = sorted((r.source, r.ts, r.status) for r in breakers.transitions(frame, "source", "ts", "failed", "key", 3, "90 seconds", "2024-01-02").collect())
    expected = sorted((s, *x) for s in {r[0] for r in log} for x in machine([r[1:] for r in log if r[0] == s], 3, dt.timedelta(seconds=90), until))
    assert got == expected and {x[2] for x in got} == {"open", "probe_due", "half_open", "closed"}
    none = breakers.transitions(frame.limit(0), "source", "ts", "failed", "key")
    assert none.count() == 0


def test_breakers_stream_equals_batch(spark, tmp_path):
    """Rows arrive out of order within the watermark; what the watermark has passed equals the batch job up to there."""
    log = call_log(300, 7)
    shuffled = sorted(log, key=lambda r: r[1].timestamp() + 60 * (r[2] % 3))
    schema = "source string, ts timestamp, key long, failed boolean"
    for i in range(0, 300, 60):
        part = spark.createDataFrame(shuffled[i : i + 60], schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in{i}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in os.listdir(f"{tmp_path}/in{i}"):
            if f.endswith(".parquet"):
                shutil.move(f"{tmp_path}/in{i}/{f}", f"{tmp_path}/in/{i:04d}-{f}")
                os.utime(f"{tmp_path}/in/{i:04d}-{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = breakers.stream_transitions(src, "source", "ts", "failed", "key", 3, 90.0, "5 minutes")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.source, r.ts, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    mark = max(r[1] for r in log) - dt.timedelta(minutes=5)
    passed = spark.createDataFrame([r for r in log if r[1] <= mark], schema)
    expected = sorted((r.source, r.ts, r.status) for r in breakers.transitions(passed, "source", "ts", "failed", "key", 3, "90 seconds", str(mark)).collect())
    assert got == expected and len(got) > 20


CATALOG = "source string, source_id string, title string, metadata_completeness double, canonical_id string"


def records(spark, ids, word):
    return spark.createDataFrame([("a", str(i), f"{word}{i}", 0.5, f"a:{i}") for i in ids], CATALOG)


def shown(spark, root):
    return sorted((r.source_id, r.title, r.ingested_at, r.crawled_at) for r in snapshots.read_snapshot(spark, root).collect())


def test_merges_are_idempotent_and_rewrite_touched_buckets_only(spark, tmp_path):
    root, now = f"file://{tmp_path}/s", lambda n: F.lit(str(T0 + dt.timedelta(days=n))).cast("timestamp")
    merge = snapshots.merge_batch(root, now, buckets=4)
    assert snapshots.read_snapshot(spark, root) is None
    merge(records(spark, range(20), "x"), 0)
    before = snapshots.current(spark, root)
    merge(records(spark, [3], "y"), 1)
    after = snapshots.current(spark, root)
    assert sum(before["buckets"][b] != after["buckets"][b] for b in before["buckets"]) == 1
    rows = shown(spark, root)
    day = lambda n: T0 + dt.timedelta(days=n)
    assert rows == sorted((str(i), f"y{i}" if i == 3 else f"x{i}", day(0), day(1 if i == 3 else 0)) for i in range(20))
    merge(records(spark, range(20), "replayed"), 0)
    merge(records(spark, [3], "replayed"), 1)
    assert shown(spark, root) == rows and snapshots.current(spark, root) == after


def test_titles_of_merged_records_keep_letters_and_lose_white_space(spark, tmp_path):
    """A title is the first six words of the text: form feeds and vertical tabs at its ends go, letters stay."""
    texts = ["foremost | of f", "\f\v two\fwords\f", "f", " \f ", "", None, "a b c d e f g", "\u00a0fine\u0085"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 2, 3.0, T0, "x")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = {str(i): None if t is None else " ".join(re.findall("[^ \t\n\v\f\r]+", t)[:6]) for i, t in enumerate(texts)}
    assert {r.source_id: r.title for r in catalog_view.base_catalog(spark, str(tmp_path)).collect()} == want
    marked = {i: t if t is None or int(i) % 4 else f"v2 {t}" for i, t in want.items()}
    assert {r.source_id: r.title for r in query_jobs.snapshot_merges(spark, str(tmp_path)).collect()} == marked


def test_two_writers_and_a_dead_one(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    snapshots.merge_batch(root)(records(spark, range(5), "x"), 0)
    at = snapshots.current(spark, root)
    with pytest.raises(Exception, match="xist"):
        snapshots.publish(spark, root, at)  # the version is there already
    os.makedirs(f"{tmp_path}/s/data/v-0000000002-dead")  # files that no manifest names
    assert snapshots.current(spark, root) == at and snapshots.read_snapshot(spark, root).count() == 5


def test_stream_that_dies_between_write_and_publish(spark, tmp_path, monkeypatch):
    """The killed batch is merged once after the restart, and its first files are named by no manifest."""
    root, src = f"file://{tmp_path}/s", f"{tmp_path}/in"
    for i in range(3):
        records(spark, range(4 * i, 4 * i + 6), f"b{i}-").coalesce(1).write.mode("append").parquet(src)
    recs = spark.readStream.schema(CATALOG).option("maxFilesPerTrigger", 1).parquet(src)
    publish, calls = snapshots.publish, []

    def dies(spark, root, manifest):
        calls.append(manifest["batch"])
        if len(calls) == 2:
            raise RuntimeError("killed")
        publish(spark, root, manifest)

    monkeypatch.setattr(snapshots, "publish", dies)
    run = lambda: streams.write_upserts(recs, snapshots.merge_batch(root), f"{tmp_path}/cp").awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    assert snapshots.current(spark, root)["batch"] == 0
    run()
    assert calls == [0, 1, 1, 2] and snapshots.current(spark, root)["version"] == 3
    assert sorted(int(r.source_id) for r in snapshots.read_snapshot(spark, root).collect()) == list(range(14))


def test_two_stages_of_signals(spark):
    ranked = spark.createDataFrame([(1, c, 0.5, i + 1) for i, c in enumerate("abcd")], "query_id int, canonical_id string, composite double, rank int")
    cols = "canonical_id string, deep_score double, balance_score double, uniqueness_score double, completeness_score double, total_images long"
    light = spark.createDataFrame([("a", None, None, None, 10.0, None), ("c", None, None, None, 90.0, None), ("d", None, None, None, 80.0, None)], cols)
    deep = spark.createDataFrame([("a", 100.0, None, None, 10.0, None), ("c", 0.0, None, None, 90.0, None), ("d", 90.0, None, None, 80.0, None)], cols)
    got = {r.canonical_id: (r.new_rank, round(r.quality_adjusted, 3)) for r in ranking.two_stage(ranked, light, deep).collect()}
    # c and d lead by completeness; deep scores then move c behind b, and never reach a
    assert got == {"d": (1, 0.689), "b": (2, 0.5), "c": (4, 0.35), "a": (4, 0.3)} or got["d"] == (1, 0.689) and got["b"] == (2, 0.5) and got["c"][0] == 3 and got["a"] == (4, 0.3)
