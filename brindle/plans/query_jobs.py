"""Queries of several passes: breakers, merged snapshots, conflicts in turn, ranking by profiles of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dedup, explain, profiling, ranking, scoring, stages
from ..sources import files
from ..streaming import breakers, snapshots
from .catalog_view import catalog, table
from .query_catalog import WITH
from .query_profile import TABLES, _profile_sql
from .query_search import _RANKED_SQL, scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register("""
WITH RECURSIVE e AS (SELECT event_type AS source, ts, value > 50 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT source, 0::BIGINT AS i, 'closed' AS status, 0 AS fails, NULL::TIMESTAMP AS opened, NULL::TIMESTAMP AS due, NULL::TIMESTAMP AS half, NULL::TIMESTAMP AS shut, NULL::TIMESTAMP AS began
    FROM (SELECT DISTINCT source FROM e)
  UNION ALL SELECT source, i, status, fails, CASE WHEN began IS NOT NULL THEN began WHEN status = 'open' THEN opened END, due, half, shut, began FROM (
    SELECT *, CASE WHEN status = 'open' AND (was = 'closed' OR half IS NOT NULL) THEN ts END AS began FROM (
      SELECT m.source, e.i, e.ts, m.status AS was, m.opened,
        CASE WHEN m.status = 'closed' THEN CASE WHEN e.failed AND m.fails >= 2 THEN 'open' ELSE 'closed' END WHEN e.ts >= m.opened + INTERVAL '2 hours' AND NOT e.failed THEN 'closed' ELSE 'open' END AS status,
        CASE WHEN m.status = 'closed' AND e.failed THEN m.fails + 1 ELSE 0 END AS fails,
        CASE WHEN m.status = 'open' AND e.ts >= m.opened + INTERVAL '2 hours' THEN m.opened + INTERVAL '2 hours' END AS due, CASE WHEN m.status = 'open' AND e.ts >= m.opened + INTERVAL '2 hours' THEN e.ts END AS half,
        CASE WHEN m.status = 'open' AND e.ts >= m.opened + INTERVAL '2 hours' AND NOT e.failed THEN e.ts END AS shut
      FROM m JOIN e ON e.source = m.source AND e.i = m.i + 1))),
z AS (SELECT source, arg_max(status, i) AS status, max(opened) AS opened FROM m GROUP BY source)
SELECT source, began AS ts, 'open' AS status FROM m WHERE began IS NOT NULL UNION ALL SELECT source, due, 'probe_due' FROM m WHERE due IS NOT NULL
UNION ALL SELECT source, half, 'half_open' FROM m WHERE half IS NOT NULL UNION ALL SELECT source, shut, 'closed' FROM m WHERE shut IS NOT NULL
UNION ALL SELECT source, opened + INTERVAL '2 hours', 'probe_due' FROM z WHERE status = 'open' AND opened + INTERVAL '2 hours' <= TIMESTAMP '2024-02-01'
""")
def breaker_transitions(spark, sf_dir):
    """States of a breaker for each type of event: three failures in a row open it, a probe is due after two hours."""
    d = table(spark, sf_dir, "events").withColumn("failed", F.col("value") > 50)
    d = breakers.transitions(d, "event_type", "ts", "failed", "event_id", opens=3, recovery="2 hours", until="2024-02-01")
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(f"""{WITH} SELECT source, source_id, CASE WHEN seq % 4 = 0 THEN 'v2 ' ELSE '' END || title AS title,
  CASE WHEN seq % 3 = 0 THEN TIMESTAMP '2001-01-01' WHEN seq % 3 = 1 THEN TIMESTAMP '2001-01-02' ELSE CASE WHEN seq % 4 = 0 THEN TIMESTAMP '2001-01-03' ELSE TIMESTAMP '2001-01-04' END END AS ingested_at,
  CASE WHEN seq % 3 = 2 AND seq % 4 <> 0 THEN TIMESTAMP '2001-01-04' WHEN seq % 4 = 0 THEN TIMESTAMP '2001-01-03' WHEN seq % 3 = 0 THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2001-01-02' END AS crawled_at FROM catalog""")
def snapshot_merges(spark, sf_dir):
    """Four numbered batches merged into a snapshot, the first two delivered again at the end: these change nothing."""
    root = f"{stages.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    c = stages.staged(catalog(spark, sf_dir).select("seq", "source", "source_id", "title", "metadata_completeness", "canonical_id"))
    batches = [c.filter("seq % 3 = 0"), c.filter("seq % 3 = 1"), c.filter("seq % 4 = 0").withColumn("title", F.concat(F.lit("v2 "), "title")), c.filter("seq % 3 = 2 AND seq % 4 <> 0")]
    merge = snapshots.merge_batch(root, lambda number: F.lit(f"2001-01-{number + 1:02d}").cast("timestamp_ntz"))
    for number in (0, 1, 2, 3, 0, 1):
        merge(batches[number].drop("seq"), number)
    return snapshots.read_snapshot(spark, root).select("source", "source_id", "title", "ingested_at", "crawled_at")


@register("""
WITH RECURSIVE o AS (SELECT o_orderkey AS seq, o_custkey AS a, CAST(o_orderdate AS DATE) AS b, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS sa, []::DATE[] AS sb, NULL::BIGINT AS kept
  UNION ALL SELECT i, CASE WHEN fresh THEN list_append(sa, a) ELSE sa END, CASE WHEN fresh THEN list_append(sb, b) ELSE sb END, CASE WHEN fresh THEN seq END
  FROM (SELECT o.i, o.seq, o.a, o.b, g.sa, g.sb, NOT list_contains(g.sa, o.a) AND NOT list_contains(g.sb, o.b) AS fresh FROM g JOIN o ON o.i = g.i + 1))
SELECT kept AS seq FROM g WHERE kept IS NOT NULL
""")
def greedy_orders(spark, sf_dir):
    """Orders taken in turn, at most one a customer and one a day: long chains of conflicts, all but a few in rounds."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return dedup.greedy_first(d, ["o_custkey", "day"], "seq", few=100)


STAGED = ("orders", "part", "customer", "supplier", "events")
_DATASET = "CASE seq % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(STAGED)) + " END"


def _adjusted_sql(source: str, signals: str, on: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality_adjusted DESC, rank) AS new_rank FROM (SELECT r.*,
  CASE WHEN s.completeness_score IS NULL THEN composite ELSE round(composite * 0.5 + (coalesce(s.deep_score / 100 * 0.35, 0) + s.completeness_score / 100 * 0.10) / ((s.deep_score IS NOT NULL)::INT * 0.35::DOUBLE + 0.10::DOUBLE) * 0.5, 4) END AS quality_adjusted
  FROM {source} r LEFT JOIN {signals} s ON {on}))"""


@register(f"""{_RANKED_SQL}, prof AS ({" UNION ALL ".join(f"SELECT '{t}' AS dataset, * FROM ({_profile_sql(t, TABLES[t])})" for t in STAGED)}),
sig AS (SELECT dataset, round(100.0 - avg(missing_percentage), 2) AS completeness_score, round(((100.0 - avg(missing_percentage)) * 0.30 + (100.0 - avg(CASE WHEN type = 'id' OR unique_count <= 1 THEN 100.0 ELSE 0 END)) * 0.20) / 0.5, 2) AS deep_score FROM prof GROUP BY dataset),
rr AS (SELECT *, {_DATASET} AS dataset FROM ranked), light AS (SELECT dataset, completeness_score, NULL::DOUBLE AS deep_score FROM sig),
one AS {_adjusted_sql('rr', 'light', 'r.dataset = s.dataset')}, chosen AS (SELECT query_id, canonical_id, completeness_score, CASE WHEN new_rank <= 2 THEN deep_score END AS deep_score FROM one JOIN sig USING (dataset)),
two AS {_adjusted_sql('rr', 'chosen', 'r.query_id = s.query_id AND r.canonical_id = s.canonical_id')}
SELECT query_id, canonical_id, round(1e-9 + quality_adjusted, 3) AS quality_adjusted, new_rank FROM two""")
def two_stage_rerank(spark, sf_dir):
    """Hits ranked by completeness of their tables, the first two then by deep scores too; tables profiled in one job."""
    signals = stages.staged(ranking.dataset_signals(profiling.profile_many({t: table(spark, sf_dir, t).select(*TABLES[t]) for t in STAGED})))
    ranked = stages.staged(ranking.rank(scored(spark, sf_dir), 10).withColumn("dataset", F.expr(_DATASET)))
    none = F.lit(None).cast("double")
    of = ranked.select("canonical_id", "dataset").distinct().join(F.broadcast(signals), "dataset")  # a row a table
    deep = of.select("canonical_id", "deep_score", none.alias("balance_score"), none.alias("uniqueness_score"), "completeness_score", F.lit(None).cast("bigint").alias("total_images"))
    d = ranking.two_stage(ranked, deep.withColumn("deep_score", none), deep)
    return d.select("query_id", "canonical_id", scoring.half_up(F.col("quality_adjusted"), 3).alias("quality_adjusted"), F.col("new_rank").cast("bigint").alias("new_rank"))


@register("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS target FROM orders")
def features_with_target(spark, sf_dir):
    """Orders landed as CSV files of features and, apart from them and cut in another way, of the target; joined row by row."""
    root = f"{stages.shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "orders")
    for name, columns, most in (("features", ["o_orderkey", "o_custkey", "o_totalprice"], 2_000_000), ("target", ["o_orderpriority"], 3_000_000)):
        d.select(*columns).write.option("header", True).option("maxRecordsPerFile", most).csv(f"{root}/{name}")
    return files.with_target(spark, f"{root}/features", f"{root}/target")


KNOWN = ("row_count", "column_count", "file_size_bytes", "data_format", "license_type", "data_domain")
_MISSING = [f"(n - n{i}) * 100.0::DOUBLE / n" for i in range(len(KNOWN))]
_TWO = "CAST(round(CAST({0} AS DECIMAL(18, 6)), 2) AS DECIMAL(5, 2))"
_NARRATED = ", ".join(f"{{'s': -CAST({k} AS DOUBLE), 'i': {i}, 't': '{k.replace('_', ' ')} (' || {_TWO.format(k)} || ')'}}" for i, k in enumerate(explain.DIMENSIONS))


@register(f"""{_RANKED_SQL},
gn AS (SELECT source, count(*) AS n, {", ".join(f"count({c}) AS n{i}" for i, c in enumerate(KNOWN))} FROM catalog GROUP BY source),
gc AS (SELECT source, license_type AS class, count(*) AS k FROM catalog WHERE license_type IS NOT NULL GROUP BY ALL),
gb AS (SELECT source, CASE WHEN count(*) > 1 THEN round(min(k) * 100.0::DOUBLE / max(k), 2) ELSE 0 END AS bal, first(class ORDER BY k DESC, class) AS dominant FROM gc GROUP BY source),
gd AS (SELECT source, sum(k - 1) AS extra FROM (SELECT source, coalesce(description, '') AS t, count(*) AS k FROM catalog GROUP BY ALL) GROUP BY source),
gs AS (SELECT *, round(100 - ({" + ".join(_MISSING)}) / {len(KNOWN)}, 2) AS comp, round(100 - extra * 100.0::DOUBLE / n, 2) AS uniq FROM gn LEFT JOIN gb USING (source) JOIN gd USING (source)),
an AS (SELECT source, comp, bal, uniq, round((comp * 0.30::DOUBLE + bal * 0.25::DOUBLE + uniq * 0.25::DOUBLE) / (0.30::DOUBLE + 0.25::DOUBLE + 0.25::DOUBLE), 2) AS deep,
  list_filter([{", ".join(f"CASE WHEN {m} > 20 THEN 'Column ''{c}'' has ' || (n - n{i}) || ' null values' END" for i, (c, m) in enumerate(zip(KNOWN, _MISSING, strict=True)))},
    CASE WHEN bal < 30 THEN 'Class imbalance: ''' || dominant || ''' dominates' END, CASE WHEN extra > 0 THEN CAST(extra AS BIGINT) || ' duplicate rows' END], lambda x: x IS NOT NULL)[1:10] AS fixes FROM gs),
ex AS (SELECT *, lower(array_to_string(coalesce(fixes, []), ' ')) AS said FROM ranked LEFT JOIN an USING (source))
SELECT query_id, canonical_id,
  array_to_string(list_filter([CASE WHEN comp >= 90 THEN 'data nearly complete: ' || CAST(100 - comp AS DECIMAL(5, 1)) || '% missing' END, CASE WHEN uniq >= 98 THEN 'hardly any duplicate rows' END,
    CASE WHEN bal >= 75 THEN 'balanced classes: ' || CAST(round_even(bal, 0) AS INT) || '/100' END, CASE WHEN deep >= 75 THEN 'good data: ' || CAST(round_even(deep, 0) AS INT) || '/100' END,
    CASE WHEN task_relevance >= 0.80 THEN 'highly relevant task' END, CASE WHEN task_relevance >= 0.65 AND task_relevance < 0.80 THEN 'good task alignment' END, CASE WHEN description_match >= 0.75 THEN 'well described' END,
    CASE WHEN popularity >= 0.70 THEN 'widely used: ' || download_count || ' downloads' END, CASE WHEN freshness >= 0.75 THEN 'recently updated' END, CASE WHEN quality >= 0.75 AND deep IS NULL THEN 'high quality' END,
    CASE WHEN has_schema_info THEN 'schema available' END, CASE WHEN license_type IS NOT NULL THEN 'license: ' || license_type END, CASE WHEN row_count >= 10000 THEN 'substantial size' END], lambda x: x IS NOT NULL)[1:7], '; ') AS strengths,
  array_to_string(list_concat(coalesce(fixes, [])[1:4], list_filter([
    CASE WHEN comp < 70 AND NOT regexp_matches(said, 'missing|null') THEN 'many missing values: only ' || CAST(round_even(comp, 0) AS INT) || '% there' END,
    CASE WHEN bal < 50 AND NOT regexp_matches(said, 'balance|samples') THEN 'classes out of balance: ' || CAST(round_even(bal, 0) AS INT) || '/100' END,
    CASE WHEN uniq < 95 AND NOT regexp_matches(said, 'duplicate') THEN 'duplicate rows: ' || CAST(100 - uniq AS DECIMAL(5, 1)) || '%' END,
    CASE WHEN freshness < 0.35 THEN 'may be outdated' END, CASE WHEN quality < 0.40 AND deep IS NULL THEN 'low quality' END, CASE WHEN license_type IS NULL AND NOT regexp_matches(said, 'license') THEN 'license not specified' END,
    CASE WHEN description_length < 20 AND NOT regexp_matches(said, 'description') THEN 'minimal description' END, CASE WHEN NOT has_schema_info AND NOT regexp_matches(said, 'schema|column') THEN 'no column schema' END,
    CASE WHEN row_count < 500 THEN 'small' END, CASE WHEN task_relevance < 0.40 THEN 'limited task alignment' END], lambda x: x IS NOT NULL))[1:6], '; ') AS weaknesses,
  'Ranked #' || rank || ' with a composite score of ' || {_TWO.format("composite")} || '. Strongest signal: ' || (list_sort([{_NARRATED}]))[1].t || '.' AS why_ranked,
  'Task relevance ' || {_TWO.format("task_relevance")} || ': ' || CASE WHEN task_relevance > 0.6 THEN 'strong' ELSE 'moderate' END || ' alignment. Freshness ' || {_TWO.format("freshness")} || ': '
    || CASE WHEN freshness > 0.6 THEN 'recent maintenance' ELSE 'potentially older data' END || '.' AS score_narrative
FROM ex""")
def explanations_sampled(spark, sf_dir):
    """Explanations with what the data themselves show: the records of a source are taken as its data."""
    found = profiling.group_signals(catalog(spark, sf_dir), "source", list(KNOWN), "license_type", "description")
    d = explain.explain(ranking.rank(scored(spark, sf_dir), 10), found, on="source").withColumn("told", explain.narrative())
    return d.select("query_id", "canonical_id", F.array_join("strengths", "; ").alias("strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"), "told.why_ranked", "told.score_narrative")
