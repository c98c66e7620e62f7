"""Queries on catalog derivation, gates, deduplication and analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import analytics, dedup, derive, explain, filters, profiling, ranking, scoring
from ..sources import files
from ..streaming import streams
from .catalog_view import AS_OF, CATALOG_SQL, base_catalog, catalog, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WITH = f"WITH {CATALOG_SQL}"


@register(f"{WITH} SELECT canonical_id, dataset_fingerprint, description_clean, description_short, array_to_string(tags_primary, ',') AS tags_primary, description_length, tag_count, missing_fields_count, has_description, has_schema_info, has_size_info, has_license_info FROM catalog")
def catalog_derive(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", "dataset_fingerprint", "description_clean", "description_short", F.array_join("tags_primary", ",").alias("tags_primary"), "description_length", "tag_count", "missing_fields_count", "has_description", "has_schema_info", "has_size_info", "has_license_info")


@register(f"{WITH} SELECT canonical_id, md5(coalesce(title, '') || ' ' || coalesce(description_clean, '') || CASE WHEN len(tags_primary) > 0 THEN ' ' || array_to_string(tags_primary, ' ') ELSE '' END) AS searchable FROM catalog")
def searchable_text(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", F.md5(derive.joined_text()).alias("searchable"))


@register(f"{WITH} SELECT canonical_id, metadata_completeness, CASE WHEN metadata_completeness >= 0.85 THEN 'gold' WHEN metadata_completeness >= 0.65 THEN 'silver' WHEN metadata_completeness >= 0.45 THEN 'bronze' ELSE 'incomplete' END AS tier FROM catalog")
def completeness_tier(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", "metadata_completeness", derive.tier("metadata_completeness").alias("tier"))


_GATES = filters.Gates(sources=("src0", "src1", "src2", "src3", "src4", "src5"), require_description=True, min_rows=200, max_rows=6000, min_completeness=0.5, min_quality=60, commercial=True, required_modalities=("text", "tabular"), updated_after="1996-01-01", strict_task="text_classification")
_JUDGED_SQL = """judged AS (SELECT *, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'source' WHEN NOT has_description THEN 'description' WHEN row_count < 200 THEN 'min_rows' WHEN row_count > 6000 THEN 'max_rows'
  WHEN metadata_completeness < 0.5 THEN 'min_completeness' WHEN metadata_completeness * 100 < 60 THEN 'min_quality' WHEN license_type IN ('cc_by_nc', 'cc_by_nc_sa') THEN 'non_commercial' WHEN len(modalities) = 0 THEN 'required_modality'
  WHEN last_updated < TIMESTAMP '1996-01-01' THEN 'updated_after' WHEN list_contains(modalities, 'tabular') THEN 'task' END AS reject_reason FROM catalog)"""
_GATE_SQL = f"{WITH}, {_JUDGED_SQL}"


@register(f"{_GATE_SQL} SELECT canonical_id, reject_reason FROM judged")
def filter_reasons(spark, sf_dir):
    return filters.judge(catalog(spark, sf_dir), _GATES).select("canonical_id", "reject_reason")


@register(f"{_GATE_SQL} SELECT count(*) AS total_input, count(*) FILTER (reject_reason IS NULL) AS passed, count(*) FILTER (reject_reason IS NOT NULL) AS rejected, round(count(*) FILTER (reject_reason IS NULL) / count(*), 3) AS pass_rate FROM judged")
def filter_summary(spark, sf_dir):
    return filters.summary(filters.judge(catalog(spark, sf_dir), _GATES))


@register(f"{_GATE_SQL} SELECT reject_reason, count(*) AS n FROM judged GROUP BY reject_reason")
def filter_counts(spark, sf_dir):
    return filters.judge(catalog(spark, sf_dir), _GATES).groupBy("reject_reason").agg(F.count("*").alias("n"))


@register(f"""{WITH} SELECT canonical_id, CASE WHEN data_format IS NULL THEN 'format' WHEN data_domain IS DISTINCT FROM 'nlp' THEN 'domain' WHEN NOT list_contains(task_types, 'text_classification') THEN 'task_type' WHEN language NOT IN ('en') THEN 'language' WHEN NOT has_schema_info THEN 'schema' WHEN NOT has_license_info THEN 'no_license' END AS reject_reason FROM catalog""")
def filter_contract(spark, sf_dir):
    g = filters.Gates(formats=("csv", "json"), domains=("nlp",), tasks=("text_classification",), languages=("en",), require_schema=True, require_license=True)
    return filters.judge(catalog(spark, sf_dir), g).select("canonical_id", "reject_reason")


@register("WITH x AS (SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text) SELECT doc_id, n FROM x")
def dedup_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return n.select("doc_id", "n")


@register(f"{WITH} SELECT canonical_id FROM (SELECT canonical_id, row_number() OVER (PARTITION BY dataset_fingerprint ORDER BY metadata_completeness DESC, seq) AS r FROM catalog) WHERE r = 1")
def dedup_keep_best(spark, sf_dir):
    return dedup.best_by_fingerprint(catalog(spark, sf_dir)).select("canonical_id")


@register(f"{WITH}, p AS (SELECT *, dataset_fingerprint AS f FROM catalog) SELECT canonical_id, seq > min(seq) OVER w AS is_duplicate, CASE WHEN seq > min(seq) OVER w THEN arg_min(canonical_id, seq) OVER w END AS duplicate_of FROM p WINDOW w AS (PARTITION BY f)")
def dedup_mark(spark, sf_dir):
    return dedup.mark(catalog(spark, sf_dir)).select("canonical_id", "is_duplicate", "duplicate_of")


@register(f"{WITH}, p AS (SELECT *, dataset_fingerprint AS f, title AS k FROM catalog), a AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY seq) AS r FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS q FROM a WHERE r = 1) SELECT canonical_id FROM b WHERE q = 1")
def dedup_first_by_either(spark, sf_dir):
    return dedup.first_by_either(catalog(spark, sf_dir), key="title").select("canonical_id")


@register(f"{WITH} SELECT source, count(*) AS n, count(column_count) AS with_columns FROM (SELECT source, column_count FROM catalog WHERE seq % 2 = 0 UNION ALL SELECT source, NULL FROM catalog WHERE seq % 2 = 1) GROUP BY source")
def union_sources(spark, sf_dir):
    c = catalog(spark, sf_dir)
    u = dedup.union_all(c.filter("seq % 2 = 0").select("source", "column_count"), c.filter("seq % 2 = 1").select("source"))
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("column_count").alias("with_columns"))


@register("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 45")
def union_candidate_ids(spark, sf_dir):
    return dedup.union_ids(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id")), table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("id")))


@register(f"{WITH} SELECT canonical_id, list_contains(modalities, 'text') AS has_text, CAST(len(list_filter(['text', 'image'], lambda x: NOT list_contains(modalities, x))) AS INT) AS n_missing FROM catalog")
def modality_sets(spark, sf_dir):
    s = dedup.modality_sets(F.col("modalities"), F.array(F.lit("text"), F.lit("image")))
    return catalog(spark, sf_dir).select("canonical_id", s["any"].alias("has_text"), F.size(s["missing"]).alias("n_missing"))


@register(f"{WITH} SELECT source, count(*) AS n FROM catalog GROUP BY source")
def counts_by_source(spark, sf_dir):
    return analytics.count_by(catalog(spark, sf_dir), "source")


@register(f"{WITH} SELECT data_domain, count(*) AS n FROM catalog WHERE data_domain IS NOT NULL GROUP BY data_domain")
def counts_by_domain(spark, sf_dir):
    return analytics.count_by(catalog(spark, sf_dir), "data_domain")


@register(f"{WITH} SELECT source, round(avg(metadata_completeness), 3) AS avg_completeness FROM catalog GROUP BY source")
def completeness_by_source(spark, sf_dir):
    return analytics.completeness_by_source(catalog(spark, sf_dir))


@register(f"{WITH} SELECT source, count(*) AS n, CAST(grouping(source) AS TINYINT) AS is_total FROM catalog GROUP BY ROLLUP (source)")
def rollup_source(spark, sf_dir):
    return analytics.rollup_by_source(catalog(spark, sf_dir))


@register(f"{WITH} SELECT canonical_id, last_updated FROM catalog WHERE last_updated < TIMESTAMP '1998-01-01' ORDER BY last_updated, canonical_id LIMIT 25")
def stale_records(spark, sf_dir):
    return analytics.stale(catalog(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz"), 25, "last_updated").select("canonical_id", "last_updated")


@register(f"""{WITH}, o AS (SELECT source, source_id, title, metadata_completeness, TIMESTAMP '2001-01-01' AS ingested_at, TIMESTAMP '2001-01-01' AS crawled_at FROM catalog WHERE seq % 3 <> 0),
n AS (SELECT source, source_id, 'x ' || title AS title, metadata_completeness FROM catalog WHERE seq % 2 = 0)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.source_id, n.source_id) AS source_id, coalesce(n.title, o.title) AS title, coalesce(o.ingested_at, TIMESTAMP '2001-09-01') AS ingested_at,
  CASE WHEN n.source_id IS NOT NULL THEN TIMESTAMP '2001-09-01' ELSE o.crawled_at END AS crawled_at FROM o FULL JOIN n ON o.source = n.source AND o.source_id = n.source_id""")
def upsert_merge(spark, sf_dir):
    c = catalog(spark, sf_dir)
    at = F.lit("2001-01-01").cast("timestamp_ntz")
    old = c.filter("seq % 3 <> 0").select("source", "source_id", "title", "metadata_completeness", at.alias("ingested_at"), at.alias("crawled_at"))
    new = c.filter("seq % 2 = 0").select("source", "source_id", F.concat(F.lit("x "), "title").alias("title"), "metadata_completeness", "canonical_id")
    return files.upsert(old, new, F.lit("2001-09-01").cast("timestamp_ntz")).select("source", "source_id", "title", "ingested_at", "crawled_at")


@register(f"{WITH} SELECT canonical_id, CASE WHEN seq % 4 = 0 THEN round(seq / 2.0::DOUBLE, 1) ELSE usability_rating END AS usability_rating FROM catalog")
def analysis_update(spark, sf_dir):
    c = catalog(spark, sf_dir)
    found = c.filter("seq % 2 = 0").select("canonical_id", F.when(F.col("seq") % 4 == 0, F.round(F.col("seq") / 2.0, 1)).alias("usability_rating"))
    return analytics.update_analysis(c, found, ("usability_rating",)).select("canonical_id", "usability_rating")


@register("SELECT event_type AS name, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def metric_summary(spark, sf_dir):
    return analytics.metric_summary(table(spark, sf_dir, "events"), "event_type", key="event_id")


@register("SELECT event_type, user_id % 10 AS cohort, count(*) AS count FROM events GROUP BY ALL")
def labelled_counters(spark, sf_dir):
    return analytics.counters(table(spark, sf_dir, "events").withColumn("cohort", F.col("user_id") % 10), ["event_type", "cohort"])


@register("SELECT event_type, edge, count(*) FILTER (edge = '+Inf' OR value <= TRY_CAST(edge AS DOUBLE)) AS count FROM events, (SELECT unnest(['0.1', '0.25', '0.5', '1.0', '2.5', '5.0', '10.0', '30.0', '60.0', '+Inf']) AS edge) GROUP BY event_type, edge")
def latency_hist(spark, sf_dir):
    return analytics.histogram(table(spark, sf_dir, "events"), "event_type", "value")


@register("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_searches(spark, sf_dir):
    return analytics.recent(table(spark, sf_dir, "events"), 50, "ts", "event_id").select("event_id", "ts", "user_id")


@register("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    return streams.volumes(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("SELECT time_bucket(INTERVAL '10 minutes', ts) - to_minutes(CAST(10 * k AS INT)) AS window_start, user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events, range(0, 6) AS r(k) WHERE user_id % 20 = 0 GROUP BY ALL")
def sliding_rates(spark, sf_dir):
    return streams.volumes(table(spark, sf_dir, "events").filter("user_id % 20 = 0"), "ts", "user_id", "value", "1 hour", "10 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    d = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@register("""WITH r AS (SELECT event_type, ts, value > 50 AS failed, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM r WHERE failed GROUP BY event_type, run HAVING count(*) >= 3""")
def failure_streaks(spark, sf_dir):
    return streams.failure_streaks(table(spark, sf_dir, "events").withColumn("failed", F.col("value") > 50), "event_type", "ts", "failed", "event_id")


@register(f"{WITH} SELECT canonical_id, type, severity, penalty FROM (SELECT canonical_id, unnest(['no_license', 'no_description', 'no_size_info', 'class_imbalance', 'class_imbalance', 'high_missing_values', 'moderate_missing_values']) AS type, unnest(['medium', 'high', 'low', 'high', 'medium', 'high', 'low']) AS severity, unnest([0.05, 0.10, 0.03, 0.08, 0.05, 0.08, 0.02]::DOUBLE[]) AS penalty,"
          " unnest([NOT has_license_info, NOT has_description, NOT has_size_info, ratio > 20, ratio > 5 AND ratio <= 20, missing > 0.20, missing > 0.05 AND missing <= 0.20]) AS hit FROM (SELECT *, CASE WHEN minority_class_size > 0 THEN majority_class_size / minority_class_size END AS ratio, CASE WHEN missing_values > 0 AND row_count > 0 THEN missing_values / (row_count * greatest(coalesce(column_count, 1), 1)) END AS missing FROM catalog)) WHERE hit")
def bias_report(spark, sf_dir):
    return explain.bias_report(catalog(spark, sf_dir))


@register(f"""{WITH}, d AS (SELECT *, CASE WHEN last_updated IS NOT NULL THEN greatest(CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_updated)) / 86400) AS INT), 0) END AS days FROM catalog)
SELECT canonical_id, days, CASE WHEN days IS NULL THEN 0.5 ELSE round(1e-9 + least(round(1e-9 + least(pow(2.0, -days / 365.0), 1.0), 4) + CASE WHEN days <= 90 THEN round(1e-9 + 0.1 * (1 - days / 90.0::DOUBLE), 4) ELSE 0 END, 1.0), 4) END AS score,
  CASE WHEN days IS NULL THEN 'unknown' WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago' WHEN days < 30 THEN days // 7 || ' week' || CASE WHEN days // 7 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN days < 365 THEN days // 30 || ' month' || CASE WHEN days // 30 = 1 THEN '' ELSE 's' END || ' ago' ELSE days // 365 || ' year' || CASE WHEN days // 365 = 1 THEN '' ELSE 's' END || ' ago' END AS label FROM d""")
def freshness_metric(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("f", scoring.freshness_metric(AS_OF))
    return c.select("canonical_id", "f.days", "f.score", text.freshness_label(F.col("f.days")).alias("label"))


_LOG = "CASE WHEN {0} > 0 THEN ln({0} + 1.0::DOUBLE) / ln({1}::DOUBLE) ELSE 0.0::DOUBLE END"
_DOWN, _UP = _LOG.format("download_count", 100001), _LOG.format("upvote_count", 1001)


@register(f"""{WITH}, p AS (SELECT canonical_id, coalesce(download_count, 0) = 0 AND coalesce(upvote_count, 0) = 0 AS missing, least(round(1e-9 + {_DOWN}, 4), 1.0) AS downloads, least(round(1e-9 + {_UP}, 4), 1.0) AS upvotes, round(1e-9 + usability_rating * 0.05, 4) AS bonus FROM catalog),
s AS (SELECT *, CASE WHEN missing THEN 0.3::DOUBLE ELSE round(1e-9 + least(downloads * 0.7 + upvotes * 0.3 + bonus, 1.0), 4) END AS score FROM p)
SELECT canonical_id, score, CASE WHEN missing THEN 'no data' WHEN score >= 0.8 THEN 'extremely popular' WHEN score >= 0.6 THEN 'widely adopted' WHEN score >= 0.4 THEN 'moderately popular' WHEN score >= 0.2 THEN 'niche community' ELSE 'limited adoption' END AS tier FROM s""")
def popularity_metric(spark, sf_dir):
    return catalog(spark, sf_dir).withColumn("p", scoring.popularity_metric()).select("canonical_id", "p.score", "p.tier")


_PENALTY = """round(1e-9 + least(CASE WHEN has_license_info THEN 0 ELSE 0.05::DOUBLE END + CASE WHEN has_description THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN has_size_info THEN 0 ELSE 0.03::DOUBLE END + CASE WHEN ratio > 20 THEN 0.08::DOUBLE WHEN ratio > 5 THEN 0.05::DOUBLE ELSE 0 END
 + CASE WHEN missing > 0.20 THEN 0.08::DOUBLE WHEN missing > 0.05 THEN 0.02::DOUBLE ELSE 0 END, 0.3), 4)"""


@register(f"""{WITH}, r AS (SELECT *, CASE WHEN minority_class_size > 0 THEN majority_class_size / minority_class_size END AS ratio, CASE WHEN missing_values > 0 AND row_count > 0 THEN missing_values / (row_count * greatest(coalesce(column_count, 1), 1)) END AS missing FROM catalog),
q AS (SELECT *, {_PENALTY} AS penalty, CASE WHEN description_length >= 500 THEN 1.0::DOUBLE WHEN description_length >= 100 THEN round(1e-9 + 0.5 + 0.5 * (description_length - 100) / 400.0::DOUBLE, 4) ELSE round(1e-9 + 0.3 * description_length / 100.0::DOUBLE, 4) END AS description_part,
  round(1e-9 + least(tag_count / 5.0::DOUBLE, 1.0) * 0.4 + (len(task_types) > 0)::INT * 0.4 + (len(modalities) > 0)::INT * 0.2, 4) AS annotation FROM r)
SELECT canonical_id, round(1e-9 + greatest(0.0, least(round(metadata_completeness, 4) * 0.35 + description_part * 0.20 + has_schema_info::INT * 0.15 + has_license_info::INT * 0.10 + annotation * 0.10 - penalty * 0.10, 1.0)), 6) AS score, penalty, annotation FROM q""")
def quality_metric(spark, sf_dir):
    return catalog(spark, sf_dir).withColumn("q", scoring.quality_metric()).select("canonical_id", scoring.half_up(F.col("q.raw"), 6).alias("score"), "q.penalty", "q.annotation")


@register(f"""{WITH}, s AS (SELECT *, CASE WHEN column_count IS NOT NULL AND column_names IS NOT NULL AND column_count <> len(column_names) THEN greatest(0.0, 1 - abs(column_count - len(column_names)) / greatest(column_count, len(column_names), 1)) ELSE 1.0 END AS consistency,
  ((length(trim(description)) >= 20)::INT + (len(tags) >= 1)::INT + (license_type IS NOT NULL)::INT + (column_names IS NOT NULL)::INT) / 4.0::DOUBLE AS validity FROM catalog)
SELECT canonical_id, CAST(round(consistency, 4) AS DOUBLE) AS consistency, validity, CAST(round(metadata_completeness * 0.4 + consistency * 0.3 + validity * 0.3, 3) AS DOUBLE) AS composite FROM s""")
def metadata_quality(spark, sf_dir):
    q = catalog(spark, sf_dir).withColumn("q", derive.metadata_quality())
    return q.select("canonical_id", F.round("q.consistency", 4).alias("consistency"), "q.validity", F.round(F.col("q.completeness") * 0.4 + F.col("q.consistency") * 0.3 + F.col("q.validity") * 0.3, 3).alias("composite"))


@register(f"{WITH} SELECT canonical_id, round(has_description::INT * 30.0::DOUBLE + has_schema_info::INT * 20 + has_size_info::INT * 20 + has_license_info::INT * 15 + least(tag_count / 10.0::DOUBLE * 15.0, 15.0), 2) AS score, array_to_string(list_filter([CASE WHEN NOT has_description THEN 'description' END, CASE WHEN NOT has_license_info THEN 'license' END, CASE WHEN row_count IS NULL THEN 'row count' END, CASE WHEN NOT has_schema_info THEN 'schema' END, CASE WHEN last_updated IS NULL THEN 'update date' END, CASE WHEN len(task_types) = 0 THEN 'task types' END, CASE WHEN tag_count = 0 THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS gaps FROM catalog")
def metadata_gaps(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", derive.metadata_score().alias("score"), F.array_join(derive.metadata_gaps(), ",").alias("gaps"))


@register("SELECT o_orderkey, CAST(o_custkey * 0.5 + o_orderkey * 0.25 AS DOUBLE) AS cost FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderstatus <> 'O'")
def token_costs(spark, sf_dir):
    usage = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("prompt_tokens"), F.col("o_orderkey").alias("completion_tokens"))
    rates = spark.createDataFrame([("O", 0.5, 0.25)], "model string, prompt_rate double, completion_rate double")
    return derive.token_cost(usage, rates).select("o_orderkey", "cost")


@register("SELECT page_id, lower(url) LIKE '%.html' OR false AS page_like, CASE WHEN regexp_matches(regexp_replace(lower(url), '[?#].*', ''), '\\.(csv|tsv|parquet|pq|arrow|json|jsonl|ndjson|xlsx|xls|zip)$') THEN true ELSE false END AS downloadable FROM pages")
def downloadable_urls(spark, sf_dir):
    from ..sources.hubs import downloadable

    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").endswith(".html").alias("page_like"), downloadable("url").alias("downloadable"))


@register(f"{WITH} SELECT canonical_id, CASE license_type WHEN 'cc_by' THEN true ELSE false END AS commercial, CASE license_type WHEN 'cc_by' THEN 'CC BY 4.0' WHEN 'cc_by_nc' THEN 'CC BY-NC 4.0' ELSE 'Unknown' END AS license_name, coalesce(nullif(concat_ws(' × ', CASE WHEN row_count > 0 THEN format('{{:,}}', row_count) || ' rows' END, CASE WHEN column_count > 0 THEN format('{{:,}}', column_count) || ' columns' END), ''), 'size unknown') AS size_text FROM catalog")
def license_and_size(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", rules.commercial_use("license_type").alias("commercial"), rules.license_name("license_type").alias("license_name"), text.size_text("row_count", "column_count").alias("size_text"))


@register(f"{WITH} SELECT canonical_id, CASE WHEN source NOT IN ('kaggle', 'huggingface', 'openml') THEN 'unknown source' END AS reject_reason FROM catalog")
def lineage_validation(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumns({"ingestion_version": F.lit("3.1.0"), "pipeline_version": F.lit("3.0.0"), "schema_version": F.lit("3.2.0")})
    return derive.validate(c).select("canonical_id", "reject_reason")


@register(f"{WITH} SELECT canonical_id AS id, CAST(seq AS VARCHAR) AS seq, license_type IS NOT NULL AS has_license FROM catalog")
def search_documents(spark, sf_dir):
    docs = files.to_documents(base_catalog(spark, sf_dir).select(F.concat_ws(":", "source", "source_id").alias("canonical_id"), "seq", "license_type"))
    return docs.select("id", F.get_json_object("document", "$.seq").alias("seq"), F.get_json_object("document", "$.license_type").isNotNull().alias("has_license"))


_N_TOP = "CASE WHEN n = 0 THEN 'low' WHEN top >= 0.70 AND n >= 3 THEN 'high' WHEN top >= 0.45 OR n >= 2 THEN 'medium' ELSE 'low' END"


@register(f"""WITH x AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) / 500000.0::DOUBLE AS top
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, {_N_TOP} AS label FROM x""")
def confidence_labels(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    d = d.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), (F.coalesce(F.max("o_totalprice"), F.lit(0)) / F.lit(500000.0)).alias("top"))
    return d.select("c_custkey", ranking.confidence_label(F.col("n"), F.col("top")).alias("label"))


@register(f"{WITH} SELECT canonical_id FROM catalog ORDER BY metadata_completeness DESC, canonical_id LIMIT 50")
def catalog_capped(spark, sf_dir):
    return ranking.capped(catalog(spark, sf_dir)).select("canonical_id")


@register(f"""{WITH} SELECT canonical_id AS dataset, unnest(tags) AS class, CAST(greatest(1, row_count // len(tags)) AS BIGINT) AS n
FROM catalog WHERE row_count IS NOT NULL""")
def card_class_counts(spark, sf_dir):
    d = catalog(spark, sf_dir).filter("row_count IS NOT NULL")
    return profiling.card_counts(d.select(F.col("canonical_id").alias("dataset"), F.col("row_count").alias("total"), F.col("tags").alias("labels")))


@register(f"""{WITH} SELECT canonical_id, len(task_types) = 0 OR len(list_filter(task_types, lambda t: contains(t, 'classification'))) > 0
  OR list_contains(modalities, 'tabular') AS applies FROM catalog""")
def balance_gate(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", profiling.balance_applies().alias("applies"))


@register(f"""{WITH}, p AS (SELECT canonical_id, metadata_completeness * 100 AS m, CASE WHEN seq % 3 > 0 THEN minority_class_size * 100.0::DOUBLE / majority_class_size END AS b,
  CASE WHEN seq % 2 = 0 THEN 100.0::DOUBLE - missing_values / 10.0::DOUBLE END AS u FROM catalog)
SELECT canonical_id, round((coalesce(b * 0.25, 0) + coalesce(u * 0.25, 0) + m * 0.20) / (CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN u IS NULL THEN 0 ELSE 0.25 END + 0.20), 2) AS score FROM p""")
def weighted_quality(spark, sf_dir):
    b = F.when(F.col("seq") % 3 > 0, F.col("minority_class_size") * 100.0 / F.col("majority_class_size"))
    u = F.when(F.col("seq") % 2 == 0, profiling.uniqueness(F.col("missing_values") / F.lit(10.0)))
    score = profiling.weighted_score(balance=b, uniqueness=u, metadata=F.col("metadata_completeness") * 100)
    return catalog(spark, sf_dir).select("canonical_id", score.alias("score"))


@register("""WITH g AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderpriority FROM g WHERE r <= 25""")
def sampled_orders(spark, sf_dir):
    return profiling.sample_per_class(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 25).select("o_orderkey", "o_orderpriority")


@register(f"""{WITH} SELECT canonical_id, row_number() OVER (ORDER BY metadata_completeness DESC, lower(title), canonical_id) AS place FROM catalog
QUALIFY place <= 100""")
def final_places(spark, sf_dir):
    d = catalog(spark, sf_dir).withColumn("composite", F.col("metadata_completeness"))
    top = d.orderBy(*ranking.final_order(d)).limit(100)
    return top.select("canonical_id", F.row_number().over(Window.orderBy(*ranking.final_order(top))).cast("bigint").alias("place"))
