"""A catalog over the driver's tables: documents as records, with label and order columns as metadata, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import derive

AS_OF = "2001-09-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), F.col("doc_id") == F.col("o_orderkey"), "left")
    return d.selectExpr(
        "doc_id AS seq", "source", "CAST(doc_id AS STRING) AS source_id", "concat('https://example.org/d/', doc_id) AS source_url",
        r"array_join(slice(split(btrim(text, ' \t\n\u000B\u000C\r'), '[ \\x09-\\x0D]+', 7), 1, 6), ' ') AS title", "text AS description",
        "slice(array_distinct(regexp_extract_all(lower(text), '[a-z]{4,}', 0)), 1, 8) AS tags",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS row_count", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS column_count",
        "CASE WHEN doc_id % 4 = 0 THEN array('id', 'text', 'label') END AS column_names", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars * 2 END AS file_size_bytes",
        "CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END AS data_format", "CASE WHEN quality = 1 AND toxic = 1 THEN 'cc_by_nc' WHEN quality = 1 THEN 'cc_by' WHEN quality = 0 THEN 'unknown' END AS license_type",
        "CASE lang WHEN 'en' THEN 'nlp' WHEN 'de' THEN 'finance' END AS data_domain",
        "CASE doc_id % 4 WHEN 0 THEN array('text_classification') WHEN 1 THEN array('summarization', 'machine_translation') WHEN 3 THEN array('classification') ELSE CAST(array() AS ARRAY<STRING>) END AS task_types",
        "CASE doc_id % 3 WHEN 0 THEN array('text') WHEN 1 THEN array('tabular') ELSE CAST(array() AS ARRAY<STRING>) END AS modalities", "lang AS language", "o_orderdate AS last_updated",
        "CAST(floor(o_totalprice) AS BIGINT) AS download_count", "o_custkey % 100 AS upvote_count", "o_orderpriority AS author", "(doc_id % 10) / 10.0D AS usability_rating",
        "doc_id % 50 + 1 AS majority_class_size", "doc_id % 7 AS minority_class_size", "doc_id % 1000 AS missing_values",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(base_catalog(spark, sf_dir))


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_TAGS = r"regexp_extract_all(lower(text), '[a-z]{4,}')"

#: DuckDB twin: CTEs ``base`` and ``catalog``.
CATALOG_SQL = rf"""
base AS (SELECT d.doc_id AS seq, source, CAST(d.doc_id AS VARCHAR) AS source_id, 'https://example.org/d/' || d.doc_id AS source_url,
  array_to_string(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')[1:6], ' ') AS title, text AS description, ({_DISTINCT.format(_TAGS)})[1:8] AS tags,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE n_chars END AS row_count, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 7 END AS column_count,
  CASE WHEN d.doc_id % 4 = 0 THEN ['id', 'text', 'label'] END AS column_names, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE n_chars * 2 END AS file_size_bytes,
  CASE d.doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END AS data_format,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'cc_by_nc' WHEN quality = 1 THEN 'cc_by' WHEN quality = 0 THEN 'unknown' END AS license_type, CASE lang WHEN 'en' THEN 'nlp' WHEN 'de' THEN 'finance' END AS data_domain,
  CASE d.doc_id % 4 WHEN 0 THEN ['text_classification'] WHEN 1 THEN ['summarization', 'machine_translation'] WHEN 3 THEN ['classification'] ELSE CAST([] AS VARCHAR[]) END AS task_types,
  CASE d.doc_id % 3 WHEN 0 THEN ['text'] WHEN 1 THEN ['tabular'] ELSE CAST([] AS VARCHAR[]) END AS modalities, lang AS language, o_orderdate AS last_updated,
  CAST(floor(o_totalprice) AS BIGINT) AS download_count, o_custkey % 100 AS upvote_count, o_orderpriority AS author, (d.doc_id % 10) / 10.0::DOUBLE AS usability_rating,
  d.doc_id % 50 + 1 AS majority_class_size, d.doc_id % 7 AS minority_class_size, d.doc_id % 1000 AS missing_values
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN orders o ON o.o_orderkey = d.doc_id),
cut AS (SELECT *, substr(description, 1, 2000) AS c2000, substr(description, 1, 300) AS c300 FROM base),
ends AS (SELECT *, greatest(CASE WHEN strpos(reverse(c2000), ' .') > 0 THEN length(c2000) - strpos(reverse(c2000), ' .') - 1 ELSE -1 END, CASE WHEN strpos(reverse(c2000), ' !') > 0 THEN length(c2000) - strpos(reverse(c2000), ' !') - 1 ELSE -1 END,
  CASE WHEN strpos(reverse(c2000), ' ?') > 0 THEN length(c2000) - strpos(reverse(c2000), ' ?') - 1 ELSE -1 END) AS e2000, CASE WHEN strpos(reverse(c300), ' ') > 0 THEN length(c300) - strpos(reverse(c300), ' ') ELSE -1 END AS e300 FROM cut),
catalog AS (SELECT * EXCLUDE (c2000, c300, e2000, e300), source || ':' || source_id AS canonical_id,
  sha256('{{"columns": [' || coalesce(array_to_string(list_transform(list_sort(column_names), lambda x: '"' || x || '"'), ', '), '') || '], "row_count": ' || coalesce(CAST(row_count AS VARCHAR), 'null') || ', "source": "' || lower(trim(source)) || '", "title": "' || replace(replace(lower(trim(title)), '\', '\\'), '"', '\"') || '"}}') AS dataset_fingerprint,
  CASE WHEN length(description) <= 2000 THEN description WHEN e2000 > 1000 THEN substr(c2000, 1, e2000 + 1) ELSE c2000 END AS description_clean,
  CASE WHEN length(description) <= 300 THEN description ELSE CASE WHEN e300 > 150 THEN substr(c300, 1, e300) ELSE c300 END || '…' END AS description_short,
  list_transform(list_sort(list_transform(tags, lambda x, i: {{'s': -(1.0::DOUBLE / (length(x) + 1) + (len(tags) - (i - 1)) / (len(tags) * 100.0::DOUBLE)), 'i': i, 't': x}}))[1:10], lambda x: x.t) AS tags_primary,
  round(((trim(title) <> '')::INT + (trim(description) <> '')::INT + (len(tags) > 0)::INT + 1 + coalesce(row_count > 0, false)::INT + coalesce(column_count > 0, false)::INT + coalesce(file_size_bytes > 0, false)::INT
    + coalesce(license_type <> 'unknown', false)::INT + (data_format IS NOT NULL)::INT + (last_updated IS NOT NULL)::INT) / 10.0::DOUBLE, 3) AS metadata_completeness,
  coalesce(trim(description) <> '', false) AS has_description, column_names IS NOT NULL AS has_schema_info, row_count IS NOT NULL OR file_size_bytes IS NOT NULL AS has_size_info, coalesce(license_type <> 'unknown', false) AS has_license_info,
  CAST(length(description) AS INT) AS description_length, CAST(len(tags) AS INT) AS tag_count,
  (row_count IS NULL)::INT + (column_count IS NULL)::INT + (file_size_bytes IS NULL)::INT + (data_format IS NULL)::INT + (license_type IS NULL)::INT + (data_domain IS NULL)::INT + (last_updated IS NULL)::INT + (author IS NULL)::INT + (language IS NULL)::INT AS missing_fields_count
  FROM ends)"""
