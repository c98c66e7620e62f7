"""Schemas of the catalog, of landed dumps and of logs."""

from __future__ import annotations

CATALOG = """canonical_id string, dataset_fingerprint string, is_duplicate boolean, duplicate_of string, source string, source_url string, source_id string,
title string, description string, tags array<string>, tags_primary array<string>, row_count bigint, column_count bigint, column_names array<string>, file_size_bytes bigint,
data_format string, license_type string, data_domain string, task_types array<string>, modalities array<string>, language string, last_updated timestamp,
download_count bigint, upvote_count bigint, author string, metadata_completeness double, has_description boolean, has_schema_info boolean, has_size_info boolean, has_license_info boolean,
missing_fields_count int, description_length int, tag_count int, usability_rating double, majority_class_size bigint, minority_class_size bigint, missing_values bigint, download_url string, extra map<string,string>"""

KAGGLE = """ref string, title string, subtitle string, description string, lastUpdated string, downloadCount string, totalBytes string, voteCount string, ownerName string, ownerRef string,
usabilityRating string, tags array<string>, licenseName string, kernelCount string, viewCount string, _corrupt_record string"""

HUGGINGFACE = """id string, tags array<string>, downloads string, likes string, lastModified string, created_at string, gated string, private string,
cardData struct<description:string,task_categories:array<string>,modalities:array<string>,license:string,language:array<string>,dataset_info:string>, _corrupt_record string"""

OPENML = """did string, name string, description string, tag array<string>, format string, licence string, creator string, uploader string, upload_date string, version string, visibility string,
NumberOfInstances string, NumberOfFeatures string, NumberOfClasses string, NumberOfMissingValues string, MajorityClassSize string, MinorityClassSize string, _corrupt_record string"""

SEARCH_LOG = "query string, results_count int, sources_used array<string>, confidence string, processing_time_ms int, searched_at timestamp, request_id string"
METRICS = "name string, labels map<string,string>, value double, ts timestamp"
