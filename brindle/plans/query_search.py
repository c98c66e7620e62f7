"""Queries on retrieval, scoring and ranking, and the whole search plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, filters, inverted, ranking, retrieval, scoring, stages
from .catalog_view import AS_OF, CATALOG_SQL, catalog, table
from .query_catalog import _GATES, _JUDGED_SQL, WITH

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A stated block of queries: id, text, task, modality, keywords.
ASKED = [
    (1, "the with that attion", "text_classification", "text", ["with", "that", "the"]),
    (2, "para que del image", "summarization", None, ["para", "crop", "que"]),
    (3, "und die classification der", "classification", "tabular", ["die", "classification", "inger"]),
]
_ASKED_SQL = "asked(query_id, query_text, task, modality, keywords) AS (VALUES " + ", ".join(f"({i}, '{t}', '{k}', {repr(m) if m else 'NULL'}, {w})" for i, t, k, m, w in ASKED) + ")"


def asked(spark) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query_text string, task string, modality string, keywords array<string>")


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark, sf_dir) -> DataFrame:
    return scoring.score(scoring.with_match_text(catalog(spark, sf_dir)).crossJoin(F.broadcast(asked(spark))), AS_OF)


_SCORED_SQL = f"""{WITH}, {_ASKED_SQL},
syn(k, s) AS (VALUES ('crop', ['plant', 'agriculture', 'farm', 'agri', 'vegetation', 'botanical', 'paddy', 'maize', 'wheat', 'rice', 'corn', 'soybean', 'cotton', 'sugarcane', 'potato', 'tomato', 'citrus', 'mango', 'coffee', 'tea'])),
txt AS (SELECT seq, lower(concat_ws(' ', title, description_short, description, array_to_string(tags_primary, ' '), array_to_string(task_types, ' '), array_to_string(modalities, ' '))) AS t FROM catalog),
kw AS (SELECT query_id, unnest(CASE WHEN len(list_filter(keywords, lambda k: k NOT IN ('image', 'classification'))) > 0 THEN list_filter(keywords, lambda k: k NOT IN ('image', 'classification')) ELSE keywords END) AS k FROM asked),
pts AS (SELECT query_id, seq, round(1e-9 + least(sum(CASE WHEN contains(t, k) OR len(list_filter(coalesce(s, []), lambda x: contains(t, x))) > 0 THEN 1.0::DOUBLE
  WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: length(x) >= 5 AND contains(x, substr(k, 1, 5)))) > 0 THEN 0.5 ELSE 0 END) / count(*), 1.0), 4) AS description_match FROM kw CROSS JOIN txt LEFT JOIN syn USING (k) GROUP BY ALL),
fam(t, f) AS (VALUES ('text_classification', 'nlp'), ('summarization', 'nlp'), ('machine_translation', 'nlp'), ('classification', 'classification')),
dims AS (SELECT c.*, a.query_id, a.task, a.modality, p.description_match,
  CASE WHEN len(task_types) > 0 AND list_contains(task_types, task) THEN 1.0::DOUBLE WHEN EXISTS (SELECT 1 FROM fam x, fam y WHERE x.t = a.task AND x.f = y.f AND list_contains(c.task_types, y.t)) THEN 0.7
    WHEN len(modalities) > 0 THEN CASE WHEN list_contains(modalities, CASE a.task WHEN 'classification' THEN 'tabular' ELSE 'text' END) THEN 1.0 ELSE 0.1 END ELSE 0.4 END AS task_relevance,
  round(1e-9 + least(metadata_completeness * 0.60 + has_description::INT * 0.20 + has_schema_info::INT * 0.10 + has_license_info::INT * 0.10, 1.0), 4) AS quality,
  CASE WHEN download_count IS NULL AND upvote_count IS NULL THEN 0.3 ELSE round(1e-9 + least(CASE WHEN download_count > 0 THEN ln(download_count + 1.0::DOUBLE) / ln(100001.0::DOUBLE) ELSE 0 END * 0.7 + CASE WHEN upvote_count > 0 THEN ln(upvote_count + 1.0::DOUBLE) / ln(1001.0::DOUBLE) ELSE 0 END * 0.3, 1.0), 4) END AS popularity,
  CASE WHEN last_updated IS NULL THEN 0.5 ELSE round(1e-9 + least(pow(2.0, -greatest(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_updated)) / 86400), 0) / 365.0), 1.0), 4) END AS freshness
  FROM catalog c CROSS JOIN asked a JOIN pts p ON p.seq = c.seq AND p.query_id = a.query_id),
scored AS (SELECT *, description_match < 0.25 AS gated, CASE WHEN description_match < 0.25 THEN 0.0::DOUBLE ELSE round(1e-9 + greatest(0.0, least(1.0, (task_relevance * 0.35 + quality * 0.20 + popularity * 0.15 + freshness * 0.10 + description_match * 0.20)
  * CASE WHEN modality IS NULL THEN 1.0::DOUBLE WHEN len(modalities) = 0 THEN 0.9 WHEN list_contains(modalities, modality) THEN 1.0 ELSE 0.4 END)), 4) END AS composite FROM dims)"""


@register(f"{_SCORED_SQL} SELECT query_id, canonical_id, CAST(task_relevance AS DOUBLE) AS task_relevance, quality, CAST(popularity AS DOUBLE) AS popularity, CAST(freshness AS DOUBLE) AS freshness, description_match, composite, gated FROM scored")
def score_dims(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "canonical_id", "task_relevance", "quality", "popularity", "freshness", "description_match", "composite", "gated")


_RANKED_SQL = f"""{_SCORED_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY gated, composite DESC, seq) AS nth FROM scored),
adj AS (SELECT *, composite * pow(0.7::DOUBLE, nth - 1) AS adjusted FROM nth), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, gated, composite DESC, seq) AS rank FROM adj) WHERE rank <= 10)"""


@register(f"{_RANKED_SQL} SELECT query_id, rank, canonical_id, round(1e-9 + adjusted, 3) AS adjusted FROM ranked")
def rank_diverse_topk(spark, sf_dir):
    return ranking.rank(scored(spark, sf_dir), 10).select("query_id", F.col("rank").cast("bigint").alias("rank"), "canonical_id", scoring.half_up(F.col("adjusted"), 3).alias("adjusted"))


@register(f"{_SCORED_SQL} SELECT query_id, canonical_id, rank FROM (SELECT query_id, canonical_id, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, gated, seq) AS rank FROM scored) WHERE rank <= 20")
def rank_plain_topk(spark, sf_dir):
    return ranking.rank(scored(spark, sf_dir), 20, diversity=False).select("query_id", "canonical_id", F.col("rank").cast("bigint").alias("rank"))


@register(f"{_RANKED_SQL} SELECT query_id, CASE WHEN count(*) = 1 THEN 'high' WHEN round(max(adjusted) FILTER (rank = 1) - max(adjusted) FILTER (rank = 2), 10) >= 0.2 THEN 'high' WHEN round(max(adjusted) FILTER (rank = 1) - max(adjusted) FILTER (rank = 2), 10) >= 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM ranked GROUP BY query_id")
def confidence(spark, sf_dir):
    return ranking.confidence(ranking.rank(scored(spark, sf_dir), 10))


@register(f"{_RANKED_SQL} SELECT query_id, max(description_match) FILTER (rank <= 5) AS best_match, max(description_match) FILTER (rank <= 5) < 0.25 AND max(composite) FILTER (rank = 1) < 0.05 AS no_results FROM ranked GROUP BY query_id")
def relevance_gate(spark, sf_dir):
    return filters.relevance_gate(ranking.rank(scored(spark, sf_dir), 10)).select("query_id", "best_match", "no_results")


@register(f"{_RANKED_SQL}, e AS (SELECT query_id, count(*) AS n, max(composite) AS top_score, round(round(avg(composite), 6)::DECIMAL(18, 6), 3)::DOUBLE AS avg_score, count(*) FILTER (composite < 0.4) AS low_scores FROM ranked GROUP BY query_id) SELECT *, top_score >= 0.4 AND low_scores < n AS sufficient, ((top_score < 0.4)::INT + (low_scores > n // 2)::INT)::INT AS n_issues FROM e")
def evaluate_results(spark, sf_dir):
    return ranking.evaluate_results(ranking.rank(scored(spark, sf_dir), 10)).withColumn("n_issues", F.size("issues")).drop("issues")


@register(f"""{_SCORED_SQL}, {_JUDGED_SQL}, ps AS (SELECT * FROM scored WHERE canonical_id IN (SELECT canonical_id FROM judged WHERE reject_reason IS NULL)),
nth AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates, row_number() OVER (PARTITION BY query_id, source ORDER BY gated, composite DESC, seq) AS nth FROM ps),
adj AS (SELECT *, CASE WHEN candidates > 10 THEN composite * pow(0.7::DOUBLE, nth - 1) ELSE composite END AS adjusted FROM nth), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, gated, composite DESC, seq) AS rank FROM adj) WHERE rank <= 10),
r AS (SELECT query_id, count(*) AS total_ranked, max(candidates) AS total_scored, max(adjusted) FILTER (rank = 1) - max(adjusted) FILTER (rank = 2) AS gap FROM ranked GROUP BY query_id), j AS (SELECT count(*) AS total_input, count(*) FILTER (reject_reason IS NULL) AS total_after_filter FROM judged)
SELECT query_id, total_input, total_after_filter, total_scored, total_ranked, round(total_after_filter / total_input, 3) AS filter_pass_rate, 'source,description,min_rows,max_rows,min_completeness,min_quality,non_commercial,required_modality,updated_after,task' AS filters_applied, total_scored > total_ranked AS diversity_applied,
  CASE WHEN total_ranked = 1 OR round(gap, 10) >= 0.2 THEN 'high' WHEN round(gap, 10) >= 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM r, j""")
def pipeline_diagnostics(spark, sf_dir):
    ranked = ranking.rank(filters.passed(filters.judge(scored(spark, sf_dir), _GATES)), 10)
    return ranking.diagnostics(filters.judge(catalog(spark, sf_dir), _GATES), ranked, [reason for reason, _ in _GATES.active()]).select(
        "query_id", "total_input", "total_after_filter", "total_scored", "total_ranked", "filter_pass_rate", "filters_applied", "diversity_applied", "confidence"
    )


@register(f"""{_SCORED_SQL}, {_JUDGED_SQL}, ps AS (SELECT * FROM scored WHERE canonical_id IN (SELECT canonical_id FROM judged WHERE reject_reason IS NULL)),
nth AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates, row_number() OVER (PARTITION BY query_id, source ORDER BY gated, composite DESC, seq) AS nth FROM ps),
adj AS (SELECT *, CASE WHEN candidates > 10 THEN composite * pow(0.7::DOUBLE, nth - 1) ELSE composite END AS adjusted FROM nth), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, gated, composite DESC, seq) AS rank FROM adj) WHERE rank <= 10),
r AS (SELECT query_id, count(*) AS total_ranked, max(candidates) AS total_scored, max(adjusted) FILTER (rank = 1) - max(adjusted) FILTER (rank = 2) AS gap FROM ranked GROUP BY query_id), j AS (SELECT count(*) AS total_input, count(*) FILTER (reject_reason IS NULL) AS total_after_filter FROM judged)
SELECT query_id, total_input, total_after_filter, total_scored, total_ranked, round(total_after_filter / total_input, 3) AS filter_pass_rate, 'source,description,min_rows,max_rows,min_completeness,min_quality,non_commercial,required_modality,updated_after,task' AS filters_applied, total_scored > total_ranked AS diversity_applied, true AS timed,
  CASE WHEN total_ranked = 1 OR round(gap, 10) >= 0.2 THEN 'high' WHEN round(gap, 10) >= 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM r, j""")
def pipeline_observed(spark, sf_dir):
    """The same stage counts, observed in the one run that ranks."""
    judged = filters.judge(scored(spark, sf_dir), _GATES)
    _, d = ranking.observed_run(judged, 10, [reason for reason, _ in _GATES.active()], [i for i, *_ in ASKED])
    timed = (F.col("score_ms") >= 0) & (F.col("rank_ms") >= 0)
    return d.select("query_id", "total_input", "total_after_filter", "total_scored", "total_ranked", "filter_pass_rate", "filters_applied", "diversity_applied", timed.alias("timed"), "confidence")


@register(f"{_RANKED_SQL}, per AS (SELECT query_id, source, count(*) AS n, sum(metadata_completeness) AS s FROM ranked GROUP BY ALL) SELECT query_id, string_agg(source || ':' || n, ' ' ORDER BY n DESC, source) AS by_source, round(sum(s) / sum(n), 3) AS avg_completeness, count(*) AS n_sources FROM per GROUP BY query_id")
def result_summary(spark, sf_dir):
    return ranking.result_summary(ranking.rank(scored(spark, sf_dir), 10)).withColumn("by_source", F.array_join("by_source", " "))


@register(f"""{_RANKED_SQL}, prof AS (SELECT canonical_id, CASE WHEN seq % 2 = 0 THEN (seq % 100)::DOUBLE END AS deep, CASE WHEN seq % 3 = 0 THEN (seq % 90)::DOUBLE END AS bal, seq * 10 AS img FROM catalog),
j AS (SELECT r.*, deep, bal, CASE WHEN img >= 50000 THEN 0.9 WHEN img >= 10000 THEN 0.75 WHEN img >= 1000 THEN 0.55 WHEN img >= 100 THEN 0.35 WHEN img > 0 THEN 0.15 END AS scale FROM ranked r JOIN prof USING (canonical_id)),
w AS (SELECT *, (deep IS NOT NULL)::INT * 0.35::DOUBLE + (bal IS NOT NULL)::INT * 0.25::DOUBLE + (scale IS NOT NULL)::INT * 0.25::DOUBLE AS held, coalesce(deep / 100 * 0.35, 0) + coalesce(bal / 100 * 0.25, 0) + coalesce(scale * 0.25, 0) AS total FROM j)
SELECT query_id, canonical_id, round(1e-9 + CASE WHEN held > 0 THEN round(composite * 0.5 + total / held * 0.5, 4) ELSE composite END, 3) AS quality_adjusted FROM w""")
def quality_adjusted(spark, sf_dir):
    prof = catalog(spark, sf_dir).selectExpr("canonical_id", "CASE WHEN seq % 2 = 0 THEN CAST(seq % 100 AS DOUBLE) END AS deep_score", "CASE WHEN seq % 3 = 0 THEN CAST(seq % 90 AS DOUBLE) END AS balance_score", "CAST(NULL AS DOUBLE) AS uniqueness_score", "CAST(NULL AS DOUBLE) AS completeness_score", "seq * 10 AS total_images")
    return ranking.quality_adjusted(ranking.rank(scored(spark, sf_dir), 10), prof).select("query_id", "canonical_id", scoring.half_up(F.col("quality_adjusted"), 3).alias("quality_adjusted"))


@register(f"""{_SCORED_SQL}, r AS (SELECT * FROM (SELECT query_id, canonical_id, source, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, gated, seq) AS rank FROM scored) WHERE rank <= 40),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth, min(rank) OVER (PARTITION BY query_id, source) AS best FROM r)
SELECT query_id, canonical_id, row_number() OVER (PARTITION BY query_id ORDER BY nth > 2, CASE WHEN nth <= 2 THEN best END, CASE WHEN nth <= 2 THEN nth END, rank) AS place FROM s""")
def spread_sources(spark, sf_dir):
    d = ranking.spread_sources(ranking.rank(scored(spark, sf_dir), 40, diversity=False))
    return d.select("query_id", "canonical_id", F.col("place").cast("bigint").alias("place"))


@register(f"""{_RANKED_SQL} SELECT query_id, canonical_id, array_to_string(list_filter([CASE WHEN freshness < 0.35 THEN 'may be outdated' END, CASE WHEN quality < 0.40 THEN 'low quality' END, CASE WHEN license_type IS NULL THEN 'license not specified' END, CASE WHEN description_length < 20 THEN 'minimal description' END,
  CASE WHEN NOT has_schema_info THEN 'no column schema' END, CASE WHEN row_count < 500 THEN 'small' END, CASE WHEN task_relevance < 0.40 THEN 'limited task alignment' END], lambda x: x IS NOT NULL)[1:6], '; ') AS weaknesses,
  array_to_string(list_filter([CASE WHEN task_relevance >= 0.80 THEN 'highly relevant task' END, CASE WHEN task_relevance >= 0.65 AND task_relevance < 0.80 THEN 'good task alignment' END, CASE WHEN description_match >= 0.75 THEN 'well described' END, CASE WHEN popularity >= 0.70 THEN 'widely used: ' || download_count || ' downloads' END,
  CASE WHEN freshness >= 0.75 THEN 'recently updated' END, CASE WHEN quality >= 0.75 THEN 'high quality' END, CASE WHEN has_schema_info THEN 'schema available' END, CASE WHEN license_type IS NOT NULL THEN 'license: ' || license_type END, CASE WHEN row_count >= 10000 THEN 'substantial size' END], lambda x: x IS NOT NULL)[1:7], '; ') AS strengths FROM ranked""")
def explanations(spark, sf_dir):
    d = explain.explain(ranking.rank(scored(spark, sf_dir), 10))
    return d.select("query_id", "canonical_id", F.array_join("weaknesses", "; ").alias("weaknesses"), F.array_join("strengths", "; ").alias("strengths"))


_DIMS = {"task_relevance": "task relevance", "quality": "data quality", "popularity": "popularity", "freshness": "freshness", "description_match": "description match"}
_DIM_LIST = "list_sort([" + ", ".join(f"{{{{'s': -CAST({c} AS DOUBLE), 'i': {i}, 'c': '{c}', 't': '{t}'}}}}" for i, (c, t) in enumerate(_DIMS.items())) + "])"
#: CTEs after ``{0}``, the ranked rows: label, best and worst dimension, and the paragraph of why a row was selected.
_SAID_SQL = f"""said AS (SELECT *, {_DIM_LIST} AS dims_, CASE WHEN composite >= 0.85 THEN 'Excellent' WHEN composite >= 0.70 THEN 'Good' WHEN composite >= 0.50 THEN 'Fair' WHEN composite >= 0.30 THEN 'Weak' ELSE 'Poor' END
  || ' (' || CAST(round(composite * 100) AS INT) || '%)' AS label, CASE rank WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS suffix FROM {{0}}),
told AS (SELECT *, list_transform(list_filter(dims_[1:2], lambda x: x.s < 0), lambda x: x.t || ' (' || CAST(round(x.s * -100) AS INT) || '%)') AS named FROM said),
why AS (SELECT *, dims_[1].c AS best, dims_[5].c AS worst, title || ' ranks ' || rank || suffix || ' with ' || label || '.' || CASE WHEN len(named) > 0 THEN ' Strongest: ' || array_to_string(named, ' and ') || '.' ELSE '' END AS why_selected FROM told)"""


@register(f"{_RANKED_SQL}, {_SAID_SQL.format('ranked')} SELECT query_id, CAST(rank AS INT) AS rank, canonical_id, label, why_selected, best, worst FROM why")
def why_selected(spark, sf_dir):
    """Paragraphs over a ranked list."""
    d = explain.explain(ranking.rank(scored(spark, sf_dir), 10))
    return d.select("query_id", "rank", "canonical_id", "label", "why_selected", "extremes.best", "extremes.worst")


@register(f"{_SCORED_SQL} SELECT query_id, canonical_id, CASE WHEN list_contains(task_types, task) THEN 'exact' WHEN task_relevance = 0.7 THEN 'family' WHEN len(modalities) > 0 AND task_relevance > 0.1 THEN 'modality' ELSE 'none' END AS match_type FROM scored")
def task_match(spark, sf_dir):
    d = catalog(spark, sf_dir).crossJoin(F.broadcast(asked(spark))).withColumn("m", scoring.task_metric(F.col("task")))
    return d.select("query_id", "canonical_id", "m.match_type")


# ---- text retrieval

_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_BM25_SQL = f"""WITH {_ASKED_SQL}, d AS (SELECT doc_id AS doc, {_TOK.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT term, doc, dl, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), mi AS (SELECT avg(raw) AS mean_idf, count(*) AS n_terms FROM raw), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw, mi),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('query_text')}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT query_id, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY query_id, doc),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM bm WHERE score > 0)"""


@register(f"{_BM25_SQL} SELECT query_id, doc, round(1e-9 + score, 4) AS score, rank FROM bt WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    d = retrieval.bm25_top(asked(spark), table(spark, sf_dir, "documents"), "doc_id", "text", 20)
    return d.select("query_id", "doc", scoring.half_up(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _new_folder(spark) -> str:
    return f"{stages.shared_dir(spark)}/index-{uuid.uuid4().hex}"


@register(f"{_BM25_SQL} SELECT query_id, doc, round(1e-9 + score, 4) AS score, rank FROM bt WHERE rank <= 20")
def bm25_stored(spark, sf_dir):
    """The same as bm25_topk, from an index that is written first and read by the buckets of the terms."""
    inverted.write_index(table(spark, sf_dir, "documents"), "doc_id", {"text": False}, path := _new_folder(spark))
    d = inverted.stored_top(spark, path, asked(spark), 20)
    return d.select("query_id", "doc", scoring.half_up(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(f"{_BM25_SQL} SELECT query_id, doc_id AS doc, round(1e-9 + coalesce(score, 0), 4) AS score FROM asked CROSS JOIN documents LEFT JOIN bm USING (query_id) WHERE bm.doc = doc_id OR bm.doc IS NULL".replace(" LEFT JOIN bm USING (query_id) WHERE bm.doc = doc_id OR bm.doc IS NULL", " LEFT JOIN bm ON bm.query_id = asked.query_id AND bm.doc = doc_id").replace("SELECT query_id, doc_id AS doc", "SELECT asked.query_id, doc_id AS doc"))
def bm25_all(spark, sf_dir):
    return retrieval.bm25_all(asked(spark), table(spark, sf_dir, "documents"), "doc_id", "text").select("query_id", "doc", scoring.half_up(F.col("score")).alias("score"))


@register(f"{_BM25_SQL} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf, n_terms FROM st, mi")
def bm25_stats(spark, sf_dir):
    _, stats = retrieval.bm25_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "n_terms")


_NORM = "list_transform(embedding, lambda x: x::DOUBLE)"
_VEC_SQL = f"""v AS (SELECT vec_id AS id, list_transform(e, lambda x: x / CASE WHEN nrm > 0 THEN nrm ELSE 1 END) AS v FROM (SELECT vec_id, {_NORM} AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings WHERE len(embedding) = 64)),
qv AS (SELECT CAST(id % 3 + 1 AS INT) AS query_id, v AS q FROM v WHERE id < 3), vs AS (SELECT query_id, id, round(list_dot_product(q, v), 6) AS score FROM qv CROSS JOIN v),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs)"""


def _vectors(spark, sf_dir):
    v = retrieval.load_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return v, v.filter("id < 3").select((F.col("id") % 3 + 1).cast("int").alias("query_id"), F.col("v").alias("qv"))


@register(f"WITH {_VEC_SQL} SELECT query_id, id, round(1e-9 + score, 4) AS score FROM vt WHERE rank <= 20")
def vector_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return retrieval.vector_top(q, v, 20).select("query_id", "id", scoring.half_up(F.col("score")).alias("score"))


@register(f"WITH {_VEC_SQL} SELECT query_id, id, round(1e-9 + score, 4) AS score FROM vs")
def cosine_ids(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    wanted = v.select("id").crossJoin(F.broadcast(q))
    return retrieval.cosine_for(wanted, v).select("query_id", "id", scoring.half_up(F.col("score")).alias("score"))


_RRF_SQL = f"{_BM25_SQL}, {_VEC_SQL}, t AS (SELECT query_id, doc AS id, rank AS rt FROM bt WHERE rank <= 30), s AS (SELECT query_id, id, rank AS rv FROM vt WHERE rank <= 30), f AS (SELECT query_id, id, rt, rv FROM t FULL JOIN s USING (query_id, id))"


def _lists(spark, sf_dir, k=30):
    v, q = _vectors(spark, sf_dir)
    text = retrieval.bm25_top(asked(spark), table(spark, sf_dir, "documents"), "doc_id", "text", k).withColumnRenamed("doc", "id")
    return text, retrieval.vector_top(q, v, k)


def _n_docs(spark, sf_dir) -> int:
    return table(spark, sf_dir, "documents").count()


@register(f"{_RRF_SQL}, x AS (SELECT query_id, id, round(0.4 / (60.0::DOUBLE + coalesce(rt, (SELECT count(*) + 1 FROM documents))) + 0.6 / (60.0::DOUBLE + coalesce(rv, (SELECT count(*) + 1 FROM documents))), 10) AS score FROM f) SELECT query_id, id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    return retrieval.rrf(*_lists(spark, sf_dir), 10, _n_docs(spark, sf_dir)).select("query_id", "id", F.round("score", 8).alias("score"))


@register(f"{_RRF_SQL}, x AS (SELECT query_id, id, round(coalesce(1.0 / (60.0::DOUBLE + rt), 0) + coalesce(1.0 / (60.0::DOUBLE + rv), 0), 10) AS score FROM f) SELECT query_id, id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10")
def rrf_unweighted(spark, sf_dir):
    return retrieval.rrf(*_lists(spark, sf_dir), 10, 0, (1.0, 1.0), missing="none").select("query_id", "id", F.round("score", 8).alias("score"))


@register(f"""{_RRF_SQL}, x AS (SELECT query_id, id, round(0.4 / (60.0::DOUBLE + coalesce(rt, (SELECT count(*) + 1 FROM documents))) + 0.6 / (60.0::DOUBLE + coalesce(rv, (SELECT count(*) + 1 FROM documents))), 10) AS score FROM f WHERE query_id <> 2)
SELECT query_id, id, mode FROM (SELECT *, 'hybrid' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10 UNION ALL SELECT query_id, doc, 'text' FROM bt WHERE query_id = 2 AND rank <= 10""")
def hybrid_fallback(spark, sf_dir):
    text, vector = _lists(spark, sf_dir)
    return retrieval.hybrid(asked(spark), text, vector.filter("query_id <> 2"), 10, _n_docs(spark, sf_dir)).select("query_id", "id", "mode")


#: The block asked of the fields: also whole tags, which the keyword field is looked up by.
SEARCHED = [*[(i, t) for i, t, *_ in ASKED], (4, "that"), (5, "heit"), (6, "with")]
_FIELD_SQL = f"""{WITH}, searched(query_id, query_text) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in SEARCHED)}),
fields AS (SELECT seq AS doc, 'title' AS f, 3.0 AS boost, false AS whole, {_TOK.format('title')} AS t FROM catalog
  UNION ALL SELECT seq, 'description', 1.0, false, {_TOK.format('description')} FROM catalog UNION ALL SELECT seq, 'tags', 2.0, true, coalesce(tags, []) FROM catalog),
st AS (SELECT f, count(*) AS n, avg(len(t)) AS avgdl FROM fields GROUP BY f),
tf AS (SELECT f, boost, whole, term, doc, dl, count(*) AS tf FROM (SELECT f, boost, whole, doc, len(t) AS dl, unnest(t) AS term FROM fields) GROUP BY ALL),
raw AS (SELECT f, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (f) GROUP BY f, term), mi AS (SELECT f, avg(raw) AS m FROM raw GROUP BY f),
idf AS (SELECT f, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw JOIN mi USING (f)),
q AS (SELECT query_id, whole, term, count(*) AS qtf FROM (SELECT query_id, false AS whole, unnest({_TOK.format('query_text')}) AS term FROM searched
  UNION ALL SELECT query_id, true, query_text FROM searched) GROUP BY ALL),
s AS (SELECT query_id, doc, boost * round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * CASE WHEN whole THEN 1 ELSE 0.25 + 0.75 * dl / avgdl END)), 6) AS score, f
  FROM q JOIN tf USING (whole, term) JOIN idf USING (f, term) JOIN st USING (f) GROUP BY query_id, doc, f, boost),
b AS (SELECT query_id, doc, round(max(score), 6) AS score, arg_max(f, score) AS f FROM s GROUP BY ALL)"""


@register(f"{_FIELD_SQL} SELECT query_id, doc, round(1e-9 + score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM b WHERE score > 0) WHERE rank <= 10")
def text_search(spark, sf_dir):
    """Title, description and tags, the last as a keyword field, from one pass over the records."""
    inverted.write_index(catalog(spark, sf_dir), "seq", {"title": False, "description": False, "tags": True}, path := _new_folder(spark))
    d = inverted.stored_field_search(spark, path, spark.createDataFrame(SEARCHED, "query_id int, query_text string"), {"title": 3.0, "description": 1.0, "tags": 2.0}, 10)
    return d.select("query_id", "doc", scoring.half_up(F.col("score")).alias("score"))


@register(f"{_FIELD_SQL} SELECT query_id, count(*) AS n, count(*) FILTER (f = 'tags') AS by_tag FROM b WHERE score > 0 GROUP BY query_id")
def text_search_fields(spark, sf_dir):
    """How many records each query finds, and how many of them best by a whole tag."""
    inverted.write_index(catalog(spark, sf_dir), "seq", {"title": False, "description": False, "tags": True}, path := _new_folder(spark))
    boosts = F.create_map(F.lit("title"), F.lit(3.0), F.lit("description"), F.lit(1.0), F.lit("tags"), F.lit(2.0))
    s = inverted.stored_scores(spark, path, spark.createDataFrame(SEARCHED, "query_id int, query_text string")).withColumn("score", boosts[F.col("field")] * F.col("score"))
    b = s.groupBy("query_id", "doc").agg(F.max("score").alias("score"), F.max_by("field", "score").alias("f")).filter("score > 0")
    return b.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("f") == "tags").alias("by_tag"))


@register(f"{WITH} SELECT canonical_id, metadata_completeness FROM catalog WHERE title ILIKE '%ther%' OR description ILIKE '%ther%' OR len(list_filter(tags, lambda x: x ILIKE '%ther%')) > 0 ORDER BY metadata_completeness DESC, canonical_id LIMIT 30 OFFSET 10")
def like_search(spark, sf_dir):
    return retrieval.like_search(catalog(spark, sf_dir), "ther", 30, 10).select("canonical_id", "metadata_completeness")


@register(f"{WITH} SELECT seq, canonical_id, (SELECT count(*) FROM catalog WHERE seq > 100 AND source = 'src0') > 25 AS has_more FROM catalog WHERE seq > 100 AND source = 'src0' ORDER BY seq LIMIT 25")
def cursor_page(spark, sf_dir):
    return retrieval.cursor_page(catalog(spark, sf_dir), 100, 25, source="src0").select("seq", "canonical_id", "has_more")


@register(f"""{WITH}, {_ASKED_SQL}, m AS (SELECT query_id, canonical_id, row_count FROM catalog, asked WHERE len(list_filter(list_filter({_TOK.format('query_text')}, lambda t: length(t) >= 3), lambda t: contains(lower(title), t))) > 0
  OR len(list_filter(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) >= 4), lambda w: contains(lower(query_text), w))) > 0)
SELECT query_id, canonical_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_count DESC NULLS LAST, canonical_id) AS rank FROM m) WHERE rank <= 15""")
def keyword_match(spark, sf_dir):
    return retrieval.keyword_match(asked(spark), catalog(spark, sf_dir), 15).select("query_id", "canonical_id", F.col("rank").cast("bigint").alias("rank"))


@register(f"""{_BM25_SQL}, h AS (SELECT b.query_id, b.doc, b.rank, len(list_filter({_TOK.format('a.query_text')}, lambda t: contains(lower(x.text), t))) AS hits FROM bt b JOIN asked a ON a.query_id = b.query_id JOIN documents x ON x.doc_id = b.doc WHERE b.rank <= 20)
SELECT query_id, doc, CAST(hits AS INT) AS keyword_hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rank) AS new_rank FROM h""")
def keyword_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = retrieval.bm25_top(asked(spark), docs, "doc_id", "text", 20).join(F.broadcast(asked(spark).select("query_id", "query_text")), "query_id").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return retrieval.keyword_rerank(top, F.col("text")).select("query_id", "doc", "keyword_hits", F.col("new_rank").cast("bigint").alias("new_rank"))


@register(f"{WITH}, w AS (SELECT CAST(seq % 2 AS INT) AS query_id, seq, canonical_id FROM catalog WHERE seq < 40) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seq DESC) - 1 AS pos, canonical_id FROM w")
def ordered_lookup(spark, sf_dir):
    c = catalog(spark, sf_dir)
    wanted = c.filter("seq < 40").groupBy((F.col("seq") % 2).cast("int").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "canonical_id")), asc=False), lambda x: x["canonical_id"]).alias("ids"))
    return retrieval.in_order(wanted, c.select("canonical_id")).select("query_id", F.col("pos").cast("bigint").alias("pos"), "canonical_id")


@register()
def text_vectors(spark, sf_dir):
    """Hashed word vectors of all benchmark passages, compared with each other's next: the encoder is Python, so rows only."""
    d = retrieval.encode_texts(table(spark, sf_dir, "benchmark"), "text")
    v = d.select("item_id", F.col("embedding").cast("array<double>").alias("v"))
    n = v.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("next"))
    return v.join(n, "item_id").select("item_id", F.round(retrieval.cosine(F.col("v"), F.col("next")), 6).alias("cosine"))


_PLAN_SQL = f"""{_SCORED_SQL}, {_BM25_SQL.removeprefix(f'WITH {_ASKED_SQL}, ')}, pairs AS (SELECT s.* FROM scored s JOIN bt ON bt.query_id = s.query_id AND bt.doc = s.seq AND bt.rank <= 100 WHERE has_description),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY gated, composite DESC, seq) AS nth, count(*) OVER (PARTITION BY query_id) AS n FROM pairs),
adj AS (SELECT *, composite * CASE WHEN n > 10 THEN pow(0.7::DOUBLE, nth - 1) ELSE 1 END AS adjusted FROM nth),
best10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, gated, composite DESC, seq) AS rank FROM adj) WHERE rank <= 10), {_SAID_SQL.format('best10')}"""


@register(f"{_PLAN_SQL} SELECT query_id, CAST(rank AS INT) AS rank, canonical_id, composite, round(1e-9 + adjusted, 3) AS adjusted, label, why_selected FROM why")
def search_plan(spark, sf_dir):
    """The whole plan for a block of queries: gates, retrieval, scores, diverse ranks, explanations."""
    c = filters.passed(filters.judge(catalog(spark, sf_dir), filters.Gates(require_description=True)))
    hits = retrieval.bm25_top(asked(spark), c, "seq", "description", 100).select("query_id", F.col("doc").alias("seq"))
    pairs = c.join(hits, "seq").join(F.broadcast(asked(spark)), "query_id")
    d = explain.explain(ranking.rank(scoring.score(pairs, AS_OF), 10))
    return d.select("query_id", "rank", "canonical_id", "composite", scoring.half_up(F.col("adjusted"), 3).alias("adjusted"), "label", "why_selected")
