"""Queries on operators of single fields, requests, remaining gates, and results in several modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals, text
from ..operators import analytics, dedup, derive, filters, profiling, ranking, retrieval, understanding
from ..sources import files
from .catalog_view import catalog, table
from .query_catalog import WITH
from .query_search import _RANKED_SQL, _RRF_SQL, _lists, _n_docs, asked, scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@register(f"""{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset_fingerprint ORDER BY seq) > 1 AS dup FROM catalog)
SELECT canonical_id, CASE WHEN dup THEN 'duplicate' WHEN license_type = 'cc_by_nc' THEN 'excluded_license' WHEN license_type IS NULL THEN 'license' WHEN NOT list_has_any(modalities, ['text', 'tabular']) THEN 'modality' END AS reject_reason,
  'duplicate,excluded_license,license,modality' AS active FROM p""")
def filter_licenses(spark, sf_dir):
    """Gates on duplicates, excluded and wanted licenses, and modalities, with the names of the active ones."""
    g = filters.Gates(exclude_duplicates=True, excluded_licenses=("cc_by_nc",), licenses=("cc_by", "unknown"), modalities=("text", "tabular"))
    d = filters.judge(dedup.mark(catalog(spark, sf_dir)), g)
    return d.select("canonical_id", "reject_reason", F.lit(",".join(reason for reason, _ in g.active())).alias("active"))


@register(f"{WITH} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY CASE WHEN seq % 2 = 0 THEN 'id ' || seq % 100 ELSE title END ORDER BY seq) AS r FROM catalog) WHERE r = 1")
def dedup_by_id_or_title(spark, sf_dir):
    """One record an id, or a title where there is no id."""
    c = catalog(spark, sf_dir).withColumn("canonical_id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("id "), (F.col("seq") % 100).cast("string"))))
    return dedup.by_id_or_title(c).select("seq")


_SIZED = "CAST(CAST(floor({0} * 10 + 0.5) / 10 AS DECIMAL(18, 1)) AS VARCHAR)"
_NAMED = "array_to_string(list_transform(task_types, lambda x: CASE x WHEN 'text_classification' THEN 'Text Classification' WHEN 'summarization' THEN 'Summarization' WHEN 'machine_translation' THEN 'Machine Translation' ELSE 'Classification' END), ', ')"


@register(f"""{WITH}, s AS (SELECT *, file_size_bytes * (CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END)::BIGINT AS b, substr(trim(description), 1, 80) AS c80 FROM catalog),
e AS (SELECT *, CASE WHEN strpos(reverse(c80), ' ') > 0 THEN length(c80) - strpos(reverse(c80), ' ') ELSE -1 END AS gap FROM s)
SELECT canonical_id, CASE WHEN coalesce(b, 0) <= 0 THEN 'unknown' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {_SIZED.format('(b / 1024.0::DOUBLE)')} || ' KB' WHEN b < 1073741824 THEN {_SIZED.format('(b / 1048576.0::DOUBLE)')} || ' MB' ELSE {_SIZED.format('(b / 1073741824.0::DOUBLE)')} || ' GB' END AS file_size,
  CASE WHEN trim(description) = '' THEN substr(concat_ws(' — ', title, CASE WHEN len(tags) > 0 THEN array_to_string(tags[1:3], ', ') END), 1, 120) WHEN length(trim(description)) <= 80 THEN trim(description) ELSE CASE WHEN gap > 0 THEN substr(c80, 1, gap) ELSE c80 END || '…' END AS summary,
  {_NAMED} AS tasks FROM e""")
def display_texts(spark, sf_dir):
    """File sizes, summary lines and names of tasks, as shown."""
    c = catalog(spark, sf_dir).withColumn("b", F.col("file_size_bytes") * F.expr("CASE seq % 3 WHEN 0 THEN 1L WHEN 1 THEN 1000L ELSE 1000000L END"))
    return c.select("canonical_id", text.file_size("b").alias("file_size"), text.summary_line("description", "title", "tags").alias("summary"), F.array_join(text.task_labels("task_types"), ", ").alias("tasks"))


@register("SELECT vec_id, CAST(100 AS INT) AS n_padded, CAST(16 AS INT) AS n_cut, CAST(embedding[len(embedding)] AS DOUBLE) AS last_own, 0.0::DOUBLE AS last_padded, CAST(embedding[16] AS DOUBLE) AS last_cut FROM embeddings")
def vectors_fitted(spark, sf_dir):
    """Vectors padded to 100 and cut to 16 numbers."""
    e = table(spark, sf_dir, "embeddings").withColumns({"p": text.embedding_of_size("embedding", 100), "c": text.embedding_of_size("embedding", 16)})
    at = lambda c, i: F.element_at(c, i).cast("double")
    return e.select("vec_id", F.size("p").alias("n_padded"), F.size("c").alias("n_cut"), F.get("p", F.size("embedding") - 1).cast("double").alias("last_own"), at("p", -1).alias("last_padded"), at("c", -1).alias("last_cut"))


@register("""WITH n AS (SELECT doc_id, unnest([source || '_label', lang, 'Label', '_class', CASE WHEN doc_id % 2 = 0 THEN ' Y ' ELSE 'x' || doc_id END, 'a_Target']) AS name, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i FROM documents),
s AS (SELECT *, CASE WHEN lower(trim(name)) IN ('target', 'label', 'class', 'y', 'output', 'outcome', 'result') THEN 0.95 WHEN regexp_matches(lower(trim(name)), '._(label|class|target)$') THEN 0.75 END AS c FROM n)
SELECT doc_id, string_agg(name || ':' || c, ',' ORDER BY c DESC, length(name), i) AS targets FROM s WHERE c IS NOT NULL GROUP BY doc_id""")
def target_candidates(spark, sf_dir):
    """Likely target columns by name, best first."""
    d = table(spark, sf_dir, "documents")
    names = F.array(F.concat("source", F.lit("_label")), F.col("lang"), F.lit("Label"), F.lit("_class"), F.when(F.col("doc_id") % 2 == 0, " Y ").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"))), F.lit("a_Target"))
    found = F.transform(signals.target_columns(names), lambda x: F.concat(x["column"], F.lit(":"), x["confidence"].cast("decimal(3,2)").cast("string")))
    return d.select("doc_id", F.array_join(found, ",").alias("targets"))


@register("""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: x NOT IN ('dataset', 'images', 'image', 'with', 'from', 'this', 'that', 'contains', 'collection'))[1:3], ' ') AS subject,
  upper(lang[1]) || lang[2:] || ' Set ' || doc_id AS slug_title, CASE WHEN doc_id % 2 = 0 THEN source END AS slug_owner, CASE doc_id % 4 WHEN 2 THEN 'a,binary_classification' WHEN 3 THEN 'a,classification' ELSE 'a' END AS tags FROM documents""")
def card_texts(spark, sf_dir):
    """Subject words of descriptions, titles and owners of ids, and tags by number of classes."""
    d = table(spark, sf_dir, "documents").withColumn("slug", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/"))).otherwise(""), "lang", F.lit("-set_"), F.col("doc_id").cast("string")))
    tags = signals.class_count_tags(F.array(F.lit("a")), F.col("doc_id") % 4)
    return d.select("doc_id", signals.subject_words("text").alias("subject"), text.slug_title("slug").alias("slug_title"), text.slug_owner("slug").alias("slug_owner"), F.array_join(tags, ",").alias("tags"))


@register(f"""{WITH} SELECT canonical_id, concat_ws(',', CASE WHEN usability_rating < 0.4 THEN 'low score' END, CASE WHEN NOT has_license_info THEN 'license unknown' END, CASE WHEN row_count < 1000 THEN 'small' END,
  CASE WHEN metadata_completeness < 0.5 THEN 'incomplete metadata' END) AS risks FROM catalog""")
def risk_signals(spark, sf_dir):
    return catalog(spark, sf_dir).select("canonical_id", F.array_join(derive.risk_signals("usability_rating"), ",").alias("risks"))


@register(r"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' || chr(9) || chr(10) ELSE ' ' || text || chr(10) END AS raw, conv_id % 60 AS most, conv_id % 5 / 4.0 * 1.25 AS c, conv_id % 7 * 100 AS low, CASE WHEN conv_id % 3 > 0 THEN 300 END AS high, turn / 3.0 AS v,
  CASE conv_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'detailed' WHEN 2 THEN 'all' END AS detail, conv_id % 12 AS prio, CASE WHEN conv_id % 11 = 0 THEN ['kaggle', 'other'] ELSE ['openml'] END AS s FROM conversations),
t AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS stripped FROM q)
SELECT conv_id, turn, md5(substr(stripped, 1, 500)) AS query, CAST(greatest(1, least(50, most)) AS BIGINT) AS max_results, nullif(concat_ws(',', CASE WHEN stripped = '' THEN 'empty query' END, CASE WHEN list_contains(s, 'other') THEN 'unknown sources' END,
  CASE WHEN c > 1 THEN 'completeness out of range' END, CASE WHEN low > high THEN 'more rows at least than at most' END, CASE WHEN v > 1 THEN 'diversity out of range' END, CASE WHEN detail = 'all' THEN 'unknown detail' END, CASE WHEN prio NOT BETWEEN 1 AND 10 THEN 'priority out of range' END), '') AS reject_reason FROM t""")
def request_checks(spark, sf_dir):
    """Turns of conversations as requests: texts stripped and cut, results bounded, values out of range told."""
    d = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 5 = 4 THEN concat(' ', chr(9), chr(10)) ELSE concat(' ', text, chr(10)) END AS raw_query", "conv_id % 60 AS max_results", "conv_id % 5 / 4.0 * 1.25 AS min_completeness", "conv_id % 7 * 100 AS min_rows",
        "CASE WHEN conv_id % 3 > 0 THEN 300 END AS max_rows", "turn / 3.0D AS result_diversity", "CASE conv_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'detailed' WHEN 2 THEN 'all' END AS explanation_detail", "conv_id % 12 AS priority",
        "CASE WHEN conv_id % 11 = 0 THEN array('kaggle', 'other') ELSE array('openml') END AS sources",
    )
    return derive.clamp_requests(d).select("conv_id", "turn", F.md5("raw_query").alias("query"), F.col("max_results").cast("bigint").alias("max_results"), "reject_reason")


@register(f"{WITH} SELECT canonical_id, md5(array_to_string(list_filter([title, title, title, description_short, array_to_string(tags_primary, ' ')], lambda x: x IS NOT NULL AND x <> ''), ' ')) AS indexed FROM catalog")
def index_text(spark, sf_dir):
    """The text that both indexes see: the title three times, the short description and the primary tags."""
    return catalog(spark, sf_dir).select("canonical_id", F.md5(derive.searchable_text()).alias("indexed"))


@register(f"{WITH} SELECT count(DISTINCT dataset_fingerprint) AS total FROM catalog")
def total_unique(spark, sf_dir):
    """Records that are no duplicates."""
    return analytics.total(dedup.mark(catalog(spark, sf_dir)), duplicates=False)


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", array_to_string((SELECT list(v ORDER BY k) FROM (SELECT o_orderkey AS k, CAST({c} AS VARCHAR) AS v FROM orders WHERE {c} IS NOT NULL ORDER BY k LIMIT 5)), '|') AS samples" for c in ("o_orderstatus", "o_custkey", "o_orderpriority")))
def first_samples(spark, sf_dir):
    """The first five values of three columns."""
    d = profiling.first_samples(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_custkey", "o_orderpriority"])
    return d.select("column", F.array_join("samples", "|").alias("samples"))


@register(f"{_RANKED_SQL} SELECT s.query_id, s.canonical_id, coalesce(r.rank, 0) AS rank, coalesce(r.rank <= 4, false) AS traced FROM scored s LEFT JOIN ranked r ON r.query_id = s.query_id AND r.canonical_id = s.canonical_id")
def ranks_of_all(spark, sf_dir):
    """All scored rows with their rank, 0 for those that were not returned, and whether they carry a decision trace."""
    s = scored(spark, sf_dir)
    top = ranking.traced(ranking.rank(s, 10).withColumn("rank", F.col("rank").cast("bigint")), most=4)
    d = ranking.with_ranks(s.select("query_id", "canonical_id"), top)
    told = top.select("query_id", "canonical_id", (F.col("trace").isNotNull() & (F.col("trace.rank") == F.col("rank"))).alias("traced"))
    d = d.join(told, ["query_id", "canonical_id"], "left")
    return d.select("query_id", "canonical_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("traced", F.lit(False)).alias("traced"))


@register(f"""{_RANKED_SQL}, w AS (SELECT query_id, rank, unnest([CASE WHEN NOT has_license_info THEN 'no license' END, CASE WHEN NOT has_schema_info THEN 'no schema' END, 'from ' || source]) AS t, unnest([1, 2, 3]) AS i FROM ranked),
f AS (SELECT query_id, t, min(rank * 10 + i) AS place FROM w WHERE t IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM f)
SELECT query_id, string_agg(t, '; ' ORDER BY place) AS warnings FROM n WHERE k <= 5 GROUP BY query_id""")
def warnings_in_common(spark, sf_dir):
    """Distinct warnings of each query's hits, in order of first appearance, at most five."""
    said = F.array_compact(F.array(F.when(~F.col("has_license_info"), "no license"), F.when(~F.col("has_schema_info"), "no schema"), F.concat(F.lit("from "), "source")))
    d = ranking.common_warnings(ranking.rank(scored(spark, sf_dir), 10).withColumn("warnings", said))
    return d.select("query_id", F.array_join("warnings", "; ").alias("warnings"))


@register(f"""{_RRF_SQL}, x AS (SELECT query_id, id, round(0.4 / (60.0::DOUBLE + coalesce(rt, (SELECT count(*) + 1 FROM documents))) + 0.6 / (60.0::DOUBLE + coalesce(rv, (SELECT count(*) + 1 FROM documents))), 10) AS score FROM f WHERE query_id = 1),
y AS (SELECT query_id, id, score, 'hybrid' AS mode, row_number() OVER (ORDER BY score DESC, id) AS rank FROM x UNION ALL SELECT query_id, doc, score / max(score) OVER (), 'text', rank FROM bt WHERE query_id = 2
  UNION ALL SELECT query_id, id, score, 'vector', rank FROM vt WHERE query_id = 3)
SELECT query_id, id, mode, rank, round(score, 4) AS score FROM y WHERE rank <= 10""")
def hybrid_modes(spark, sf_dir):
    """One query with hits of both kinds, one with text hits only, whose scores become shares of the best, one with vector hits only."""
    texts, vectors = _lists(spark, sf_dir)
    d = retrieval.hybrid(asked(spark), texts.filter("query_id <> 3"), vectors.filter("query_id <> 2"), 10, _n_docs(spark, sf_dir))
    return d.select("query_id", "id", "mode", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


RELAXED = [(1, "zz qx le"), (2, "zzz the"), (3, "qqqq"), (4, "xq re")]
_RELAXED_SQL = "q(query_id, query_text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in RELAXED) + ")"
_HAS = "len(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda t: length(t) >= {0} AND contains(lower(title), t))) > 0 OR len(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) >= 4 AND contains(lower(query_text), w))) > 0"


@register(f"""{WITH}, {_RELAXED_SQL}, a AS (SELECT query_id, canonical_id, row_count FROM catalog, q WHERE {_HAS.format(3)}),
b AS (SELECT query_id, canonical_id, row_count FROM catalog, q WHERE query_id NOT IN (SELECT query_id FROM a) AND ({_HAS.format(2)})), u AS (SELECT *, false AS again FROM a UNION ALL SELECT *, true FROM b)
SELECT query_id, canonical_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_count DESC NULLS LAST, canonical_id) AS rank FROM u) WHERE rank <= 15""")
def keyword_relaxed(spark, sf_dir):
    """Keyword search in which two of four queries have hits in the second, relaxed pass only."""
    q = spark.createDataFrame(RELAXED, "query_id int, query_text string")
    return retrieval.keyword_match(q, catalog(spark, sf_dir), 15).select("query_id", "canonical_id", F.col("rank").cast("bigint").alias("rank"))


@register("""WITH h AS (SELECT user_id AS query_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS variant, event_id FROM events), c AS (SELECT query_id, variant FROM h GROUP BY ALL HAVING count(*) >= 14),
f AS (SELECT query_id, min(variant) AS variant FROM c GROUP BY query_id) SELECT query_id, variant, event_id FROM h JOIN f USING (query_id, variant)""")
def first_variant_enough(spark, sf_dir):
    """Hits of each query's first variant that has at least 14: users as queries, kinds of event as variants."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END").alias("variant"), "event_id")
    return understanding.first_enough(e, 14).select("query_id", "variant", "event_id")


@register(f"{WITH} SELECT seq, canonical_id FROM catalog WHERE source = 'src1' AND data_format = 'json'")
def record_lookup(spark, sf_dir):
    """Records by exact keys."""
    return files.lookup(catalog(spark, sf_dir), source="src1", data_format="json").select("seq", "canonical_id")
