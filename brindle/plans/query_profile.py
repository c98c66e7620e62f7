"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, profiling
from .catalog_view import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    """Profile of typed columns (int, float, string, time): the text rules of string columns are spelled out."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        num = kind in ("int", "float")
        x = f"CAST({c} AS DOUBLE)" if num else f"CASE WHEN regexp_full_match(CAST({c} AS VARCHAR), '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST({c} AS DOUBLE) END"
        share = f"count(DISTINCT {c}) / count(*)"
        kind_sql = "'datetime'" if kind == "time" else f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN {share} >= 0.95 THEN 'id' ELSE 'numeric' END" if num else f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN count({x}) > 0.9 * count({c}) THEN CASE WHEN {share} >= 0.95 THEN 'id' ELSE 'numeric' END WHEN {share} >= 0.95 THEN 'id' WHEN {share} <= 0.10 THEN 'categorical' WHEN {share} <= 0.50 THEN 'text' WHEN avg(length({c})) > 50 THEN 'text' ELSE 'categorical' END"
        x = "CAST(NULL AS DOUBLE)" if kind == "time" else x
        parts.append(f"SELECT '{c}' AS \"column\", {i} AS position, {kind_sql} AS type, count(*) AS total_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage, count(DISTINCT {c}) AS unique_count, round({share}, 4) AS cardinality_ratio, avg({x}) AS mean, coalesce(stddev_samp({x}), 0) AS std, min({x}) AS min, max({x}) AS max, median({x}) AS median, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75, avg(CASE WHEN {x} = 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) * 100 AS zeros, avg(CASE WHEN {x} < 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) * 100 AS negatives FROM {name}")
    stat = lambda c, k=4, to=None: f"CASE WHEN type = 'numeric' THEN round({c}, {k}) END AS {to or c}"
    hints = "[" + ", ".join(f"'{h}'" for h in profiling.TARGET_HINTS) + "]"
    ids = ", ".join(f"'{h}'" for h in profiling.ID_NAMES)
    return f"SELECT \"column\", position, type, total_count, null_count, CAST(missing_percentage AS DOUBLE) AS missing_percentage, unique_count, cardinality_ratio, {stat('mean', 2)}, {stat('std', 2)}, {stat('min')}, {stat('max')}, {stat('median')}, {stat('q25')}, {stat('q75')}, {stat('zeros', 2, 'zeros_percentage')}, {stat('negatives', 2, 'negatives_percentage')}, len(list_filter({hints}, lambda h: contains(lower(\"column\"), h))) > 0 AS is_likely_target, type = 'id' OR lower(\"column\") IN ({ids}) AS is_likely_id FROM ({' UNION ALL '.join(parts)})"


TABLES = {
    "lineitem": {"l_orderkey": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time", "l_linenumber": "int"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "time", "o_orderpriority": "string"},
    "part": {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"},
    "customer": {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "string", "value": "float"},
    "supplier": {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "float"},
}


def _profile(name: str, columns: dict[str, str]):
    def run(spark, sf_dir):
        p = profiling.profile(table(spark, sf_dir, name), columns=list(columns))
        return p.withColumns({c: F.round(c, 2) for c in ("mean", "std")})

    return run


for _name, _columns in TABLES.items():
    QUERIES[f"profile_{_name}"] = _profile(_name, _columns)
    ORACLES[f"profile_{_name}"] = _profile_sql(_name, _columns)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _top_sql(name: str, columns: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)
    return f'SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({each})) WHERE rank <= 10'


@register(_top_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]))
def top_categories(spark, sf_dir):
    d = profiling.top_categories(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])
    return d.withColumn("rank", F.col("rank").cast("bigint"))


_BALANCE = """WITH c AS (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}), a AS (SELECT count(*) AS num_classes, sum(n)::BIGINT AS total, arg_min(CAST(v AS VARCHAR), (-n, CAST(v AS VARCHAR))) AS dominant_class, round(max(n) * 100.0 / sum(n), 2) AS dominant_percentage, round(min(n) * 100.0 / sum(n), 2) AS minority_percentage, round(min(n) * 100.0 / max(n), 2) AS raw FROM c)
SELECT num_classes, total, dominant_class, dominant_percentage, minority_percentage, CASE WHEN num_classes <= 1 THEN 0 ELSE raw END AS score, CASE WHEN num_classes <= 1 THEN true ELSE raw < 30 END AS is_imbalanced, num_classes < 5 AS few_classes FROM a"""


@register(_BALANCE.format(c="event_type", t="events"))
def class_balance_events(spark, sf_dir):
    return profiling.class_balance(table(spark, sf_dir, "events"), "event_type")


@register(_BALANCE.format(c="label", t="embeddings"))
def class_balance_embeddings(spark, sf_dir):
    return profiling.class_balance(table(spark, sf_dir, "embeddings"))


@register(_BALANCE.format(c="quality", t="labels"))
def class_balance_labels(spark, sf_dir):
    return profiling.class_balance(table(spark, sf_dir, "labels"), "quality")


@register("WITH g AS (SELECT count(*) AS n FROM (SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem) GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount) SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_percentage, round(sum(n - 1) * 100.0 / sum(n), 2) >= 5 AS warning, round(100.0 - round(sum(n - 1) * 100.0 / sum(n), 2), 2) AS uniqueness_score FROM g")
def dup_rows(spark, sf_dir):
    return dedup.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@register("WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY h), a AS (SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_percentage FROM g) SELECT *, CASE WHEN duplicate_percentage >= 10 THEN 'high' WHEN duplicate_percentage >= 3 THEN 'some' ELSE 'none' END AS level FROM a")
def dup_hashes(spark, sf_dir):
    return dedup.duplicate_hashes(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash")))


_P = _profile_sql("orders", TABLES["orders"])


MANY = ("orders", "part", "customer", "supplier", "events")


@register(" UNION ALL ".join(f"SELECT '{t}' AS dataset, * FROM ({_profile_sql(t, TABLES[t])})" for t in MANY))
def profile_many(spark, sf_dir):
    """Five tables profiled in one grouping over all their values."""
    p = profiling.profile_many({t: table(spark, sf_dir, t).select(*TABLES[t]) for t in MANY})
    return p.withColumns({c: F.round(c, 2) for c in ("mean", "std")})


@register(f"WITH p AS ({_P}) SELECT count(*) AS total_columns, count(*) FILTER (type = 'numeric') AS numeric_columns, count(*) FILTER (type = 'categorical') AS categorical_columns, count(*) FILTER (type = 'text') AS text_columns, count(*) FILTER (type = 'datetime') AS datetime_columns, count(*) FILTER (type = 'id') AS id_columns, count(*) FILTER (type = 'boolean') AS boolean_columns, round(avg(missing_percentage), 2) AS overall_missing, round(100 - avg(missing_percentage), 2) AS completeness_score FROM p")
def table_rollup(spark, sf_dir):
    return profiling.table_rollup(profiling.profile(table(spark, sf_dir, "orders"), columns=list(TABLES["orders"])))


@register(f"WITH p AS ({_P}) SELECT \"column\", missing_percentage > 5 AS missing, cardinality_ratio > 0.95 OR type = 'id' AS low_information, unique_count <= 1 AS constant FROM p WHERE missing_percentage > 5 OR cardinality_ratio > 0.95 OR type = 'id' OR unique_count <= 1")
def column_flags(spark, sf_dir):
    return profiling.column_flags(profiling.profile(table(spark, sf_dir, "orders"), columns=list(TABLES["orders"])))


_L = "labels_full AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality END AS quality, toxic FROM labels)"


@register(f"WITH {_L}, f AS (SELECT 0 AS g, 'Column ''quality'' has ' || count(*) FILTER (quality IS NULL) || ' null values' AS fix FROM labels_full HAVING count(*) FILTER (quality IS NULL) * 100.0 / count(*) > 20 UNION ALL SELECT 1, 'Class imbalance: ''0'' dominates' FROM (SELECT toxic, count(*) AS n FROM labels_full GROUP BY toxic) HAVING min(n) * 100.0 / max(n) < 30) SELECT row_number() OVER (ORDER BY g) AS place, fix FROM f")
def suggested_fixes(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("quality")).alias("quality"), "toxic")
    return profiling.fixes(profiling.profile(d), profiling.class_balance(d, "toxic"), dedup.duplicate_rows(d)).withColumn("place", F.col("place").cast("bigint"))


@register("WITH c AS (SELECT lang, source AS class, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, class, n, round(n * 100.0 / sum(n) OVER w, 2) AS share, n * 10 < sum(n) OVER w AND count(*) OVER w > 2 AS low FROM c WINDOW w AS (PARTITION BY lang)")
def class_shares(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("class")).agg(F.count("*").alias("n"))
    return profiling.class_shares(c, ["lang"])


@register("WITH c AS (SELECT lang, source AS class, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, sum(n)::BIGINT AS total, arg_min(class, (-n, class)) AS largest, arg_min(class, (n, class)) AS smallest, count(*) AS n_classes FROM c GROUP BY lang")
def class_summary(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("class")).agg(F.count("*").alias("n"))
    return profiling.class_summary(c, ["lang"])


@register("WITH p AS (SELECT split_part(substr(url, strpos(url, '://') + 3), '/', 2) AS class, count(*) AS n FROM pages GROUP BY ALL) SELECT class, n FROM p ORDER BY n DESC, class LIMIT 50")
def url_classes(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select(F.expr("concat_ws('/', 'train', split_part(substring(url, instr(url, '://') + 3), '/', 2), 'x')").alias("path"))
    return profiling.class_counts(d)


@register()
def sampled_lineitem(spark, sf_dir):
    """Twenty rows of each return flag by hash: a sampling operator, with Spark's own hash, so rows only."""
    d = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return profiling.sample_per_class(d, "l_returnflag", "key", 20).select("l_returnflag", "key")


@register()
def profile_approx(spark, sf_dir):
    """Sketch profile of lineitem: approximate counts and percentiles have no exact twin, so rows only."""
    return profiling.profile(table(spark, sf_dir, "lineitem"), mode="approx")
