"""Queries that normalise text and understand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, signals, text, vocab
from ..operators import understanding
from .catalog_view import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_sql(x: str, members: list[str], table_: list[tuple[str, str]], default: str) -> str:
    tried = " ".join(f"WHEN contains({x}, {_q(k)}) THEN {_q(v)}" for k, v in table_)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {_q(default)} WHEN {x} IN ({', '.join(map(_q, members))}) THEN {x} {tried} ELSE {_q(default)} END"


#: Words to normalise: names and types that the tables hold, with endings that rules look for.
_VALUES_SQL = "SELECT DISTINCT v FROM (SELECT event_type AS v FROM events UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_type || ' image csv' FROM part UNION ALL SELECT p_name || '-nlp' FROM part UNION ALL SELECT p_brand || ' cc-by-sa table' FROM part UNION ALL SELECT lang || ' text-classification' FROM documents)"


def _values(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    parts = [t("events").select(F.col("event_type").alias("v")), t("customer").select("c_mktsegment"), t("part").select(F.concat("p_type", F.lit(" image csv"))), t("part").select(F.concat("p_name", F.lit("-nlp"))), t("part").select(F.concat("p_brand", F.lit(" cc-by-sa table"))), t("documents").select(F.concat("lang", F.lit(" text-classification")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


_PLAIN, _UNDER, _SPACE = "lower(trim(v))", "replace(replace(lower(trim(v)), ' ', '_'), '-', '_')", "replace(lower(trim(v)), ' ', '_')"


@register(f"""SELECT v, {_rules_sql(_SPACE, rules.DOMAINS, vocab.DOMAIN_RULES, 'other')} AS domain, {_rules_sql(_PLAIN, rules.FORMATS, vocab.FORMAT_RULES, 'other')} AS format, {_rules_sql(_PLAIN, rules.LICENSES, vocab.LICENSE_RULES, 'unknown')} AS license,
{_rules_sql(_UNDER, rules.TASKS, vocab.TASK_RULES, 'other')} AS task, {_rules_sql(_UNDER, rules.MODALITIES, vocab.MODALITY_RULES, 'other')} AS modality, {_rules_sql(_UNDER, [*rules.MODALITIES, 'unknown'], vocab.QUERY_MODALITY_RULES, 'unknown')} AS query_modality FROM ({_VALUES_SQL})""")
def normalize_values(spark, sf_dir):
    return _values(spark, sf_dir).select("v", rules.domain("v").alias("domain"), rules.data_format("v").alias("format"), rules.license_type("v").alias("license"), rules.task_type("v").alias("task"), rules.modality("v").alias("modality"), rules.query_modality("v").alias("query_modality"))


@register(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'), '(?i)(password|api_key|apikey|secret|token|auth|bearer)[\s:=''"]+\S+', '[CREDENTIAL_REDACTED]', 'g'),
'\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b', '[CARD_REDACTED]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN_REDACTED]', 'g')) AS redacted FROM documents""")
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact("text")).alias("redacted"))


def _hits_sql(x: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({x}, {_q(p)})::INT" for p in patterns)


def _modality_sql() -> str:
    cols = []
    for kind in signals.KINDS:
        score = "0.0::DOUBLE"
        if kind in signals.PATTERN_POINTS:
            each, most = signals.PATTERN_POINTS[kind]
            score = f"least(({_hits_sql('t', getattr(vocab, 'TITLE_' + kind.upper()))}) * {each}::DOUBLE, {min(most, 0.25)}) + least(({_hits_sql('d', getattr(vocab, 'DESC_' + kind.upper()))}) * {each}::DOUBLE, {min(most, 0.25)})"
        cols.append(f"round({score}, 6) AS s_{kind}")
    best = "greatest(s_image, s_tabular, s_text, s_audio, s_video)"
    name = "CASE " + " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in signals.KINDS) + " END"
    return f"WITH x AS (SELECT doc_id, lower(lang || ' news images ' || source) AS t, lower(text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'rows and columns of a csv' WHEN 1 THEN 'audio recordings of speech' WHEN 2 THEN 'sentences, words and documents' ELSE 'x-ray scans' END) AS d FROM documents), s AS (SELECT doc_id, {', '.join(cols)} FROM x) SELECT doc_id, CASE WHEN {best} < 0.2 THEN 'other' ELSE {name} END AS modality FROM s"


@register(_modality_sql())
def modality_detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 4 == 0, "rows and columns of a csv").when(F.col("doc_id") % 4 == 1, "audio recordings of speech").when(F.col("doc_id") % 4 == 2, "sentences, words and documents").otherwise("x-ray scans"))
    m = signals.detect_modality(F.array().cast("array<string>"), F.concat_ws(" ", "lang", F.lit("news images"), "source"), said)
    return d.select("doc_id", m["modality"].alias("modality"))


def _region_sql() -> str:
    hits = [f"CASE WHEN contains({f}, {_q(w)}) THEN {_q(r)} END" for r, ws in vocab.REGIONS.items() for f in ("d", "t") for w in ws]
    return f"WITH x AS (SELECT conv_id, turn, lower(text) AS d, lower(role || ' naro ' || CASE WHEN conv_id % 5 = 0 THEN 'kenya' ELSE '' END) AS t FROM conversations), h AS (SELECT conv_id, turn, list_filter([{', '.join(hits)}], lambda r: r IS NOT NULL) AS h FROM x) SELECT conv_id, turn, len(h) AS hits, len(list_distinct(h)) AS regions, round(CASE WHEN len(h) = 0 THEN 0.0 ELSE least(1.0, 0.3 + len(h) * 0.1) END, 4) AS confidence, len(list_distinct(h)) = 1 AS single_region FROM h"


@register(_region_sql())
def geo_bias(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("t", F.concat("role", F.lit(" naro "), F.when(F.col("conv_id") % 5 == 0, "kenya").otherwise("")))
    d = d.withColumn("b", signals.region_bias({"description": "text", "title": "t"}))
    return d.select("conv_id", "turn", F.size("b.evidence").cast("bigint").alias("hits"), F.size("b.regions").cast("bigint").alias("regions"), F.round("b.confidence", 4).alias("confidence"), "b.single_region")


@register(r"""WITH x AS (SELECT o_orderkey, 'about ' || o_custkey * 7 || ' images in ' || o_orderkey % 2000 || ' classes' AS d FROM orders), c AS (SELECT *, TRY_CAST(regexp_extract(d, '(?i)(\d[\d,]+)\s*(?:images?|photos?|samples?|pictures?|files?)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(d, '(?i)(?:over|around|about|~)\s*(\d[\d,]+)', 1) AS DOUBLE) AS b, TRY_CAST(regexp_extract(d, '(?i)(\d+)\s*(?:different\s+)?(?:classes?|categories?)', 1) AS DOUBLE) AS k FROM x)
SELECT o_orderkey, CAST(CASE WHEN a BETWEEN 50 AND 10000000 THEN a WHEN b BETWEEN 50 AND 10000000 THEN b END AS BIGINT) AS total_images, CAST(CASE WHEN k BETWEEN 2 AND 1000 THEN k END AS BIGINT) AS num_classes FROM c""")
def count_extract(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("about "), F.col("o_custkey") * 7, F.lit(" images in "), F.col("o_orderkey") % 2000, F.lit(" classes")).alias("d"))
    return d.withColumn("c", signals.described_counts(F.lit(""), "d")).select("o_orderkey", "c.total_images", "c.num_classes")


#: Sentences of users' turns as queries of one session each.
@register(f"""WITH a AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]+') AS a FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, unnest(a) AS raw_query, generate_subscripts(a, 1) - 1 AS i FROM a),
l AS (SELECT *, lag(raw_query) OVER (PARTITION BY conv_id ORDER BY turn, i) AS previous_query FROM s), t AS (SELECT *, regexp_replace(raw_query, '^\\s+|\\s+$', '', 'g') AS now, regexp_replace(coalesce(previous_query, ''), '^\\s+|\\s+$', '', 'g') AS before FROM l),
n AS (SELECT *, len(regexp_split_to_array(now, '\\s+')) AS n FROM t)
SELECT conv_id, turn, i::INT AS i, previous_query, CASE WHEN now = '' OR before = '' THEN now WHEN n <= 3 OR lower(now) IN ({', '.join(map(_q, vocab.REFINEMENTS))}) THEN before || ' ' || chr(8212) || ' ' || now WHEN n < 6 THEN before || ' ' || now ELSE now END AS merged_query FROM n""")
def session_followups(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").filter("role = 'user'")
    u = u.select("conv_id", "turn", F.posexplode(F.split("text", "[.\n]+")).alias("i", "raw_query"))
    return understanding.follow_ups(u, "conv_id", ("turn", "i")).select("conv_id", "turn", "i", "previous_query", "merged_query")


_STOP = "(" + ", ".join(_q(w) for w in vocab.STOP_WORDS) + ")"
_SYN = "map_from_entries([" + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in vocab.QUERY_SYNONYMS.items()) + "])"
#: Turns as queries: each gets words that rules know, chosen by its numbers.
_TAILS = ["house price prediction", "crop disease image detection", "hindi speech recognition", "sentiment of reviews", "the forecast of stock", "tabular fraud table"]
_TURNS_SQL = f"""turns AS (SELECT conv_id * 1000 + turn AS query_id, [{', '.join(map(_q, _TAILS))}][CAST((conv_id + turn) % 6 AS INT) + 1] || ' ' || regexp_replace(lower(trim(text)), '[^ -~]', '', 'g') AS raw_query FROM conversations),
cl AS (SELECT query_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(substr(trim(raw_query), 1, 500)), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z0-9\\s_]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned_text FROM turns),
tk AS (SELECT *, list_filter(string_split(cleaned_text, ' '), lambda t: length(t) >= 2) AS tokens FROM cl), kw AS (SELECT *, list_filter(tokens, lambda t: t NOT IN {_STOP}) AS keywords FROM tk),
nk AS (SELECT *, list_transform(keywords, lambda t: coalesce({_SYN}[t], t)) AS n0 FROM kw), nd AS (SELECT * EXCLUDE n0, list_filter(n0, lambda x, i: list_position(n0, x) = i) AS normalized FROM nk),
ng AS (SELECT *, list_transform(range(1, len(normalized)), lambda i: normalized[i] || '_' || normalized[i + 1]) AS bigrams, list_transform(range(1, greatest(len(normalized) - 1, 1)), lambda i: normalized[i] || '_' || normalized[i + 1] || '_' || normalized[i + 2]) AS trigrams FROM nd)"""


def _turns(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    t = F.regexp_replace(F.lower(F.trim("text")), "[^ -~]", "")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat_ws(" ", tail, t).alias("raw_query"))


@register(f"WITH {_TURNS_SQL} SELECT query_id, cleaned_text, array_to_string(keywords, ' ') AS keywords, array_to_string(normalized, ' ') AS normalized, array_to_string(bigrams, ' ') AS bigrams, array_to_string(trigrams, ' ') AS trigrams FROM ng")
def query_clean(spark, sf_dir):
    u = understanding.understand(_turns(spark, sf_dir))
    return u.select("query_id", "cleaned_text", *[F.array_join(c, " ").alias(c) for c in ("keywords", "normalized", "bigrams", "trigrams")])


def _detect_sql(table_: list[tuple[str, str, float]], floor: float, name: str) -> str:
    rows = ", ".join(f"({i}, {_q(k)}, {_q(v)}, {w}::DOUBLE)" for i, k, v, w in understanding.signals(table_))
    return f"""WITH {_TURNS_SQL}, rules(o, token, label, weight) AS (VALUES {rows}), said AS (SELECT DISTINCT query_id, unnest(list_concat(normalized, bigrams, trigrams)) AS token FROM ng),
per AS (SELECT query_id, label, round(sum(weight), 6) AS w, min(o) AS o FROM said JOIN rules USING (token) GROUP BY ALL), best AS (SELECT query_id, arg_min(label, (-w, o)) AS label, round(least(max(w) / 1.5, 1.0), 3) AS share FROM per GROUP BY query_id)
SELECT ng.query_id, CASE WHEN share >= {floor} THEN label ELSE 'unknown' END AS {name}, coalesce(share, 0) AS {name}_confidence, CASE WHEN coalesce(share, 0) >= 0.75 THEN 'high' WHEN coalesce(share, 0) >= 0.5 THEN 'medium' WHEN coalesce(share, 0) >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM ng LEFT JOIN best ON best.query_id = ng.query_id"""


@register(_detect_sql(vocab.TASK_SIGNALS, 0.4, "task"))
def task_detect(spark, sf_dir):
    d = understanding.detect_tasks(understanding.understand(_turns(spark, sf_dir)))
    return d.withColumn("level", understanding.confidence_bucket(F.col("task_confidence")))


@register(_detect_sql(vocab.MODALITY_SIGNALS, 0.35, "modality"))
def modality_of_queries(spark, sf_dir):
    d = understanding.detect_modalities(understanding.understand(_turns(spark, sf_dir)))
    return d.withColumn("level", understanding.confidence_bucket(F.col("modality_confidence")))


def _weights_sql() -> str:
    table_ = "[" + ", ".join(f"{{'k': {_q(k)}, 'w': [{', '.join(f'{w}::DOUBLE' for w in ws)}]}}" for k, *ws in vocab.PROVIDER_WEIGHTS) + "]"
    fold = lambda i: f"list_reduce(list_transform(h, lambda r: r.w[{i}]), lambda a, b: CASE WHEN b > 1.0 THEN greatest(a, b) ELSE least(a, b) END, 1.0::DOUBLE)"
    return f"WITH {_TURNS_SQL}, hits AS (SELECT query_id, list_filter({table_}, lambda r: contains(cleaned_text, r.k)) AS h FROM ng) SELECT query_id, {fold(1)} AS huggingface, {fold(2)} AS kaggle, {fold(3)} AS openml FROM hits"


@register(_weights_sql())
def provider_weights(spark, sf_dir):
    u = understanding.understand(_turns(spark, sf_dir))
    return u.withColumn("w", understanding.provider_weights(F.col("cleaned_text"))).select("query_id", "w.huggingface", "w.kaggle", "w.openml")


_HINT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw_query), {_q('|'.join(stems))}) THEN {_q(task)}" for task, stems in vocab.TASK_STEMS.items()) + " ELSE 'classification' END"


@register(f"""WITH {_TURNS_SQL}, held AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\\s]+')) AS w FROM documents), none AS (SELECT *, list_filter(string_split(trim(regexp_replace(raw_query, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3)[1:3] AS long FROM turns WHERE regexp_split_to_array(raw_query, '\\s+')[-1] NOT IN (SELECT w FROM held)),
c AS (SELECT query_id, raw_query, CASE WHEN len(long) > 0 THEN array_to_string(long, ' ') ELSE raw_query END AS core_terms, {_HINT_SQL} AS hint FROM none)
SELECT query_id, core_terms, hint, md5('No datasets were found for ''' || raw_query || ''' across Kaggle, HuggingFace, and OpenML. Try ''' || core_terms || ' data'' or the task type ''' || hint || '''.') AS message FROM c""")
def no_result_help(spark, sf_dir):
    """Turns whose last word no document holds."""
    q = _turns(spark, sf_dir)
    held = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).distinct()
    hits = q.withColumn("w", F.element_at(F.split("raw_query", r"\s+"), -1)).join(held, "w", "left_semi")
    return understanding.no_result_help(q, hits).withColumn("message", F.md5("message"))


@register(f"""WITH {_TURNS_SQL}, w AS (SELECT query_id, raw_query AS q, list_filter(regexp_split_to_array(raw_query, '\\s+'), lambda w: length(w) > 3) AS w FROM turns)
SELECT query_id, md5(array_to_string(list_filter([CASE WHEN len(w) > 0 THEN q || ' benchmark' END, CASE WHEN len(w) > 0 THEN w[1] || ' labeled dataset' END, CASE WHEN len(w) > 1 THEN w[-1] || ' annotations' END, q || ' evaluation'], lambda x: x IS NOT NULL), ';')) AS suggestions FROM w""")
def research_suggestions(spark, sf_dir):
    return understanding.research_suggestions(_turns(spark, sf_dir)).withColumn("suggestions", F.md5(F.array_join("suggestions", ";")))


@register()
def enrich_terms(spark, sf_dir):
    """Expansion is a fold whose state decides what comes next; tests hold it against a plain loop, so rows only."""
    u = understanding.expand(understanding.understand(_turns(spark, sf_dir)))
    u = u.join(understanding.suggestions(u), "query_id")
    return u.select("query_id", F.array_join("suggestions", ",").alias("suggestions"), F.array_join("domains", ",").alias("domains"), F.array_join("expansion_terms", ",").alias("terms"), "expanded_query")


@register(f"""WITH {_TURNS_SQL}, p AS (SELECT query_id, [array_to_string(keywords[1:3], ' '), CASE WHEN len(keywords) > 3 THEN array_to_string(keywords[3:5], ' ') END, CASE WHEN len(keywords) > 3 THEN keywords[1] || ' ' || array_to_string(keywords[-2:], ' ') END] AS p FROM ng), f AS (SELECT query_id, list_filter(p, lambda x: x IS NOT NULL AND x <> '') AS p FROM p), d AS (SELECT query_id, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM f)
SELECT query_id, unnest(range(0, len(p)))::INT AS variant, unnest(p) AS query_text FROM d""")
def short_queries(spark, sf_dir):
    return understanding.short_queries(understanding.understand(_turns(spark, sf_dir)))


@register(f"""WITH {_TURNS_SQL}, v AS (SELECT query_id, [cleaned_text, array_to_string(keywords[1:4], ' '), array_to_string(list_filter(tokens, lambda w: length(w) <= 10)[1:3], ' '), array_to_string(tokens[1:2], ' ')] AS p FROM ng), x AS (SELECT query_id, unnest(range(0, 4))::INT AS variant, unnest(p) AS query_text FROM v) SELECT * FROM x WHERE query_text <> ''""")
def query_variants(spark, sf_dir):
    return understanding.variants(understanding.understand(_turns(spark, sf_dir)))


_PAIRS = ", ".join(f"({_q(t)}, {_q(m)}, {s}::DOUBLE)" for t, m, s in rules.serve_table())
_KINDS = ["text_classification", "image_captioning", "classification", "regression", "speech_recognition", "clustering", "other"]


@register(f"""WITH s(task, modality, score) AS (VALUES {_PAIRS}), x AS (SELECT event_id, [{', '.join(map(_q, _KINDS))}][CAST(event_id % 7 AS INT) + 1] AS task, CASE event_id % 4 WHEN 0 THEN ['text'] WHEN 1 THEN ['image', 'text'] WHEN 2 THEN ['tabular'] ELSE ['time_series', 'audio'] END AS m FROM events),
n(task, needs) AS (VALUES ('text_classification', ['text']), ('image_captioning', ['image', 'text']), ('classification', ['tabular']), ('regression', ['tabular']), ('speech_recognition', ['audio']), ('clustering', ['tabular']), ('other', CAST([] AS VARCHAR[])))
SELECT event_id, x.task, CASE WHEN len(needs) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(needs, m)) / len(needs), 3) END AS needs_met, coalesce((SELECT max(score) FROM s WHERE s.task = x.task AND list_contains(x.m, s.modality)), 0) AS serves FROM x JOIN n ON n.task = x.task""")
def task_compatibility(spark, sf_dir):
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (e % 7 + 1).cast("int")).alias("task"), F.expr("CASE event_id % 4 WHEN 0 THEN array('text') WHEN 1 THEN array('image', 'text') WHEN 2 THEN array('tabular') ELSE array('time_series', 'audio') END").alias("m"))
    return d.select("event_id", "task", rules.needs_met("task", "m").alias("needs_met"), rules.serves("task", "m").alias("serves"))


@register("SELECT p_partkey, CASE p_name WHEN '' THEN '' ELSE p_name END AS p_name, TRY_CAST(replace(p_retailprice::VARCHAR, ',', '') AS DOUBLE) AS price, CAST(trunc(p_retailprice) AS BIGINT) AS whole FROM part")
def parsed_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", text.to_double(F.col("p_retailprice").cast("string")).alias("price"), text.to_long(F.col("p_retailprice").cast("string")).alias("whole"))
