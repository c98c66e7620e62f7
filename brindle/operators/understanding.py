"""Query understanding over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, vocab
from ..functions.rules import literal_map
from ..functions.text import plain_ascii, stripped

MOST_CHARS = 500
TASK_FLOOR, MODALITY_FLOOR, FULL = 0.40, 0.35, 1.5


def signals(table: list[tuple[str, str, float]]) -> list[tuple[int, str, str, float]]:
    """(order, token, label, weight) of a rule table."""
    return [(i, *row) for i, row in enumerate(table)]


def cleaned(raw: Column, fold_accents: bool = True) -> Column:
    """Cut, without accents, lower case, without URLs and signs."""
    t = F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, MOST_CHARS)
    t = F.lower(plain_ascii(t) if fold_accents else t)
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s_]", " "), r"\s+", " "))


def grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by underscores (C4)."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), "_"))


def understand(queries: DataFrame, raw: str = "raw_query", fold_accents: bool = True) -> DataFrame:
    """Queries with cleaned_text, tokens, keywords, normalized, bigrams and trigrams."""
    replace = literal_map(vocab.QUERY_SYNONYMS)
    stop = vocab.STOP_WORDS
    q = queries.withColumn("cleaned_text", cleaned(F.col(raw), fold_accents))
    q = q.withColumn("tokens", F.filter(F.split("cleaned_text", r"\s+"), lambda t: F.length(t) >= 2))
    q = q.withColumn("keywords", F.filter("tokens", lambda t: ~t.isin(stop)))
    q = q.withColumn("normalized", F.array_distinct(F.transform("keywords", lambda t: F.coalesce(replace[t], t))))
    return q.withColumns({"bigrams": grams(F.col("normalized"), 2), "trigrams": grams(F.col("normalized"), 3)})


def detect(understood: DataFrame, table: list[tuple[str, str, float]], floor: float, name: str, unknown: str = "unknown") -> DataFrame:
    """(query_id, name, name_confidence): the label with the most weight of fired rules.

    Words and runs of words are exploded and joined to the broadcast rule table (some hundred rows).
    """
    spark = understood.sparkSession
    known = F.broadcast(spark.createDataFrame(signals(table), "o int, token string, label string, weight double"))
    said = understood.select("query_id", F.explode(F.array_distinct(F.concat("normalized", "bigrams", "trigrams"))).alias("token"))
    per = said.join(known, "token").groupBy("query_id", "label").agg(F.round(F.sum("weight"), 6).alias("w"), F.min("o").alias("o"))
    best = per.groupBy("query_id").agg(F.max(F.struct("w", (-F.col("o")).alias("o"), "label")).alias("b"))
    share = F.round(F.least(F.col("b.w") / FULL, F.lit(1.0)), 3)
    best = best.select("query_id", F.when(share >= floor, F.col("b.label")).otherwise(unknown).alias(name), share.alias(f"{name}_confidence"))
    return understood.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(name, F.lit(unknown)).alias(name), F.coalesce(f"{name}_confidence", F.lit(0.0)).alias(f"{name}_confidence"))


def detect_tasks(understood: DataFrame) -> DataFrame:
    return detect(understood, vocab.TASK_SIGNALS, TASK_FLOOR, "task")


def detect_modalities(understood: DataFrame) -> DataFrame:
    return detect(understood, vocab.MODALITY_SIGNALS, MODALITY_FLOOR, "modality")


def confidence_bucket(c: Column) -> Column:
    """Level of a confidence."""
    return F.when(c >= 0.75, "high").when(c >= 0.50, "medium").when(c >= 0.30, "low").otherwise("very_low")


def phrases() -> list[tuple[int, str, list[str]]]:
    """Expansion phrases, longest first."""
    ordered = sorted(vocab.EXPANSIONS.items(), key=lambda x: -len(x[0]))
    return [(i, p, terms) for i, (p, terms) in enumerate(ordered)]


def expand(queries: DataFrame, text_col: str = "cleaned_text", each: int = 4, most: int = 8) -> DataFrame:
    """Queries with domains, expansion_terms and expanded_query (C11).

    Phrases are looked for from the longest on; one within a phrase already found is skipped; each adds up to four
    terms that aren't in the query or added before. What was added decides what comes next, so this is a fold.
    """
    low = F.lower(F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.array(*[F.lit(t) for t in ts]).alias("ts")) for _, p, ts in phrases()])
    zero = F.struct(F.array().cast("array<string>").alias("found"), F.array().cast("array<string>").alias("terms"))

    def fold(x: Column) -> Column:
        words = F.split(x, r"\s+")
        hits = F.filter(table, lambda r: F.contains(x, r["p"]))

        def step(s: Column, r: Column) -> Column:
            new = F.slice(F.filter(r["ts"], lambda t: ~F.array_contains(words, t) & ~F.array_contains(s["terms"], t)), 1, each)
            inside = F.exists(s["found"], lambda f: F.contains(f, r["p"]) & (f != r["p"]))
            return F.when(inside, s).otherwise(F.struct(F.array_append(s["found"], r["p"]).alias("found"), F.concat(s["terms"], new).alias("terms")))

        return F.aggregate(hits, zero, step)

    q = queries.withColumn("__e", F.get(F.transform(F.array(low), fold), 0))
    return q.withColumns({"domains": F.col("__e.found"), "expansion_terms": F.col("__e.terms"), "expanded_query": F.concat_ws(" ", F.trim(F.col(text_col)), F.when(F.size("__e.terms") > 0, F.array_join(F.slice(F.col("__e.terms"), 1, most), " ")))}).drop("__e")


def provider_weights(text: Column) -> Column:
    """struct<huggingface, kaggle, openml>: boosts by maximum and penalties by minimum, in rule order."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(w) for w in ws]).alias("w")) for k, *ws in vocab.PROVIDER_WEIGHTS])
    low = F.lower(F.coalesce(text, F.lit("")))
    step = lambda s, r: F.zip_with(s, r["w"], lambda a, b: F.when(b > 1.0, F.greatest(a, b)).otherwise(F.least(a, b)))
    w = F.aggregate(F.filter(table, lambda r: F.contains(low, r["k"])), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), step)
    return F.struct(w[0].alias("huggingface"), w[1].alias("kaggle"), w[2].alias("openml"))


def short_queries(understood: DataFrame) -> DataFrame:
    """(query_id, variant, query_text): one to three short queries of the keywords."""
    k = F.col("keywords")
    n = F.size(k)
    parts = F.array(F.array_join(F.slice(k, 1, 3), " "), F.when(n > 3, F.array_join(F.slice(k, 3, 3), " ")), F.when(n > 3, F.concat_ws(" ", F.get(k, 0), F.array_join(F.slice(k, n - 1, F.lit(2)), " "))))
    parts = F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != "")))
    return understood.select("query_id", F.posexplode(parts).alias("variant", "query_text"))


def variants(understood: DataFrame) -> DataFrame:
    """(query_id, variant, query_text): the query and its broader forms, tried in turn until one has hits (C14)."""
    k, t = F.col("keywords"), F.col("tokens")
    long = F.filter(t, lambda w: F.length(w) <= 10)
    forms = F.array(F.col("cleaned_text"), F.array_join(F.slice(k, 1, 4), " "), F.array_join(F.slice(long, 1, 3), " "), F.array_join(F.slice(t, 1, 2), " "))
    return understood.select("query_id", F.posexplode(forms).alias("variant", "query_text")).filter("query_text <> ''")


def first_enough(hits: DataFrame, least: int = 1) -> DataFrame:
    """Hits of each query's lowest variant that has at least ``least`` of them (C14)."""
    per = hits.groupBy("query_id", "variant").count().filter(F.col("count") >= least).groupBy("query_id").agg(F.min("variant").alias("variant"))
    return hits.join(per, ["query_id", "variant"], "left_semi")


def word_list(x: Column) -> Column:
    """Words of a text that is stripped, none for an empty one."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"\s+"))


def follow_ups(queries: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("ts",), raw: str = "raw_query") -> DataFrame:
    """Queries with previous_query and merged_query.

    A query that is a refinement phrase or has at most three words is put behind the one before it with a dash, one of
    four or five words with a space; others stand alone, as do empty queries and those behind an empty one.
    """
    d = queries.withColumn("previous_query", F.lag(raw).over(Window.partitionBy(session).orderBy(*order)))
    now, before = stripped(raw), stripped("previous_query")
    n = F.size(word_list(now))
    refines = F.lower(now).isin(*vocab.REFINEMENTS) | (n <= 3)
    joined = F.when(refines, F.concat(before, F.lit(" \u2014 "), now)).when(n < 6, F.concat(before, F.lit(" "), now)).otherwise(now)
    return d.withColumn("merged_query", F.when((now == "") | (before == ""), now).otherwise(joined))


def no_result_help(queries: DataFrame, hits: DataFrame, raw: str = "raw_query", sources: str = "Kaggle, HuggingFace, and OpenML") -> DataFrame:
    """(query_id, core_terms, hint, message) for queries without hits.

    Core terms are the first three words of over three characters, or else the query; the hint is the first task
    that has a stem in the query.
    """
    none = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    q = F.coalesce(F.col(raw), F.lit(""))
    long = F.slice(F.filter(word_list(stripped(F.lower(q))), lambda w: F.length(w) > 3), 1, 3)
    hint = F.coalesce(*[F.when(F.lower(q).rlike("|".join(stems)), task) for task, stems in vocab.TASK_STEMS.items()], F.lit("classification"))
    d = none.select("query_id", q.alias("q"), F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(q).alias("core_terms"), hint.alias("hint"))
    return d.select("query_id", "core_terms", "hint", F.format_string("No datasets were found for '%s' across %s. Try '%s data' or the task type '%s'.", "q", F.lit(sources), "core_terms", "hint").alias("message"))


def suggestions(expanded: DataFrame) -> DataFrame:
    """(query_id, suggestions): a benchmark of the first three keywords, then the first two domains' datasets (C17)."""
    first = F.when(F.size("keywords") > 0, F.array(F.concat(F.array_join(F.slice("keywords", 1, 3), " "), F.lit(" benchmark")))).otherwise(F.array().cast("array<string>"))
    return expanded.select("query_id", F.concat(first, F.transform(F.slice("domains", 1, 2), lambda d: F.concat(d, F.lit(" dataset")))).alias("suggestions"))


def research_suggestions(queries: DataFrame, raw: str = "raw_query") -> DataFrame:
    """(query_id, suggestions): up to four next searches built of a query's words of over three characters (C17)."""
    q = F.coalesce(F.col(raw), F.lit(""))
    w = F.filter(word_list(stripped(F.lower(q))), lambda x: F.length(x) > 3)
    parts = F.array(F.when(F.size(w) > 0, F.concat(q, F.lit(" benchmark"))), F.concat(F.get(w, F.lit(0)), F.lit(" labeled dataset")), F.when(F.size(w) > 1, F.concat(F.element_at(F.when(F.size(w) > 0, w), -1), F.lit(" annotations"))), F.concat(q, F.lit(" evaluation")))
    return queries.select("query_id", F.array_compact(parts).alias("suggestions"))


def compatibility_table(spark: SparkSession) -> DataFrame:
    """(task, modality, score) of all pairs above 0, to broadcast."""
    return spark.createDataFrame(rules.serve_table(), "task string, modality string, score double")
