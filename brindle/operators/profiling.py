"""Profiles of any table: columns, classes, duplicates, scores and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import ranged, small, staged

#: Names that hint at a target or an id, and thresholds of semantic types.
TARGET_HINTS = "target label labels class classes y output result outcome response dependent survived churn fraud diagnosis disease price salary score rating".split()
ID_NAMES = "id idx index uuid guid key user_id item_id product_id customer_id".split()
CLASS_NAMES = "target label labels class y output survived churn fraud diagnosis".split()
ID_SHARE, FEW_SHARE, SOME_SHARE, LONG_TEXT = 0.95, 0.10, 0.50, 50
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{2}:\d{2}.*)?\s*$"
IMBALANCED = 30.0


def _is(df: DataFrame, c: str, *kinds: type) -> bool:
    return isinstance(df.schema[c].dataType, kinds)


def _value(df: DataFrame, c: str) -> Column:
    """The column with nan as null."""
    return F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if _is(df, c, T.FloatType, T.DoubleType) else F.col(f"`{c}`")


def _number(df: DataFrame, c: str) -> Column:
    v = _value(df, c)
    if _is(df, c, T.NumericType):
        return v.cast("double")
    return F.when(v.cast("string").rlike(NUMBER), v.cast("string").try_cast("double")) if _is(df, c, T.StringType) else F.lit(None).cast("double")


def value_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset, column, position, kind, v, x, n): how often each value occurs in each column of each table.

    ``v`` is the value as text, null for nulls and nan, ``x`` its number if it is one. All tables are unpivoted into one
    grouping, which has partial sums and spreads over all values; each table is read once.
    """
    every = None
    for name, df in tables.items():
        wanted = (columns or {}).get(name) or df.columns
        cells = [F.struct(F.lit(c).alias("column"), F.lit(df.columns.index(c) if not columns else i).alias("position"), F.lit(_kind(df, c)).alias("kind"), _value(df, c).cast("string").alias("v"), (_number(df, c) + F.lit(0.0)).alias("x")) for i, c in enumerate(wanted)]
        one = df.select(F.lit(name).alias("dataset"), F.explode(F.array(*cells)).alias("u")).select("dataset", "u.*")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("dataset", "column", "position", "kind", "v", "x").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(counts: DataFrame, by: list[str], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, q): linearly interpolated quantiles of ``x``, given ``counts`` (by, x, n).

    Rank selection: the counts are split into ranges of (by, x); sums per range, added up over the ranges, tell in which
    range each wanted rank lies, and only those ranges are gone through. No task has more than one range of a column.
    """
    parts = ranged(counts.filter("x IS NOT NULL").select(*by, "x", "n"), *by, "x")
    sums = parts.groupBy("part", *by).agg(F.sum("n").alias("held"))
    w = Window.partitionBy(*by).orderBy("part")
    sums = sums.withColumns({"until": F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("held").over(Window.partitionBy(*by))})
    sums = staged(sums.withColumn("before", F.col("until") - F.col("held")))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), f(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("share")) for i, p in enumerate(probabilities) for k, f in enumerate((F.floor, F.ceil))])
    wanted = sums.select("part", *by, "before", "until", F.explode(ranks).alias("r")).select("part", *by, "before", "until", "r.*").filter("rank >= before AND rank < until")
    wanted = staged(wanted)
    within = Window.partitionBy("part", *by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = parts.join(small(wanted.select("part", *by, "before").distinct()), ["part", *by]).withColumn("upto", F.col("before") + F.sum("n").over(within))
    hit = near.drop("before").join(small(wanted.drop("before", "until")), ["part", *by]).filter("rank < upto AND rank >= upto - n")
    pair = hit.groupBy(*by, "i").agg(F.max(F.when(F.col("k") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("high"), F.first("share").alias("share"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return pair.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda e: e["q"]).alias("q"))


def _semantic_type(float_id: bool) -> Column:
    """Type of a column from its measures (H1)."""
    share = F.col("share")
    numeric = F.when((share >= ID_SHARE) & (F.lit(float_id) | (F.col("kind") != "float")), "id").otherwise("numeric")
    by_share = F.when(share >= ID_SHARE, "id").when(share <= FEW_SHARE, "categorical").when(share <= SOME_SHARE, "text").when(F.col("len") > LONG_TEXT, "text").otherwise("categorical")
    return (
        F.when(F.col("n") == 0, "unknown").when(F.col("kind") == "boolean", "boolean").when(F.col("kind").isin("int", "float"), numeric).when(F.col("kind") == "time", "datetime")
        .when(F.col("kind") != "string", "unknown").when(F.col("bool"), "boolean").when(F.col("nums") > 0.9 * F.col("n"), numeric).when(F.col("dates") > 0.8 * F.col("n"), "datetime").otherwise(by_share)
    )


def _measured(counts: DataFrame) -> DataFrame:
    """Measures of each column from the counts of its values."""
    key, text = ["dataset", "column", "position", "kind"], F.col("kind") == "string"
    n, x = F.col("n"), F.col("x")
    s = F.lower(F.trim("v"))
    of = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    sets = [F.coalesce(F.bool_and(s.isin(*pair)), F.lit(False)) for pair in (("true", "false"), ("yes", "no"), ("0", "1"))]
    one = counts.groupBy(*key).agg(
        F.sum("n").alias("rows"), of(F.col("v").isNotNull()).alias("n"), F.count("v").alias("d"), of(x.isNotNull()).alias("nums"), F.try_divide(F.sum(x * n), of(x.isNotNull())).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.try_divide(of(x == 0), of(x.isNotNull())).alias("zero"), F.try_divide(of(x < 0), of(x.isNotNull())).alias("neg"), of(text & F.col("v").rlike(DATE)).alias("dates"), F.try_divide(F.sum(F.length("v") * n), of(F.col("v").isNotNull())).alias("len"),
        (F.first("kind") == "string").alias("is_text"), (sets[0] | sets[1] | sets[2]).alias("sets"),
    )
    one = staged(one.withColumn("bool", F.col("is_text") & F.col("sets")).drop("is_text", "sets"))
    # deviations from the mean in a second pass over the counts
    off = counts.filter("x IS NOT NULL").join(small(one.select("dataset", "column", "mean", "nums")), ["dataset", "column"])
    spread = off.groupBy("dataset", "column").agg(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("ss"), F.first("nums").alias("m"))
    std = spread.select("dataset", "column", F.when(F.col("m") > 1, F.sqrt(F.col("ss") / (F.col("m") - 1))).alias("std"))
    return one.join(std, ["dataset", "column"], "left").withColumn("std", F.coalesce("std", F.lit(0.0)))


def profile_counts(counts: DataFrame, float_id: bool = True) -> DataFrame:
    """Profiles of all columns of all tables from ``value_counts``: one row a dataset and column.

    The counts are staged once and gone through three times: measures, deviations, and ranks of the quantiles, these of
    columns of numeric type only.
    """
    counts = staged(counts)
    p = _measured(counts)
    p = p.withColumn("share", F.coalesce(F.try_divide("d", "rows"), F.lit(0.0)))
    p = staged(p.withColumn("type", _semantic_type(float_id)))
    numeric = p.filter("type = 'numeric' AND nums > 0").select("dataset", "column")
    q = exact_quantiles(counts.join(small(numeric), ["dataset", "column"], "left_semi"), ["dataset", "column"])
    return _reported(p.join(q, ["dataset", "column"], "left"))


def _reported(p: DataFrame) -> DataFrame:
    """The profile's columns from measures, type and quantiles."""
    stat = lambda c, k=4: F.when((F.col("type") == "numeric") & (F.col("nums") > 0), F.round(c, k))
    low = F.lower(F.trim("column"))
    return p.select(
        "dataset", "column", "position", "type", F.col("rows").alias("total_count"), (F.col("rows") - F.col("n")).alias("null_count"), F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("n")) * 100.0 / F.col("rows"), 2)).otherwise(100.0).alias("missing_percentage"),
        F.col("d").alias("unique_count"), F.round("share", 4).alias("cardinality_ratio"), stat(F.col("mean")).alias("mean"), stat(F.col("std")).alias("std"), stat(F.col("min")).alias("min"), stat(F.col("max")).alias("max"),
        stat(F.get("q", 1)).alias("median"), stat(F.get("q", 0)).alias("q25"), stat(F.get("q", 2)).alias("q75"), stat(F.col("zero") * 100, 2).alias("zeros_percentage"), stat(F.col("neg") * 100, 2).alias("negatives_percentage"),
        F.exists(F.array(*[F.lit(h) for h in TARGET_HINTS]), lambda h: F.contains(low, h)).alias("is_likely_target"), ((F.col("type") == "id") | low.isin(*ID_NAMES)).alias("is_likely_id"),
    )


def profile(df: DataFrame, float_id: bool = True, mode: str = "exact", columns: list[str] | None = None) -> DataFrame:
    """One row a column: counts, semantic type, numeric statistics, hints (H1-H4, H7).

    ``exact`` counts all values of all columns in one grouping (``profile_counts``); a table without rows has a row for
    each column too. ``approx`` is one pass of sketches: HyperLogLog counts and approximate percentiles.
    """
    names = columns or df.columns
    if mode == "approx":
        return _reported(_sketched(df, names).withColumn("type", _semantic_type(float_id))).drop("dataset")
    out = profile_counts(value_counts({"": df}, {"": names}), float_id).drop("dataset")
    return _with_all(out, df, names)


def _with_all(profiled: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """The profile, and rows of unknown type for columns of a table that has no rows."""
    if not df.isEmpty():
        return profiled
    none = _reported(_sketched(df, names).withColumn("type", F.lit("unknown"))).drop("dataset")
    return profiled.unionByName(none)


def _sketched(df: DataFrame, names: list[str]) -> DataFrame:
    """Measures of all columns in one pass, by sketches where exact ones would need all values."""
    measures = []
    for i, c in enumerate(names):
        v, x = _value(df, c), _number(df, c)
        s = F.lower(F.trim(v.cast("string")))
        text = _is(df, c, T.StringType)
        sets = [F.coalesce(F.bool_and(s.isin(*pair)), F.lit(False)) for pair in (("true", "false"), ("yes", "no"), ("0", "1"))] if text else []
        measures += [
            F.count(v).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}"),
            F.avg((x == 0).cast("double")).alias(f"zero{i}"), F.avg((x < 0).cast("double")).alias(f"neg{i}"), F.count(x).alias(f"nums{i}"), F.approx_count_distinct(v).alias(f"d{i}"),
            (F.count_if(s.rlike(DATE)) if text else F.lit(0).cast("bigint")).alias(f"dates{i}"), F.avg(F.length(v.cast("string"))).alias(f"len{i}"), (sets[0] | sets[1] | sets[2] if text else F.lit(False)).alias(f"bool{i}"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    fields = ["n", "mean", "std", "min", "max", "zero", "neg", "nums", "dates", "len", "bool", "d"]
    each = F.array(*[F.struct(F.lit("").alias("dataset"), F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(_kind(df, c)).alias("kind"), F.col(f"q{i}").cast("array<double>").alias("q"), *[F.col(f"{f}{i}").alias(f) for f in fields]) for i, c in enumerate(names)])
    p = one.select("rows", F.explode(each).alias("p")).select("rows", "p.*")
    return p.withColumn("share", F.coalesce(F.try_divide("d", "rows"), F.lit(0.0)))


def _kind(df: DataFrame, c: str) -> str:
    for kinds, name in (((T.BooleanType,), "boolean"), ((T.FloatType, T.DoubleType, T.DecimalType), "float"), ((T.NumericType,), "int"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "time"), ((T.StringType,), "string")):
        if _is(df, c, *kinds):
            return name
    return "other"


def top_categories(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, value, n, rank): the ``k`` most frequent values of each column (H5)."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _value(df, c).cast("string").alias("value")) for c in columns])).alias("u")).select("u.*").filter("value IS NOT NULL")
    n = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)


def first_samples(df: DataFrame, order: str, columns: list[str], k: int = 5) -> DataFrame:
    """(column, samples): first ``k`` non-null values by ``order`` (H6): one top-k a column, no sort of the table."""
    out = None
    for c in columns:
        one = df.filter(_value(df, c).isNotNull()).orderBy(order).limit(k).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), _value(df, c).cast("string").alias("v")))), lambda x: x["v"]).alias("samples")).select(F.lit(c).alias("column"), "samples")
        out = one if out is None else out.unionByName(one)
    return out


def table_rollup(profiled: DataFrame) -> DataFrame:
    """One row: columns by type, mean missing share, completeness score."""
    of = lambda t: F.count_if(F.col("type") == t).alias(f"{t}_columns")
    missing = F.round(F.coalesce(F.avg("missing_percentage"), F.lit(0.0)), 2)
    return profiled.agg(F.count(F.lit(1)).alias("total_columns"), of("numeric"), of("categorical"), of("text"), of("datetime"), of("id"), of("boolean"), missing.alias("overall_missing"), F.round(100 - F.coalesce(F.avg("missing_percentage"), F.lit(0.0)), 2).alias("completeness_score"))


def find_target(columns: list[str], hint: str | None = None) -> str | None:
    """The hinted column, else one with a target's name, else the last (H9)."""
    if hint in columns:
        return hint
    return next((c for c in columns if c.lower().strip() in CLASS_NAMES), columns[-1] if columns else None)


def balance_of_counts(counts: DataFrame, value: str = "class", n: str = "n") -> DataFrame:
    """One row: classes, majority, minority and balance score from counts of classes."""
    score = F.round(F.coalesce(F.try_divide(F.min(n) * 100.0, F.max(n)), F.lit(0.0)), 2)
    share = lambda f: F.round(F.coalesce(F.try_divide(f(n) * 100.0, F.sum(n)), F.lit(0.0)), 2)
    most = F.min_by(F.col(value).cast("string"), F.struct((-F.col(n)).alias("o"), F.col(value).cast("string").alias("v")))
    d = counts.agg(F.count(F.lit(1)).alias("num_classes"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), most.alias("dominant_class"), share(F.max).alias("dominant_percentage"), share(F.min).alias("minority_percentage"), score.alias("raw"))
    s = F.when(F.col("num_classes") <= 1, 0.0).otherwise(F.col("raw"))
    return d.withColumns({"score": s, "is_imbalanced": (F.col("num_classes") > 0) & (s < IMBALANCED), "few_classes": F.col("num_classes") < 5}).drop("raw")


def class_balance(df: DataFrame, target: str | None = None) -> DataFrame:
    c = find_target(df.columns, target)
    return balance_of_counts(df.filter(_value(df, c).isNotNull()).groupBy(F.col(c).alias("class")).agg(F.count(F.lit(1)).alias("n")))


def class_counts(paths: DataFrame, path: str = "path", most: int = 50) -> DataFrame:
    """(class, n) from image paths, the ``most`` largest classes."""
    from ..sources.files import image_class

    per = paths.groupBy(image_class(F.col(path), "").alias("class")).agg(F.count(F.lit(1)).alias("n")).filter("class IS NOT NULL")
    return per.orderBy(F.desc("n"), "class").limit(most)


def card_counts(cards: DataFrame) -> DataFrame:
    """(dataset, class, n): examples split evenly over the labels that a card names."""
    return cards.select("dataset", "total", F.size("labels").alias("k"), F.explode("labels").alias("class")).select("dataset", "class", F.greatest(F.lit(1), F.floor(F.col("total") / F.col("k"))).cast("bigint").alias("n"))


def sample_per_class(df: DataFrame, cls: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """``cap`` rows of each class by hash: a sampling operator, the same rows on every run."""
    w = Window.partitionBy(cls).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def uniqueness(duplicate_percentage: Column) -> Column:
    """100 less the percentage of duplicate rows."""
    return F.lit(100.0) - duplicate_percentage


def weighted_score(**parts: Column) -> Column:
    """Mean of the scores that are there, weighted .30 completeness, .25 balance, .25 uniqueness, .20 metadata."""
    weights = {"completeness": 0.30, "balance": 0.25, "uniqueness": 0.25, "metadata": 0.20}
    pairs = [(parts[k], w) for k, w in weights.items() if k in parts]
    held = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs[1:]), F.when(pairs[0][0].isNotNull(), pairs[0][1]).otherwise(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in pairs[1:]), F.coalesce(pairs[0][0] * pairs[0][1], F.lit(0.0)))
    return F.round(F.coalesce(F.try_divide(total, held), F.lit(0.0)), 2)


def column_flags(profiled: DataFrame) -> DataFrame:
    """Columns with over 5 % missing, of little information, or constant."""
    return profiled.select("column", (F.col("missing_percentage") > 5).alias("missing"), ((F.col("cardinality_ratio") > ID_SHARE) | (F.col("type") == "id")).alias("low_information"), (F.col("unique_count") <= 1).alias("constant")).filter("missing OR low_information OR constant")


def balance_applies() -> Column:
    """Balance is meant for classification tasks, tabular data, or no task at all."""
    tasks = F.coalesce(F.col("task_types"), F.array().cast("array<string>"))
    return (F.size(tasks) == 0) | F.exists(tasks, lambda t: F.contains(t, F.lit("classification"))) | F.coalesce(F.array_contains("modalities", "tabular"), F.lit(False))


def fixes(profiled: DataFrame, balance: DataFrame, duplicates: DataFrame, most: int = 10) -> DataFrame:
    """(place, fix): suggestions in order, at most ``most``."""
    cols = profiled.filter("missing_percentage > 20").select(F.lit(0).alias("g"), F.col("position").alias("i"), F.format_string("Column '%s' has %d null values", F.col("column"), F.col("null_count")).alias("fix"))
    bal = balance.filter("is_imbalanced").select(F.lit(1).alias("g"), F.lit(0).alias("i"), F.format_string("Class imbalance: '%s' dominates", F.col("dominant_class")).alias("fix"))
    dup = duplicates.filter("duplicate_count > 0").select(F.lit(2).alias("g"), F.lit(0).alias("i"), F.format_string("%d duplicate rows", F.col("duplicate_count")).alias("fix"))
    every = cols.unionByName(bal).unionByName(dup).orderBy("g", "i").limit(most)
    return every.select(F.row_number().over(Window.orderBy("g", "i")).alias("place"), "fix")  # over at most ``most`` rows


def profile_many(tables: dict[str, DataFrame], float_id: bool = True) -> DataFrame:
    """Profiles of several tables, told apart by ``dataset``, from one grouping over all their values."""
    return profile_counts(value_counts(tables), float_id)


def group_signals(rows: DataFrame, by: str, columns: list[str], target: str, key: str, most: int = 10) -> DataFrame:
    """(by, completeness_score, balance_score, uniqueness_score, deep_score, fixes, partial) of datasets that are groups of rows.

    Values that are there, classes of ``target`` and copies of ``key`` (null counts as one value) are each counted in one
    grouping with partial sums, so no dataset is gathered in one task; copies are told by SHA-256.
    """
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.count(_value(rows, c)).alias(f"n{i}") for i, c in enumerate(columns)])
    classes = rows.filter(_value(rows, target).isNotNull()).groupBy(by, F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    most_of = F.min_by("class", F.struct((-F.col("n")).alias("o"), "class"))
    balance = classes.groupBy(by).agg(F.when(F.count(F.lit(1)) > 1, F.round(F.min("n") * 100.0 / F.max("n"), 2)).otherwise(0.0).alias("balance_score"), most_of.alias("dominant"))
    copies = rows.groupBy(by, F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    extra = copies.groupBy(by).agg(F.sum(F.col("n") - 1).alias("extra"))
    d = n.join(balance, by, "left").join(extra, by)
    missing = lambda i: (F.col("rows") - F.col(f"n{i}")) * 100.0 / F.col("rows")
    total = sum((missing(i) for i in range(1, len(columns))), missing(0))
    d = d.withColumns({"completeness_score": F.round(100 - total / len(columns), 2), "uniqueness_score": F.round(100 - F.col("extra") * 100.0 / F.col("rows"), 2)})
    said = [F.when(missing(i) > 20, F.concat(F.lit(f"Column '{c}' has "), (F.col("rows") - F.col(f"n{i}")).cast("string"), F.lit(" null values"))) for i, c in enumerate(columns)]
    said += [F.when(F.col("balance_score") < IMBALANCED, F.concat(F.lit("Class imbalance: '"), "dominant", F.lit("' dominates"))), F.when(F.col("extra") > 0, F.concat(F.col("extra").cast("string"), F.lit(" duplicate rows")))]
    fixes_ = F.slice(F.filter(F.array(*said), lambda x: x.isNotNull()), 1, most)
    deep = weighted_score(completeness=F.col("completeness_score"), balance=F.col("balance_score"), uniqueness=F.col("uniqueness_score"))
    return d.select(by, "completeness_score", "balance_score", "uniqueness_score", deep.alias("deep_score"), fixes_.alias("fixes"), F.lit(False).alias("partial"))


def class_summary(classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, largest, smallest, classes) of (by, class, n) rows."""
    order = lambda s: F.struct((s * F.col("n")).alias("o"), F.col("class").alias("c"))
    return classes.groupBy(*by).agg(F.sum("n").alias("total"), F.min_by("class", order(-1)).alias("largest"), F.min_by("class", order(1)).alias("smallest"), F.count(F.lit(1)).alias("n_classes"))


def class_shares(classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, n, share, low): share of each class; low below 10 % where there are over two classes."""
    w = Window.partitionBy(*by)
    return classes.withColumns({"share": F.round(F.col("n") * 100.0 / F.sum("n").over(w), 2), "low": (F.col("n") * 10 < F.sum("n").over(w)) & (F.count(F.lit(1)).over(w) > 2)})
