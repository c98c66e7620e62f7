"""Readers and sinks of data files, image folders, catalog snapshots and search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import col
from ..operators.stages import small, staged


def detect_formats(files: DataFrame) -> DataFrame:
    """``format`` of each row of a binaryFile listing: by ending, then by first bytes (A5)."""
    path = F.lower("path")
    head = F.substring("content", 1, 4)
    first = F.substring(F.trim(F.decode(F.substring("content", 1, 64), "ISO-8859-1")), 1, 1)
    by_end = F.when(path.rlike(r"\.(csv|tsv|txt)$"), "csv").when(path.rlike(r"\.(parquet|pq)$"), "parquet").when(path.rlike(r"\.(jsonl|ndjson)$"), "jsonl").when(path.endswith(".json"), "json")
    return files.withColumn("format", F.coalesce(by_end, F.when(head == F.encode(F.lit("PAR1"), "UTF-8"), "parquet").when(first.isin("{", "["), "json").otherwise("csv")))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, limit: int | None = None) -> DataFrame:
    """A table from a CSV, Parquet, JSON or JSONL path."""
    if fmt is None:
        fmt = detect_formats(spark.read.format("binaryFile").load(path).limit(1)).select("format").first()[0]
    if fmt == "parquet":
        out = spark.read.parquet(path)
    elif fmt in ("json", "jsonl"):
        out = spark.read.option("multiLine", fmt == "json").json(path)
    else:
        out = read_csv(spark, path)
    return out.limit(limit) if limit else out


def _charset_of_name(name: str) -> str:
    """A header that was read as Latin-1, as UTF-8 if its bytes are."""
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return name


def read_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """CSV files, each read as UTF-8 if all of its lines are valid, else as Latin-1 (A2).

    All lines are judged as bytes, split by split: no split cuts a line, and no letter holds a line break. Only names of
    files that aren't UTF-8 reach the driver, which lists all files anyway. Types are inferred over all files at once; where
    these have unlike headers, columns are strings, under the names of the first.
    ``place`` names a column for the row's number, from 0, over all files in order of their paths (``numbered``).
    """
    lines = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    odd = [r[0] for r in lines.select("_metadata.file_path").distinct().collect()]
    reader = spark.read.option("header", True)
    schema = reader.option("inferSchema", True).option("encoding", "ISO-8859-1").csv(path).schema
    names = [_charset_of_name(f.name) for f in schema]
    if place in names:
        raise ValueError(f"the files have a column {place}")
    parts = []
    for charset, of in (("UTF-8", ~F.col("_metadata.file_path").isin(odd)), ("ISO-8859-1", F.col("_metadata.file_path").isin(odd))):
        part = spark.read.option("header", True).option("encoding", charset).schema(schema).csv(path)
        part = part.filter(of) if odd else part
        at = [F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(place)] if place else []
        parts.append(part.select("*", *at).toDF(*names, *[place] * len(at)))
    out = parts[0].unionByName(parts[1]) if odd else parts[0]
    return numbered(out, place) if place else out


def numbered(d: DataFrame, place: str) -> DataFrame:
    """``d`` with ``place`` = struct<file_path, file_block_start, row> replaced by the number of the row over all files.

    ``row`` rises within a split as it is read. The rows are staged, so that all that follows sees the same splits; then
    only the row counts of the splits, one row each, are added up in order. No sort, and no shuffle of the rows unless
    the splits are too many to be broadcast.
    """
    d = staged(d)
    split = [F.col(place)["file_path"].alias("__file"), F.col(place)["file_block_start"].alias("__block")]
    n = d.groupBy(*split).agg(F.min(F.col(place)["row"]).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)  # over a row a split
    n = small(staged(n.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")))
    met = d.join(n, (F.col(place)["file_path"] == F.col("__file")) & (F.col(place)["file_block_start"] == F.col("__block")))
    return met.withColumn(place, F.col("__before") + F.col(place)["row"] - F.col("__first")).drop("__file", "__block", "__first", "__before")


def first_rows(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame:
    """A sample of ``n`` rows from the first 2n rows of CSV files."""
    d = read_csv(spark, path, place="__place").filter(F.col("__place") < 2 * n)
    return sample(d, n, "__place", seed).drop("__place")


def with_target(spark: SparkSession, features: str, target: str, name: str = "target", limit: int | None = None) -> DataFrame:
    """CSV features with the first column of the target's files beside them as ``name``, row by row.

    Rows meet by their number over the files, however these are split. A feature column called ``name`` is replaced;
    ``limit`` keeps the first rows. Different numbers of rows are refused, as no row would be sure of its target.
    """
    x, y = (staged(read_csv(spark, p, place="__place")) for p in (features, target))
    if (n := x.count()) != (m := y.count()):
        raise ValueError(f"{n} rows of features, {m} of the target")
    if limit is not None:
        x, y = x.filter(F.col("__place") < limit), y.filter(F.col("__place") < limit)
    y = y.toDF(name, *[f"__{i}" for i in range(1, len(y.columns) - 1)], "__place").select("__place", name)
    return x.drop(name).join(y, "__place").drop("__place")


def sample(df: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """First n/2 rows by ``order`` and n/2 of the rest by hash: the same rows on every run."""
    first = df.orderBy(order).limit(n // 2)
    rest = df.join(first.select(order), order, "left_anti").orderBy(F.xxhash64(order, F.lit(seed)), order).limit(n - n // 2)
    return first.unionByName(rest)


SPLITS = ("train", "test", "val", "valid", "validation", "dev")


def image_class(path: Column | str, root: str) -> Column:
    """Class of an image from root/split/class/file or root/class/file; null for a bare file."""
    parts = F.split(F.expr(f"substring({path}, {len(root) + 1})") if isinstance(path, str) else path, "/")
    parts = F.filter(parts, lambda p: p != "")
    in_split = F.lower(F.get(parts, 0)).isin(*SPLITS) & (F.size(parts) >= 3)
    return F.when(in_split, F.get(parts, 1)).when(F.size(parts) >= 2, F.get(parts, 0))


def list_images(spark: SparkSession, root: str, fmt: str = "binaryFile") -> DataFrame:
    """Images below a folder of class folders, with ``class`` and ``file``."""
    d = spark.read.format(fmt).option("recursiveFileLookup", True)
    d = (d.option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif,webp}") if fmt == "binaryFile" else d.option("dropInvalid", False)).load(root)
    path = F.col("path") if fmt == "binaryFile" else F.col("image.origin")
    rest = F.regexp_replace(path, "^.*?" + root.strip("/").split("/")[-1] + "/", "")
    return d.withColumn("class", image_class(rest, "")).withColumn("file", F.element_at(F.split(path, "/"), -1))


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images joined to a label file by file name; common header names are accepted (A10)."""
    names = {c.lower(): c for c in labels.columns}
    file = next(names[c] for c in ("filename", "file", "image", "image_id", "path", "id") if c in names)
    label = next(names[c] for c in ("label", "class", "category", "target") if c in names)
    return images.drop("class").join(labels.select(F.col(file).alias("file"), F.col(label).cast("string").alias("class")), "file")


def to_documents(catalog: DataFrame) -> DataFrame:
    """(id, document): records as JSON for a search store, without nulls."""
    return catalog.select(F.col("canonical_id").alias("id"), F.to_json(F.struct(*catalog.columns)).alias("document"))


def from_documents(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select(F.from_json("document", schema).alias("r")).select("r.*")


SAFE = ("canonical_id", "source", "source_url", "title", "description_short", "tags_primary", "license_type", "metadata_completeness")
LINEAGE = ("canonical_id", "source", "source_id", "source_url", "dataset_fingerprint")


def shaped(catalog: DataFrame, shape: str = "safe") -> DataFrame:
    """Projections for readers: safe, lineage or full."""
    wanted = {"safe": SAFE, "lineage": LINEAGE, "full": tuple(catalog.columns)}[shape]
    return catalog.select(*[c for c in wanted if c in catalog.columns])


def upsert(old: DataFrame, new: DataFrame, now: Column, keys: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """Snapshot after new records replace those of the same key; first ingestion time stays."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("metadata_completeness"), "canonical_id")
    fresh = new.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r")
    o, n = old.alias("o"), fresh.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    changed = F.col("n.__new").isNotNull()
    made = [F.coalesce(F.col("o.ingested_at"), now).alias(c) if c == "ingested_at" else F.when(changed, now).otherwise(F.col("o.crawled_at")).alias(c) if c == "crawled_at" else F.when(changed, F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, on, "full_outer").select(*made)


def write_snapshot(catalog: DataFrame, path: str) -> None:
    """A new snapshot, by source, for pruned reads."""
    catalog.write.mode("errorifexists").partitionBy("source").parquet(path)


def append_log(searches: DataFrame, path: str) -> None:
    """Search records appended to the log."""
    searches.write.mode("append").parquet(path)


def lookup(catalog: DataFrame, **keys: str) -> DataFrame:
    """Rows by exact keys; the filter reaches the Parquet scan."""
    out = catalog
    for k, v in keys.items():
        out = out.filter(col(k) == v)
    return out
