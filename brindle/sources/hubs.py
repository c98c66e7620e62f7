"""Landed hub dumps to catalog records (A11-A16, B24-B32): one projection for each hub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules, signals, text
from ..functions.vocab import IMAGE_WORDS, TABULAR_WORDS
from ..operators.derive import derive


def read_dump(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): JSON lines that fit the schema, and the raw lines that don't."""
    line = spark.read.text(path).filter(F.trim("value") != "")
    rows = line.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), rows.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _record(d: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Records with every base field, missing ones null, and the derived ones."""
    kinds = {"source_id": "string", "source_url": "string", "title": "string", "description": "string", "tags": "array<string>", "row_count": "bigint", "column_count": "bigint", "column_names": "array<string>", "file_size_bytes": "bigint", "data_format": "string", "license_type": "string", "data_domain": "string", "task_types": "array<string>", "modalities": "array<string>", "language": "string", "last_updated": "timestamp", "download_count": "bigint", "upvote_count": "bigint", "author": "string", "usability_rating": "double", "majority_class_size": "bigint", "minority_class_size": "bigint", "missing_values": "bigint", "download_url": "string", "reject_reason": "string"}
    return derive(d.select(F.lit(source).alias("source"), *[fields.get(k, _none(t)).cast(t).alias(k) for k, t in kinds.items()]))


def _hits(tags: Column, f) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, f), lambda x: x != "other"))


def _modalities(tags: Column, title: Column, description: Column, source: str, default: str | None = None, extra: dict[str, Column] | None = None) -> Column:
    """Modalities that tags name; without any, the detected one; without that, the source's default."""
    found = signals.detect_modality(tags, title, description, F.lit(source), extra)["modality"]
    guessed = F.when(found != "other", F.array(found)).otherwise(F.array(F.lit(default)) if default else F.array().cast("array<string>"))
    if default:
        guessed = F.when(found.isin("image", "text", "audio"), F.array(found)).otherwise(F.array(F.lit(default)))
    return F.when(F.size(_hits(tags, rules.modality)) > 0, _hits(tags, rules.modality)).otherwise(guessed)


def _signalled(dump: DataFrame, tags: Column, title: Column, description: Column) -> DataFrame:
    """``dump`` with ``modalities``, those that tags name. Without any, or with tabular alone, the detected one joins them;
    then image, and where nothing is known yet tabular, if the record's text holds one of their words (B32). Each step is
    a column of its own, as the next one uses it several times."""
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.array_join(tags, " ")))
    d = dump.withColumns({"__tagged": _hits(tags, rules.modality), "__found": signals.detect_modality(tags, title, description, F.lit("kaggle"))["modality"], "__said": said})
    none, found = F.size("__tagged") == 0, F.col("__found")
    vague = none | ((F.size("__tagged") == 1) & F.array_contains("__tagged", "tabular"))
    more = F.when(vague & found.isin("image", "text", "audio"), F.array_union("__tagged", F.array(found))).when(none & (found == "tabular"), F.array(found)).otherwise(F.col("__tagged"))
    d = d.withColumn("__more", more)
    d = d.withColumn("__shown", F.when(F.col("__said").rlike("|".join(IMAGE_WORDS)), F.array_union("__more", F.array(F.lit("image")))).otherwise(F.col("__more")))
    return d.withColumn("modalities", F.when((F.size("__shown") == 0) & F.col("__said").rlike("|".join(TABULAR_WORDS)), F.array(F.lit("tabular"))).otherwise(F.col("__shown")))


def _card(info: Column) -> tuple[Column, Column]:
    """(rows, names) of a card's dataset_info, as JSON text: the examples of its splits, which are a list or a map, added up,
    and the names of its features; of several configurations the first counts (B26)."""
    one = F.when(F.ltrim(info).startswith("["), F.get_json_object(info, "$[0]")).otherwise(info)
    splits = F.get_json_object(one, "$.splits")
    listed = F.from_json(F.when(splits.startswith("["), splits), "array<struct<num_examples:string>>")
    mapped = F.map_values(F.from_json(F.when(splits.startswith("{"), splits), "map<string,struct<num_examples:string>>"))
    rows = F.aggregate(F.coalesce(listed, mapped), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(text.to_long(x["num_examples"]), F.lit(0)))
    return F.when(rows > 0, rows), F.transform(F.from_json(F.get_json_object(one, "$.features"), "array<struct<name:string>>"), lambda f: f["name"])


def kaggle(dump: DataFrame) -> DataFrame:
    ref = F.trim("ref")
    tags = text.clean_tags("tags")
    title = text.first_text("title", slug := text.slug_title(ref), default="")
    description = text.first_text("description", "subtitle", default="")
    modalities = F.col("modalities")
    api = F.concat(F.lit("https://www.kaggle.com/api/v1/datasets/download/"), ref)
    return _record(
        _signalled(dump, tags, title, description), "kaggle", source_id=ref, source_url=F.concat(F.lit("https://www.kaggle.com/datasets/"), ref), title=F.coalesce(title, slug), description=description, tags=tags,
        file_size_bytes=text.to_long("totalBytes"), data_format=rules.first_hit(tags, rules.data_format), license_type=F.when(text.first_text("licenseName").isNotNull(), rules.license_type("licenseName")),
        data_domain=rules.first_hit(tags, rules.domain), task_types=rules.tag_tasks(tags), modalities=modalities, last_updated=text.to_time("lastUpdated"), download_count=text.to_long("downloadCount"),
        upvote_count=text.to_long("voteCount"), author=text.first_text("ownerName", "ownerRef", text.slug_owner(ref)), usability_rating=text.to_double("usabilityRating"),
        download_url=F.when(~F.array_contains(modalities, "image"), api), reject_reason=F.when(~F.coalesce(ref.rlike("^[^/]+/[^/]+$"), F.lit(False)), "ref is not owner/name"),
    )


def huggingface(dump: DataFrame) -> DataFrame:
    i, tags, card = F.trim("id"), text.clean_tags("tags"), F.col("cardData")
    category = text.clean_tags(card["task_categories"])
    description = text.first_text(card["description"], default="")
    rows, names = _card(card["dataset_info"])
    columns = F.size(names)
    extra = {"image": _points(category, "image|visual|vision"), "text": _points(category, "text|nlp|language"), "audio": _points(category, "audio|speech")}
    named = F.array_union(_hits(text.clean_tags(card["modalities"]), rules.modality), F.array().cast("array<string>"))
    return _record(
        dump, "huggingface", source_id=i, source_url=F.concat(F.lit("https://huggingface.co/datasets/"), i), title=text.slug_title(i), description=description, tags=tags, row_count=rows,
        column_count=F.when(columns > 0, columns), column_names=names, license_type=F.when(text.first_text(card["license"]).isNotNull(), rules.license_type(card["license"])),
        data_domain=rules.first_hit(tags, rules.domain), task_types=F.array_distinct(F.concat(rules.tag_tasks(category), rules.tag_tasks(tags))), language=F.get(card["language"], 0),
        modalities=F.when(F.size(named) > 0, named).otherwise(_modalities(tags, text.slug_title(i), description, "huggingface", extra=extra)), last_updated=F.coalesce(text.to_time("lastModified"), text.to_time("created_at")),
        download_count=text.to_long("downloads"), upvote_count=text.to_long("likes"), author=text.slug_owner(i), reject_reason=F.when(F.coalesce(i == "", F.lit(True)), "no id"),
    )


def _points(tags: Column, words: str) -> Column:
    return F.size(F.filter(tags, lambda t: t.rlike(words))) * F.lit(0.10)


def openml(dump: DataFrame) -> DataFrame:
    """Format is CSV and domain tabular unless tags say otherwise; the number of classes implies tag and task."""
    did = F.trim("did")
    classes = text.to_long("NumberOfClasses")
    tags = F.array_union(text.clean_tags("tag"), F.when(classes == 2, F.array(F.lit("binary_classification"))).when(classes > 2, F.array(F.lit("multi_class_classification"))).otherwise(F.array().cast("array<string>")))
    title = F.initcap(F.translate("name", "_-", "  "))
    description = text.first_text("description", default="")
    arff = F.coalesce(F.contains(F.lower("format"), F.lit("arff")) | (F.trim("format") == ""), F.lit(True))
    implied = F.when(arff & (classes == 2), F.array(F.lit("binary_classification"))).when(arff & (classes > 0), F.array(F.lit("classification"))).otherwise(F.array().cast("array<string>"))
    some = lambda c, p: F.when(F.coalesce(text.to_long(c) > 0, F.lit(False)), p).otherwise(0.0)
    return _record(
        dump, "openml", source_id=did, source_url=F.concat(F.lit("https://www.openml.org/d/"), did), title=title, description=description, tags=tags, row_count=text.to_long("NumberOfInstances"), column_count=text.to_long("NumberOfFeatures"),
        data_format=F.lit("csv"), license_type=F.when(text.first_text("licence").isNotNull(), rules.license_type("licence")).otherwise("cc_by"), data_domain=F.coalesce(rules.first_hit(tags, rules.domain), F.lit("tabular")),
        task_types=F.array_distinct(F.concat(implied, rules.tag_tasks(tags))), modalities=_modalities(tags, title, description, "openml", "tabular", {"tabular": some("NumberOfClasses", 0.08) + some("NumberOfFeatures", 0.05)}),
        last_updated=text.to_time("upload_date"), author=text.first_text("creator", "uploader"), majority_class_size=text.to_long("MajorityClassSize"), minority_class_size=text.to_long("MinorityClassSize"), missing_values=text.to_long("NumberOfMissingValues"),
        reject_reason=F.when(~F.coalesce(text.to_long("did") > 0, F.lit(False)), "did is no positive number"),
    )


#: Landing pages, endpoints that always serve data, and endings of data files.
LANDING = ("https://www.kaggle.com/datasets/", "https://kaggle.com/datasets/", "https://huggingface.co/datasets/", "https://www.huggingface.co/datasets/", "https://openml.org/d/", "https://www.openml.org/d/", "https://openml.org/t/", "https://www.openml.org/t/")
SERVING = ("/data/get_csv/", "/data/v1/download/", "api.openml.org/data/")
DATA_FILES = (".csv", ".tsv", ".parquet", ".pq", ".arrow", ".json", ".jsonl", ".ndjson", ".xlsx", ".xls", ".zip")


def downloadable(url: Column | str) -> Column:
    """Whether a URL leads to data rather than to a page about it."""
    u = text.col(url)
    path = F.regexp_replace(F.lower(u), "[?#].*", "")
    any_ = lambda f, xs: F.coalesce(*[F.when(f(x), True) for x in xs], F.lit(False))
    return ~any_(u.startswith, LANDING) & (any_(lambda x: F.contains(path, F.lit(x)), SERVING) | any_(path.endswith, DATA_FILES))
