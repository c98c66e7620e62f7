"""Versioned snapshots of the catalog that micro-batches are merged into, each batch once.

A snapshot is a manifest: its version, the number of the last merged batch, and for each bucket of keys the folder with
its rows. A batch rewrites the buckets it touches only; the new manifest names the old folders of all others. Manifests
are published by a rename that must not overwrite: of two writers one fails, and a writer that dies before it leaves
files that no manifest names. A batch whose number was merged already changes nothing, so a replay is harmless. (The
rename is atomic on HDFS and local disks; on a store that copies and deletes, one writer at a time must be seen to.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import upsert

BUCKETS = 16
KEYS = ("source", "source_id")


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict:
    """The newest manifest; version 0, without buckets, where there is none."""
    fs, folder = _fs(spark, root), spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    known = sorted(n for n in names if n.startswith("v-"))
    if not known:
        return {"version": 0, "batch": -1, "buckets": {}, "schema": None}
    return json.loads(spark.read.text(f"{root}/manifests/{known[-1]}", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """Make ``manifest`` the newest one; raises if its version is there already."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = _fs(spark, root)
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/v-{manifest['version']:010d}"), options)


def read_snapshot(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the newest snapshot, of some buckets if named; None before the first batch."""
    manifest = current(spark, root)
    if not manifest["schema"]:
        return None
    paths = [p for b, p in manifest["buckets"].items() if buckets is None or int(b) in buckets]
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket(keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_batch(root: str, now: Callable[[int], Column] | None = None, keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that merges records by their keys into the snapshot in ``root``.

    ``now`` gives the time that a batch's records are marked with; the time of the job by default.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = current(spark, root)
        if number <= manifest["batch"]:
            return
        at = now(number) if now else F.current_timestamp()
        new = batch.withColumn("__bucket", bucket(keys, buckets))
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most ``buckets`` numbers
        old = read_snapshot(spark, root, touched)
        if old is None:
            old = batch.limit(0).withColumns({"ingested_at": at, "crawled_at": at})
        folder = f"{root}/data/v-{manifest['version'] + 1:010d}-{uuid.uuid4().hex}"
        merged = upsert(old, new.drop("__bucket"), at, keys).withColumn("__bucket", bucket(keys, buckets))
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        paths = manifest["buckets"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
        publish(spark, root, {"version": manifest["version"] + 1, "batch": number, "buckets": paths, "schema": manifest["schema"] or old.schema.jsonValue()})

    return run
