"""Sharding by size-tiered compaction (operator 8), in DataFrame functions only.

Arrivals are appended as small immutable runs of Parquet files. A versioned manifest lists the runs that are live,
with their rows, bytes and files; a run that is in no manifest is invisible. ``compact`` groups runs of similar size,
again and again until no group is large enough, and then writes each final group once, as files of about the target
size. Runs that have reached the target stay as they are, unless their files are small: such a run is rewritten alone.

A manifest version is one JSON file, written under a unique name first and then renamed to that of its version, which
must not be there yet. So readers see all of it or nothing; of two writers of a version one fails, and goes on with the
next number; and a writer that dies leaves files that nobody sees. A compaction takes effect only for groups whose runs
are all still live. Old runs stay for readers of old versions. Merging needs no shuffle: files are packed into fewer
tasks. Sizes are bytes of the values, before compression.

Defined results: null and empty texts and ids are kept as they are, and so are repeated rows and all columns, whatever
their names; an empty
arrival commits a version without a new run; an empty store reads as an empty table of the given schema.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, shared_dir, table

TARGET = 128 << 20
#: So many runs of similar size are merged; similar: up to so many times the mean of the smaller ones.
FAN_IN, SIMILAR = 4, 1.5
#: A run is ragged if it has more than so many times the files that its bytes fill; a merged run never has.
RAGGED = 3
FIELDS = "name string, path string, rows bigint, bytes bigint, files bigint"
#: Of the registered query: a block of arrivals has four of each weight. The largest have half the target at most.
WEIGHTS, EACH = (1, 4, 11), 4
#: Arrivals come in so many waves at least, and in more if a wave would have more than so many arrivals; the store is compacted after each.
WAVES, WAVE_RUNS = 3, 48


@dataclass(frozen=True)
class Run:
    name: str
    path: str
    rows: int
    bytes: int
    files: int = 1


def n_files(spark: SparkSession, path: str) -> int:
    return len(spark.read.schema("n int").option("recursiveFileLookup", True).parquet(path).inputFiles())


def _files(spark: SparkSession, path: str):
    """Hadoop's file context for a path, the path, and a maker of paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), at, hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    files, at, _ = _files(spark, f"{root}/manifest")
    if not files.util().exists(at):
        return []
    names = [f.getPath().getName() for f in files.util().listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int) -> list[Run]:
    """Live runs of a version; their number is kept small by compaction."""
    rows = spark.read.schema(FIELDS).json(f"{root}/manifest/{version:08d}.json").filter("name IS NOT NULL").collect()
    return sorted((Run(**r.asDict()) for r in rows), key=lambda r: r.name)


def commit(spark: SparkSession, root: str, version: int, runs: list[Run]) -> int:
    """Publish a manifest version, atomically; FileExistsError if it is there already."""
    staged = f"{root}/staging/{uuid.uuid4().hex}"
    rows = [(r.name, r.path, r.rows, r.bytes, r.files) for r in runs] or [(None, None, 0, 0, 0)]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.json(staged)
    files, folder, hadoop = _files(spark, staged)
    part = next(f.getPath() for f in files.util().listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = hadoop.Path(f"{root}/manifest/{version:08d}.json")
    files.mkdir(target.getParent(), hadoop.permission.FsPermission.getDirDefault(), True)
    try:
        files.rename(part, target, spark._sc._gateway.new_array(hadoop.Options.Rename, 0))  # fails if the target is there
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise FileExistsError(f"version {version} of {root}") from None
        raise
    finally:
        files.delete(folder, True)
    return version


def publish(spark: SparkSession, root: str, change: Callable[[list[Run]], list[Run]], tries: int = 20) -> list[Run]:
    """Commit what ``change`` makes of the last version's runs as the next version, again if another writer was first."""
    for _ in range(tries):
        last = (versions(spark, root) or [0])[-1]
        runs = change(manifest(spark, root, last) if last else [])
        try:
            commit(spark, root, last + 1, runs)
        except FileExistsError:
            continue
        return sorted(runs, key=lambda r: r.name)
    raise RuntimeError(f"no version could be published in {tries} tries")


def _unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _size(columns: list[tuple[str, str]]) -> Column:
    """Bytes of a row: its texts, and eight for each other value."""
    parts = [F.coalesce(F.octet_length(at(c)), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in columns]
    return sum(parts[1:], parts[0]).cast("bigint")


def land(df: DataFrame, root: str, run: Column | None = None) -> list[Run]:
    """Write ``df`` as one immutable run, or as one for each value of ``run``; readers see it once it is added."""
    spark, folder, name = df.sparkSession, f"{root}/runs/{uuid.uuid4().hex}", _unused("__run", df.columns)
    df.withColumn(name, (run if run is not None else F.lit(0)).cast("int")).write.partitionBy(name).parquet(folder)
    written = spark.read.schema(df.withColumn(name, F.lit(0)).schema).parquet(folder)
    sizes = written.groupBy(F.col(name).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum(_size(df.dtypes)).alias("b")).collect()
    tag, files = folder[-12:], Counter(f.split("/")[-2] for f in written.inputFiles())
    return [Run(f"{tag}-{r['run']:04d}", f"{folder}/{name}={r['run']}", r["n"], r["b"], files[f"{name}={r['run']}"]) for r in sorted(sizes, key=lambda r: r["run"])]


def add(spark: SparkSession, root: str, runs: list[Run]) -> list[Run]:
    """Commit landed runs; all live runs."""
    return publish(spark, root, lambda live: [*live, *runs])


def append(df: DataFrame, root: str, run: Column | None = None) -> list[Run]:
    return add(df.sparkSession, root, land(df, root, run))


def ragged(run: Run, target: int = TARGET) -> bool:
    """Whether a run that has reached the target is in files much smaller than it."""
    return run.bytes >= target and run.files * target > RAGGED * run.bytes


def plan(runs: list[Run], target: int = TARGET, fan_in: int = FAN_IN, similar: float = SIMILAR) -> list[list[Run]]:
    """Groups of runs to merge into one each, a ragged run being one of its own.

    Works on the manifest only, merged groups counting with their sum.
    """
    heaps = [([r], r.bytes) for r in sorted(runs, key=lambda r: (r.bytes, r.name))]
    while True:
        heaps.sort(key=lambda h: (h[1], h[0][0].name))
        small = [h for h in heaps if h[1] < target]
        tier: list[tuple[list[Run], int]] = []
        found = None
        for h in small:
            if tier and h[1] > similar * sum(x[1] for x in tier) / len(tier):
                if len(tier) >= fan_in:
                    break
                tier = []
            tier.append(h)
        if len(tier) >= fan_in:
            found = tier
        if not found:
            return [h[0] for h in heaps if len(h[0]) > 1 or ragged(h[0][0], target)]
        names = {id(h) for h in found}
        heaps = [h for h in heaps if id(h) not in names] + [([r for h in found for r in h[0]], sum(h[1] for h in found))]


def read_runs(spark: SparkSession, schema, runs: list[Run]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[r.path for r in runs])


def swapped(live: list[Run], merged: list[tuple[list[Run], list[Run]]]) -> list[Run]:
    """``live`` with groups of runs replaced by what they were merged to; a group that isn't wholly live stays."""
    for group, made in merged:
        if set(group) <= set(live):
            live = [r for r in live if r not in group] + made
    return live


def compact(spark: SparkSession, root: str, schema, target: int = TARGET, fan_in: int = FAN_IN, similar: float = SIMILAR) -> list[Run]:
    """Merge what ``plan`` groups and commit a version; without a group nothing is written but the version."""
    merged = []
    for group in plan(manifest(spark, root, versions(spark, root)[-1]), target, fan_in, similar):
        total = sum(r.bytes for r in group)
        rows, path = sum(r.rows for r in group), f"{root}/runs/{uuid.uuid4().hex}"
        fill = math.ceil(rows / max(1.0, total / target))  # rows of a target-sized file; where input splits are large, a task writes several
        read_runs(spark, schema, group).coalesce(max(1, math.ceil(total / target))).write.option("maxRecordsPerFile", 2 * fill).parquet(path)
        merged.append((group, [Run(f"{path[-12:]}-m", path, rows, total, n_files(spark, path))]))
    return publish(spark, root, lambda live: swapped(live, merged))


def read(spark: SparkSession, root: str, schema, version: int, run_col: str | None = "run") -> DataFrame:
    """Rows of a version, with the run they are in as ``run_col``, which must be no column of theirs (None: without)."""
    if run_col is not None and _unused(run_col, schema.names) != run_col:
        raise ValueError(f"the rows have a column {run_col}: name another one, or None, for the run")
    runs = manifest(spark, root, version)
    if run_col is None:
        return read_runs(spark, schema, runs)
    if not runs:
        return read_runs(spark, schema, runs).withColumn(run_col, F.lit(None).cast("string"))
    # one scan, however many runs there are: a row's run is that of its file's folder
    d, key = read_runs(spark, schema, runs), _unused("__path", [*schema.names, run_col])
    names = spark.createDataFrame([(r.path.rpartition("/runs/")[2], r.name) for r in runs], [key, run_col])
    d = d.withColumn(key, F.regexp_extract(d.metadataColumn("_metadata")["file_path"], "^.*/runs/(.*)/[^/]*$", 1))
    return d.join(F.broadcast(names), key, "left").select(*[at(c) for c in schema.names], at(run_col))


def shares(n_bytes: int = 0, target: int = TARGET) -> list[int]:
    """Weights of the arrival sizes, four arrivals of each: 1, 4 and 11, again and again until none is above half the target.

    So the number of arrivals grows with the input, not their size, and all of them are there to be merged.
    """
    return [*WEIGHTS] * max(1, math.ceil(n_bytes * max(WEIGHTS) / (EACH * sum(WEIGHTS)) / (target / 2)))


def arrivals(sizes: list[int] | None = None) -> Column:
    """Four arrivals of each size, by hash of the id; by default four of 1/64 of the rows, four of 4/64 and four of 11/64."""
    sizes = shares() if sizes is None else sizes
    k = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(EACH * sum(sizes))).cast("int")
    out, start = None, 0
    for i, size in enumerate(sizes):
        at = (EACH * i + F.floor((k - start) / size)).cast("int")
        start += EACH * size
        out = F.when(k < start, at) if out is None else out.when(k < start, at)
    return out


def spread(blocks: int, parts: int) -> Column:
    """The arrivals of so many blocks at least, for a table read in ``parts`` partitions.

    A block takes whole partitions, or a partition has whole blocks: each task writes the arrivals of its own blocks
    only, so files grow with the input and not with its square, and nothing is shuffled.
    """
    together, apart = max(1, parts // blocks), max(1, math.ceil(blocks / max(1, parts)))
    inner = F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.lit(apart)).cast("int")
    return (F.floor(F.spark_partition_id() / together).cast("int") * apart + inner) * (EACH * len(WEIGHTS)) + arrivals()


def waves(runs: list[Run]) -> list[list[Run]]:
    """Landed runs, in the order in which they are added: neighbours together, so that a wave has runs of similar size."""
    n = min(len(runs), max(WAVES, math.ceil(len(runs) / WAVE_RUNS)))
    return [runs[i * len(runs) // n : (i + 1) * len(runs) // n] for i in range(n)]


def store(docs: DataFrame, root: str, target: int = TARGET) -> list[Run]:
    """All ``docs`` as arrivals of a store at ``root``, which is compacted after each wave of them; the live runs."""
    spark = docs.sparkSession
    n_bytes, last = docs.select(_size(docs.dtypes).alias("b"), F.spark_partition_id().alias("p")).agg(F.sum("b"), F.max("p")).first()
    live = add(spark, root, [])
    for wave in waves(land(docs, root, spread(len(shares(n_bytes or 0, target)) // len(WEIGHTS), (last or 0) + 1))):
        add(spark, root, wave)
        live = compact(spark, root, docs.schema, target)
    return live


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents through a store: they land as small runs of several sizes, the more of them the more documents there
    are; wave by wave they are added and the store is compacted; read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store(docs, root)
    out = read(spark, root, docs.schema, versions(spark, root)[-1])
    return out.select("doc_id", "source", _size(docs.dtypes).alias("n_bytes"), "run")
