"""Image checks over Spark's image source, which decodes files without further libraries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import cosine
from .stages import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLURRY, SMALL, LARGE = 100.0, 32, 4096


def _grey(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(h, w, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # the source keeps blue first


@F.pandas_udf(T.StructType([T.StructField("hash", T.StringType()), T.StructField("sharpness", T.DoubleType())]))
def _looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """64-bit average hash of an 8 x 8 area mean, and variance of the Laplacian."""
    for b in batches:
        rows = []
        for data, h, w, c in zip(b["data"], b["height"], b["width"], b["nChannels"], strict=True):
            if h < 1 or data is None:
                rows.append((None, None))
                continue
            g = _grey(data, h, w, c)
            ys, xs = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 9).astype(int)
            small = np.array([[g[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(8)] for i in range(8)])
            bits = int("".join("1" if v else "0" for v in (small > small.mean()).ravel()), 2)
            p = np.pad(g, 1, mode="reflect") if min(h, w) > 1 else np.pad(g, 1, mode="edge")
            edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
            rows.append((f"{bits:016x}", float(edges.var())))
        yield pd.DataFrame(rows, columns=["hash", "sharpness"])


def inspect(images: DataFrame) -> DataFrame:
    """(class, path, width, height, corrupt, hash, sharpness, blurry) of rows of the image source."""
    d = images.withColumn("__l", _looks(F.struct("image.data", "image.height", "image.width", "image.nChannels")))
    return d.select("class", F.col("image.origin").alias("path"), "image.width", "image.height", (F.col("image.width") < 1).alias("corrupt"), "__l.hash", "__l.sharpness", (F.col("__l.sharpness") < BLURRY).alias("blurry"))


def summary(inspected: DataFrame) -> DataFrame:
    """One row: blur, corruption and size measures."""
    ok = ~F.col("corrupt")
    sizes = inspected.filter(ok).groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))
    dims = sizes.agg(F.max_by(F.concat_ws("x", "width", "height"), F.struct("n", "width", "height")).alias("dominant_size"), F.count(F.lit(1)).alias("unique_sizes"))
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c) * 100.0, n), F.lit(0.0)), 2)
    tiny, huge = F.least("width", "height") < SMALL, F.greatest("width", "height") > LARGE
    one = inspected.agg(n.alias("total"), share(F.col("blurry")).alias("blurry_percentage"), share(F.col("corrupt")).alias("corrupt_percentage"), F.count_if(ok & tiny).alias("tiny"), F.count_if(ok & huge).alias("huge"))
    return one.crossJoin(F.broadcast(dims)).withColumn("corruption_warning", F.col("corrupt_percentage") > 5)


def per_class(inspected: DataFrame) -> DataFrame:
    """(class, n, blurry, duplicates, corrupt): a duplicate's hash occurs more than once anywhere."""
    seen = inspected.filter("hash IS NOT NULL").groupBy("hash").agg((F.count(F.lit(1)) > 1).alias("twice"))
    d = inspected.join(seen, "hash", "left")
    return d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("blurry").alias("blurry"), F.count_if("twice").alias("duplicates"), F.count_if("corrupt").alias("corrupt"))


def label_mismatch(images: DataFrame, labels: DataFrame, least: float = 0.20, flagged: float = 25.0) -> DataFrame:
    """(class, mismatch_percentage, flagged): images (class, v) whose cosine with their label's vector is low."""
    d = images.join(small(labels.select("class", F.col("v").alias("lv"))), "class")
    share = F.round(F.avg(F.when(cosine(F.col("v"), F.col("lv")) < least, 100.0).otherwise(0.0)), 2)
    return d.groupBy("class").agg(share.alias("mismatch_percentage")).withColumn("flagged", F.col("mismatch_percentage") > flagged)


def sample_images(images: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """``cap`` images of each class by hash."""
    w = Window.partitionBy("class").orderBy(F.xxhash64("path", F.lit(seed)), "path")
    return images.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")
