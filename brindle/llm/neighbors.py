"""Approximate nearest neighbours by inner product (operator 4): a forest of random-projection trees.

1. Rows with equal vectors form a class, kept with its smallest ids: never more than k + 1 of them can be asked for.
   Vectors are scaled to length 1; where lengths differ, one more coordinate makes up the difference, so that nearness
   by inner product becomes nearness by distance. A query has length 1 without it, whatever its own length.
2. A router, one tree fitted on a bounded sample of classes (``MAX_SAMPLE``), deals all classes to tiles. Tiles that
   come out large are cut into parts by hash, so that a task holds a bounded number of vectors at any size of the table.
3. In each part a forest of trees is built over all its vectors, down to leaves of at most ``LEAF``. Each node splits
   at the median of a random projection: the direction from one of its points to another.
4. A query searches the forest through one priority queue, which all trees share. Its order is the probability that a
   neighbour at the query's bound (its k-th best score so far) lies in a node, from how far the query lies beyond or
   within the splits on the way. Leaves come off the queue and vote for their vectors. The search ends along the queue:
   once the leaves taken are expected to hold such a neighbour ``NEED`` times. Vectors with ``VOTES`` votes are the
   candidates, scored exactly, in double precision, summed in order of the coordinates. If they are fewer than k, the
   queue goes on, to its end if need be; then all vectors have been scored.
5. A few trees over the query's own tile give a first bound. The router's queue then yields tiles in the same order,
   until they hold a neighbour at the bound with probability ``MASS``.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, neither as queries
nor as candidates, nor do those of another length than most; null ids take no part; of different vectors under one id
the least in order of components stands for it; ties go to smaller ids; repeated rows count once; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ships, small, table

ships(__name__)

K = 20
EVERY = 20
TREES, LEAF, VOTES, NEED = 64, 24, 3, 17.0
#: Trees whose leaf of the query is scored to get a first bound.
PROBES = 8
MASS = 0.98
#: Numbers held by the vectors of a tile, more or less; a part has at most about twice as many. Queries that a task
#: answers, and that share a queue.
TILE, ASKED, BLOCK = 1 << 21, 2000, 32
MAX_SAMPLE = 100_000
SEED = 11


class Forest:
    """Trees over points, in level order: node i has children 2i + 1 and 2i + 2. ``members`` holds the points' positions
    by tree and leaf."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        points, n, rng = points.astype(np.float32), len(points), np.random.default_rng(seed)
        depth = max(0, math.ceil(math.log2(max(1.0, n / leaf))))
        self.n, self.depth, self.inner = n, depth, 2**depth - 1
        self.normal = np.zeros((trees, self.inner, points.shape[1]), np.float32)
        self.offset = np.zeros((trees, self.inner), np.float32)
        self.members = None
        for t in range(trees):
            order, bounds = np.arange(n), np.array([0, n])
            for level in range(depth):
                nodes, size = 2**level, np.diff(bounds)
                one, other = (order[np.minimum(bounds[:-1] + (rng.random(nodes) * size).astype(np.int64), n - 1)] for _ in range(2))
                w = points[one] - points[other]
                flat = np.linalg.norm(w, axis=1) < 1e-9
                w[flat] = rng.normal(size=(flat.sum(), w.shape[1]))
                w /= np.linalg.norm(w, axis=1)[:, None]
                node = np.repeat(np.arange(nodes), size)
                at = np.einsum("ij,ij->i", points[order], w[node])
                by = np.argsort(8.0 * node + at)  # nodes lie in a row, and |at| <= 2
                order, at = order[by], at[by]
                middle = bounds[:-1] + (size + 1) // 2
                self.normal[t, nodes - 1 : 2 * nodes - 1] = w
                self.offset[t, nodes - 1 : 2 * nodes - 1] = (at[np.clip(middle - 1, 0, n - 1)] + at[np.clip(middle, 0, n - 1)]) / 2
                bounds = np.sort(np.concatenate([bounds, middle]))
            sizes = np.diff(bounds)
            if self.members is None:
                self.members = np.full((trees, 2**depth, sizes.max()), n, np.int32)
            self.members[t, np.repeat(np.arange(2**depth), sizes), np.arange(n) - np.repeat(bounds[:-1], sizes)] = order
        w = self.normal
        self.spread = np.sqrt(np.einsum("tij,tij->ti", w[..., :-1], w[..., :-1]) / max(1, w.shape[2] - 1) + w[..., -1] ** 2)

    def filed(self, points: np.ndarray, tree: int = 0) -> np.ndarray:
        """The leaf of a tree that each point falls into."""
        node, x = np.zeros(len(points), np.int64), points.astype(np.float32)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normal[tree, node]) > self.offset[tree, node])
        return node - self.inner

    def queue(self, q: np.ndarray, distance: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, tree, leaf, probability) of the leaves taken for each of some queries, best first.

        One priority queue holds nodes of all trees and of all these queries. It is kept by ranges of probability, each
        down to 0.7 of the one before: all nodes of the best range are opened at once, until only leaves are left of
        it, and these are taken in order. A query ends when its leaves' probabilities sum up to ``need``.

        The probability is that of a neighbour at the query's distance, which deviates normally from the query along each
        normal: by its share of a random direction in the coordinates, and wholly in the last one.
        """
        trees = len(self.offset)
        above = (q.astype(np.float32) @ self.normal.reshape(trees * self.inner, q.shape[1]).T - self.offset.ravel()) / self.spread.ravel()
        row, tree = np.repeat(np.arange(len(q)), trees), np.tile(np.arange(trees), len(q))
        node, p = np.zeros(len(row), np.int64), np.ones(len(row))
        none = (row[:0], tree[:0], node[:0], p[:0])
        held, least, out = np.zeros(len(q)), 1.0, [none]
        while len(row):
            least = least * 0.7 if least > 1e-9 else 0.0
            now = p >= least
            later, leaves = [(row[~now], tree[~now], node[~now], p[~now])], [none]
            row, tree, node, p = row[now], tree[now], node[now], p[now]
            while len(row):
                end = node >= self.inner
                leaves.append((row[end], tree[end], node[end] - self.inner, p[end]))
                row, tree, node, p = row[~end], tree[~end], node[~end], p[~end]
                z = above[row, tree * self.inner + node] / distance[row]
                right = 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -80, 80)))  # the normal distribution, to 2e-4
                row, tree = np.tile(row, 2), np.tile(tree, 2)
                node, p = np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([p * (1 - right), p * right])
                now = p >= least
                later.append((row[~now], tree[~now], node[~now], p[~now]))
                row, tree, node, p = row[now], tree[now], node[now], p[now]
            row, tree, node, p = (np.concatenate(x) for x in zip(*leaves, strict=True))
            order = np.lexsort((node, tree, -p, row))
            row, tree, node, p = row[order], tree[order], node[order], p[order]
            sums = np.cumsum(p) - p  # of the leaves before, in this range
            sums -= sums[np.searchsorted(row, row)] if len(row) else 0.0
            take = held[row] + sums < need
            out.append((row[take], tree[take], node[take], p[take]))
            np.add.at(held, row[take], p[take])
            row, tree, node, p = (np.concatenate(x) for x in zip(*later, strict=True))
            open_ = held[row] < need
            row, tree, node, p = row[open_], tree[open_], node[open_], p[open_]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def candidates(self, q: np.ndarray, distance: np.ndarray, k: int, need: float, votes: int) -> list[np.ndarray]:
        """For each query the positions of the points with enough votes of the leaves that come off the queue."""
        row, tree, leaf, _ = self.queue(q, distance, need)
        size = self.n + 1  # the last one for the gaps of leaves
        count = np.bincount(((row * size)[:, None] + self.members[tree, leaf]).ravel(), minlength=len(q) * size).reshape(len(q), size)[:, : self.n]
        out = [np.flatnonzero(c) for c in count >= min(votes, len(self.offset))]
        few = [i for i, x in enumerate(out) if len(x) < min(k, self.n)]
        if few and need <= len(self.offset):  # on along the queue, if need be to its end
            for i, x in zip(few, self.candidates(q[few], distance[few], k, 2 * need, votes), strict=True):
                out[i] = x
        return out


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of q with all rows of v, summed in order of the coordinates, so that a pair always scores equally."""
    out = np.zeros(len(v))
    for d in range(len(q)):
        out += q[d] * v[:, d]
    return out


def placed(x: np.ndarray, longest: float) -> np.ndarray:
    """On the unit sphere, with one more coordinate for what a vector lacks of the greatest length."""
    lack = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, lack[:, None]], axis=1) / longest


def aimed(q: np.ndarray) -> np.ndarray:
    """Where queries lie: their directions, lacking nothing."""
    return np.concatenate([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))], axis=1)


def distance(q: np.ndarray, low: float, longest: float) -> float:
    """On the sphere, from a query to a neighbour at the bound ``low``; without a bound the greatest there is."""
    return math.sqrt(min(4.0, max(1e-6, 2 - 2 * low / (longest * np.linalg.norm(q))))) if np.isfinite(low) else 2.0


def best(q: np.ndarray, v: np.ndarray, at: np.ndarray, k: int, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Of some positions those with the k + 1 best scores, ties included, from ``low`` up; and the scores."""
    s = exact(q, v[at])
    if len(at) > k + 1:  # the rest can't be among this query's k, wherever else it looks
        low = max(low, np.partition(s, len(s) - k - 1)[len(s) - k - 1])
    return at[s >= low], s[s >= low]


def probe(q: np.ndarray, v: np.ndarray, longest: float, k: int, leaf: int = LEAF, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its position, positions of the best candidates in its own leaves of a few trees, scores)."""
    forest = Forest(placed(v, longest), PROBES, leaf, seed)
    own = np.stack([forest.filed(aimed(q), t) for t in range(PROBES)], axis=1)
    for n, leaves in enumerate(own):
        at = np.unique(forest.members[np.arange(PROBES), leaves])
        yield n, *best(q[n], v, at[at < forest.n], k, -np.inf)


def search(q: np.ndarray, low: np.ndarray, v: np.ndarray, longest: float, k: int, trees: int = TREES, leaf: int = LEAF, need: float = NEED, votes: int = VOTES, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its position, positions of the best candidates of ``v``, scores), given its bound so far."""
    forest = Forest(placed(v, longest), trees, leaf, seed)
    to, far = aimed(q), np.array([distance(*x, longest) for x in zip(q, low, strict=True)])
    for o in range(0, len(q), BLOCK):
        for n, at in enumerate(forest.candidates(to[o : o + BLOCK], far[o : o + BLOCK], k, need, votes), o):
            yield n, *best(q[n], v, at, k, low[n])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, need: float = NEED, votes: int = VOTES, mass: float = MASS, tile: int | None = None, max_sample: int = MAX_SAMPLE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    d = d.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).filter(F.exists(v, lambda x: x != 0.0))
    d = materialize(d.groupBy("vec_id").agg(F.min("v").alias("v")))
    order = Window.partitionBy("cls", "v").orderBy("vec_id")
    ids = d.withColumn("cls", F.xxhash64(v)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("cls", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(ids.select(F.element_at("ids", 1).alias("cls"), "v", "ids"))
    dims = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    width, total = dims["n"], dims["count"]
    tile = tile or max(1024, TILE // width)
    classes = classes.filter(F.size("v") == width)
    queries = d.filter(F.col("vec_id") % every == 0).filter(F.size("v") == width).select(F.col("vec_id").alias("query_id"), "v")

    longest = float(np.sqrt(classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))
    part = F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1_000_000_000)) < int(1e9 * min(1.0, max_sample / total))
    sample = np.array([r["v"] for r in classes.filter(part).orderBy("cls").select("v").collect()]).reshape(-1, width)
    # as many tiles as the table needs, if the sample has some vectors for each
    router = Forest(placed(sample, longest), 1, max(16, math.ceil(len(sample) / max(1, total / tile))), seed)
    router.members = None
    held = spark.sparkContext.broadcast(cloudpickle.dumps(router))  # by value

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(held.value)
        for b in batches:
            if len(b):
                yield b.assign(tile=own.filed(placed(np.stack(b["v"].to_numpy()), longest)))

    def ask(further: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pickle.loads(held.value)
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy())
                to, low = aimed(x), b["bound"].to_numpy()
                if not further:
                    yield b.assign(tile=own.filed(to))[["query_id", "tile", "v", "bound"]]
                    continue
                far = np.array([distance(*r, longest) for r in zip(x, low, strict=True)])
                for some, until in ((np.isfinite(low), mass), (~np.isfinite(low), 2.0)):  # without a bound all tiles
                    some = np.flatnonzero(some)
                    row, _, at, _ = own.queue(to[some], far[some], until)
                    yield b.iloc[some[row]].assign(tile=at)[["query_id", "tile", "v", "bound"]]

        return run

    def score(further: bool):
        def run(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "cls": [], "score": []})]
            if len(asked) and len(own):
                own = own.sort_values("cls", kind="stable")
                cls, vs, names = own["cls"].to_numpy(), np.stack(own["v"].to_numpy()), asked["query_id"].to_numpy()
                q, low = np.stack(asked["v"].to_numpy()), asked["bound"].to_numpy()
                for n, at, s in search(q, low, vs, longest, k, trees, leaf, need, votes, seed) if further else probe(q, vs, longest, k, leaf, seed):
                    out.append(pd.DataFrame({"query_id": names[n], "cls": cls[at], "score": s}))
            return pd.concat(out).astype({"query_id": "int64", "cls": "int64", "score": "float64"})

        return run

    filed = materialize(classes.select("cls", "v").mapInPandas(file, "cls long, v array<double>, tile long"))
    sizes = filed.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(2.0 * tile)).cast("int").alias("parts"))
    members = classes.select("cls", "ids")

    def found(asked: DataFrame, further: bool) -> DataFrame:
        asked = materialize(asked)
        per = asked.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(float(ASKED))).cast("int").alias("chunks"))
        cells = small(materialize(sizes.join(per, "tile")))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = asked.join(cells, "tile").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).withColumn("part", upto("parts"))
        h = filed.join(cells, "tile").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(seed)), F.col("parts")).cast("int")).withColumn("chunk", upto("chunks"))
        key = ["tile", "part", "chunk"]
        made = a.select(*key, "query_id", "v", "bound").groupBy(*key).cogroup(h.select(*key, "cls", "v").groupBy(*key))
        return materialize(made.applyInPandas(score(further), "query_id long, cls long, score double"))

    def ranked(near: DataFrame) -> DataFrame:
        each = near.join(members, "cls").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    asked, none = "query_id long, tile long, v array<double>, bound double", F.lit(float("-inf"))
    first = found(queries.withColumn("bound", none).mapInPandas(ask(False), asked), False)
    bounds = ranked(first).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    again = queries.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", none).alias("bound"))
    near = found(again.mapInPandas(ask(True), asked), True)
    return ranked(near).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbors(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
