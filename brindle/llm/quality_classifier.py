"""Quality classifier by Bradley-Terry pairwise ranking (operator 7).

Scores are linear in measurements of the text. They are learned from preference pairs (a document labelled 1 over
one labelled 0) by logistic loss on the differences of their measurements. The cut is a quantile of the scores of
the labelled documents, at their share of label 0; a document's score is moved so that the cut lies at 0.3.

The model is fitted on all labelled documents outside the held-out fold, and on every pair of them. The loss of a pair
depends on the difference of two scores only. So a step of Newton's method groups the documents by label and narrow range
of scores, with sums of powers of the distance from the range's middle, alone and times the measurements; the driver gets
these sums of a bounded number of ranges, and adds up the pairs of ranges by Taylor series, whose error is below that of
the stop rule. The cut is picked by rank among the scores of all labelled documents. Measurements are taken once and
stored; they alone are read for the steps and joined with the labels. Everything is DataFrame functions.

Defined results: null and empty texts are measured as 0 words and scored like all others; without labels of both
kinds every document scores 0.5; labels other than 0 and 1 (null too) teach nothing, and repeated label rows count once, with the smaller
label; repeated documents are repeated in the result; an empty table gives an empty result; labels, language,
source and id are no inputs of a score; ``accepted`` keeps the caller's columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, at, materialize, packed, ships, table, unpacked, words

ships(__name__)

#: Of ``fit_pairs``, which draws its pairs.
MAX_PAIRS = 200_000
#: Ranges of scores are so wide, and wider only if there were more than so many; terms of the series between two ranges.
WIDTH, RANGES, TERMS = 1 / 16, 2048, 6
CUT = 0.3
FOLDS = 5
#: The cut's quantile as a part of the share of label 0: a little below it, so that odd but good texts stay.
CAUTION = 0.98

FEATURES = ("log_words", "symbols", "bars", "exclamations", "capitals", "stutter", "variety", "stops", "double_lines")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``__x`` of measurements."""
    text = F.coalesce(at(text_col), F.lit(""))
    d = docs.withColumns({"__w": words(text), "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))})
    gone = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    n = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.array_join("__w", "")), F.lit(1)).cast("double")
    x = {
        "log_words": F.log1p(F.size("__w").cast("double")),
        "symbols": F.least(gone("[#*$%&<>]+") / n, F.lit(5.0)),
        "bars": F.least(gone(r"\|+") / n, F.lit(5.0)),
        "exclamations": F.least(gone("!+") / n, F.lit(5.0)),
        "capitals": gone("[A-Z]+") / chars,
        "stutter": F.size(F.filter(F.zip_with(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0))), F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)) / n,
        "variety": F.log1p(F.size(F.array_distinct("__w")).cast("double")) / F.log1p(n),
        "stops": F.least(gone("[.,]+") / n, F.lit(5.0)),
        "double_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))) / F.greatest(F.size("__lines"), F.lit(1)),
    }
    return d.withColumn("__x", F.struct(*[x[k].cast("double").alias(k) for k in FEATURES])).drop("__w", "__lines")


@dataclass(frozen=True)
class Ranker:
    """score(x) = sum of weight * (x - mean) / spread; ``cut`` is the quantile that separates the labels."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    cut: float

    def raw(self, x: str = "__x") -> Column:
        total = F.lit(0.0)
        for k, w, m, s in zip(FEATURES, self.weights, self.means, self.spreads, strict=True):
            total = total + (F.col(f"{x}.{k}") - F.lit(m)) * F.lit(w / s)
        return total

    def score(self, x: str = "__x") -> Column:
        if not any(self.weights):
            return F.lit(0.5)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.cut - math.log(CUT / (1 - CUT))) - self.raw(x)))


def fit_pairs(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3, steps: int = 50, seed: int = 7) -> Ranker:
    """Newton's method on the mean logistic loss of w . (x_preferred - x_other), with a ridge.

    For arrays in memory and drawn pairs; the queries learn from all pairs, by ``fit``.
    """
    flat = Ranker((0.0,) * len(FEATURES), (0.0,) * len(FEATURES), (1.0,) * len(FEATURES), 0.0)
    if not len(y) or y.min() == y.max():
        return flat
    means, spreads = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z, rng = (x - means) / spreads, np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(max_pairs, 20 * len(y))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the pair being the other way round
        grad, curve = ridge * w - d.T @ p / n, (d.T * (p * (1 - p))) @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(z @ w)
    cut = float(np.quantile(s, CAUTION * (y == 0).mean()))
    return Ranker(tuple(map(float, w)), tuple(map(float, means)), tuple(map(float, spreads)), cut)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _slopes(u: np.ndarray) -> list[np.ndarray]:
    """log(1 + exp(-u)) and its first TERMS derivatives."""
    p = np.exp(-np.logaddexp(0, -u))
    out, poly = [np.logaddexp(0, -u), -np.exp(-np.logaddexp(0, u))], np.polynomial.Polynomial([0, 1])
    for _ in range(TERMS - 1):
        poly = poly.deriv() * np.polynomial.Polynomial([0, 1, -1])
        out.append(poly(p))
    return out


def _grouped(keys: np.ndarray, sums: np.ndarray) -> pa.Table:
    """Sums of the rows of equal keys (label, range)."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, sums = keys[order], sums[order]
    start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)][: len(keys)])
    keys, sums = keys[start], np.add.reduceat(sums, start) if len(start) else sums
    return pa.table({"y": pa.array(keys[:, 0], pa.int32()), "b": pa.array(keys[:, 1], pa.int32()), "v": pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))})


def _range_sums(ranker: Ranker, low: float, width: float):
    """For tasks: of each label and range of scores the sums of powers of the distance from its middle, alone and times measurements, and of their products."""
    w, means, spreads = map(np.array, (ranker.weights, ranker.means, ranker.spreads))
    i, j = np.triu_indices(len(w))

    def sums(batches):
        for batch in batches:
            y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            z = (np.stack(x, 1) - means) / spreads
            s = z @ w
            at_ = np.floor((s - low) / width).astype(int)
            t = s - (low + (at_ + 0.5) * width)
            powers = t[:, None] ** np.arange(TERMS)
            first = powers[:, :, None] * np.concatenate([np.ones((len(z), 1)), z], 1)[:, None, :]
            yield from _grouped(np.stack([y, at_], 1), np.concatenate([first.reshape(len(z), -1), z[:, i] * z[:, j]], 1)).to_batches()

    return sums


def _added(part: pa.Table) -> pa.Table:
    return _grouped(np.stack([part["y"].to_numpy(), part["b"].to_numpy()], 1), np.array(part["v"].to_pylist()))


def pair_loss(known: DataFrame, ranker: Ranker) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a row of label 1 and one of label 0, its gradient and (nearly) its curvature."""
    f = len(FEATURES)
    low, high = known.agg(F.min(ranker.raw()), F.max(ranker.raw())).first()
    width = max(WIDTH, (high - low) / RANGES)
    low, n = low - width, int((high - low) / width) + 3  # a range more on either side, for scores rounded otherwise
    parts = known.select("__y", *[F.col(f"__x.{k}") for k in FEATURES]).mapInArrow(_range_sums(ranker, low, width), "y int, b int, v array<double>")
    alone, times, squares = np.zeros((2, TERMS, n)), np.zeros((2, TERMS, n, f)), np.zeros((2, n, f, f))
    for y, at_, v in parts.groupBy("y", "b").applyInArrow(_added, "y int, b int, v array<double>").collect():
        first = np.array(v[: TERMS * (f + 1)]).reshape(TERMS, f + 1)
        alone[y, :, at_], times[y, :, at_] = first[:, 0], first[:, 1:]
        squares[y, at_][np.triu_indices(f)] = v[TERMS * (f + 1) :]
        squares[y, at_] += np.triu(squares[y, at_], 1).T
    slopes = _slopes(np.arange(1 - n, n) * width)
    over = lambda k, x, flip: np.convolve(k[::-1] if flip else k, x, "valid")  # noqa: E731  over ranges of the other label
    loss, grad = 0.0, np.zeros(f)
    for p in range(TERMS):
        for q in range(p + 1):
            c = math.comb(p, q) * (-1) ** (p - q) / math.factorial(p)
            loss += c * (alone[1, q] @ over(slopes[p], alone[0, p - q], False))
            grad += c * (over(slopes[p + 1], alone[0, p - q], False) @ times[1, q] - over(slopes[p + 1], alone[1, q], True) @ times[0, p - q])
    bend = slopes[2]
    cross = np.array([over(bend, times[0, 0, :, k], False) @ times[1, 0] for k in range(f)])
    curve = np.tensordot(over(bend, alone[0, 0], False), squares[1], 1) + np.tensordot(over(bend, alone[1, 0], True), squares[0], 1) - cross - cross.T
    pairs = alone[1, 0].sum() * alone[0, 0].sum()
    return loss / pairs, grad / pairs, curve / pairs


def kth(d: DataFrame, k: int, bins: int = 1024, few: int = 1000) -> float:
    """The value of column ``s`` with ``k`` rows before it in order: ranges are counted and narrowed to the one that has it."""
    low, high, n = d.agg(F.min("s"), F.max("s"), F.count("s")).first()
    while low < high:
        inside = d.filter(F.col("s").between(low, high))
        if n <= few:
            return sorted(r["s"] for r in inside.select("s").collect())[k]
        place = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("b")).agg(F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["b"]):
            if k < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    return low


def fit_measured(measures: DataFrame, labels: DataFrame, label_col: str = "quality", ridge: float = 1e-3, steps: int = 50) -> Ranker:
    """A Ranker from all labelled rows of ``measures`` (doc_id, __x) outside the held-out fold, and all their pairs."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("__y"))
    known = materialize(measures.join(known, "doc_id").select("__y", "__x"))
    of = lambda g: [g(F.col(f"__x.{k}")) for k in FEATURES]
    n, good, *stats = known.agg(F.count("__y"), F.sum("__y"), *of(F.avg), *of(F.stddev_pop)).first()
    f = len(FEATURES)
    if not n or good in (0, n):
        return Ranker((0.0,) * f, (0.0,) * f, (1.0,) * f, 0.0)
    # rounded, so that sums added up in another order give the same model
    means, spreads = (tuple(float(f"{x:.9g}") for x in part) for part in (stats[:f], [x if x > 1e-12 else 1.0 for x in stats[f:]]))

    def at_weights(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, grad, curve = pair_loss(known, Ranker(tuple(map(float, w)), means, spreads, 0.0))
        return loss + ridge / 2 * (w @ w), grad + ridge * w, curve + ridge * np.eye(f)

    w = np.zeros(f)
    loss, grad, curve = at_weights(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, grad)
        if np.abs(step).max() < 1e-8:
            break
        new = at_weights(w - step)
        while new[0] > loss + 1e-9 and np.abs(step).max() >= 1e-8:
            step = step / 2
            new = at_weights(w - step)
        w, (loss, grad, curve) = w - step, new
    flat = Ranker(tuple(round(float(x), 7) for x in w), means, spreads, 0.0)
    place = CAUTION * (1 - good / n) * (n - 1)
    scores = known.select(flat.raw().alias("s"))
    low, high = kth(scores, math.floor(place)), kth(scores, math.ceil(place))
    return replace(flat, cut=low + (place - math.floor(place)) * (high - low))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text") -> Ranker:
    """A Ranker from all labelled rows of ``docs`` outside the held-out fold."""
    return fit_measured(measured(docs.select("doc_id", F.col(text_col).alias("text"))).select("doc_id", "__x"), labels, label_col)


def scored(measures: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``measures`` (doc_id, __x)."""
    return measures.select("doc_id", held_out().alias("held_out"), ranker.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    return scored(measured(docs.select(at(id_col).alias("doc_id"), at(text_col).alias("text"))), ranker)


def accepted(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the ranker predicts as 1, with their own columns."""
    return unpacked(measured(packed(docs, text=at(text_col))).filter(ranker.score() >= CUT), docs.columns)


def learned(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a ranker learned from their labels predicts as 1; texts are measured once."""
    d = materialize(measured(packed(docs, doc_id=at("doc_id"), text=at(text_col))).drop("text"))
    return unpacked(d.filter(fit_measured(d.select("doc_id", "__x"), labels).score() >= CUT), docs.columns)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    measures = materialize(measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__x"))
    return scored(measures, fit_measured(measures, table(spark, sf_dir, "labels")))
