"""Periodic runs of words (operator 13): block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal) of at least four periods, and six words,
that no neighbouring word extends.

Periods from b to 2b - 1, for b = 1, 2, 4, ..., are found together. A run of such a period holds at least two blocks
of b words, aligned to multiples of b, each of which recurs q words further on. For every block the sums of squared
differences to the following window, at all distances from b to 2b - 1, come from one convolution: a number-theoretic
transform modulo two primes, whose product exceeds every sum, so that both residues are zero just where no word
differs. Neighbouring blocks that recur at one distance form a chain; what lies within one block of its ends is
compared word by word, which gives the run.

Two exact tests spare convolutions. A block recurs at less than 2b only if each of its words does, so blocks with a
word that doesn't come again so soon are left out. A block whose window lies in a run of a period below b shows
multiples of that period only (Fine and Wilf), so it is left out too; multiples at the ends of such runs likewise.

Words of many texts are put behind each other under numbers of their own, so that equal words of two texts differ.
All is one pass over the table, without a shuffle; a task holds some texts' words as numbers.

Defined results: a null or blank text has no words and no runs; repeated rows are rows of their own; a null id counts
as the empty string in the disturbance of the query; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC, CRC_TABLE, ships, table

ships(__name__)

#: A run has at least so many periods, and so many words.
PERIODS, WORDS = 4, 6
#: Words whose runs are looked for at a time, unless one text has more.
BATCH = 400_000
#: Numbers that one convolution works on at a time.
CELLS = 1 << 21
#: Texts of more bytes are split word by word instead of at once.
LONG = 1 << 22
#: Two primes of the form c * 2^k + 1, both with the primitive root 3.
PRIMES = (998244353, 469762049)

_WORD = re.compile(rb"[^ \x09-\x0d]+")


def _twiddles(n: int, p: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order n, n / 2 of them."""
    root = pow(3, (p - 1) // n, p)
    if inverse:
        root = pow(root, p - 2, p)
    out = np.ones(max(1, n // 2), np.int64)
    done = 1
    while done < len(out):  # the second half of a stretch is the first times a power
        step = min(done, len(out) - done)
        out[done : done + step] = out[:step] * pow(root, done, p) % p
        done += step
    return out


def _forward(x: np.ndarray, p: int) -> np.ndarray:
    """Transform of the rows of x (decimation in frequency): natural order in, bit-reversed order out."""
    rows, n = x.shape
    w = _twiddles(n, p, False)
    x, half = x.copy(), n // 2
    while half:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        v[:, :, 0] = a % p
        v[:, :, 1] = b % p * w[:: n // 2 // half][:half] % p
        half //= 2
    return x


def _backward(x: np.ndarray, p: int) -> np.ndarray:
    """Inverse of ``_forward``: bit-reversed order in, natural order out."""
    rows, n = x.shape
    w = _twiddles(n, p, True)
    x, half = x.copy(), 1
    while half < n:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0].copy(), v[:, :, 1] * w[:: n // 2 // half][:half] % p
        v[:, :, 0] = (a + b) % p
        v[:, :, 1] = (a - b) % p
        half *= 2
    return x * pow(n, p - 2, p) % p


def mismatch_free(x: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into starts, distance) wherever the b numbers from a start recur at a distance from b to 2b - 1.

    ``x`` has to go on for 3b - 1 numbers behind every start.
    """
    blocks, shifts = [], []
    step, n = max(1, CELLS // (2 * b)), 2 * b
    for at in range(0, len(starts), step):
        s = starts[at : at + step, None]
        block, window = x[s + np.arange(b)], x[s + np.arange(b, 3 * b - 1)]
        zero = np.ones((len(s), b), bool)
        for p in PRIMES:
            a, w = np.zeros((len(s), n), np.int64), np.zeros((len(s), n), np.int64)
            a[:, :b] = block[:, ::-1] % p
            w[:, : 2 * b - 1] = window % p
            cross = _backward(_forward(a, p) * _forward(w, p) % p, p)[:, b - 1 : 2 * b - 1]
            squares = np.cumsum(w * w % p, axis=1) % p
            ahead = squares[:, b - 1 : 2 * b - 1].copy()
            ahead[:, 1:] -= squares[:, : b - 1]
            own = (a * a % p).sum(1, keepdims=True)
            zero &= (own + ahead - 2 * cross) % p == 0
        i, d = np.nonzero(zero)
        blocks.append(i + at)
        shifts.append(d + b)
    return (np.concatenate(blocks), np.concatenate(shifts)) if blocks else (np.empty(0, np.int64), np.empty(0, np.int64))


def runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of x, by start, then period; no run is longer than ``longest``."""
    size = len(x)
    if size < WORDS:
        return []
    order = np.argsort(x, kind="stable")
    after = np.full(size, 2 * size + 2, np.int64)  # distance to the next equal number
    same = x[order[1:]] == x[order[:-1]]
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    covered = np.zeros(size, np.int64)  # where the furthest run of a smaller period that holds a place ends
    found: list[tuple[int, int, int]] = []
    b = 1
    while PERIODS * b <= longest:
        m = size // b
        live = np.flatnonzero(after[: m * b].reshape(m, b).max(1) < 2 * b) * b
        live = live[covered[live] < live + 3 * b - 1]
        if len(live) > 1:
            padded = np.concatenate([x, np.arange(int(x.max()) + 1, int(x.max()) + 1 + 3 * b)])
            i, d = mismatch_free(padded, live, b)
            at = live[i]
            new = at + d + b > covered[at]
            at, d = at[new], d[new]
            now = []
            by = np.lexsort((at, d))
            at, d = at[by], d[by]
            cuts = np.flatnonzero((np.diff(at) != b) | (np.diff(d) != 0)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]), strict=True):
                if hi - lo < 2:  # a run of four periods holds two blocks
                    continue
                q, first, last = int(d[lo]), int(at[lo]), int(at[hi - 1]) + b
                left = max(0, first - b)
                differs = np.flatnonzero(x[left:first] != x[left + q : first + q])
                start = left + int(differs[-1]) + 1 if len(differs) else left
                right = min(size - q, last + b)
                differs = np.flatnonzero(x[last:right] != x[last + q : right + q])
                end = q + (last + int(differs[0]) if len(differs) else right)
                if end - start >= max(WORDS, PERIODS * q):
                    now.append((start, end, q))
            for start, end, _ in now:
                np.maximum(covered[start:end], end, out=covered[start:end])
            found += now
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words of a text as numbers from 0, and the word of each number."""
    known: dict[bytes, int] = {}
    split = text.split() if len(text) <= LONG else (m[0] for m in _WORD.finditer(text))
    return np.fromiter((known.setdefault(w, len(known)) for w in split), np.int64), list(known)


def disturbed(doc_id: int | None, x: np.ndarray) -> np.ndarray:
    """The query's words: in one text of ten, those from a place chosen by the id on repeat with a period."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(x)
    if h % 10 or not n:
        return x
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([x[:a], x[a + np.arange(n - a) % p]])


def _digest(x: np.ndarray, words: list[bytes]) -> str:
    """SHA-256 of the words, joined by one space."""
    sha, sep = hashlib.sha256(), b""
    for at in range(0, len(x), 100_000):
        sha.update(sep + b" ".join([words[i] for i in x[at : at + 100_000].tolist()]))
        sep = b" "
    return sha.hexdigest()


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def _row(own: list[tuple[int, int, int]], x: np.ndarray, words: list[bytes]) -> tuple:
    keep = np.ones(len(x), bool)
    for start, end, q in own:
        keep[start + q : end] = False
    best = max(own, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own)
    return (len(own), *four, hashlib.sha256(listed.encode()).hexdigest(), _digest(x[keep], words))


def _measured(change: Callable[[int | None, np.ndarray], np.ndarray] | None):
    """doc_id, text to doc_id and the columns of ``SCHEMA``."""

    def flush(held: list) -> Iterator[tuple]:
        at, base, parts, starts = 0, 0, [], [0]
        for x, words in held:
            parts.append(x + base)
            base += len(words)
            at += len(x)
            starts.append(at)
        every = np.concatenate(parts) if parts else np.empty(0, np.int64)
        own: dict[int, list] = {}
        for start, end, q in runs(every, max((len(x) for x, _ in held), default=0)):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            own.setdefault(k, []).append((start - starts[k], end - starts[k], q))
        for k, (x, words) in enumerate(held):
            yield _row(own.get(k, []), x, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held, rows, total = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), [], [], 0
            for i, text in zip(ids, texts, strict=True):
                x, words = numbered(text.as_py() or b"")
                held.append((change(i, x) if change else x, words))
                total += len(x)
                if total >= BATCH:
                    rows += flush(held)
                    held, total = [], 0
            rows += flush(held)
            columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
            made = [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """doc_id, the number of runs, the longest run, digests of the runs and of the text without repeats, for each row.

    ``change(doc_id, words as numbers)`` may alter a text's words before they are looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_measured(change), f"doc_id {kind}, {SCHEMA}")


def _collapsing():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_py()
                x, words = numbered(raw or b"")
                own, keep = runs(x, len(x)), np.ones(len(x), bool)
                for start, end, q in own:
                    keep[start + q : end] = False
                out.append(raw if not own else b" ".join([words[i] for i in x[keep].tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "text"])

    return run


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run cut to its first period; texts without runs stay as they are, others lose their spacing."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_collapsing(), rows.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=disturbed)


ORACLE = {"op13_periodic_runs": rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {CRC.format(x="coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM d, crc),
a AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
m AS (SELECT doc_id, n, CASE WHEN changed THEN list_transform(w, lambda x, i: w[CASE WHEN i - 1 >= a THEN a + (i - 1 - a) % p + 1 ELSE i END]) ELSE w END AS w FROM p),
o AS (SELECT doc_id, n, unnest(w) AS word, CAST(unnest(range(0, n)) AS BIGINT) AS i FROM m WHERE n > 0),
j AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
k AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, arg_max(k, (length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM k GROUP BY doc_id),
c AS (SELECT doc_id, list(start + period) AS lo, list(start + length) AS hi FROM k GROUP BY doc_id),
t AS (SELECT m.doc_id, list_filter(m.w, lambda x, i: c.lo IS NULL OR NOT list_bool_or(list_transform(c.lo, lambda y, z: i - 1 >= y AND i - 1 < c.hi[z]))) AS w FROM m LEFT JOIN c ON m.doc_id = c.doc_id)
SELECT t.doc_id, coalesce(b.n_runs, 0) AS n_runs, CAST(b.best.start AS BIGINT) AS start, CAST(b.best.length AS BIGINT) AS length, CAST(b.best.period AS BIGINT) AS period,
  CAST(1000 * b.best.length // b.best.period AS BIGINT) AS exponent_milli, sha256(coalesce(b.listed, '')) AS runs_sha256, sha256(array_to_string(t.w, ' ')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.doc_id = b.doc_id
"""}
