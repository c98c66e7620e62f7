"""Removal of repeated substrings by suffix sorting (operator 10).

Every 100-byte string that also starts earlier (in a document of smaller id, or earlier in the same one) is found,
and the bytes it covers are removed.

1. Each 100-byte window is filed under its least 24-byte gram by hash, the window's anchor. Equal windows have equal
   anchors at equal places, so only windows under an anchor that occurs twice can repeat. Neighbouring windows with
   one anchor make a context: one row for some 39 windows, with the hash of its bytes.
2. Of contexts with equal bytes (128 bits of hash) all but the first are covered whole.
3. Anchors that still have several different contexts get the contexts' bytes, and their windows (suffixes, cut at
   100 bytes) are sorted deep-shallow: a multikey sort of all suffixes at once, eight bytes a step, to a shallow
   depth; ranges that are still tied and not all equal go to blind tries. Equal suffixes after the first are covered.
   An anchor with very many different contexts is sorted in chunks by hash; what is left of each chunk, the first of
   each of its suffixes, is merged over the chunks by an aggregation.

Anchors that are frequent in a bounded sample of documents are known to repeat, so their rows are salted: no task
gets all rows of an anchor. Work and shuffles grow with the input; nothing is capped.

Defined results: null and empty texts have 0 bytes and the hash of no bytes; repeated rows of one id and text count as
one document, and its removed spans apply to each of them; rows without an id, and rows of one id with different texts,
which have no order, neither lose bytes nor make others lose any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ships, small, table

ships(__name__)

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time; longer documents are cut into pieces that overlap by LENGTH - 1 bytes.
BUFFER = 1 << 20
#: Steps of eight bytes of the multikey sort.
SHALLOW = 3
SAMPLE_DOCS = 20_000
#: So many rows of an anchor in the sample make it frequent.
FREQUENT = 50
SALTS = 64
#: Frequent anchors are broadcast up to so many; texts have no size limit, so there may be more.
FREQUENT_ROWS = 100_000
#: Anchors with more different contexts are sorted in chunks of about so many.
CROWD = 4096

_R = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd bases of the two polynomial hashes
_M = np.uint64(0xFF51AFD7ED558CCD)


class Powers:
    """Powers of a base and of its inverse, modulo 2 ** 64."""

    def __init__(self, base: int, n: int) -> None:
        self.up, self.down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        for p in (self.up, self.down):
            p[0] = 1
            np.cumprod(p, dtype=np.uint64, out=p)

    def sums(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], dtype=np.uint64, out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.down[: len(sums)][start]
        x ^= x >> np.uint64(31)
        x *= _M
        return x ^ (x >> np.uint64(29))


def sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive keys, by minima from the left and the right of blocks."""
    n = len(keys) - span + 1
    blocks = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


def contexts_of(pieces: list[tuple[int, int, bytes]], gram: Powers, whole: Powers) -> dict[str, np.ndarray]:
    """Contexts of (doc_id, offset, bytes) pieces: doc_id, anchor hash h, content hash c, at = 256 * start + windows."""
    sizes = np.array([len(p[2]) for p in pieces])
    b = np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8)
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return {"doc_id": none, "h": none, "c": none, "at": none}
    sums = gram.sums(b)
    g = gram.hashes(sums, slice(0, len(b) - GRAM + 1), slice(GRAM, len(b) + 1))
    low = np.uint64(2 * BUFFER - 1)
    least = sliding_least((g & ~low) | np.arange(len(g), dtype=np.uint64), SPAN)
    at = (least & low).astype(np.int64)  # the anchor of the window that starts here
    first = np.cumsum(sizes) - sizes
    fits = np.zeros(len(at) + 1, bool)  # windows within one piece
    for s, n in zip(first, sizes, strict=True):
        if n >= LENGTH:
            fits[s : s + n - LENGTH + 1] = True
    fits[len(at) :] = False
    fits = fits[: len(at)]
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (at[1:] != at[:-1])
    last = fits.copy()
    last[:-1] &= ~fits[1:] | new[1:]
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    piece = np.searchsorted(first, s, side="right") - 1
    ids, offsets = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    n = e - s + 1
    c = whole.hashes(whole.sums(b), s, e + LENGTH)
    return {"doc_id": ids[piece], "h": g[at[s]].view(np.int64), "c": c.view(np.int64), "at": (s - first[piece] + offsets[piece]) * 256 + n}


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gram, whole = Powers(_R[0], 2 * BUFFER), Powers(_R[1], 2 * BUFFER)
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(contexts_of(pieces, gram, whole))

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b = text.as_py()
            if b is None or len(b) < LENGTH:
                continue
            for o in range(0, len(b) - LENGTH + 1, BUFFER - LENGTH + 1):
                pieces.append((i, o, b[o : o + BUFFER]))
                held += len(pieces[-1][2])
                if held >= BUFFER:
                    yield flush()
                    pieces, held = [], 0
    if pieces:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, doc_id, wanted (h, at, n) to rows with the contexts' bytes."""
    for batch in batches:
        h, doc, start, n, data = [], [], [], [], []
        for text, i, wanted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            b = text.as_py() or b""
            for w in wanted:
                s, windows = w["at"] >> 8, w["at"] & 255
                if s + windows + LENGTH - 1 <= len(b):
                    h.append(w["h"])
                    doc.append(i)
                    start.append(s)
                    n.append(w["n"])
                    data.append(b[s : s + windows + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["h", "doc_id", "start", "n", "data"])


class BlindTrie:
    """A Patricia trie over byte strings of one length; a leaf holds the positions of equal strings."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.root = texts, None
        for i in range(len(texts)):
            self._add(i)

    def _add(self, i: int) -> None:
        s, node = self.texts[i], self.root
        if node is None:
            self.root = [i]
            return
        while isinstance(node, tuple):  # blindly: characters between branchings are not looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = self.texts[node[0]]
        differ = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        if not differ:
            node.append(i)
            return
        common = len(s) - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == common:
            node[1][s[common]] = [i]
            return
        inner = (common, {t[common]: node, s[common]: [i]})
        if parent is None:
            self.root = inner
        else:
            parent[1][s[parent[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Positions of equal strings, in the order of the strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                out.append(node)
        return out


def _runs(change: np.ndarray) -> np.ndarray:
    """Label of the run each sorted element is in, from where runs begin."""
    return np.cumsum(change) - 1


def deep_shallow(text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of ``text`` (n x LENGTH bytes) with an equal row in their group, and a label for equal ones."""
    wide = np.zeros((len(text), -(-LENGTH // 8) * 8), np.uint8)
    wide[:, :LENGTH] = text
    words = wide.view(">u8").astype(np.uint64)
    act, label = np.arange(len(text)), group
    for level in range(SHALLOW):
        if not len(act):
            break
        order = np.lexsort((words[act, level], label))
        act, label, w = act[order], label[order], words[act[order], level]
        change = np.ones(len(act), bool)
        change[1:] = (label[1:] != label[:-1]) | (w[1:] != w[:-1])
        label = _runs(change)
        several = np.bincount(label)[label] > 1
        act, label = act[several], label[several]
    if not len(act):
        return act, label
    head = np.ones(len(act), bool)
    head[1:] = label[1:] != label[:-1]
    label = _runs(head)
    same = (words[act, SHALLOW:] == words[act[np.flatnonzero(head)][label], SHALLOW:]).all(1)
    mixed = np.bincount(label, weights=~same) > 0
    fresh = label.max() + 1
    keep = np.ones(len(act), bool)
    bounds = np.append(np.flatnonzero(head), len(act))
    for r in np.flatnonzero(mixed):
        own = np.arange(bounds[r], bounds[r + 1])
        for leaf in BlindTrie([text[i].tobytes() for i in act[own]]).leaves():
            label[own[leaf]] = fresh
            fresh += 1
            keep[own[leaf]] = len(leaf) > 1
    return act[keep], label[keep]


def repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Spans (doc_id, start, end) of windows that repeat an earlier one, among groups of contexts with one anchor; of
    groups that are chunks also all other windows, with their hash as ``window``."""
    data = rows["data"].tolist()
    n = np.array([len(d) - LENGTH + 1 for d in data])
    b = np.frombuffer(b"".join(data), np.uint8)
    first = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, group = np.unique(rows["g"].to_numpy(), return_inverse=True)
    windows = np.lib.stride_tricks.sliding_window_view(b, LENGTH)
    act, label = deep_shallow(windows[first[row] + within], group[row])
    doc, start = rows["doc_id"].to_numpy()[row[act]], rows["start"].to_numpy()[row[act]] + within[act]
    order = np.lexsort((start, doc, label))
    doc, start, label = doc[order], start[order], label[order]
    head = np.ones(len(doc), bool)
    head[1:] = label[1:] != label[:-1]
    of = np.flatnonzero(head)[_runs(head)] if len(doc) else np.empty(0, np.int64)
    later = (doc != doc[of]) | (start != start[of])
    spans = _spans(doc[later], start[later]).assign(window=None)
    left = (rows["n"].to_numpy() > CROWD)[row]
    left[act[order[later]]] = False
    left = np.flatnonzero(left)
    if not len(left):
        return spans
    start = rows["start"].to_numpy()[row[left]] + within[left]
    hashes = [hashlib.blake2b(windows[i].tobytes(), digest_size=16).digest() for i in first[row[left]] + within[left]]
    return pd.concat([spans, pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[row[left]], "start": start, "end": start + LENGTH, "window": hashes})])


def _spans(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new, last = np.ones(len(doc), bool), np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    last[:-1] = new[1:]
    return pd.DataFrame({"doc_id": doc[new], "start": start[new], "end": start[last] + LENGTH})


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by g; a group that goes on in the next batch waits for it. Groups hold about CROWD contexts at most."""
    left: pd.DataFrame | None = None
    for b in batches:
        b = b if left is None else pd.concat([left, b], ignore_index=True)
        cut = int(np.searchsorted(b["g"].to_numpy(), b["g"].iloc[-1])) if len(b) else 0
        left = b.iloc[cut:]
        if cut:
            yield repeated(b.iloc[:cut])
    if left is not None and len(left):
        yield repeated(left)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, data, spans to the contract's columns and the merged spans."""
    for batch in batches:
        out = []
        for data, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            b, at, gone, parts, runs = data.as_py() or b"", 0, 0, [], []
            for s in sorted((x["start"], min(x["end"], len(b))) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                elif s[0] < s[1]:
                    runs.append([*s])
            for s, e in runs:
                parts.append(b[at:s])
                gone += e - s
                at = e
            parts.append(b[at:])
            out.append((len(b), gone, len(runs), hashlib.sha256(b"".join(parts)).hexdigest(), b"".join(parts)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end) in bytes, overlapping, of all windows of (doc_id, data) that also start earlier."""
    scan = lambda d: d.select("doc_id", "data").mapInArrow(_contexts, "doc_id long, h long, c long, at long")
    part = int(1e6 * min(1.0, SAMPLE_DOCS / max(1, docs.count())))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < part)
    frequent = materialize(scan(sample).groupBy("h").count().filter(F.col("count") >= FREQUENT).select("h", F.lit(True).alias("frequent")))
    found = scan(docs).join(small(frequent, FREQUENT_ROWS), "h", "left")
    found = found.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    found = found.withColumn("m", F.count("*").over(Window.partitionBy("h", "salt"))).filter("frequent OR m > 1")
    twice = materialize(found.select("doc_id", "h", "c", "at"))

    kinds = materialize(twice.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at")).alias("first")))
    end = F.shiftright("at", 8) + F.col("at").bitwiseAND(F.lit(255)) + (LENGTH - 1)
    whole = twice.join(kinds, ["h", "c"]).filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.at") != F.col("at"))).select("doc_id", F.shiftright("at", 8).alias("start"), end.alias("end"))

    several = kinds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = kinds.join(several, "h").select("first.doc_id", F.struct("h", "first.at", "n").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    held = docs.join(wanted, "doc_id").select("data", "doc_id", "wanted").mapInArrow(_cut, "h long, doc_id long, start long, n long, data binary")
    held = materialize(held)
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("n") / CROWD))
    dealt = held.withColumn("g", F.when(F.col("n") > CROWD, F.xxhash64("h", chunk)).otherwise(F.col("h")))
    ordered = dealt.repartition("g").sortWithinPartitions("g").mapInPandas(_sorted_groups, "doc_id long, start long, end long, window binary")
    ordered = materialize(ordered)
    left = ordered.filter("window IS NOT NULL")
    least = left.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last")).filter("first <> last")
    again = left.join(least, "window").filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.start") != F.col("start"))).select("doc_id", "start", "end")
    return whole.unionByName(ordered.filter("window IS NULL").drop("window")).unionByName(again)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept holds the bytes left over."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    texts = d.select("doc_id", F.xxhash64("data").alias("t")).groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    several = small(materialize(texts.filter("a <> b").select("doc_id")))
    spans = materialize(repeated_spans(d.filter("doc_id IS NOT NULL").join(several, "doc_id", "left_anti")))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return d.join(spans, "doc_id", "left").select("doc_id", "data", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = {"op10_suffixes": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(b[s + 1:s + 100]) AS h FROM d, range(0, greatest(n - 99, 0)) AS r(s)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS fresh FROM f),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g) GROUP BY doc_id, k),
x AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS after FROM r),
k AS (SELECT d.doc_id, sum(hi - lo) AS gone, count(*) AS runs, string_agg(CASE WHEN lo > before THEN hex(b[before + 1:lo]) ELSE '' END || CASE WHEN after IS NULL AND n > hi THEN hex(b[hi + 1:n]) ELSE '' END, '' ORDER BY lo) AS kept
  FROM x JOIN d ON d.doc_id = x.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(CASE WHEN k.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""}
