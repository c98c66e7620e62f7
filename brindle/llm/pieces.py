"""SentencePiece encoding and decoding (operator 5): n-best segmentation over the piece lattice.

A forward Viterbi pass finds the best score from the start to every position. A backward A* search from the end
then takes partial segmentations by (score so far + best forward score): the heuristic is exact, so complete ones
come out best first. Pieces hold a space at their start only and a line feed never, so a text's lattice falls
into chunks (spaces with the word after them, line feeds) whose n best combine to the text's n best.

Order of segmentations, for all searches alike: the greater sum of scores (in units of 2 ** -6, none below -100,000); of equal sums the one
whose last pieces are longer, i.e. the smaller number if each cut at position p < 24 of the chunk counts 2 ** p (a
fixed weight below 2 ** 24 at later ones); of equal chunks of one text the earlier is changed first. A chunk is so
cut alike wherever it stands. This is the best segmentation by the model's scores. Where a model file is of the BPE
kind its scores are merge ranks, and its own encoder, which merges greedily, gives other ids; both decode to the text.

The vocabulary with its scores is read from a ``.model`` file and never trained. Characters outside it become
UTF-8 byte pieces. Texts get one space in front, as the model expects; decoding takes it off. Literal U+2581 is
an ordinary character here (byte pieces), so decoding gives back every text exactly.

Defined results: null and empty texts have no pieces; their decoded form is the empty text. Repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ships, table

ships(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: How far below the worst piece a byte of a character without a piece scores.
UNKNOWN = 10.0
#: Scores below it, which some models give to pieces that they avoid, count as it.
FLOOR = -100_000.0
#: Chunks remembered by a task, and piece ids of theirs; and characters segmented at a time.
REMEMBERED, HELD, CHARS = 400_000, 8_000_000, 4_000_000
#: Words of at most so many characters are searched so many at once; others, and unknown characters, one by one.
WIDE, BLOCK = 24, 4096
#: No way, in blocks: beyond all sums of WIDE weights.
LOW = -(1 << 61)
LOOSE = re.compile(r" *[^ ]+| +")

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def cut(position: int) -> int:
    """What a cut before a position of a chunk counts among equal scores."""
    return 1 << position if position < WIDE else 1 + position * 2654435761 % (1 << WIDE)


class Prefixes:
    """All prefixes of all pieces by hash, in two tables, so that many words are walked at once."""

    def __init__(self, pieces: dict[str, int]) -> None:
        known: dict[str, int] = {}
        for p, i in pieces.items():
            for end in range(1, len(p)):
                known.setdefault(p[:end], -1)
            known[p] = i
        self.piece = np.array(list(known.values()), np.int32)
        self.key = np.array([self._hash(p) for p in known], np.uint64)
        if len(np.unique(self.key)) < len(self.key):
            raise ValueError("two prefixes have one hash")
        every = np.arange(len(known), dtype=np.int32)
        self.one = self._table(np.uint64(_MIX), every)
        rest = every[self.one[self._slot(self.key, np.uint64(_MIX))] != every]
        for m in range(_MIX + 2, _MIX + 20_000, 2):
            self.mix = np.uint64(m)
            if len(np.unique(self._slot(self.key[rest], self.mix))) == len(rest):
                break
        else:
            raise ValueError("no table for the prefixes")
        self.two = self._table(self.mix, rest)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(keys: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * mix) >> np.uint64(44)

    def _table(self, mix: np.uint64, which: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, np.int32)
        out[self._slot(self.key[which], mix)] = which
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the prefix with each key; -1 without."""
        a = self.one[self._slot(keys, np.uint64(_MIX))]
        miss = np.flatnonzero(self.key[a] != keys)
        b = self.two[self._slot(keys[miss], self.mix)]
        a[miss] = np.where(self.key[b] == keys[miss], b, -1)
        return a


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by text (a space instead of U+2581) with their ids; of every id the bytes, the score, and the score in
    units of 2 ** -6, times 2 ** 32; ids of the byte pieces; the length of the longest piece; all prefixes."""

    pieces: dict[str, int]
    spelled: list[bytes]
    scores: np.ndarray
    weights: np.ndarray
    byte_ids: list[int]
    reach: int
    prefixes: Prefixes

    def edges(self, chunk: str, start: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(end, weight, ids) of the lattice edges from a position."""
        out = []
        for end in range(start + 1, min(len(chunk), start + self.reach) + 1):
            if (i := self.pieces.get(chunk[start:end])) is not None:
                out.append((end, int(self.weights[i]) - cut(end), (i,)))
        if chunk[start] not in self.pieces:
            ids = tuple(self.byte_ids[b] for b in chunk[start].encode("utf-8", "surrogatepass"))
            out.append((start + 1, sum(int(self.weights[i]) for i in ids) - cut(start + 1), ids))
        return out


def load(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size()
    pieces, spelled, byte_ids, scores = {}, [], [0] * 256, np.zeros(size)
    for i in range(size):
        text = sp.id_to_piece(i).replace("▁", " ")
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelled.append(b"")
        else:
            if "\n" in text or " " in text.lstrip(" "):
                raise ValueError(f"piece {text!r} would cross the chunks that texts are cut into")
            pieces[text] = i
            scores[i] = max(FLOOR, sp.get_score(i))
            spelled.append(text.encode())
    scores[byte_ids] = min(scores[i] for i in pieces.values()) - UNKNOWN
    weights = np.round(scores * 64).astype(np.int64) << 32
    return Vocabulary(pieces, spelled, scores, weights, byte_ids, max(map(len, pieces)), Prefixes(pieces))


def viterbi(chunk: str, v: Vocabulary) -> tuple[int, int, tuple[int, ...]]:
    """Best weight, second best (or minus infinity), and the ids of the best segmentation, in memory linear in the length."""
    size = len(chunk)
    none = float("-inf")
    first, second, back = [none] * (size + 1), [none] * (size + 1), [(0, ())] * (size + 1)
    first[0] = 0
    for start in range(size):
        one, two = first[start], second[start]
        for end, weight, ids in v.edges(chunk, start):
            x = one + weight
            second[end] = max(second[end], min(first[end], x), two + weight)
            if x > first[end]:
                first[end], back[end] = x, (start, ids)
    at, parts = size, []
    while at:
        at, ids = back[at]
        parts.append(ids)
    return first[size], second[size], tuple(itertools.chain.from_iterable(reversed(parts)))


def viterbi_block(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``viterbi`` of many words of at most WIDE characters at once: best and second best weights, numbers of ids
    (0 for a word with a character without a piece), and all ids in a row."""
    n, size = len(words), np.array([len(w) for w in words])
    wide = int(size.max())
    codes = np.array(words, f"U{wide}").view(np.uint32).reshape(n, wide)
    reach = min(v.reach, wide)
    gain, piece = np.full((reach, wide, n), LOW, np.int64), np.zeros((reach, wide, n), np.int32)
    row, start = np.nonzero(np.arange(wide) < size[:, None])
    h = np.zeros(len(row), np.uint64)
    for k in range(reach):  # pieces of k + 1 characters
        in_ = start + k < size[row]
        row, start = row[in_], start[in_]
        h = h[in_] * _BASE + codes[row, start + k] + np.uint64(1)
        p = v.prefixes.find(h)
        row, start, h, p = row[p >= 0], start[p >= 0], h[p >= 0], p[p >= 0]
        ids = v.prefixes.piece[p]
        whole = np.flatnonzero(ids >= 0)
        gain[k, start[whole], row[whole]] = v.weights[ids[whole]]
        piece[k, start[whole], row[whole]] = ids[whole]
    known = ((gain[0] > LOW).T | (np.arange(wide) >= size[:, None])).all(1)
    first, second = np.full((wide + 1, n), LOW, np.int64), np.full((wide + 1, n), LOW, np.int64)
    back = np.zeros((wide + 1, n), np.int8)
    first[0] = 0
    for end in range(1, wide + 1):
        one, two = first[end], second[end]
        for k in range(min(end, reach)):
            g = gain[k, end - k - 1]
            x = first[end - k - 1] + g
            np.maximum(two, np.minimum(one, x), out=two)
            np.maximum(two, second[end - k - 1] + g, out=two)
            back[end][x > one] = k + 1
            np.maximum(one, x, out=one)
        one -= cut(end)
        two -= cut(end)
    act, at, rows, ids = np.flatnonzero(known), size.copy(), [], []
    while len(act):
        k = back[at[act], act]
        at[act] -= k
        rows.append(act)
        ids.append(piece[k - 1, at[act], act])
        act = act[at[act] > 0]
    none = np.empty(0, np.int64)
    row, turn = np.concatenate([none, *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    every = np.arange(n)
    return first[size, every], second[size, every], np.bincount(row, minlength=n), np.concatenate([none, *ids])[np.lexsort((-turn, row))]


def n_best(chunk: str, v: Vocabulary, n: int = N_BEST) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``n`` best segmentations, (weight, ids), best first: forward Viterbi, then backward A*."""
    size = len(chunk)
    into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # edges by their end
    best = [0] + [float("-inf")] * size
    for start in range(size):
        for end, weight, ids in v.edges(chunk, start):
            into[end].append((start, weight, ids))
            best[end] = max(best[end], best[start] + weight)
    turn = itertools.count()
    heap = [(-best[size], size, next(turn), 0, None)]
    out: list[tuple[int, tuple[int, ...]]] = []
    while heap and len(out) < n:
        _, at, _, weight, path = heapq.heappop(heap)
        if not at:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((weight, tuple(ids)))
            continue
        for start, w, ids in into[at]:
            heapq.heappush(heap, (-(weight + w + best[start]), start, next(turn), weight + w, (ids, path)))
    return out


class Numbers(dict):
    """Numbers of chunks, given as they come; what is new waits in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = i = len(self)
        return i


class Spaced(dict):
    """Numbers of the chunks that are a space and a word, by word."""

    def __init__(self, numbers: Numbers) -> None:
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        self[word] = i = self.numbers[" " + word]
        return i


class Encoder:
    """Segments texts. Chunks are numbered as they come; their Viterbi results lie in growing arrays, so that all but
    the lookup of a chunk's number is done on many texts at once. Forgets all when there are many chunks."""

    def __init__(self, v: Vocabulary, n: int) -> None:
        self.v, self.n = v, n
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.spaced = Spaced(self.number)
        self.ranked: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self.exact: dict[int, int] = {}
        self.size, self.used = 0, 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.loss = np.zeros(1 << 16)
        self.ids = np.zeros(1 << 18, np.int32)

    def _hold(self, own: np.ndarray, loss: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.count[own], self.loss[own] = counts, loss
        self.at[own] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        """Viterbi results of the chunks that are new."""
        fresh, self.number.fresh = self.number.fresh, []
        while self.size + len(fresh) > len(self.at):
            self.at, self.count, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count, self.loss))
        lengths = np.array([len(c) for c in fresh])
        short = np.flatnonzero(lengths <= WIDE)
        short = short[np.argsort(lengths[short], kind="stable")]
        alone = np.flatnonzero(lengths > WIDE).tolist()
        for o in range(0, len(short), BLOCK):
            own = short[o : o + BLOCK]
            first, second, counts, ids = viterbi_block([fresh[k] for k in own], self.v)
            alone += own[counts == 0].tolist()
            whole = counts > 0
            self._hold(self.size + own[whole], np.where(second > LOW // 2, first - second, np.inf)[whole], counts[whole], ids)
        for k in alone:
            first, second, ids = viterbi(fresh[k], self.v)
            self._hold(np.array([self.size + k]), np.array([float(first - second)]), np.array([len(ids)]), np.array(ids, np.int32))
        self.size += len(fresh)

    def alternatives(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        if chunk not in self.ranked:
            self.ranked[chunk] = n_best(chunk, self.v, self.n)
        return self.ranked[chunk]

    def _numbers(self, text: str) -> np.ndarray:
        """Numbers of a text's chunks, in order."""
        out: list[int] = []
        for j, line in enumerate((" " + text).split("\n")):
            if j:
                out.append(self.number["\n"])
            if "  " in line:
                out += map(self.number.__getitem__, LOOSE.findall(line))
            else:
                head, *rest = line.split(" ")
                if head:
                    out.append(self.number[head])
                out += map(self.spaced.__getitem__, rest)
        return np.array(out, np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list]]:
        """Of each text the ids of the best segmentation, and (score, pieces, changes) of the n best; changes are
        (offset, number, ids): so many of the best's ids there are replaced by others."""
        if self.size > REMEMBERED or self.used > HELD:
            self._forget()
        numbers = [self._numbers(t) if t else np.empty(0, np.int64) for t in texts]
        if self.number.fresh:
            self._learn()
        self.chunks = list(self.number)
        return [self._ranked(i) for i in numbers]

    def _ranked(self, i: np.ndarray) -> tuple[np.ndarray, list]:
        """Only the n - 1 chunks with the smallest losses can differ from their best in an n-best segmentation: any
        other change is worse than n - 1 single ones and none. So only these go through the A* search."""
        if not len(i):
            return np.empty(0, np.int32), []
        loss, count = self.loss[i], self.count[i]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.at[i] - (ends - count), count) + np.arange(ends[-1])]
        score = float(self.v.scores[ids].sum())
        most = min(self.n - 1, len(i))
        limit = np.partition(loss, most - 1)[most - 1] if most else -1.0
        near = np.flatnonzero((loss <= limit) & np.isfinite(loss)).tolist()
        if len(near) > most:  # floats may round great losses that differ
            value = loss.__getitem__ if limit < 2.0**53 else lambda k: self._exact_loss(i[k])
            near = sorted(near, key=lambda k: (value(k), k))[:most]
        changes: list[tuple[int, tuple, int]] = [(0, (), 1)]  # loss, (chunk, rank) and how many are as good for certain
        for k in sorted(near):
            r = self.alternatives(self.chunks[i[k]])
            changes = [(lost + r[0][0] - x[0], (*picks, (k, j)) if j else picks, better * (j + 1)) for lost, picks, better in changes for j, x in enumerate(r) if better * (j + 1) <= self.n]
        out = []
        for _, picks, _ in sorted(changes)[: self.n]:
            made, total, more = [], score, 0
            for k, j in picks:
                r = self.alternatives(self.chunks[i[k]])
                made.append((int(ends[k] - count[k]), int(count[k]), list(r[j][1])))
                total += float(self.v.scores[list(r[j][1])].sum() - self.v.scores[list(r[0][1])].sum())
                more += len(r[j][1]) - len(r[0][1])
            out.append((total, len(ids) + more, made))
        return ids, out

    def _exact_loss(self, number: int) -> int:
        if number not in self.exact:
            r = self.alternatives(self.chunks[number])
            self.exact[number] = r[0][0] - r[1][0]
        return self.exact[number]


def spell(ids: list[int] | None, v: Vocabulary) -> str:
    return b"".join(map(v.spelled.__getitem__, ids or ())).decode("utf-8", "surrogatepass")[1:]


CHANGES = "array<struct<at:int,n:int,ids:array<int>>>"
SCHEMA = f"doc_id long, n_tokens long, ids array<int>, nbest array<struct<score:double,n_tokens:int,changes:{CHANGES}>>, exact boolean"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_tokens, ids, nbest, exact): the best segmentation's ids; of the n best, which start with it, score,
    number of pieces and where they differ from it (``nth_ids`` gives their ids); exact: decoding gives the text back.

    The vocabulary (one per model, some 32,000 pieces) goes to the tasks with the function. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(load(model)))  # by value: executors need no copy of the package
    change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kinds = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int32()), ("changes", pa.list_(change))]))

    def made(own: Encoder, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = own.encode(texts)
        sizes = np.array([0] + [len(ids) for ids, _ in found])
        flat = np.concatenate([np.empty(0, np.int32), *[ids for ids, _ in found]])
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))
        best = [[{"score": s, "n_tokens": k, "changes": [{"at": a, "n": m, "ids": x} for a, m, x in c]} for s, k, c in b] for _, b in found]
        exact = [spell(ids.tolist(), own.v) == t for t, (ids, _) in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes[1:], pa.int64()), ids, pa.array(best, kinds), pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "ids", "nbest", "exact"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(pickle.loads(held.value), n)
        for b in batches:
            texts, first, size = [], 0, 0
            for at, text in enumerate(b.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > CHARS or at + 1 == len(b):
                    yield made(own, b.column(0).slice(first, len(texts)), texts)
                    texts, first, size = [], at + 1, 0

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, SCHEMA)


def nth_ids(rank: int, ids: str = "ids", nbest: str = "nbest") -> Column:
    """Ids of the segmentation of a rank (from 1) of ``encode``'s rows; null if there are fewer."""
    best = F.get(F.col(nbest), rank - 1)
    swap = lambda a, c: F.concat(F.slice(a, F.lit(1), c["at"]), c["ids"], F.slice(a, c["at"] + c["n"] + 1, F.size(a)))
    return F.when(best.isNotNull(), F.aggregate(F.reverse(best["changes"]), F.col(ids), swap))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from piece ids."""
    held = encoded.sparkSession.sparkContext.broadcast(cloudpickle.dumps(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spell(ids, v) for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
