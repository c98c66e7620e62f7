"""Spelling variants of words (operator 12): an index of grams of variable length.

1. Words and their counts: each task counts the words of its texts, the partial counts meet by word.
2. The gram dictionary: two-letter grams, and longer ones, up to ``LONGEST``, where their beginning is frequent. A gram
   is frequent if it has more than a share of 1 / ``FREQUENT`` of all places of grams, so fewer than ``FREQUENT`` grams
   of any length are. Only these are collected; what starts with none of them ends there (pruning).
3. Decomposition: at each place of a word starts the shortest gram that isn't frequent; those within another are dropped.
4. Affected grams: an edit at a place changes the grams that hold the place; on its left those that could go on across it,
   which needs the letters from their start to the place to be frequent; on its right those that a gram from across
   could hold, which needs the letters up to their last but one to end a frequent gram. All else is in the edited word
   too. That bound depends on the letters of one side only, so both words of a near pair find the same grams.
5. List merging: two words that differ by one edit share the unaffected grams of one place. Their lists are met by one
   key over all of these, one for each place of a word with other unaffected grams, and the length of the rest. So a list has
   words that are alike but for a gap of at most 2 * LONGEST - 3 letters, frequent grams around the edit (words shorter
   than that apart); its length is bounded by the alphabet, not by the number of words.
6. Verification: each pair of a list by its edit distance. No pair of words with distance 1 is lost.

Defined results: a null or blank text has no words; a null id counts as the empty string in the disturbance of the
query; repeated rows count as often as they occur; of several forms of equal count the first in code-point order is
taken; words of any length are indexed, those over ``SHORT`` letters by their digest, and compared whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC, CRC_TABLE, materialize, ships, table

ships(__name__)

#: Words of at least so many letters, and occurrences, count; a form has so many times the occurrences of its variants.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Fewer grams of any length than this are frequent; the longest grams.
FREQUENT, LONGEST = 200, 4
#: Words that a task counts before it hands them on.
HELD = 400_000
#: Longer words stand in the index by a digest.
SHORT = 64
#: Rows of the index that a task hands on at a time.
BATCH = 20_000

#: Bytes of letters, A-Z lower-cased; all else becomes a space. Letters from U+00C0 to U+00FF are C3 and one more byte.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c == 0xC3 or 0x80 <= c <= 0xBF else 32 for c in range(256))
_OTHERS = re.compile(rb"[\xc0-\xc2\xc4-\xff][\x80-\xbf]*")


def letter_runs(text: bytes) -> list[bytes]:
    return _OTHERS.sub(b" ", text).translate(_LETTERS).split()


def disturbed(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The query's words: one in 31 runs of a document loses a letter, both chosen by a checksum."""
    begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)

    def change(run: bytes) -> bytes:
        h = zlib.crc32(run, begun)
        if h % 31:
            return run
        s = run.decode()
        k = h % len(s)
        return (s[:k] + s[k + 1 :]).encode()

    return change


def _counting(change: Callable | None, letters: int):
    def flush(counts: Counter) -> pa.RecordBatch:
        long = {w.decode(): n for w, n in counts.items() if len(w) >= letters}
        long = {w: n for w, n in long.items() if len(w) >= letters}
        return pa.RecordBatch.from_arrays([pa.array(list(long), pa.string()), pa.array(list(long.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = Counter(letter_runs(text.as_py() or b""))
                if change:
                    new, own = change(i), own.items()
                    for w, n in own:
                        counts[new(w)] += n
                else:
                    counts.update(own)
                if len(counts) > HELD:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    return run


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): letter runs of all texts with at least so many letters and occurrences."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    partial = rows.mapInArrow(_counting(change, letters), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            for q in range(2, LONGEST):
                counts.update([w[p : p + q] for p in range(len(w) - q + 1)])
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "places"])


def frequent_grams(vocabulary: DataFrame, share: int = FREQUENT) -> frozenset[str]:
    """Grams of 2 to LONGEST - 1 letters with more than 1 / share of all places of two-letter grams: under share of each length."""
    counts = vocabulary.select("word").mapInArrow(_grams, "gram string, places long").groupBy("gram").agg(F.sum("places").alias("places"))
    counts = materialize(counts)
    places = counts.filter(F.length("gram") == 2).agg(F.sum("places")).first()[0] or 0
    return frozenset(r[0] for r in counts.filter(F.col("places") * share > places).select("gram").toLocalIterator())


def bounds(s: str, frequent: frozenset[str], endings: frozenset[str]) -> tuple[list[int], list[int]]:
    """For i from 0 to len(s): where the unaffected grams of s[:i] end, and where those of s[i:] begin, for an edit between."""
    n = len(s)
    ends = []
    for p in range(n - 1):
        q = 2
        while q < LONGEST and p + q < n and s[p : p + q] in frequent:
            q += 1
        ends.append(p + q)
    left, right = [], []
    for i in range(n + 1):
        p = i - 2
        while p >= 0 and s[p:i] in frequent:
            p -= 1
        left.append(max(ends[max(0, p - LONGEST) : p + 1], default=0))
        end, begin = 0, n
        for p in range(i, n - 1):
            if ends[p] > end:
                end = ends[p]
                if s[i : end - 1] not in endings:
                    begin = p
                    break
        right.append(begin)
    return left, right


def _hashes(letters: list[bytes]) -> list[int]:
    """64-bit hashes of all beginnings."""
    h = xxhash.xxh64()
    out = [h.intdigest()]
    for c in letters:
        h.update(c)
        out.append(h.intdigest())
    return out


def keys(s: str, frequent: frozenset[str], endings: frozenset[str]) -> tuple[set[int], set[int]]:
    """Keys of the unaffected grams of s: where a letter of s is replaced or deleted, and where one is inserted."""
    letters, n = [c.encode() for c in s], len(s)
    left, right = bounds(s, frequent, endings)
    begin, rest = _hashes(letters), _hashes(letters[::-1])
    made = lambda size, i, j: xxhash.xxh64_intdigest(b"%d:%x:%x" % (size, begin[i], rest[n - j])) - 2**63
    out = {(left[i], right[i + 1]) for i in range(n)}, {(left[i], right[i]) for i in range(n + 1)}
    return {made(n - 1, i, j) for i, j in out[0]}, {made(n, i, j) for i, j in out[1]}


def digest(word: str) -> str:
    """How a long word stands in the index: a space, which no word has, and its hash."""
    return " " + xxhash.xxh3_128_hexdigest(word.encode())


def _indexed(frequent: frozenset[str]):
    endings = frozenset(g[k:] for g in frequent for k in range(1, len(g)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple = ([], [], [], [])
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = w if len(w) <= SHORT else digest(w)
                for takes, own in zip((True, False), keys(w, frequent, endings), strict=True):
                    out[0].extend(own)
                    for column, value in zip(out[1:], (takes, name, n), strict=True):
                        column.extend([value] * len(own))
                if len(out[0]) >= BATCH:
                    yield _index_batch(out)
                    out = ([], [], [], [])
            yield _index_batch(out)

    return run


INDEX = "key long, takes boolean, word string, n long"


def _index_batch(out: tuple) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb): the pairs of words of ``vocabulary`` (word, n) with edit distance 1, each once."""
    spread = vocabulary.repartition(F.col("word"))
    index = materialize(spread.mapInArrow(_indexed(frequent_grams(vocabulary)), INDEX))
    a = index.filter("takes").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = index.select("key", "takes", F.col("word").alias("b"), F.col("n").alias("nb"))
    # a letter replaced: both lists are of the first kind; one deleted: the longer word's and the shorter one's
    met = a.join(b, "key").filter("NOT takes AND a <> b OR a < b")
    long = F.startswith("a", F.lit(" ")) | F.startswith("b", F.lit(" "))
    checked = met.filter(F.when(long, True).otherwise(F.levenshtein("a", "b", 1) == 1))
    pairs = materialize(checked.select("a", "na", "b", "nb").distinct())
    short = pairs.filter(~long)
    whole = vocabulary.filter(F.length("word") >= SHORT).select("word", F.col("n").alias("m"))
    named = whole.mapInArrow(_named, "name string, word string, m long")
    if pairs.filter(long).take(1):
        of = pairs.filter(long).join(named.select(F.col("name").alias("a"), F.col("word").alias("wa")), "a").join(named.select(F.col("name").alias("b"), F.col("word").alias("wb")), "b")
        short = short.unionByName(of.filter(F.levenshtein("wa", "wb", 1) == 1).select(F.col("wa").alias("a"), "na", F.col("wb").alias("b"), "nb"))
    return short


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of SHORT letters by themselves, longer ones by their digest too."""
    for batch in batches:
        names = [w if len(w) <= SHORT else digest(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns], names=["name", "word", "m"])


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for each word of ``forms`` (word, form), by doubling the steps; ``most`` is the longest chain."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, most)))):
        at = materialize(at)
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return at


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of ``vocabulary`` (word, n)."""
    vocabulary = materialize(vocabulary)
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = vocabulary.join(near, "word", "left").withColumn("is", -F.col("best.m") >= times * F.col("n"))
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), F.col("best.other")).alias("form"), F.when(F.col("is"), -F.col("best.m")).alias("form_n")))
    forms = found.filter("form IS NOT NULL").select("word", "form")
    # each step multiplies the count by ``times``
    most = int(math.log(max(1, found.agg(F.max("n")).first()[0] or 1), times)) + 1
    out = found.join(roots(forms, most), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents"), change=disturbed))


ORACLE = {"op12_spelling": rf"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS x, run, count(*) AS c FROM t WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, {CRC.format(x="x")} AS h FROM g, crc),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY word HAVING length(word) >= 7 AND sum(c) >= 2),
d AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, range(0, length(word)) AS r(i)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM d a JOIN d b ON a.len = b.len AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.rest = b.word),
f AS (SELECT a AS word, count(*) AS n_near, max(n) AS m FROM e GROUP BY a),
o AS (SELECT e.a AS word, min(encode(e.b)) AS best FROM e JOIN f ON f.word = e.a AND f.m = e.n GROUP BY e.a),
v AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.m >= 10 * w.n THEN decode(o.best) END AS form, CASE WHEN f.m >= 10 * w.n THEN f.m END AS form_n
  FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN o ON o.word = w.word),
c(word, here) AS (SELECT word, word FROM v UNION SELECT c.word, v.form FROM c JOIN v ON v.word = c.here WHERE v.form IS NOT NULL),
r AS (SELECT c.word, c.here AS root FROM c JOIN v ON v.word = c.here WHERE v.form IS NULL)
SELECT v.word, v.form, r.root, v.n, v.n_near, v.form_n FROM v JOIN r ON r.word = v.word
"""}
