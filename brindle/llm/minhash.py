"""MinHash near-duplicates (operator 9): universal hash minima, banding, verification, connected components.

1. Each text becomes its set of five-word shingles (64-bit hashes), a digest of the set, and band keys of universal
   hash minima: 30 of six at similarity 0.85, 36 of five at 0.80. Texts with equal sets form a class; its smallest
   id, with the digest beside it, as rows of one id can differ, stands for it from here on.
2. Candidates are the representatives that share a band key. A pair at the similarity asked for shares none with
   probability below 1e-6. First each is compared, on full sets, with the least one of each of its keys: that is one
   pair a member, and links most members of a group of near copies.
3. Keys whose further members still lie in different components are gone through by task: where the signatures (all
   minima) of two members that no link joins yet agree often enough, the pair is compared on full sets, under the first
   of its common keys only. Only links that join two parts are returned, at most one for each member. Large keys are cut
   into chunks by hash, by members and by shingles, each pair of chunks being a task. So the cost follows the pairs
   that share a key; a chain of unlike texts is no group.
4. Components of all links, by large-star and small-star, are the near-duplicate groups.

Defined results: null and blank texts have no shingles and are linked with nothing; a text of fewer than five
words is one shingle; repeated rows (of one id or several) fall in one component; rows of one id with different
texts are compared as different documents; a row without an id is kept and in no component; ids that are no integers are
compared as strings; an empty table gives an empty result; other columns are ignored, and kept by ``deduplicate``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, materialize, packed, ships, table, unpacked
from .components import components

ships(__name__)

WORDS = 5
PERCENT = 85
MINIMA = 180
#: A pair at the limit shares no band with at most this probability.
MISSED = 1e-6
#: A pair is compared on full sets unless its share of equal minima lies five deviations below the limit.
SLACK = 5.0
#: Members of a band key, or partners of a text, that a task takes; shingles of such partners.
CHUNK_DOCS = 1024
CHUNK_SHINGLES = 2_000_000
#: Shingles hashed at a time.
BATCH = 1_000_000

_rng = np.random.default_rng(20240509)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_C = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shape(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair of this similarity rarely enough."""
    for rows in range(MINIMA, 1, -1):
        if MINIMA % rows == 0 and (1 - (percent / 100) ** rows) ** (MINIMA // rows) <= MISSED:
            return rows, MINIMA // rows
    return 1, MINIMA


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white-space characters only
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _C[i]
    s ^= s >> np.uint64(29)
    s *= _C[15]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 minima, one row for each (non-empty) set, one column for each hash function (multiply, add, high bits)."""
    out = np.empty((len(sets), len(_A)), np.uint32)
    if not sets:
        return out
    x, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, i] = np.minimum.reduceat((x * a + b) >> np.uint64(32), at)
    return out


def _signed(percent: int):
    """doc_id, text_hash, text to doc_id, text_hash, n_shingles, digest, bands."""
    n_rows, n_bands = shape(percent)

    def flush(ids: list, hashes: list, sets: list, kind: pa.DataType) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        m = minima(full).reshape(len(full), n_bands, n_rows)
        keys = iter([[xxhash.xxh64_intdigest(band.tobytes(), seed=i) - 2**63 for i, band in enumerate(row)] for row in m])
        return pa.RecordBatch.from_arrays([
            pa.array(ids, kind), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
        ], names=["doc_id", "text_hash", "n_shingles", "digest", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, hashes, sets, held = [], [], [], 0
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                hashes.append(h)
                sets.append(shingles(text.as_py(), known))
                held += len(sets[-1])
                if held > BATCH:
                    yield flush(ids, hashes, sets, batch.column(0).type)
                    ids, hashes, sets, held = [], [], [], 0
            if ids:
                yield flush(ids, hashes, sets, batch.column(0).type)

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest, text to these and the signature."""
    known = WordHashes()
    for b in batches:
        made = [minima([shingles(text.as_py(), known)])[0].tobytes() for text in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=["id", "digest", "text", "signature"])


def to_compare(m: np.ndarray, bands: np.ndarray, slot: int, part: np.ndarray, sizes: np.ndarray, own: np.ndarray | None, percent: int) -> list[tuple[int, np.ndarray]]:
    """(row, later rows): the pairs of a band key that are compared on full sets here.

    They lie in different parts (and in different chunks, if ``own`` is given), their sizes and signatures allow the
    similarity, and they share no key of an earlier band: of all keys of a pair only the first compares it.
    """
    share, out = percent / 100, []
    limit = share - SLACK * np.sqrt(share * (1 - share) / MINIMA)
    for i in range(len(sizes) - 1):
        near = (part[i + 1 :] != part[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))
        if own is not None:
            near &= own[i + 1 :] != own[i]
        near = np.flatnonzero(near) + i + 1
        if slot and len(near):
            near = near[(bands[near, :slot] != bands[i, :slot]).all(1)]
        near = near[(m[near] == m[i]).mean(1) >= limit] if len(near) else near
        if len(near):
            out.append((i, near))
    return out


def _joining(percent: int):
    """Links, of one pair of chunks of a band key, that join different components."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "digest"], kind="stable").reset_index(drop=True)
        ids, sizes, part = list(zip(rows["id"], rows["digest"], strict=True)), rows["n"].to_numpy(), rows["part"].to_numpy().copy()
        m = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), MINIMA)
        own = rows["chunk"].to_numpy() if key[1] != key[2] else None
        pairs = to_compare(m, np.stack(rows["bands"].to_list()), int(rows["slot"][0]) - 1, part, sizes, own, percent)
        if not pairs:
            return _frame([])
        # shingles as small numbers; those of a row are marked, and looked up for all its partners at once
        known, used = WordHashes(), np.unique(np.concatenate([[i for i, _ in pairs], *[js for _, js in pairs]]))
        sets = [shingles(rows["text"][k], known) for k in used]
        at = dict(zip(used.tolist(), np.cumsum([0, *map(len, sets[:-1])]).tolist(), strict=True))
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marked, out = np.zeros(int(numbers.max()) + 1, np.uint8), []
        for i, js in pairs:
            js = js[part[js] != part[i]]
            if not len(js):
                continue
            mine = numbers[at[i] : at[i] + sizes[i]]
            marked[mine] = 1
            both = np.array([marked[numbers[at[j] : at[j] + sizes[j]]].sum(dtype=np.int64) for j in js.tolist()])
            marked[mine] = 0
            for j in js[100 * both >= percent * (sizes[i] + sizes[js] - both)].tolist():
                if part[j] != part[i]:
                    out.append((*ids[i], *ids[j]))
                    part[part == part[j]] = part[i]
        return _frame(out)

    return run


def _frame(pairs: list) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["u_id", "u_digest", "v_id", "v_digest"], dtype=object)


def _id_kind(docs: DataFrame, id_col: str) -> str:
    """Integers are compared as long; ids of any other kind as their strings."""
    return "bigint" if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else "string"


def _pairs(kind: str) -> str:
    return f"u_id {kind}, u_digest binary, v_id {kind}, v_digest binary"


def _confirmed(percent: int):
    """Links between one text, ``first``, and others, by their full sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, out = WordHashes(), []
        head = rows[rows["first"]].iloc[0]
        a = shingles(head["text"], known)
        rest = rows[~rows["first"]].sort_values(["id", "digest"], kind="stable")
        for i, digest, text in zip(rest["id"], rest["digest"], rest["text"], strict=True):
            b = shingles(text, known)
            both = np.intersect1d(a, b, assume_unique=True).size
            if 100 * both >= percent * (len(a) + len(b) - both):
                out.append((head["id"], head["digest"], i, digest))
        return _frame(out)

    return run


def _node(x: str) -> Column:
    return F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_digest").alias("digest")).alias(x)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (u, v) among distinct ``pairs`` (u, v, n): the pairs of one u are tasks of bounded size, with u's text in each.

    ``texts`` has rep, text, one row each; n is the size of v's set.
    """
    count = pairs.groupBy("u").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = pairs.join(count, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"))
    rest = dealt.join(texts, dealt["v"] == texts["rep"]).select("u", "chunk", F.lit(False).alias("first"), "rep.id", "rep.digest", "text")
    head = count.join(texts, count["u"] == texts["rep"]).select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("first"), "rep.id", "rep.digest", "text")
    # of a u with several chunks one may be empty
    return materialize(rest.unionByName(head).groupBy("u", "chunk").applyInPandas(_confirmed(percent), _pairs(kind)).select(_node("u"), _node("v")))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(at(text_col), F.lit("")), at(text_col).isNull())


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, component), one row for each row of ``docs``.

    A component is the least struct<id, digest> of its members; null without shingles.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long
    kind = _id_kind(docs, id_col)
    texts = docs.select(at(id_col).cast(kind).alias("doc_id"), _text_hash(text_col).alias("text_hash"), at(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signed(percent), f"doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>"))
    sets = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = materialize(sets.groupBy("digest").agg(F.min("doc_id").alias("id")).select("digest", F.struct("id", "digest").alias("rep")))

    # of several rows with the id and the set of a representative one text is taken: all have the same shingles
    first = sets.join(reps, "digest").filter("doc_id = rep.id").groupBy("rep").agg(F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    first = materialize(first)
    keys = first.select("rep", "n", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("least"), F.max("rep").alias("last"), F.count("*").alias("members")).filter("least.rep <> last").select("band", "least", "members")
    near = materialize(keys.join(shared, "band"))
    wanted = near.select("rep").distinct().join(first.select("rep", "text_hash"), "rep").select("rep", F.col("rep.id").alias("doc_id"), "text_hash")
    held = materialize(texts.join(wanted, ["doc_id", "text_hash"]).groupBy("rep").agg(F.min("text").alias("text")))

    ratio = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = near.filter("rep <> least.rep").select(F.col("least.rep").alias("u"), F.col("rep").alias("v"), "n", F.col("least.n").alias("m")).filter(ratio).select("u", "v", "n").distinct()
    links = _verified(materialize(pairs), held, percent, kind)
    parts = components(links).withColumnRenamed("component", "part")

    # keys of three members or more, the least one apart (its pairs are done), with members in different components
    rest = near.filter("members > 2 AND rep <> least.rep").select("band", "rep", "n", "members")
    rest = materialize(rest.join(parts, rest["rep"] == parts["node"], "left").select("band", "rep", "n", "members", F.xxhash64(F.coalesce("part", "rep")).alias("part")))
    mixed = rest.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("band")
    rest = materialize(rest.join(mixed, "band"))
    signed_ = held.join(rest.select("rep").distinct(), "rep").select("rep.id", "rep.digest", "text").mapInArrow(_signatures, f"id {kind}, digest binary, text string, signature binary")
    signed_ = signed_.select(F.struct("id", "digest").alias("rep"), "text", "signature").join(first.select("rep", "bands"), "rep")
    signed_ = materialize(signed_)
    held_n = rest.groupBy("band").agg(F.sum("n").alias("shingles"))
    chunks = F.ceil(F.greatest(F.col("members") / CHUNK_DOCS, F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    chunked = rest.join(held_n, "band").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(signed_, "rep")
    sides = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    tasks = chunked.withColumn("p", F.explode(sides)).select("band", "p.i", "p.j", "chunk", "rep.id", "rep.digest", "part", "n", "text", "signature", "bands", F.array_position("bands", F.col("band")).alias("slot"))
    joining = tasks.groupBy("band", "i", "j").applyInPandas(_joining(percent), _pairs(kind)).select(_node("u"), _node("v"))
    grouped = components(links.unionByName(joining))

    of = reps.join(grouped, reps["rep"] == grouped["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc_id", "text_hash", "n_shingles", "digest").join(of, "digest", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Texts whose shingle sets reach ``percent`` of similarity are linked.
    """
    out = _grouped(docs, id_col, text_col, percent)
    kept = F.coalesce((F.col("doc_id") == F.col("component.id")) & (F.col("digest") == F.col("component.digest")), F.lit(True))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component.id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id; rows without an id stay."""
    kind = _id_kind(docs, id_col)
    rows = _grouped(docs, id_col, text_col, percent).filter("doc_id IS NOT NULL")
    linked = rows.filter("doc_id = component.id AND digest = component.digest").groupBy("component").agg(F.min("text_hash").alias("h")).select(F.col("component.id").alias("__keep"), F.col("h").alias("__hash"))
    keep = linked.unionByName(rows.filter("digest IS NULL").select(F.col("doc_id").alias("__keep"), F.col("text_hash").alias("__hash")).distinct())
    named = packed(docs.filter(at(id_col).isNotNull()), __id=at(id_col).cast(kind), __hash=_text_hash(text_col))
    named = named.join(keep.withColumnRenamed("__keep", "__id"), ["__id", "__hash"])
    return unpacked(named.dropDuplicates(["__id", "__hash"]), docs.columns).unionByName(docs.filter(at(id_col).isNull()))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {"op9_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g FROM d, range(1, greatest(len(w) - 3, 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * common >= 85 * (nu.n + nv.n - common)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.v FROM c JOIN e ON e.u = c.r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c.r) AS component_id, d.doc_id = min(c.r) AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""}
