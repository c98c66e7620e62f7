"""Retrieval: BM25 over postings, exact vectors, rank fusion, text search, pages and lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 constants; negative idf is replaced by EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF, TEXT_WEIGHT, VECTOR_WEIGHT = 60, 0.4, 0.6
#: Queries are broadcast to the scan in blocks of so many.
QUERY_BLOCK = 1000


def block(queries: DataFrame) -> DataFrame:
    """``queries``, whose rows were counted and found to fit one block, so that they may be broadcast."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: search at most so many at a time, in blocks")
    return queries


def tokens(c: Column | str) -> Column:
    """ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, dl) (D3). With ``terms``, a bounded frame, of those only: they are counted within a document's row,
    so that nothing is shuffled. Without, all terms of all documents are grouped."""
    t = docs.select(F.col(id_col).alias("doc"), tokens(text_col).alias("t")).withColumn("dl", F.size("t"))
    if terms is None:
        return t.select("doc", "dl", F.explode("t").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
    wanted = terms.agg(F.collect_set("term").alias("wanted"))
    t = t.crossJoin(F.broadcast(wanted)).select("doc", "dl", F.filter("t", lambda x: F.array_contains("wanted", x)).alias("t")).filter(F.size("t") > 0)
    t = t.withColumn("term", F.explode(F.array_distinct("t")))
    return t.select("term", "doc", "dl", F.size(F.filter("t", lambda x: x == F.col("term"))).cast("bigint").alias("tf"))


def bm25_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings with idf, one-row statistics). With ``terms``, postings of those only.

    Empty documents count in the number and mean length of documents. The mean idf is over all terms.
    """
    sizes = docs.select(F.size(tokens(text_col)).alias("dl"))
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    p = postings(docs, id_col, text_col, terms)
    each = docs.select(F.explode(F.array_distinct(tokens(text_col))).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # partial sums before the shuffle
    df = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean_idf"), F.count("*").alias("n_terms"))
    if terms is not None:
        df = df.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    idf = df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return p.join(idf, "term"), stats.crossJoin(F.broadcast(mean))


def bm25_scores(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, doc, score) for every document that holds a term of a query; a term said twice counts twice.

    ``queries`` has query_id and query_text, at most QUERY_BLOCK rows a call (checked): the terms are broadcast.
    """
    q = block(queries).select("query_id", F.explode(tokens("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    index, stats = bm25_index(docs, id_col, text_col, q)
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    hit = index.join(F.broadcast(q), "term").crossJoin(F.broadcast(stats))
    return hit.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)), 6).alias("score"))


def top_k(scores: DataFrame, k: int, order: list[Column], key: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each key, with rank; a limit below the shuffle keeps k rows a key and task."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def bm25_top(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Best ``k`` documents above 0 of each query."""
    return top_k(bm25_scores(queries, docs, id_col, text_col).filter("score > 0"), k, [F.desc("score"), F.col("doc")])


def bm25_all(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Scores of all documents, 0 included."""
    every = docs.select(F.col(id_col).alias("doc")).crossJoin(F.broadcast(block(queries).select("query_id")))
    return every.join(bm25_scores(queries, docs, id_col, text_col), ["query_id", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The shipped encoder: signed hashed word counts. Any function from texts to a matrix can stand in for it."""

    def run(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        return out

    return run


def encode_texts(docs: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64) -> DataFrame:
    """``docs`` with ``embedding``; blank texts are zero vectors, texts whose batch fails get null."""
    encoder = encoder or hashing_encoder(dim)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            try:
                m = encoder(texts)
                yield pd.Series([np.zeros(dim, np.float32) if not t.strip() else v for t, v in zip(texts, m, strict=True)])
            except Exception:  # noqa: BLE001 - a bad batch costs its own vectors only
                yield pd.Series([None] * len(s), dtype=object)

    return docs.withColumn("embedding", embed(text_col))


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def load_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v) with vectors of length 1; null and other sizes dropped, zero vectors kept."""
    v = F.col(vector_col).cast("array<double>")
    n = norm2(v)
    return df.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0)).alias("v"))


def vector_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top ``k`` (D8, D13). ``queries`` (query_id, qv) is a stated block of queries, checked and broadcast."""
    pairs = vectors.crossJoin(F.broadcast(block(queries))).select("query_id", "id", F.round(dot(F.col("qv"), F.col("v")), 6).alias("score"))
    return top_k(pairs, k, [F.desc("score"), F.col("id")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    n = norm2(a) * norm2(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_for(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine for given ids: ``wanted`` has query_id, id and qv."""
    return wanted.join(vectors, "id").select("query_id", "id", F.round(cosine(F.col("qv"), F.col("v")), 6).alias("score"))


def rrf(text: DataFrame, vector: DataFrame, k: int, n_docs: int, weights: tuple[float, float] = (TEXT_WEIGHT, VECTOR_WEIGHT), constant: int = RRF, missing: str = "last") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, rank): a row missing from one counts as last (D11), or not at all."""
    t, v = text.select("query_id", "id", F.col("rank").alias("rt")), vector.select("query_id", "id", F.col("rank").alias("rv"))
    part = lambda r, w: w / (F.lit(float(constant)) + (F.coalesce(r, F.lit(n_docs + 1)) if missing == "last" else r))
    d = t.join(v, ["query_id", "id"], "full_outer").withColumn("score", F.round(F.coalesce(part(F.col("rt"), weights[0]), F.lit(0.0)) + F.coalesce(part(F.col("rv"), weights[1]), F.lit(0.0)), 10))
    return top_k(d, k, [F.desc("score"), F.col("id")])


def hybrid(queries: DataFrame, text: DataFrame, vector: DataFrame, k: int, n_docs: int) -> DataFrame:
    """Fusion where a query has hits of both kinds, else the kind that it has (D12-D14). Modes are told in ``mode``."""
    flags = block(queries).select("query_id").join(text.select("query_id", F.lit(True).alias("t")).distinct(), "query_id", "left").join(vector.select("query_id", F.lit(True).alias("v")).distinct(), "query_id", "left")
    flags = flags.select("query_id", F.when(F.col("t") & F.col("v"), "hybrid").when(F.col("t"), "text").when(F.col("v"), "vector").otherwise("none").alias("mode"))
    both = rrf(text, vector, k, n_docs).select("query_id", "id", "score", "rank", F.lit("hybrid").alias("mode"))
    most = F.max("score").over(Window.partitionBy("query_id"))
    only_t = text.filter(F.col("rank") <= k).select("query_id", "id", F.round(F.col("score") / most, 6).alias("score"), "rank", F.lit("text").alias("mode"))
    only_v = vector.filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", F.lit("vector").alias("mode"))
    return both.unionByName(only_t).unionByName(only_v).join(F.broadcast(flags), ["query_id", "mode"], "left_semi")


def in_order(wanted: DataFrame, catalog: DataFrame, id_col: str = "canonical_id") -> DataFrame:
    """Rows for an array of ids, in its order; ids that aren't there are left out."""
    each = wanted.select("query_id", F.posexplode("ids").alias("pos", id_col))
    return each.join(catalog, id_col).orderBy("query_id", "pos")


def like_search(catalog: DataFrame, words: str, limit: int, offset: int = 0, filters: Column | None = None) -> DataFrame:
    """Substring search without case over title, description and tags, most complete first."""
    like = f"%{words}%"
    hit = F.col("title").ilike(like) | F.col("description").ilike(like) | F.exists("tags", lambda t: t.ilike(like))
    d = catalog.filter(hit if filters is None else hit & filters)
    return d.orderBy(F.desc("metadata_completeness"), "canonical_id").offset(offset).limit(limit)


def cursor_page(catalog: DataFrame, cursor: int, n: int, id_col: str = "seq", source: str | None = None) -> DataFrame:
    """The ``n`` rows after a cursor, with has_more (D19): one row more is read to know."""
    d = catalog.filter(F.col(id_col) > cursor)
    d = d.filter(F.col("source") == source) if source else d
    d = d.orderBy(id_col).limit(n + 1)
    w = Window.orderBy(id_col)  # over n + 1 rows
    return d.withColumn("__i", F.row_number().over(w)).withColumn("has_more", F.max("__i").over(Window.partitionBy()) > n).filter(F.col("__i") <= n).drop("__i")


def keyword_match(queries: DataFrame, catalog: DataFrame, k: int, text_col: str = "title", least: int = 3, relaxed: int = 2) -> DataFrame:
    """Records whose name holds a token of the query, or has a word of four letters within it; queries without hits
    are tried again with tokens of two characters (D21). Most rows first. The queries are a block, checked and broadcast."""

    def hits(q: DataFrame, n: int) -> DataFrame:
        name = F.lower(F.col(text_col))
        has = F.exists(F.filter(tokens("query_text"), lambda t: F.length(t) >= n), lambda t: F.contains(name, t))
        back = F.exists(F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= 4), lambda w: F.contains(F.lower("query_text"), w))
        return catalog.join(F.broadcast(q), has | back)

    first = hits(block(queries), least)
    again = hits(queries.join(first.select("query_id").distinct(), "query_id", "left_anti"), relaxed)
    return top_k(first.unionByName(again), k, [F.desc_nulls_last("row_count"), F.col("canonical_id")])


def keyword_rerank(hits: DataFrame, text: Column, position: str = "rank") -> DataFrame:
    """Hits by the number of query tokens their text holds, then by their old position."""
    n = F.size(F.filter(tokens("query_text"), lambda t: F.contains(F.lower(text), t)))
    return hits.withColumn("keyword_hits", n).withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("keyword_hits"), position)))
