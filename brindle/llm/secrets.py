"""Secret scans (operator 2), in DataFrame functions only.

Base kinds are regular expressions. Further candidates are long runs of key-like characters: for each character
class a window slides over the run, its character counts and the sum of c * log2(c) are updated by the character
that enters and the one that leaves, and the run is reported if any window's Shannon entropy reaches the class's
limit. Runs that the allow-list knows are left out: slashes alone excuse no run, only several of them between word-like
parts do. A run may overlap a base span; both are reported, and ``redact`` masks what they cover together. The query,
its SQL and ``redact`` share this one scan.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored, and kept by ``redact``, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, packed, table, unpacked

#: The kinds that the contract names, in its order, with the group whose length is tested and its least.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Character class: the characters, and the least entropy in bits of a window.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.05), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85)}
#: Key-like runs that are no secrets: UUIDs, documented example keys, integrity digests, numbers.
ALLOW = r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|.*EXAMPLE.*|sha(?:256|384|512)-.*|[0-9+/_=-]*)$"
#: And paths: two slashes or more, and between separators nothing but words, of one case or CamelCase, with short numbers.
SEPARATOR = "[/_=-]"
WORD = "^(?:[a-z]+|[A-Z]+)?(?:[A-Z][a-z]{2,})*[0-9]{0,8}$"
LONGEST_WORD = 200
MASK = "[SECRET]"
CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often or in however many lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(lengths: Column, start: Column) -> Column:
    """start, start + lengths[0], ...: one element more than ``lengths``."""
    return F.aggregate(lengths, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts(lengths: Column) -> Column:
    """Sums of all earlier elements; in chunks, so that long arrays don't cost the square of their length."""
    zero = F.lit(0)

    def of(n: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.greatest(F.ceil(F.size(n) / F.lit(CHUNK)).cast("int") - 1, zero)), lambda c: F.slice(n, c * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, lambda parts: F.flatten(F.zip_with(parts, F.slice(_running(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero), F.lit(1), F.size(parts)), lambda p, at: F.slice(_running(p, at), F.lit(1), F.size(p)))))

    return let(lengths, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches.

    ``split`` and ``regexp_extract_all`` cut at the same matches, so lengths of pieces and matches give offsets.
    """
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("p"))

    def spans(x: Column) -> Column:
        sizes = F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: p + F.length(m))
        return F.zip_with(F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: F.struct(p.alias("p"), m.alias("m"))), starts(sizes), lambda a, at: F.struct((at + a["p"]).alias("start"), (at + a["p"] + F.length(a["m"])).alias("end"), a["m"].alias("match")))

    return let(pair, spans)


NONE = "array<struct<start:int,end:int,match:string>>"


def _found(text: Column, may: Column, pattern: str) -> Column:
    return F.when(may & text.rlike(pattern), matches(text, pattern)).otherwise(F.array().cast(NONE))


def _entropic(run: Column, chars: str, least: float) -> Column:
    """Whether a window of the run holds characters of the class only and reaches the entropy."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    term = lambda c: F.get(f, c)
    limit = WINDOW * (math.log2(WINDOW) - least)  # of the sum of c * log2(c)

    def slide(x: Column) -> Column:
        n = F.size(x)
        zero = F.struct(F.array_repeat(F.lit(0), len(chars)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("held"), F.lit(False).alias("hit"))

        def step(s: Column, i: Column) -> Column:
            into, out = F.get(x, i), F.when(i >= WINDOW, F.get(x, i - WINDOW)).otherwise(F.lit(-1))
            same = into == out
            c_in, c_out = F.coalesce(F.get(s["counts"], into), F.lit(0)), F.coalesce(F.get(s["counts"], out), F.lit(0))
            plus = F.when((into >= 0) & ~same, term(c_in + 1) - term(c_in)).otherwise(0.0)
            minus = F.when((out >= 0) & ~same, term(c_out - 1) - term(c_out)).otherwise(0.0)
            held = s["held"] + F.when(into >= 0, 1).otherwise(0) - F.when(out >= 0, 1).otherwise(0)
            counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0)))
            total = s["sum"] + plus + minus
            return F.struct(counts.alias("counts"), total.alias("sum"), held.alias("held"), (s["hit"] | ((held == WINDOW) & (total <= limit))).alias("hit"))

        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda s, i: F.when(s["hit"], s).otherwise(step(s, i)), lambda s: s["hit"])

    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(chars), ch) - 1)
    return F.when(F.length(run) >= WINDOW, let(codes, slide)).otherwise(F.lit(False))


def _allowed(run: Column) -> Column:
    """Whether the allow-list knows the run; words are matched one by one, so that long runs need no deep matching."""
    slashes = F.length(run) - F.length(F.replace(run, F.lit("/"), F.lit("")))
    words = F.forall(F.split(run, SEPARATOR), lambda w: (F.length(w) <= LONGEST_WORD) & w.rlike(WORD))
    return run.rlike(ALLOW) | ((slashes >= 2) & words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): arrays of struct<start, kind, end> in order; found holds base and the method's own.

    No shuffle. Texts without the characters that a kind needs skip its expressions.
    """
    d = docs.select(at(id_col).alias("doc_id"), F.coalesce(at(text_col), F.lit("")).alias("__t"))
    return _with_spans(d).select("doc_id", F.col("__base").alias("base"), F.col("__found").alias("found"))


def _with_spans(d: DataFrame) -> DataFrame:
    text = F.col("__t")
    tag = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    assign = F.filter(_found(text, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    d = d.withColumn("__base", F.array_sort(F.concat(
        tag(assign, 0),
        tag(_found(text, F.contains(text, F.lit("AKIA")), "AKIA[A-Z0-9]{16,}"), 1),
        tag(_found(text, F.lit(True), "[0-9a-f]{24,}"), 2),
    )))
    run = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
    key = lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]") & ~_allowed(x["match"])
    high = lambda x: F.reduce(F.array(*[_entropic(x["match"], *c) for c in CLASSES.values()]), F.lit(False), lambda a, b: a | b)
    d = d.withColumn("__runs", F.filter(_found(text, F.lit(True), run), key))
    own = F.when(F.size("__runs") > 0, F.filter("__runs", high)).otherwise(F.array().cast(NONE))
    return d.withColumn("__found", F.array_sort(F.concat("__base", tag(own, 3))))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mask``; null texts stay null."""
    d = _with_spans(packed(docs, __t=F.coalesce(at(text_col), F.lit(""))))

    def cut(text: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        gap = lambda s, x: F.substring(text, s["at"] + 1, x["start"] - s["at"])
        step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(gap(s, x), F.lit(mask))).alias("parts"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts")))
        return F.aggregate("__found", zero, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))

    new = F.when(F.size("__found") > 0, let(F.col("__t"), cut)).otherwise(F.col("row")[text_col])
    return unpacked(d, docs.columns, **{text_col: new})


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def _oracle_spans(kind: int, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, {kind} AS kind, start, start + length(m) AS stop, m FROM (
      SELECT doc_id, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start FROM (
        SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p FROM (
          SELECT doc_id, regexp_extract_all(text, $r${pattern}$r$) AS ms, string_split_regex(text, $r${pattern}$r$) AS ps FROM d))) WHERE {keep}"""


_KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_O_ASSIGN = _KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_WINDOWS = lambda chars, least: f"EXISTS (SELECT 1 FROM range(1, length(m) - {WINDOW - 2}) AS r(i) WHERE regexp_matches(substr(m, i, {WINDOW}), '^[{chars}]{{{WINDOW}}}$') AND list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy') >= {least})"

ORACLE = {"op2_secrets": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_oracle_spans(0, _O_ASSIGN, f"length(regexp_extract(m, $r${_O_ASSIGN}$r$, 1)) >= 6")}),
k AS ({_oracle_spans(1, "AKIA[A-Z0-9]{16,}", "true")}),
h AS ({_oracle_spans(2, "[0-9a-f]{24,}", "true")}),
b AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
c AS ({_oracle_spans(3, "[A-Za-z0-9+/_=-]{20,}", f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, $r${ALLOW}$r$)")}),
e AS (SELECT * FROM c WHERE NOT (length(m) - length(replace(m, '/', '')) >= 2
    AND len(list_filter(string_split_regex(m, '{SEPARATOR}'), lambda w: length(w) > {LONGEST_WORD} OR NOT regexp_matches(w, '{WORD}'))) = 0)
  AND ({_WINDOWS("0-9a-fA-F", 3.05)} OR {_WINDOWS("A-Za-z0-9+/_=-", 3.85)})),
u AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM b UNION ALL SELECT * FROM e)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""}
