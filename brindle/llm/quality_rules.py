"""Quality rules as a bitmask ledger (operator 1), in DataFrame functions only.

``ledger`` evaluates every rule once and stores its failures as bits of one long beside the measurements.
Policies are versioned masks over these bits, applied afterwards without reading texts again, and ``ablations``
finds what each rule decides alone from counts per distinct bit pattern.

Defined results: null and blank texts have 0 words and fail the base; repeated rows give repeated results; a
window counts as repeated if its eight words occur at two or more places of the text, which may overlap; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, table, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Rule names in bit order, with the condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("exclamations", "2 * n_exclamations > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named version of a set of rules; a document passes if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PROSE = Policy("prose", 1, tuple(BIT))
#: The second version lets texts in capitals and lively ones pass.
PROSE_2 = Policy("prose", 2, tuple(r for r in BIT if r not in ("capitals", "exclamations")))


def _pairs(a: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` later."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed_bits), one row for each row of ``docs``; no shuffle.

    A window's hash is built from its words' hashes by doubling (2, 4, 8 words). Only documents in which two
    hashes agree go on to the positions; these are sorted by hash, so that a document of any length costs
    n log n.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    d = d.withColumns({"w": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WS}]"))})
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        gone("[A-Z]+").cast("long").alias("n_capitals"),
        gone("!+").cast("long").alias("n_exclamations"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for step in (1, 2, 4):
        d = d.withColumn("h", _pairs(F.col("h"), step))
    again = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("h", F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    n = F.greatest(F.size("h") - 1, F.lit(0))
    none = F.array().cast("array<int>")
    d = d.withColumn("at", F.when(F.col("h").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.zip_with(F.slice("h", 1, n), F.slice("h", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))))))
    m = F.greatest(F.size("at") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("at", 1, m), F.slice("at", F.lit(2), m), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("h", "at")
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return d.withColumn("failed_bits", bits)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(entries: DataFrame, *policies: Policy) -> DataFrame:
    """(policy, version, rule, n_failed, n_only): documents that fail a rule of a policy, and those it alone rejects.

    The ledger is counted once per bit pattern (at most 2 ** rules rows), with map-side partial sums; all policies are
    then applied to the patterns. An empty ledger gives an empty result.
    """
    held = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for p in policies for r in sorted(set(p.rules), key=BIT.get)])
    each = held.withColumn("r", F.explode(named)).select("failed_bits", "n", "r.*")
    hit, alone = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("failed_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("policy", "version", "rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = ledger(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(PROSE).alias("kept"), "failed_bits")


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule decides in every policy, from one ledger of all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents")), BASE, PROSE, PROSE_2)


#: Queries beside the dealt one.
QUERIES = {"rule_ablations": rule_ablations}

_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM d, range(1, len(w) - 6) AS r(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
a AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_capitals, n_exclamations, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (2 * n_symbols > n_words)::INT
  + 8 * (10 * n_dup_lines > 6 * n_lines)::INT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT
  + 32 * (2 * n_capitals > word_chars)::INT + 64 * (2 * n_exclamations > n_words)::INT AS BIGINT) AS failed_bits FROM a)"""

_RULES_SQL = ", ".join(f"('{p.name}', {p.version}, {p.mask}, '{r}', {BIT[r]})" for p in (BASE, PROSE, PROSE_2) for r in p.rules)
ORACLE = {
    "op1_quality_rules": f"{_LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b",
    "rule_ablations": f"{_LEDGER_SQL}, p(policy, version, mask, rule, bit) AS (VALUES {_RULES_SQL}) SELECT policy, version, rule, sum(((failed_bits & bit) <> 0)::INT)::BIGINT AS n_failed, sum(((failed_bits & mask) = bit)::INT)::BIGINT AS n_only FROM b CROSS JOIN p GROUP BY ALL",
}
