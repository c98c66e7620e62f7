"""Column functions that normalise text, numbers and dates of landed records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that stand for no value.
NULL_WORDS = ("null", "none", "n/a", "na", "undefined", "")
#: Date formats, tried in this order (fraction and zone, zone, fraction, seconds, space, day, slashes).
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")
CLEAN_CHARS, SHORT_CHARS, PRIMARY_TAGS = 2000, 300, 10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_text(*cs: Column | str, default: str | None = None) -> Column:
    """First value that is no null word, trimmed (B1)."""
    tried = [F.when(~F.lower(F.trim(col(c))).isin(*NULL_WORDS), F.trim(col(c))) for c in cs]
    return F.coalesce(*tried, F.lit(default))


def to_long(c: Column | str) -> Column:
    """Whole number from texts such as ``1,000`` or ``1000.0`` (B2); nan and infinities give null."""
    x = F.regexp_replace(col(c).cast("string"), "[, ]", "")
    x = F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x)
    return F.coalesce(x.try_cast("bigint"), F.when(F.abs(x.try_cast("double")) < 9.2e18, F.floor(F.abs(x.try_cast("double"))) * F.signum(x.try_cast("double"))).cast("bigint"))


def to_double(c: Column | str) -> Column:
    """Number from text."""
    x = F.trim(F.regexp_replace(col(c).cast("string"), ",", ""))
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def to_list(c: Column | str) -> Column:
    """Items of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_tags(c: Column | str) -> Column:
    """Lower-case distinct tags in first order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def split_tags(c: Column | str) -> Column:
    """Tags from one text, at commas if it has any, else at spaces."""
    return clean_tags(F.when(F.contains(col(c), F.lit(",")), F.split(col(c), ",")).otherwise(F.split(col(c), r"\s+")))


def to_time(c: Column | str) -> Column:
    """Timestamp from any of the known formats."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col(c)), F.lit(f)) for f in DATE_FORMATS])


def _last(text: Column, what: str) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    n = len(what)
    at = F.instr(F.reverse(text), what[::-1])
    return F.when(at > 0, F.length(text) - at - n + 1).otherwise(-1)


def sentence_cut(c: Column | str, most: int = CLEAN_CHARS) -> Column:
    """Text up to the last sentence end within ``most`` characters, if that lies past the half."""
    t = F.substring(col(c), 1, most)
    at = F.greatest(_last(t, ". "), _last(t, "! "), _last(t, "? "))
    return F.when(F.length(col(c)) <= most, col(c)).when(at > most // 2, F.substring(t, F.lit(1), at + 1)).otherwise(t)


def word_cut(c: Column | str, most: int = SHORT_CHARS) -> Column:
    """Text up to the last space within ``most`` characters, if that lies past the half, and an ellipsis."""
    t = F.substring(col(c), 1, most)
    at = _last(t, " ")
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(F.when(at > most // 2, F.substring(t, F.lit(1), at)).otherwise(t), F.lit("…")))


def primary_tags(c: Column | str, most: int = PRIMARY_TAGS) -> Column:
    """The ``most`` tags of highest 1 / (length + 1) + rank bonus; shorter and earlier ones first."""
    n = F.size(col(c))
    score = lambda x, i: F.lit(1.0) / (F.length(x) + 1) + (n - i) / (n * 100.0)
    ranked = F.transform(col(c), lambda x, i: F.struct((-score(x, i)).alias("s"), i.alias("i"), x.alias("t")))
    ranked = F.array_sort(F.filter(ranked, lambda x: F.length(F.trim(x["t"])) > 1))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["t"])


def json_text(c: Column) -> Column:
    """A JSON string literal as a fixed-format writer makes it: quotes, backslashes and control characters escaped."""
    x = F.regexp_replace(c, r'(["\\])', r"\\$1")
    for ch, to in (("\n", "n"), ("\t", "t"), ("\r", "r"), ("\b", "b"), ("\f", "f")):
        x = F.replace(x, F.lit(ch), F.lit("\\" + to))
    return F.concat(F.lit('"'), x, F.lit('"'))


def fingerprint(title: Column | str, source: Column | str, row_count: Column | str, column_names: Column | str, include_source: bool = True) -> Column:
    """SHA-256 of the sorted-key JSON of title, source, row count and sorted column names."""
    names = F.array_sort(F.transform(F.coalesce(col(column_names), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    shown = F.concat(F.lit('{"columns": ['), F.array_join(F.transform(names, json_text), ", "), F.lit('], "row_count": '), F.coalesce(col(row_count).cast("string"), F.lit("null")))
    if include_source:
        shown = F.concat(shown, F.lit(', "source": '), json_text(F.lower(F.trim(col(source)))))
    return F.sha2(F.concat(shown, F.lit(', "title": '), json_text(F.lower(F.trim(col(title)))), F.lit("}")), 256)


def stripped(c: Column | str) -> Column:
    """Text without white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")


def embedding_of_size(c: Column | str, n: int) -> Column:
    """Vector padded with zeros or cut to ``n``."""
    return F.slice(F.concat(col(c), F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def slug_title(c: Column | str) -> Column:
    """Title of an ``owner/some-name`` id."""
    return F.initcap(F.translate(F.element_at(F.split(col(c), "/"), -1), "-_", "  "))


def slug_owner(c: Column | str) -> Column:
    """Owner of an ``owner/name`` id, null without one."""
    return F.when(F.contains(col(c), F.lit("/")), F.get(F.split(col(c), "/"), 0))


#: Personal data and what stands for it, applied in this order.
PII = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"""(?i)(password|api_key|apikey|secret|token|auth|bearer)[\s:='"]+\S+""", "[CREDENTIAL_REDACTED]"),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[CARD_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
)


def redact(c: Column | str) -> Column:
    """Text without e-mail addresses, credentials, card and social security numbers."""
    out = col(c)
    for pattern, to in PII:
        out = F.regexp_replace(out, pattern, to)
    return out


def file_size(c: Column | str) -> Column:
    """Bytes as B, KB, MB or GB."""
    b = col(c)
    scaled = lambda k, u: F.concat(F.format_string("%.1f", b / float(1024**k)), F.lit(u))
    return F.when(b.isNull() | (b <= 0), "unknown").when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024**2, scaled(1, " KB")).when(b < 1024**3, scaled(2, " MB")).otherwise(scaled(3, " GB"))


def size_text(rows: Column | str, columns: Column | str) -> Column:
    """``45,000 rows × 12 columns``."""
    part = lambda c, name: F.when(col(c) > 0, F.concat(F.format_number(col(c), 0), F.lit(f" {name}")))
    out = F.concat_ws(" × ", part(rows, "rows"), part(columns, "columns"))
    return F.when(out == "", "size unknown").otherwise(out)


def age_days(c: Column | str, as_of: Column | str) -> Column:
    """Whole days from ``c`` to ``as_of``, at least 0; whole 24-hour spans, not calendar days."""
    to = lambda x: F.unix_timestamp(col(x).cast("timestamp"))
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return F.greatest(F.floor((F.unix_timestamp(as_of) - to(c)) / 86400), F.lit(0)).cast("int")


def freshness_label(days: Column) -> Column:
    """How long ago, in words."""
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    whole = lambda n: F.floor(days / n).cast("int")
    return F.when(days.isNull(), "unknown").when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, plural(days, "day")).when(days < 30, plural(whole(7), "week")).when(days < 365, plural(whole(30), "month")).otherwise(plural(whole(365), "year"))


def summary_line(description: Column | str, title: Column | str, tags: Column | str) -> Column:
    """Description cut at a word within 80 characters, else title and three tags within 120."""
    d = F.trim(F.coalesce(col(description), F.lit("")))
    cut = F.substring(d, 1, 80)
    at = _last(cut, " ")
    short = F.when(F.length(d) <= 80, d).otherwise(F.concat(F.when(at > 0, F.substring(cut, F.lit(1), at)).otherwise(cut), F.lit("…")))
    named = F.substring(F.concat_ws(" — ", col(title), F.when(F.size(col(tags)) > 0, F.array_join(F.slice(col(tags), 1, 3), ", "))), 1, 120)
    return F.when(d != "", short).otherwise(named)


def task_labels(c: Column | str) -> Column:
    """Display names of task types."""
    return F.transform(col(c), lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" "))))


@F.pandas_udf(StringType())
def plain_ascii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Letters without accents, everything else beyond ASCII dropped: no built-in function does this."""
    for s in batches:
        yield s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
