"""Rule tables as Column expressions: the first keyword found decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import col


#: Members of the vocabularies.
DOMAINS = "computer_vision nlp tabular time_series audio multimodal geospatial medical finance scientific social other".split()
FORMATS = "csv json jsonl parquet arrow images audio_files video hdf5 sqlite arff xlsx xml text other".split()
LICENSES = "cc0 cc_by cc_by_sa cc_by_nc cc_by_nc_sa cc_by_nd mit apache_2 gpl_2 gpl_3 lgpl bsd proprietary unknown".split()
MODALITIES = "text image audio video tabular time_series graph multimodal other".split()
TASKS = list(vocab.TASK_NEEDS)
#: Licenses that allow commercial use, and display names.
COMMERCIAL = ("cc0", "cc_by", "cc_by_sa", "mit", "apache_2", "bsd")
LICENSE_NAMES = {"cc0": "CC0 (Public Domain)", "cc_by": "CC BY 4.0", "cc_by_sa": "CC BY-SA 4.0", "cc_by_nc": "CC BY-NC 4.0", "cc_by_nc_sa": "CC BY-NC-SA 4.0", "cc_by_nd": "CC BY-ND 4.0", "mit": "MIT License", "apache_2": "Apache 2.0", "gpl_2": "GPL v2", "gpl_3": "GPL v3", "lgpl": "LGPL", "bsd": "BSD License", "proprietary": "Proprietary", "unknown": "Unknown"}


def by_rules(text: Column, members: list[str], rules: list[tuple[str, str]], default: str) -> Column:
    """The text itself if it is a member; else the value of the first keyword in it; else ``default``."""
    tried = [F.when(F.contains(text, F.lit(k)), v) for k, v in rules]
    return F.when(text.isNull() | (text == ""), default).when(text.isin(members), text).otherwise(F.coalesce(*tried, F.lit(default)))


def _plain(c: Column | str, under: str = "") -> Column:
    x = F.lower(F.trim(col(c)))
    for ch in under:
        x = F.replace(x, F.lit(ch), F.lit("_"))
    return x


def domain(c: Column | str) -> Column:
    return by_rules(_plain(c, " "), DOMAINS, vocab.DOMAIN_RULES, "other")


def data_format(c: Column | str) -> Column:
    return by_rules(_plain(c), FORMATS, vocab.FORMAT_RULES, "other")


def license_type(c: Column | str) -> Column:
    return by_rules(_plain(c), LICENSES, vocab.LICENSE_RULES, "unknown")


def task_type(c: Column | str) -> Column:
    return by_rules(_plain(c, " -"), TASKS, vocab.TASK_RULES, "other")


def modality(c: Column | str) -> Column:
    return by_rules(_plain(c, " -"), MODALITIES, vocab.MODALITY_RULES, "other")


def query_task_type(c: Column | str) -> Column:
    members = [t for t in TASKS if t not in ("relation_extraction", "coreference_resolution")] + ["unknown"]
    return by_rules(_plain(c, " -"), members, vocab.QUERY_TASK_RULES, "unknown")


def query_modality(c: Column | str) -> Column:
    return by_rules(_plain(c, " -"), [*MODALITIES, "unknown"], vocab.QUERY_MODALITY_RULES, "unknown")


def commercial_use(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(*COMMERCIAL), F.lit(False))


def license_name(c: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LICENSE_NAMES.items() for x in kv])[col(c)], F.lit("Unknown"))


def first_hit(tags: Column | str, f, miss: str = "other") -> Column:
    """First value that ``f`` finds in the tags."""
    return F.get(F.filter(F.transform(col(tags), f), lambda x: x != miss), 0)


def tag_tasks(tags: Column | str) -> Column:
    """Task types that tags name, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(col(tags), task_type), lambda x: x != "other"))


FAMILY, NEEDS = vocab.TASK_FAMILIES, vocab.TASK_NEEDS
SERVES = vocab.TASK_SERVES | {t: dict.fromkeys(MODALITIES, 0.5) for t in ("other", "unknown")}


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def family(c: Column | str) -> Column:
    """Family of a task, null for one of none."""
    return literal_map(FAMILY)[col(c)]


def needs_met(task: Column | str, modalities: Column | str) -> Column:
    """Share of the modalities a task needs that are there; 1 if it needs none."""
    needs = F.create_map(*[x for t, ms in NEEDS.items() for x in (F.lit(t), F.array(*[F.lit(m) for m in ms]) if ms else F.array().cast("array<string>"))])[col(task)]
    return F.when(F.coalesce(F.size(needs), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(needs, col(modalities))) / F.size(needs), 3))


def serve_table() -> list[tuple[str, str, float]]:
    """(task, modality, score) for every pair above 0, with 0.3 where only a task of the same family is served."""
    rows = []
    for t in [*TASKS, "unknown"]:
        own = SERVES.get(t, {})
        near = {m for s, f in FAMILY.items() if s != t and f == FAMILY.get(t) for m in SERVES.get(s, {})}
        rows += [(t, m, own.get(m, 0.3 if m in near else 0.0)) for m in MODALITIES if own.get(m, 0.0) > 0 or m in near]
    return rows


def serves(task: Column | str, modalities: Column | str) -> Column:
    """Best score of the modalities for a task; 0.3 if only a task of the same family is served.

    A modality served only by the family counts only where none serves the task itself; 0.3 is below any own score.
    """
    table = literal_map({f"{t} {m}": s for t, m, s in serve_table()})
    return F.coalesce(F.array_max(F.transform(col(modalities), lambda m: F.coalesce(table[F.concat_ws(" ", col(task), m)], F.lit(0.0)))), F.lit(0.0))
