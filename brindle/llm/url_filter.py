"""URL filters (operator 3): pattern rules indexed by their rarest literal token.

Each rule names literal tokens that any URL it fits must hold as whole tokens. One pass over the table counts
the rules' tokens; a rule is filed under the rarest of its own. A URL's tokens then fetch its candidate rules,
and only these run their regular expressions. A rule without a literal is a candidate for every URL. The pass over the URLs needs no shuffle, and what is sent to the
tasks is the rule list, whose length is a parameter of the caller's and is checked.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; it is allowed. Repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored. Literals other than
runs of a-z and 0-9 are refused, as no URL's tokens could fetch their rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, table

MAX_RULES = 100_000
TOKEN = re.compile("[a-z0-9]+")
#: Where rules without a literal are filed.
ANYWHERE = ""


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path; of the rules that fit, the highest rank, then the greatest name wins."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int
    base: bool = False


def site_rule(prefix: str, verdict: str) -> Rule:
    """A host with its subdomains and the start of a path, like ``example.org/en/1``."""
    host, slash, path = prefix.partition("/")
    cut = re.split("[^a-z0-9]+", path.lower())
    whole = [t for t in [*TOKEN.findall(host), *cut[:-1]] if t]  # the last part may go on in the URL
    return Rule(prefix, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole), 1000 + len(prefix), True)


def word_rule(name: str, verdict: str, pattern: str, *literals: str) -> Rule:
    return Rule(name, verdict, pattern, literals, len(name))


#: The rules that the contract names.
SITES = (
    site_rule("org/", "allow"),
    site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"),
    site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
)
#: The method's own rules: pages that seldom hold prose, and sites that corpora leave out.
WORDS = (
    word_rule("login page", "block", r"/(?:login|signin|logout)(?:[/.]|$)", "login"),
    word_rule("sign-in page", "block", r"/signin(?:[/.]|$)", "signin"),
    word_rule("shopping cart", "block", r"/cart/(?:checkout|items)(?:[/.]|$)", "cart"),
    word_rule("casino", "block", r"^(?:[^/]*[.-])?casino[.-]", "casino"),
    word_rule("adult", "block", r"^(?:[^/]*[.-])?(?:porn|xxx)[.-]", "xxx"),
    word_rule("adult host", "block", r"^(?:[^/]*[.-])?porn[.-]", "porn"),
    word_rule("feed", "block", r"/(?:feed|rss)/?(?:index\.xml)?$", "feed"),
    word_rule("page for printing", "block", r"/print(?:/|\.html?$|$)", "print"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(sites: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How often each of the rules' own tokens occurs; at most as many rows as the rules have tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.literals})
    tokens = sites.select(F.explode(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), 0)).alias("token"))
    found = tokens.filter(F.col("token").isin(wanted)).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {x["token"]: x["count"] for x in found}


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITES + WORDS, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule): rule names the site rule that won, pattern_rule any other."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the tasks hold at most {MAX_RULES}")
    if odd := [r.name for r in rules if not all(TOKEN.fullmatch(t) for t in r.literals)]:
        raise ValueError(f"literals are runs of a-z and 0-9, unlike those of {odd[:5]}")
    sites = pages.select(at(id_col).alias("page_id"), at(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    sites = sites.select("page_id", host.alias("host"), path.alias("path"))
    counts = token_counts(sites, rules)
    filed: dict[str, list[tuple]] = {}
    for r in rules:
        rarest = min(r.literals, key=lambda t: (counts[t], t), default=ANYWHERE)
        filed.setdefault(rarest, []).append((r.base, r.rank, r.name, r.verdict, r.pattern))

    @F.pandas_udf("name string, base boolean, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = {t: [(*r[:4], re.compile(r[4])) for r in sorted(rs, reverse=True)] for t, rs in filed.items()}
        for urls in batches:
            won = []
            for url in urls:
                near = [r for t in {ANYWHERE, *TOKEN.findall(url.lower())} & index.keys() for r in index[t]]
                fits = max((r[:4] for r in near if r[4].search(url)), default=None)
                won.append((fits[2], fits[0], fits[3]) if fits else (None, None, otherwise))
            yield pd.DataFrame(won, columns=["name", "base", "verdict"])

    out = sites.withColumn("won", judge(F.concat("host", "path")))
    base = F.coalesce(F.col("won.base"), F.lit(False))
    return out.select("page_id", "host", "path", F.when(base, F.col("won.name")).alias("rule"), F.col("won.verdict").alias("verdict"), F.when(~base, F.col("won.name")).alias("pattern_rule"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = {"op3_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule, host || path AS site FROM u),
g AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(site, '/print(?:/|\.html?$|$)') THEN 'page for printing'
  WHEN regexp_matches(site, '/cart/(?:checkout|items)(?:[/.]|$)') THEN 'shopping cart'
  WHEN regexp_matches(site, '/signin(?:[/.]|$)') THEN 'sign-in page'
  WHEN regexp_matches(site, '/login(?:[/.]|$)') THEN 'login page'
  WHEN regexp_matches(site, '^(?:[^/]*[.-])?porn[.-]') THEN 'adult host'
  WHEN regexp_matches(site, '^(?:[^/]*[.-])?casino[.-]') THEN 'casino'
  WHEN regexp_matches(site, '^(?:[^/]*[.-])?xxx[.-]') THEN 'adult'
  WHEN regexp_matches(site, '/feed/?(?:index\.xml)?$') THEN 'feed' END AS pattern_rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern_rule FROM g
"""}
