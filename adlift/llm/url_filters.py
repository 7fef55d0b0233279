"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules judge a url.  A site rule ``host/path`` fits its host and
all subdomains if the url's path starts with the rule's; the longest fitting
one decides.  Else pattern rules are tried on the whole url: ``*`` is any run
of characters, ``^`` a separator (no letter, digit, ``-``, ``.``, ``%`` or
``_``) or the end, ``||`` the beginning of the host or of a subdomain; an
allowing pattern wins over blocking ones.  Else ``default`` holds.

A rule can fit only urls that hold all of its literal tokens, runs of letters
and digits that the rule bounds on both sides.  Rules are indexed by the token
that is rarest over all urls; a url's tokens fetch candidate rules, and only
those run their regular expressions.  Rules without such a token run always.

The rule set is a parameter held by every task, its size checked against
``MAX_RULES``; urls are never shuffled.  A-Z are taken as a-z in hosts and by
patterns, not in paths.

Cases: a null url, or one without ``://``, has an empty host and path; null
gets the default; equal urls are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 500_000

#: site rules of the query
SITE_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: pattern rules of the query
PATTERN_RULES = (
    ("block", "||casino-win."),
    ("block", "||free-bets."),
    ("block", "||cheap-pills."),
    ("block", "/ads/"),
    ("block", "^utm_source=spam^"),
    ("block", "/en/*.php^"),
    ("allow", "||blog.*/en/"),
)
DEFAULT = "allow"

_AZ = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile("[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9\-.%_]|\Z)"
_PARTS = re.compile(r"\|\||\*|\^|[^*^|]+|\|")


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(_AZ), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    site: bool

    def regex(self) -> str:
        if self.site:
            host, slash, path = self.text.partition("/")
            end = re.escape(slash + path) if slash else r"(?=/|\Z)"
            return rf"(?:[^/]*\.)?{re.escape(host.translate(_AZ))}{end}"
        out = []
        for part in _PARTS.findall(self.text.translate(_AZ)):
            out.append({"||": r"(?:\A|://)(?:[^/?#]*\.)?", "*": ".*", "^": _SEPARATOR}.get(part, re.escape(part)))
        return "".join(out)

    def tokens(self) -> list[str]:
        """Literal tokens that the rule bounds on both sides."""
        text = self.text.translate(_AZ)
        # a site rule starts at a host's label; a pattern may start within a word
        marked = f"/{text}" if self.site else text.replace("||", "/").replace("^", "/")
        if self.site and "/" not in text:
            marked += "/"
        found = re.finditer("[a-z0-9]+", marked)
        inner = lambda i: 0 <= i < len(marked) and marked[i] != "*"
        return [m[0] for m in found if inner(m.start() - 1) and inner(m.end())]


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], seen: dict[str, int]):
        self.always: list[tuple[Rule, re.Pattern]] = []
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            entry = (r, re.compile(r.regex(), re.DOTALL))
            if tokens := r.tokens():
                rarest = min(tokens, key=lambda t: (seen.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, url: str) -> list[tuple[Rule, re.Pattern]]:
        out = list(self.always)
        for t in set(_TOKEN.findall(url)):
            out += self.by_token.get(t, ())
        return out

    def judge(self, url: str | None, default: str) -> tuple[str, str, str | None, str]:
        """(host, path, site rule or None, verdict)."""
        host, path = host_and_path(url)
        if url is None:
            return host, path, None, default
        lower, best, actions = url.translate(_AZ), None, set()
        for rule, pattern in self.candidates(lower):
            if rule.site:
                if (host or path) and pattern.match(host + path):
                    best = max(best or rule, rule, key=lambda r: (len(r.text), r.action == "block"))
            elif pattern.search(lower):
                actions.add(rule.action)
        if best:
            return host, path, best.text, best.action
        return host, path, None, "allow" if "allow" in actions else "block" if "block" in actions else default


def rule_set(site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    rules = [Rule(a, t, True) for a, t in site_rules] + [Rule(a, t, False) for a, t in pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; every task holds them all, so {MAX_RULES} at most")
    return rules


def token_frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules is: a row per such token."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    wanted_rows = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(wanted_rows), "token", "left_semi")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judgement(index: Index, default: str, spark) -> Column:
    """struct(host, path, rule, verdict) of the url column."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.judge(u, default) for u in urls], columns=["host", "path", "rule", "verdict"], dtype=object)

    return judge(F.col("url"))


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each page."""
    rules = rule_set(site_rules, pattern_rules)
    index = Index(rules, token_frequencies(pages, rules))
    rows = pages.select("page_id", judgement(index, default, pages.sparkSession).alias("j"))
    return rows.select("page_id", "j.*")
