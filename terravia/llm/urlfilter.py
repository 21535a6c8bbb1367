"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern is written with `*` (any characters), `^` (a separator or the end), `||` (start
of a host label) and `|` (start or end of the URL). Its literal tokens are the runs of
a-z and 0-9 that separators of the pattern itself bound on both sides, so a URL that fits
it has them among its own tokens. Each rule is filed under the one of its tokens that is
rarest in the URLs to be judged (counted over all of them). The tokens of a URL fetch the
rules filed under them, and only those run as regular expressions. Rules without such a
token are always run.

Host rules fit a host and its subdomains where the URL's path starts with the rule's; the
longest fitting rule decides. Otherwise the pattern rules decide: a fitting rule that
allows outweighs those that block; without any the URL is allowed.

Defined cases: a null URL, or one without `://`, has an empty host and path and is
allowed. Equal URLs are judged alike; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import ascii_lower, unused

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PATTERN_RULES = tuple(
    [PatternRule("block", p) for p in (
        "/ads/*", "/adserver/", "/banners/*", "||ads.", "||adserver.", "||tracker.", "||metrics.", "||doubleclick.",
        "^sessionid=", "^phpsessid=", "^sid=", "^replytocom=", "^utm_source=", "^gclid=", "^fbclid=", "/wp-admin/", "/wp-login.php",
        "/cgi-bin/", "/login^", "/signup^", "/cart^", "/checkout^", "/print/*", "/calendar/*/day^", "/search?*q=", "/tag/*/page/",
        ".exe|", ".zip|", ".apk|", ".jpg|", ".png|", ".gif|", ".css|", ".js|", "/casino/", "/xxx/", "^casino^", "^porn^", "-download-free-",
    )]
    + [PatternRule("allow", p) for p in ("/wp-login.php?help^", "/docs/ads/", "/robots.txt|")]
)


def compiled(pattern: str) -> re.Pattern[str]:
    p, head, tail = pattern.lower(), "", ""
    if p.startswith("||"):
        p, head = p[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif p.startswith("|"):
        p, head = p[1:], "^"
    if p.endswith("|"):
        p, tail = p[:-1], "$"
    return re.compile(head + "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in p) + tail, re.DOTALL)


def literal_tokens(pattern: str) -> set[str]:
    """Runs that no URL can extend: separators, or an anchored end, stand on both sides."""
    p = pattern.lower()
    found = set()
    for m in TOKEN.finditer(p):
        left = p[m.start() - 1] if m.start() else "*"
        right = p[m.end()] if m.end() < len(p) else "*"
        if left != "*" and right != "*":
            found.add(m[0])
    return found


#: Rules that are read from a table at most; they go to every task.
MOST_RULES = 100_000


def rules_of(table: DataFrame) -> tuple[tuple[HostRule, ...], tuple[PatternRule, ...]]:
    """Host and pattern rules from a table: verdict (allow, block), and either host with path (null: any) or pattern. A host that is there twice with one path is an error, as is a row that is neither."""
    rows = table.select("verdict", "host", "path", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hosts, patterns = [], []
    for r in rows:
        if r["verdict"] not in ("allow", "block") or (r["host"] is None) == (r["pattern"] is None):
            raise ValueError(f"no rule: {r.asDict()}")
        if r["host"] is None:
            patterns.append(PatternRule(r["verdict"], r["pattern"]))
        else:
            hosts.append(HostRule(r["verdict"], r["host"].lower(), r["path"] or "/"))
    if len({h.name for h in hosts}) < len(hosts):
        raise ValueError("two rules for one host and path")
    return tuple(sorted(hosts, key=lambda h: h.name)), tuple(sorted(patterns, key=lambda p: (p.pattern, p.verdict)))


def token_counts(urls: DataFrame, url: str, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """In how many places of all the URLs each literal token of the rules occurs; no more entries than the rules have tokens."""
    wanted = sorted(set().union(*(literal_tokens(r.pattern) for r in rules)) if rules else ())
    tokens = urls.select(F.explode(F.regexp_extract_all(ascii_lower(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    return {r["t"]: r["count"] for r in tokens.where(F.col("t").isin(wanted)).groupBy("t").count().collect()} if wanted else {}


class Filter:
    """The index: host rules by host, pattern rules by rarest token."""

    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...], counts: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = {}
        for rule in hosts:
            self.hosts.setdefault(rule.host, []).append(rule)
        self.filed: dict[str, list[tuple[re.Pattern[str], str]]] = {}
        self.always: list[tuple[re.Pattern[str], str]] = []
        for rule in patterns:
            tokens = literal_tokens(rule.pattern)
            where = self.filed.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always
            where.append((compiled(rule.pattern), rule.verdict))

    def host_rule(self, host: str, path: str) -> HostRule | None:
        best, at = None, 0
        while host and at >= 0:
            for rule in self.hosts.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            at = host.find(".", at) + 1 or -1
        return best

    def by_pattern(self, url: str) -> str:
        low = url.lower()
        candidates = [c for t in set(TOKEN.findall(low)) for c in self.filed.get(t, ())] + self.always
        said = {verdict for regex, verdict in candidates if regex.search(low)}
        return "block" if said == {"block"} else "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    empty = F.lit("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), empty)
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), empty)
    return ascii_lower(host), path


def judge(rows: DataFrame, url: str = "url", into: str = "judged", hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """rows with a struct column `into`: host, path, rule, verdict."""
    counts = token_counts(rows, url, patterns)

    @F.pandas_udf("rule string, verdict string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        filters = Filter(hosts, patterns, counts)
        for urls, names, paths in batches:
            out = []
            for u, h, p in zip(urls, names, paths, strict=True):
                rule = filters.host_rule(h, p)
                out.append((rule.name, rule.verdict) if rule else (None, filters.by_pattern(u) if h or p else "allow"))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    host, path = host_and_path(F.col(url))
    said = verdict(F.col(url), host, path)
    (at,) = unused(rows, "said")
    return rows.withColumn(at, said).withColumn(into, F.struct(host.alias("host"), path.alias("path"), F.col(f"{at}.rule"), F.col(f"{at}.verdict"))).drop(at)


def op8(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "judged.*")


def oracle(hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """Every rule on every URL."""
    quote = lambda s: s.replace("'", "''")
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in hosts)
    by = {v: "|".join(f"(?:{compiled(r.pattern).pattern})" for r in patterns if r.verdict == v) for v in ("allow", "block")}
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
 split AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
 rules(v, h, p) AS (VALUES {rules}),
 fits AS (
  SELECT s.page_id, s.url, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(r.h || r.p) DESC) AS n
  FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT s.page_id, s.host, s.path, f.rule,
  CASE WHEN f.v IS NOT NULL THEN f.v
       WHEN s.host = '' AND s.path = '' THEN 'allow'
       WHEN regexp_matches(lower(s.url), '{quote(by["allow"])}', 's') THEN 'allow'
       WHEN regexp_matches(lower(s.url), '{quote(by["block"])}', 's') THEN 'block' ELSE 'allow' END AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND s.url IS NOT DISTINCT FROM f.url AND f.n = 1
"""
