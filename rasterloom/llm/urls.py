"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that every url it fits must
hold as whole tokens. Spark counts how many urls hold each of them; a rule is listed under the rarest. The
tokens of a url fetch the rules listed under them, and only those run. Site rules (host, path) fit a host
and its subdomains where the url's path starts with the rule's; the longest that fits decides, ties going
to the longer host, then to block. Where none fits, the patterns decide: a url that fits a blocking pattern
and no allowing one is blocked, any other allowed.

Patterns are literal text in lower case with `^` for one character other than a-z and 0-9, or the beginning
or end, and `*` for any characters; they look at host, path, query and fragment, A-Z lower-cased.

A null url, one without `://` and an empty one have empty host and path; no rule fits them. Repeated rows
are judged alike; an empty table gives an empty result; other columns are ignored, whatever their names.
Rules without any whole literal token run on every url. Rules reach the executors some at a time, at most
`RULES` rules and `CHARS` characters together; all of them are tried in the same pass over the urls.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the rules that are sent together; a longer rule goes by itself.
RULES, CHARS = 20_000, 4_000_000
TOKEN = "[0-9a-z]+"

#: Site rules as (verdict, host, path).
SITES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Gambling, adult, drug and fraud sites, spam, and addresses that hold no article.
BLOCKED = (
    "^casino^", "^poker^", "^roulette^", "^betting^", "^sportsbook^", "^slots^", "^jackpot^", "^lottery^",
    "^adult^", "^porn^", "^xxx^", "^sex^", "^nude^", "^escort^", "^camgirls^", "^hentai^",
    "^viagra^", "^cialis^", "^pharmacy^cheap^", "^cheap^pharmacy^", "^payday^loan", "^replica^watches^", "^get^rich^",
    "^warez^", "^keygen^", "^torrent^", "^phishing^", "^malware^",
    "^wp-login.php^", "^wp-admin^", "^cgi-bin^", "/cart/*^checkout^", "?*^sessionid=", "?*^phpsessid=",
)
ALLOWED = ("^adult^education^", "^sex^education^", "^casino^royale^", "^lottery^fund^")


@dataclass(frozen=True)
class Rule:
    """`text` names it; `site` rules look at host and path from the beginning, others at all of the url."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False
    host_length: int = 0


def _lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def site_rule(verdict: str, host: str, path: str) -> Rule:
    whole = host + path
    # A last token that the path leaves open may be the beginning of a longer one.
    closed = re.sub(f"{TOKEN}$", "", _lower(whole)) if path else _lower(whole)
    pattern = rf"(?:[^/]*\.)?{re.escape(whole)}" + ("" if path else r"(?=/|\Z)")
    return Rule(whole, verdict, pattern, tuple(re.findall(TOKEN, closed)), True, len(host))


def pattern_rule(verdict: str, text: str) -> Rule:
    parts = re.split(r"([*^])", text)
    regex = "".join({"*": "(?s:.*)", "^": "(?:^|[^0-9a-z]|$)"}.get(p) or re.escape(p) for p in parts)
    # Tokens that touch `*` or an end of the text may continue in the url.
    open_ends = "*" + text + "*"
    return Rule(text, verdict, regex, tuple(re.findall(rf"(?<![0-9a-z*]){TOKEN}(?![0-9a-z*])", open_ends)))


RULE_LIST = tuple([site_rule(*s) for s in SITES] + [pattern_rule("block", t) for t in BLOCKED] + [pattern_rule("allow", t) for t in ALLOWED])


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the host) of a url."""
    after = r"(?s)^.*?://"
    get = lambda pattern: F.coalesce(F.regexp_extract(url, after + pattern, 1), F.lit(""))
    return _ascii_lower(get("([^/?#]*)")), get("[^/?#]*([^?#]*)"), get("[^/?#]*(.*)$")


def token_counts(whole: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many rows of `whole` (lower-cased) each literal token of the rules stands."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    listed = whole.sparkSession.createDataFrame([(t,) for t in names], "token string")
    found = whole.select(F.explode(F.array_distinct(F.regexp_extract_all("whole", F.lit(TOKEN), F.lit(0)))).alias("token"))
    counts = found.groupBy("token").agg(F.count("*").alias("n")).join(listed, "token")
    return {t: 0 for t in names} | {r["token"]: r["n"] for r in counts.collect()}


def listed(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token (ties to the longer, then to the smaller one); None: those without."""
    out: dict[str | None, list[Rule]] = defaultdict(list)
    for rule in rules:
        out[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)].append(rule)
    return dict(out)


def blocks(rules: tuple[Rule, ...]) -> Iterator[tuple[Rule, ...]]:
    held, size = [], 0
    for rule in rules:
        if held and (len(held) == RULES or size + len(rule.pattern) > CHARS):
            yield tuple(held)
            held, size = [], 0
        held.append(rule)
        size += len(rule.pattern)
    if held:
        yield tuple(held)


#: What a block of rules says: the longest site rule as a sort key, and a fitting pattern of each verdict.
KEY = ("size", "host", "verdict", "rule")
FOUND = "size int, host int, verdict string, rule string, allow string, block string"


def _matcher(index: dict[str | None, list[Rule]], sc):
    shared = sc.broadcast(index)

    @F.pandas_udf(FOUND)
    def found(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index, compiled = shared.value, {}

        def run(rule: Rule) -> re.Pattern:
            if rule not in compiled:
                compiled[rule] = re.compile(rule.pattern)
            return compiled[rule]

        for address, whole in columns:
            rows = []
            for a, w in zip(address, whole):
                best, fits = None, {"allow": None, "block": None}
                for token in {None, *re.findall(TOKEN, w)} & index.keys():
                    for rule in index[token]:
                        if rule.site:
                            key = (len(rule.text), rule.host_length, rule.verdict, rule.text)
                            if (best is None or key > best) and run(rule).match(a):
                                best = key
                        elif (fits[rule.verdict] is None or rule.text < fits[rule.verdict]) and run(rule).search(w):
                            fits[rule.verdict] = rule.text
                rows.append((*(best or (None,) * len(KEY)), fits["allow"], fits["block"]))
            yield pd.DataFrame(rows, columns=[*KEY, "allow", "block"], dtype=object)

    return found


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULE_LIST) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and the pattern that decided, if one did."""
    host, path, rest = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), _ascii_lower(F.concat(host, rest)).alias("whole"))
    counts = token_counts(cut.select("whole"), rules)
    said = [_matcher(listed(b, counts), pages.sparkSession.sparkContext)(F.concat("host", "path"), "whole") for b in blocks(rules)]
    if not said:
        none = F.lit(None).cast("string")
        return cut.select("page_id", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict"), none.alias("pattern"))
    each = cut.select("page_id", "host", "path", *[s.alias(f"b{i}") for i, s in enumerate(said)])
    of = lambda make: F.array(*[make(f"b{i}") for i in range(len(said))])
    site = of(lambda b: F.when(F.col(f"{b}.rule").isNotNull(), F.struct(*[F.col(f"{b}.{k}") for k in KEY])))
    first = lambda verdict: F.array_min(of(lambda b: F.col(f"{b}.{verdict}"))).alias(verdict)
    each = each.select("page_id", "host", "path", F.array_max(site).alias("site"), first("allow"), first("block"))
    blocked = F.col("block").isNotNull() & F.col("allow").isNull()
    decided = F.when(F.col("site").isNull(), F.when(blocked, F.col("block")).otherwise(F.col("allow")))
    return each.select(
        "page_id",
        "host",
        "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        decided.alias("pattern"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(c).replace("'", "''") + "'" for c in row) + ")" for row in rows)


#: The same rows in DuckDB: every rule against every url.
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1), '') AS rest
  FROM pages
), sites(verdict, host, path) AS (VALUES {_values(SITES)}),
patterns(verdict, text, pattern) AS (VALUES {_values([(r.verdict, r.text, r.pattern) for r in RULE_LIST if not r.site])}),
fits AS (
  SELECT c.n, arg_max(s, (length(s.host || s.path), length(s.host), s.verdict)) AS best
  FROM cut c JOIN sites s ON (c.host = s.host OR ends_with(c.host, '.' || s.host)) AND starts_with(c.path, s.path)
  GROUP BY c.n
), matched AS (
  SELECT c.n, min(p.text) FILTER (p.verdict = 'allow') AS allow, min(p.text) FILTER (p.verdict = 'block') AS block
  FROM cut c JOIN patterns p
    ON regexp_matches(translate(c.host || c.rest, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), p.pattern)
  GROUP BY c.n
)
SELECT c.page_id, c.host, c.path, f.best.host || f.best.path AS rule,
       coalesce(f.best.verdict, CASE WHEN m.block IS NOT NULL AND m.allow IS NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.n IS NULL THEN CASE WHEN m.allow IS NULL THEN m.block ELSE m.allow END END AS pattern
FROM cut c LEFT JOIN fits f USING (n) LEFT JOIN matched m USING (n)
"""
