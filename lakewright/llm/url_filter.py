"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is filed under the one of its literal tokens that the fewest rules hold. The tokens of a URL fetch the
rules filed under them, and only those run their regular expressions, compiled when first fetched. An index is
bounded (MAX_RULES) and broadcast; the URLs are never shuffled. A longer list is matched in several passes, one
index each. Rules are on hosts and paths, wildcards over both, or expressions; `parse_rules` reads them from lines.

Cases: a null URL, or one without "://", has an empty host and path, fits no host rule and gets the default;
repeated rows are judged each on its own; an empty table gives an empty result; other columns are not read;
equally long fitting rules: block goes before allow, then the rule's text decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, free_name, table

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules in one index; about 40 MB in each worker.
MAX_RULES = 200_000

#: The host and path rules of the production query.
HOST_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Rules on the host alone, which decide where no host and path rule fits.
PATTERN_RULES = [
    ("block", r"(^|[.-])casino([.-]|$)", "casino"),
    ("block", r"(^|[.-])bets([.-]|$)", "bets"),
    ("block", r"(^|[.-])pills([.-]|$)", "pills"),
    ("block", r"(^|[.-])ads([.-]|$)", "ads"),
    ("block", r"(^|[.-])porn([.-]|$)", "porn"),
]


@dataclass(frozen=True)
class Rule:
    """A rule's expression runs on the host, a #, which neither part holds, and the path; on the host alone; or on host and path joined."""

    verdict: str
    text: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    host_alone: bool = False
    joined: bool = False


def host_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    pattern = rf"\A(?:[^#]*\.)?{re.escape(host)}\#{re.escape(slash + path)}"
    # The last path token may continue in the URL, so only host tokens and closed path tokens are literal.
    closed = TOKEN.findall(path.translate(LOWER)) if path.endswith("/") else TOKEN.findall(path.translate(LOWER))[:-1]
    return Rule(verdict, text, pattern, tuple(TOKEN.findall(host) + closed), 1)


def wildcard_rule(verdict: str, text: str) -> Rule:
    """A rule on the host and the path together, where * stands for anything; it is anchored at both ends."""
    pattern = r"\A" + ".*".join(map(re.escape, text.split("*"))) + r"\Z"
    # A token beside a * may go on in the URL.
    literal = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", text.translate(LOWER))
    return Rule(verdict, text, r"(?s)" + pattern, tuple(literal), 0, joined=True)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Lines of a verdict and a rule: a host and path (example.org/a/), a wildcard (*/track/*.gif), or re: and an expression on the host."""
    rules = []
    for line in lines:
        verdict, _, text = line.strip().partition(" ")
        if not text or verdict.startswith("#"):
            continue
        if verdict not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {line!r}")
        if text.startswith("re:"):
            rules.append(host_pattern_rule(verdict, text[3:]))
        elif "*" in text:
            rules.append(wildcard_rule(verdict, text))
        else:
            rules.append(host_rule(verdict, text if "/" in text else text + "/"))
    return rules


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(verdict, pattern, pattern, tokens, 0)


def host_pattern_rule(verdict: str, pattern: str, *tokens: str, text: str | None = None) -> Rule:
    """An expression on the host, compiled as it is given; text: what it is called in results."""
    return Rule(verdict, text or pattern, pattern, tokens, 0, True)


def production_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [host_pattern_rule(verdict, rf"(^|[.-]){word}([.-]|\Z)", word, text=text) for verdict, text, word in PATTERN_RULES]


def index_rules(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; a rule without a token is filed under the empty token, which every URL has."""
    held = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        token = min(set(r.tokens), key=lambda t: (held[t], -len(t), t), default="")
        index.setdefault(token, []).append(r)
    return index


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class Matcher:
    def __init__(self, rules: list[Rule]):
        self.index = index_rules(rules)
        self.compiled: dict[str, list[tuple[Rule, re.Pattern]]] = {}

    def fetched(self, token: str) -> list[tuple[Rule, re.Pattern]]:
        if token not in self.compiled:
            self.compiled[token] = [(r, re.compile(r.pattern)) for r in self.index[token]]
        return self.compiled[token]

    def best(self, host: str, path: str) -> Rule | None:
        tokens = {*TOKEN.findall(host), *TOKEN.findall(path.translate(LOWER)), ""}
        subject = lambda r: host if r.host_alone else host + path if r.joined else f"{host}#{path}"
        fits = [r for t in tokens if t in self.index for r, p in self.fetched(t) if p.search(subject(r))]
        return max(fits, key=precedence, default=None)


def precedence(r: Rule) -> tuple:
    return (r.rank, len(r.text) if r.rank else 0, r.verdict == "block", r.text)


def judge(shared):
    """An Arrow-batched function from URLs to the host, the path and the best rule of this index."""

    @F.pandas_udf("host string, path string, rank int, text string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split_url(url)
                r = matcher.best(host, path)
                rows.append((host, path, r.rank, r.text, r.verdict) if r else (host, path, None, None, None))
            out = pd.DataFrame(rows, columns=["host", "path", "rank", "text", "verdict"])
            yield out.astype({"rank": "Int32"})

    return judged.asNondeterministic()


def url_filter(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """key, host, path, rule (the fitting host rule, else null), verdict, pattern (the deciding pattern rule, else null)."""
    parts = [rules[i : i + max_rules] for i in range(0, len(rules), max_rules)] or [[]]
    df = pages.select(F.col(key), F.col("url"))
    names = []
    for part in parts:
        names.append(free_name(df, f"judged{len(names)}"))
        df = df.withColumn(names[-1], judge(pages.sparkSession.sparkContext.broadcast(part))(F.col("url")))
    order = lambda j: F.struct(j["rank"], F.when(j["rank"] == 1, F.length(j["text"])).otherwise(0), j["verdict"] == "block", j["text"], j["verdict"])
    best = F.greatest(*(F.when(F.col(n)["rank"].isNotNull(), order(F.col(n))) for n in names)) if len(names) > 1 else order(F.col(names[0]))
    first = F.col(names[0])
    return (
        df.select(key, first["host"].alias("host"), first["path"].alias("path"), best.alias("best"))
        .toDF(key, "host", "path", "best")
        .select(
            key,
            "host",
            "path",
            F.when(F.col("best.rank") == 1, F.col("best.text")).alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
            F.when(F.col("best.rank") == 0, F.col("best.text")).alias("pattern"),
        )
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), production_rules())


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN url LIKE '%://%' THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, n,
         translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM parts),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
                                ('block', 'net/es/'), ('block', 'net/fr/')),
fits AS (
  SELECT s.n, r.rule, r.verdict, row_number() OVER (PARTITION BY s.n ORDER BY length(r.rule) DESC) AS k
  FROM split s JOIN rules r
    ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/')))),
patterns(pattern) AS (VALUES ('(^|[.-])casino([.-]|$)'), ('(^|[.-])bets([.-]|$)'), ('(^|[.-])pills([.-]|$)'),
                             ('(^|[.-])ads([.-]|$)'), ('(^|[.-])porn([.-]|$)')),
hits AS (SELECT s.n, max(p.pattern) AS pattern FROM split s JOIN patterns p ON regexp_matches(s.host, p.pattern) GROUP BY s.n)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN h.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.rule IS NULL THEN h.pattern END AS pattern
FROM split s LEFT JOIN fits f ON f.n = s.n AND f.k = 1 LEFT JOIN hits h ON h.n = s.n
"""
