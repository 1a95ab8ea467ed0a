"""URL filters: pattern rules indexed by their rarest literal token.

A URL is split into tokens; the tokens fetch the few rules that could match, and
only those run their regular expressions.  A rule is filed under that one of its
whole literal tokens that is rarest in the judged URLs, so a token that a third of
all URLs share (``com``) files no rule that has any other token.

Two kinds of rules:

* host rules ``host/path``: fit the host and all its subdomains if the URL's path
  starts with the rule's path.  The longest rule that fits decides.
* pattern rules, asked where no host rule fits: ``||`` anchors at a label of the
  host, ``|`` at an end, ``*`` stands for anything and ``^`` for a separator or the
  end.  They see the lower-cased URL after ``://``.  An ``allow`` pattern overrides
  ``block`` patterns; without any match the verdict is ``allow``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import Memo, UPPER, free_name, kept, without

#: Rules are sent to every executor; a longer list is refused.
MAX_RULES = 500_000

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    action: str  # allow or block
    regex: str
    tokens: tuple[str, ...]  # those that every matching URL has as whole tokens
    host_rule: bool


def host_rule(text: str, action: str) -> Rule:
    """``example.com/en/7``: a host, its subdomains, and paths that start with ``/en/7``."""
    host, _, path = text.partition("/")
    host, path = host.lower(), f"/{path}"
    # The last token of the path may go on in the URL; all others are whole.
    tokens = TOKEN.findall(host) + TOKEN.findall(re.sub("[A-Za-z0-9]+$", "", path).lower())
    return Rule(text, action, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)), True)


def pattern_rule(text: str, action: str) -> Rule:
    """A pattern with ``||``, ``|``, ``*`` and ``^``; see the module's text."""
    body, start, end = text.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    tokens = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else ("/" if start else "*")
        after = body[m.end()] if m.end() < len(body) else ("/" if end else "*")
        if before != "*" and after != "*":
            tokens.append(m[0])
    return Rule(text, action, start + regex + end, tuple(dict.fromkeys(tokens)), False)


#: The rules that the query's contract fixes.
HOST_RULES = (
    host_rule("com/en/", "block"),
    host_rule("example.com/en/7", "allow"),
    host_rule("net/de/", "allow"),
    host_rule("example.net/de/8", "block"),
    host_rule("org/es/", "block"),
)

#: What is blocked elsewhere: hosts of advertising and tracking, and sections that hold no prose.
PATTERN_RULES = tuple(
    pattern_rule(text, action)
    for text, action in (
        ("||ads-track.*", "block"),
        ("||*.ads-track.*", "block"),
        ("||adserver.*", "block"),
        ("||tracker.*", "block"),
        ("/ads/*", "block"),
        ("/banner/*", "block"),
        ("/casino/*", "block"),
        ("/porn/*", "block"),
        ("/login^", "block"),
        ("/cart/checkout^", "block"),
        ("/ads/about^", "allow"),
    )
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def token_counts(df: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens.  At most as many rows as the rules have tokens come back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    own = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    found = df.select(F.explode(tokens).alias("token")).join(own, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and the rules without a whole token, which every URL has to try."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(host: str, path: str, rest: str, rules, compiled, index, always) -> tuple[str | None, str, int]:
    """Rule, verdict and the number of regular expressions tried."""
    candidates = list(always)
    for token in set(TOKEN.findall(rest)):
        candidates += index.get(token, ())
    best, actions = None, set()
    location = host + path
    for i in candidates:
        rule = rules[i]
        if rule.host_rule:
            if (best is None or len(rule.text) > len(best.text)) and compiled[i].match(location):
                best = rule
        elif compiled[i].search(rest):
            actions.add(rule.action)
    if best is not None:
        return best.text, best.action, len(candidates)
    return None, "block" if actions == {"block"} else "allow", len(candidates)


def filter_urls(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the host rule that decided, or null), ``verdict`` and ``n_tried``.

    No shuffle of the rows: one narrow pass counts the rules' tokens, one judges.
    Null URLs and URLs without ``://`` have an empty host and path and are allowed.
    Repeated rows are judged alike; input columns named like an output give way; an
    empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the executors")
    if clash := [n for n in ("host", "path", "rule", "verdict", "n_tried") if n == url_col]:
        raise ValueError(f"the URL column is named like an output: {clash[0]}")
    index, always = build_index(rules, token_counts(df, url_col, rules))

    @F.pandas_udf("rule string, verdict string, n_tried int")
    def verdicts(host: pd.Series, path: pd.Series, rest: pd.Series) -> pd.DataFrame:
        compiled = kept("url_filters", lambda: Memo(lambda i: re.compile(rules[i].regex, re.DOTALL)), rules)  # only candidates are compiled
        rows = [judge(h, p, x, rules, compiled, index, always) for h, p, x in zip(host, path, rest, strict=True)]
        return pd.DataFrame(rows, columns=["rule", "verdict", "n_tried"])

    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    out = without(df, ["host", "path", "rule", "verdict", "n_tried"])
    own, rest, judged = [F.col(f"`{c}`") for c in out.columns], free_name(out, "_rest"), free_name(out, "_judged")
    out = out.select(*own, host_of(url).alias("host"), path_of(url).alias("path"), F.lower(_rest(url)).alias(rest))
    out = out.withColumn(judged, verdicts("host", "path", rest))
    return out.select(*own, "host", "path", f"{judged}.rule", f"{judged}.verdict", f"{judged}.n_tried")
