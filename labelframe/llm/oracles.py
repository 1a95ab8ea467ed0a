"""The results of queries whose method SQL can state, in SQL of DuckDB."""

from __future__ import annotations

from labelframe.llm.common import UPPER
from labelframe.llm.url_filters import PATTERN_RULES

_ALPHABET = UPPER + "234567"


def warc() -> str:
    """Equal payloads: the smallest page is the response.  Base32: five bits at a time of the SHA-1."""
    bits = "('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)) & 31"
    digest = f"list_reduce(list_transform(range(32), lambda i: '{_ALPHABET}'[CAST({bits} AS BIGINT) + 1]), lambda a, b: a || b)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {digest} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d"""


#: The contract's rules, longest first (fixed values): what is shown, verdict, host, begin of the path.
RULES = (
    ("example.net/de/8", "block", "example.net", "/de/8"),
    ("example.com/en/7", "allow", "example.com", "/en/7"),
    ("com/en/", "block", "com", "/en/"),
    ("net/de/", "allow", "net", "/de/"),
    ("org/es/", "block", "org", "/es/"),
)


def url_filters() -> str:
    """Host rules, longest first; then block patterns unless an allow pattern matches."""
    fits = [(r, f"(host = '{r[2]}' OR ends_with(host, '.{r[2]}')) AND starts_with(path, '{r[3]}')") for r in RULES]
    rule = " ".join(f"WHEN {c} THEN '{r[0]}'" for r, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r[1]}'" for r, c in fits)
    some = {a: " OR ".join("regexp_matches(rest, '{}', 's')".format(r.regex.replace("\\Z", "$")) for r in PATTERN_RULES if r.action == a) for a in ("block", "allow")}
    verdict += f" WHEN ({some['block']}) AND NOT ({some['allow']}) THEN 'block' ELSE 'allow'"
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS raw FROM pages),
x AS (SELECT page_id, lower(raw) AS rest, translate(regexp_extract(raw, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(raw, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM x"""


ORACLE_SQL = {"op8_warc": warc(), "op9_url_filters": url_filters()}
