"""URL rules, with block decisions carried over redirects and canonical links.

Pages that redirect to each other or name the same canonical page are one page under
several addresses. Their addresses form a graph; its connected components are found
by joins and groupings, and a component with a blocked address blocks its members
unless an address in it is explicitly allowed. A page's own rule always comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits host and all its subdomains where the path starts with path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: Keys that pages without an address are dealt over.
SALTS = 1024
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\x22']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\x22']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\x22([^\x22]*)\x22|'([^']*)'|([^\s\x22'>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*[\x22']?\s*([^\x22'>\s]+)"


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z folded; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substr(url, F.length(rest) + 4)
    host = fold(F.regexp_extract(tail, "^[^/?#]*", 0))
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """Behind the host, up to ? or #."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substr(url, F.length(rest) + 4)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def node_of(url: Column) -> Column:
    """An address without scheme and fragment; null where there is no ://."""
    tail = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    behind = F.regexp_extract(tail, "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), behind))


def rule_index(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Place in longest_first(rules) of the first rule that fits, or null."""
    out = F
    for i, r in enumerate(longest_first(rules)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, i)
    return F.lit(None).cast("int") if out is F else out


def longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def rule_part(index: Column, rules: Sequence[Rule], part: str) -> Column:
    """text or action of the rule at index; null at null."""
    return F.get(F.array(*[F.lit(getattr(r, part)) for r in longest_first(rules)]).cast("array<string>"), index)


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are formed here, once: the explode keeps later expressions from copying them."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.withColumn("__x", F.explode_outer(one)).select(*rows.columns, "__x.*")


def with_target(links: DataFrame) -> DataFrame:
    """Adds target, href as an absolute address seen from url; null where it is none."""
    folder = F.regexp_replace(path_of(F.col("url")), "[^/]*$", "")
    parts = staged(
        links, scheme=F.substring_index("url", "://", 1), host=host_of(F.col("url")), folder=F.when(folder == "", "/").otherwise(folder)
    )
    href, root = F.col("href"), F.concat("scheme", F.lit("://"), "host")
    target = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href)
        .when(href.startswith("//"), F.concat("scheme", F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when((href != "") & ~href.startswith("#"), F.concat(root, "folder", href))
    )
    return staged(parts, target=target)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: page and canonical link, page and redirect target."""
    url = F.col("url")
    # Most pages have neither tag; they never reach the extraction.
    tags = F.filter(
        F.regexp_extract_all("html", F.lit(TAG), 0), lambda t: t.rlike(CANONICAL) | t.rlike(REFRESH)
    )
    some = F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH)
    tag = F.col("tag")
    href = F.when(
        tag.rlike(CANONICAL),
        F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)]),
    ).otherwise(F.regexp_extract(tag, REFRESH_URL, 1))
    found = pages.filter(url.isNotNull() & some).select("url", F.explode_outer(tags).alias("tag")).filter("tag is not null")
    links = with_target(staged(found, href=F.trim(href)))
    return staged(links, src=node_of(url), dst=node_of(F.col("target"))).select("src", "dst").filter(
        "src is not null and dst is not null and src <> dst"
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds host, path, rule, alias_action and verdict to pages(page_id, url, html, …).

    verdict: the action of the page's longest rule, else of its alias component
    (allow if any address in it is allowed by a rule, else block if any is blocked),
    else allow. A null url, or one without ://, has empty host and path, is no alias
    of anything and is allowed. Null html declares no alias. Repeated rows are judged
    alike. Rules are part of the plan; they are configuration, not data. Pages without an
    address are dealt over SALTS keys that no alias has; those of one address are split by
    the engine as any skewed key of a left join.
    """
    parts = connected_components(alias_edges(pages.select("url", "html")), "src", "dst")
    addressed = parts.withColumns(
        {"__h": F.regexp_extract("node", "^[^/?#]*", 0), "__p": F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1)}
    )
    by_component = (
        addressed.withColumn("__i", rule_index(F.col("__h"), F.col("__p"), rules))
        .filter("__i is not null")
        .groupBy("component")
        # allow comes before block
        .agg(F.min(rule_part(F.col("__i"), rules, "action")).alias("alias_action"))
    )
    aliases = parts.join(by_component, "component").select(F.col("node").alias("__node"), "alias_action")
    url = F.col("url")
    own = pages.drop("host", "path", "rule", "alias_action", "verdict").withColumns(
        {"host": host_of(url), "path": path_of(url), "__node": node_of(url)}
    )
    own = own.withColumn("__i", rule_index(F.col("host"), F.col("path"), rules))
    nowhere = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    own = own.withColumn("__salt", F.when(F.col("__node").isNull(), nowhere).otherwise(0))
    aliases = aliases.withColumn("__salt", F.lit(0).cast("long"))
    action = rule_part(F.col("__i"), rules, "action")
    return (
        own.join(aliases, ["__node", "__salt"], "left")
        .withColumn("rule", rule_part(F.col("__i"), rules, "text"))
        .withColumn("verdict", F.coalesce(action, "alias_action", F.lit("allow")))
        .drop("__node", "__salt", "__i")
    )


def contract_sql() -> str:
    """SQL of the query op5: same result, components by recursive reachability."""
    fold_sql = f"translate({{}}, '{UPPER}', '{LOWER}')"

    def sql_rule(host: str, path: str, what: str) -> str:
        cases = "".join(
            f" WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}')"
            f" THEN '{getattr(r, what)}'"
            for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
        )
        return f"CASE{cases} END"

    def tail(u: str) -> str:
        return f"substr({u}, strpos({u}, '://') + 3)"

    def node(u: str) -> str:
        host = fold_sql.format(f"regexp_extract({tail(u)}, '^[^/?#]*')")
        return f"CASE WHEN strpos({u}, '://') > 0 THEN {host} || regexp_extract({tail(u)}, '^[^/?#]*([^#]*)', 1) END"

    attr = "regexp_extract(tag, '(?is)\\bhref\\s*=\\s*(?:\\x22([^\\x22]*)\\x22|''([^'']*)''|([^\\s\\x22''>]+))', {})"
    href = " || ".join(attr.format(i) for i in (1, 2, 3))
    scheme = "split_part(url, '://', 1)"
    folder = "regexp_replace(path, '[^/]*$', '')"
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN {fold_sql.format(f"regexp_extract({tail('url')}, '^[^/?#]*')")} ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({tail('url')}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    {node('url')} AS node
  FROM pages),
tags AS (SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE url IS NOT NULL),
hrefs AS (
  SELECT url, host, path, node, trim(CASE WHEN regexp_matches(tag, '(?is)\\brel\\s*=\\s*[\\x22'']?\\s*canonical\\b') THEN {href}
    ELSE regexp_extract(tag, '(?is)\\burl\\s*=\\s*[\\x22'']?\\s*([^\\x22''>\\s]+)', 1) END) AS href
  FROM tags WHERE regexp_matches(tag, '(?is)\\brel\\s*=\\s*[\\x22'']?\\s*canonical\\b')
    OR regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*[\\x22'']?\\s*refresh\\b')),
targets AS (
  SELECT node AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN href
    WHEN starts_with(href, '//') THEN {scheme} || ':' || href
    WHEN starts_with(href, '/') THEN {scheme} || '://' || host || href
    WHEN href <> '' AND NOT starts_with(href, '#') THEN {scheme} || '://' || host || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || href END AS target
  FROM hrefs),
links AS (SELECT a, {node('target')} AS b FROM targets),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS n, a AS m FROM edges UNION SELECT r.n, e.b FROM reach r JOIN edges e ON r.m = e.a),
told AS (SELECT n, min({sql_rule("regexp_extract(m, '^[^/?#]*')", "regexp_extract(m, '^[^/?#]*([^?#]*)', 1)", "action")}) AS action FROM reach GROUP BY n)
SELECT page_id, host, path, {sql_rule('host', 'path', 'text')} AS rule,
  coalesce({sql_rule('host', 'path', 'action')}, told.action, 'allow') AS verdict
FROM p LEFT JOIN told ON p.node = told.n"""
