"""URL filters: rules by host and path, carried over to the aliases of a page.

A page's own rule decides: the longest one that fits. Pages without a rule take the decision of
their aliases. Two addresses are aliases if one redirects to the other (a row of the redirect table
or `<meta http-equiv="refresh">`) or names it as its canonical form (`<link rel="canonical">`), and
so on along such links: classes are connected components. A class in which a rule blocks an address
is blocked, unless a rule allows one of its addresses; allow has precedence. Addresses that are no page of
the table take part too. What no rule reaches is allowed.

An address is host, path and query, without scheme, fragment and `utm_` parameters; an empty path is
`/`. Links in comments, scripts and styles do not count; `<base>` is not read.

All of it is DataFrame functions. Only addresses with a link travel: their edges are labelled round by round, where a
label passes to neighbours and then jumps along itself, so rounds grow with the logarithm of a class's width. Pages
meet blocked addresses by one join. The list of rules is a parameter and becomes part of the plan.

Defined results: a null url, or one without `://`, has empty host and path, no rule and no aliases, and is allowed; null
and empty html has no links; repeated rows each get the same verdict; links to other schemes are left out; rules of
equal length that both fit are taken allow first, then by name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.llm.common import fresh
from depscope.scratch import materialize

# The rules of the query, as (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns of both engines: what is no markup, tags that may link, and the target of a refresh.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
REFRESH = r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*)"
TRACKING = r"(^|&)utm_[^&]*"


def attribute_pattern(name: str) -> str:
    return rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of a url; both empty for null and where `://` is missing."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_address(df: DataFrame, url: str, host: str, path: str, address: str) -> DataFrame:
    """Add a url's host, path, and the address by which aliases are compared, null where there is none."""
    query = fresh(df, "_query")[0]
    of_url = host_and_path(F.col(url))
    found = df.select("*", of_url[0].alias(host), of_url[1].alias(path), F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "").alias(query))
    found = found.withColumn(query, F.regexp_replace(query, "^&+", ""))
    whole = F.concat(host, F.when(F.col(path) == "", "/").otherwise(F.col(path)), F.when(F.col(query) != "", F.concat(F.lit("?"), query)).otherwise(""))
    return found.select(*df.columns, host, path, F.when(F.col(host) != "", whole).alias(address))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]), reverse=True):
        cut = rule.index("/") if "/" in rule else len(rule)
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _plain_path(path: Column) -> Column:
    """A path without `.` and `..` segments."""
    parts = F.split(path, "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(ends, "/")).otherwise(path)


def resolved(links: DataFrame) -> DataFrame:
    """(a, url): the address of a page and the url its link means, from (base, link); null for other schemes and for links to the page itself."""
    plain = F.btrim(F.regexp_replace("link", "&(?:amp|#38|#x26);", "&"), F.lit(" \t\n\r\f"))
    cut = with_address(links.select("base", plain.alias("link")), "base", "host", "path", "a").select(
        "a", "host", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), "link",
        F.regexp_extract("link", r"^[^?#]*", 0).alias("before"), F.regexp_extract("link", r"^[^?#]*([^\x00]*)", 1).alias("after"))
    link, before, none = F.col("link"), F.col("before"), F.lit(None).cast("string")
    absolute, local = link.rlike("(?i)^https?://"), link.startswith("/") & ~link.startswith("//")
    told = host_and_path(link)
    cut = cut.select(
        "a", "after", F.when(absolute, told[0]).otherwise(F.col("host")).alias("site"),
        F.when(absolute, told[1])
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (link == "") | link.startswith("#") | (F.col("host") == ""), none)
        .when(local | link.startswith("//"), before).when(link.startswith("?"), F.col("path"))
        .otherwise(F.concat(F.regexp_extract("path", r"^[^\x00]*/", 0), before)).alias("to"))
    # Links that begin with // carry their host in the path.
    site = F.when(F.col("to").startswith("//"), F.lit("http:")).otherwise(F.concat(F.lit("http://"), "site"))
    return cut.select("a", F.concat(site, F.when(F.col("to").startswith("//"), F.col("to")).otherwise(_plain_path(F.col("to"))), "after").alias("url"))


def declared_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): addresses of pages and of what they redirect to or call their canonical form; one pass over the markup."""
    # Few pages have either word; only their markup is cut up.
    tags = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(
        F.col(url).alias("base"), F.explode(F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))).alias("tag"))
    attribute = lambda name: F.concat(*[F.regexp_extract("tag", attribute_pattern(name), i) for i in (1, 2, 3)])
    kind = F.lower(F.substring("tag", 2, 4))
    canonical = (kind == "link") & F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "canonical")
    refresh = (kind == "meta") & (F.lower(F.btrim(attribute("http-equiv"))) == "refresh")
    link = F.when(canonical, attribute("href")).when(refresh, F.regexp_extract(attribute("content"), REFRESH, 1))
    told = materialize(tags.select("base", link.alias("link")).where("link IS NOT NULL"), "declared-links")
    return with_address(resolved(told), "url", "host", "path", "b").select("a", "b")


def classes(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) and the least one it reaches either way."""
    both = edges.union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = materialize(both, "aliases")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "alias-labels")
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("told"))
        heard = labels.join(told, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "told").alias("component"))
        beyond = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = heard.join(beyond, "component").select("node", "was", F.least("component", "beyond").alias("component"))
        new = materialize(new, "alias-labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels


def blocked_aliases(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(node): addresses whose class is blocked by rules and not allowed by any."""
    labels = classes(edges)
    verdict = rule_of(*host_and_path(F.concat(F.lit("http://"), "node")), rules)["verdict"]
    found = labels.select("component", verdict.alias("verdict")).groupBy("component").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
    return labels.join(found.where("blocked AND NOT allowed"), "component", "left_semi").select("node")


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Add host, path, rule and verdict to pages, in place of columns of these names; `redirects` has more links, as urls (source, target)."""
    edges = declared_links(pages, url, html)
    if redirects is not None:
        both = with_address(redirects.select("source", "target"), "source", "_", "__", "a")
        edges = edges.union(with_address(both.select("a", "target"), "target", "_", "__", "b").select("a", "b"))
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in names]
    address, node_alias, own, host, path = fresh(pages, "_address", "_alias", "_own", "_host", "_path")
    judged = with_address(pages.select(*{*kept, url}), url, host, path, address)
    judged = judged.withColumn(own, rule_of(F.col(host), F.col(path), rules))
    # An address alone is a class of its own; its empty path counts as `/`.
    alone = rule_of(F.col(host), F.when(F.col(path) == "", "/").otherwise(F.col(path)), rules)["verdict"]
    aliases = blocked_aliases(edges, rules).withColumnRenamed("node", node_alias)
    joined = judged.join(aliases, F.col(address) == F.col(node_alias), "left")
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col(node_alias).isNotNull(), "block"), alone, F.lit("allow"))
    return joined.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col(own)["rule"].alias("rule"), verdict.alias("verdict"))


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rules: list[tuple[str, str]]) -> str:
    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    fits = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, '{v}' AS verdict, '{r[:r.index('/')]}' AS site, '{r[r.index('/'):]}' AS begins" for v, r in rules)
    attribute = lambda name: "concat(" + ", ".join(f"regexp_extract(tag, {quoted(attribute_pattern(name))}, {i})" for i in (1, 2, 3)) + ")"
    rest = lambda url: f"CASE WHEN instr(coalesce({url}, ''), '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    host = lambda url: f"translate(regexp_extract({rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    path = lambda url: f"regexp_extract({rest(url)}, '^[^/?#]*([^?#]*)', 1)"
    query = lambda url: f"regexp_replace(regexp_replace(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '{TRACKING}', '', 'g'), '^&+', '')"
    addr = lambda url: (
        f"CASE WHEN {host(url)} <> '' THEN concat({host(url)}, CASE WHEN {path(url)} = '' THEN '/' ELSE {path(url)} END, "
        f"CASE WHEN {query(url)} <> '' THEN concat('?', {query(url)}) ELSE '' END) END")
    plain = lambda p: (
        f"CASE WHEN NOT contains({p}, '/.') THEN {p} ELSE array_to_string(list_concat(list_reduce(list_prepend([]::VARCHAR[], "
        f"list_transform(string_split({p}, '/'), lambda s: [s])), lambda a, s: CASE WHEN s[1] = '.' THEN a "
        f"WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, s) END), "
        f"CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') END")
    cut = lambda c: f"regexp_extract({c}, '^[^?#]*')"
    tail = lambda c: f"regexp_extract({c}, '^[^?#]*([^\\x00]*)', 1)"
    return f"""
WITH rules AS ({fits}), tags AS (
  SELECT url AS base, unnest(regexp_extract_all(regexp_replace(html, {quoted(HIDDEN)}, ' ', 'g'), {quoted(TAG)})) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')
), links AS (
  SELECT base, trim(regexp_replace(CASE
    WHEN lower(tag[2:5]) = 'link' AND list_contains(regexp_split_to_array(lower({attribute('rel')}), '\\s+'), 'canonical') THEN {attribute('href')}
    WHEN lower(tag[2:5]) = 'meta' AND lower(trim({attribute('http-equiv')})) = 'refresh'
      THEN regexp_extract({attribute('content')}, {quoted(REFRESH)}, 1) END, '&(?:amp|#38|#x26);', '&', 'g'), concat(' ', chr(9), chr(10), chr(12), chr(13))) AS link
  FROM tags
), resolved AS (
  SELECT base, CASE
    WHEN regexp_matches(link, '(?i)^https?://') THEN concat('http://', {host('link')}, {plain(path('link'))}, {tail("regexp_extract(link, '://([^\\x00]*)', 1)")})
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR link = '' OR link[1] = '#' OR {host('base')} = '' THEN NULL
    WHEN link[1:2] = '//' THEN concat('http:', link)
    WHEN link[1] = '/' THEN concat('http://', {host('base')}, {plain(cut('link'))}, {tail('link')})
    WHEN link[1] = '?' THEN concat('http://', {host('base')}, {path('base')}, link)
    ELSE concat('http://', {host('base')}, {plain(f"concat(regexp_extract(CASE WHEN {path('base')} = '' THEN '/' ELSE {path('base')} END, '^[^\\x00]*/'), {cut('link')})")}, {tail('link')})
    END AS url FROM links
), edges AS (
  SELECT {addr('base')} AS a, {addr('url')} AS b FROM resolved
), both_ways AS (
  SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways e ON e.a = r.b) SELECT a, b FROM r
), judged AS (
  SELECT *, {host('url')} AS host, {path('url')} AS path, {addr('url')} AS node FROM pages
), nodes AS (
  SELECT node FROM judged WHERE node IS NOT NULL UNION SELECT a FROM both_ways
), node_rules AS (
  SELECT node, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT node, {host("concat('http://', node)")} AS host, {path("concat('http://', node)")} AS path FROM nodes) n
  JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, begins) GROUP BY node
), decided AS (
  SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
  FROM (SELECT a, b FROM reach UNION SELECT node, node FROM nodes) JOIN node_rules ON node = b GROUP BY a
), named AS (
  SELECT page_id, j.host, j.path, node, (SELECT arg_max(struct_pack(rule, verdict), length(rule)) FROM rules
    WHERE (j.host = site OR ends_with(j.host, '.' || site)) AND starts_with(j.path, begins)) AS own FROM judged j
)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, d.verdict, 'allow') AS verdict FROM named n LEFT JOIN decided d ON d.node = n.node
"""


ORACLE = _oracle(RULES)
