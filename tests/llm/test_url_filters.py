"""URL filters against the standard library's resolution, a plain union of sets, and SQL."""

import random
from urllib.parse import urljoin, urlsplit

import duckdb
import pytest

from depscope.llm import url_filters as U


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def _address(url):
    host, path = _host_path(url)
    query = "&".join(p for p in urlsplit(url or "").query.split("&") if p and not p.startswith("utm_"))
    return host + (path or "/") + ("?" + query if query else "") if host else None


def _rule(host, path):
    best = None
    for verdict, rule in U.RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def _brute(pages, links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for source, target in links:
        a, b = _address(source), _address(target)
        if a and b:
            parent[root(a)] = root(b)
    found = {}
    for node in {*parent, *(a for _, url in pages if (a := _address(url)))}:
        own = _rule(*_host_path("http://" + node))
        if own:
            found.setdefault(root(node), set()).add(own[1])
    out = []
    for page, url in pages:
        host, path = _host_path(url)
        own, node = _rule(host, path), _address(url)
        of_class = found.get(root(node), set()) if node else set()
        out.append((page, host, path, own[0] if own else None, own[1] if own else "block" if of_class == {"block"} else "allow"))
    return sorted(out, key=repr)


def _pages(seed, n=120):
    r = random.Random(seed)
    hosts = ["a.example.org", "example.org", "b.com", "WWW.b.com", "c.net", "m.c.net", "xorg", "d.example.net"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12", "/fr/2", "/de/3", "/de/../fr/4", "/x/y/z.html"]
    extras = ["", "", "#top", "?page=2&ref=x", "?utm_source=feed", "?utm_source=a&q=1"]
    urls = [f"{r.choice(('http', 'https'))}://{r.choice(hosts)}{r.choice(paths)}{r.choice(extras)}" for _ in range(n)]
    rows, links = [], []
    for page, url in enumerate(urls):
        target = r.choice([*r.sample(urls, 3), "/es/1", "../de/3", "y.html", "//b.com/de/9", "./q", "?k=1&amp;l=2"])
        kind = r.randrange(6)
        head = ""
        if kind == 0:
            head = f"<link href='{target}' rel=\"Canonical nofollow\">"
        elif kind == 1:
            head = f'<META http-equiv="Refresh" content="0; URL={target}">'
        elif kind == 2:
            head = f"<!-- <link rel=canonical href={target}> --><script>'<link rel=canonical href={target}>'</script><link rel=\"canonicals\" href=\"{target}\">"
        elif kind == 3:
            head = '<link rel="canonical" href="mailto:x@b.com"><link rel="canonical" href="#x"><link rel="canonical">'
        if kind < 2:
            links.append((url, urljoin(url, target.replace("&amp;", "&"))))
        rows.append((page, url, f"<html><head>{head}</head></html>"))
    return rows, links


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_and_sql(spark, seed):
    rows, links = _pages(seed)
    rows += [(1000, None, "<link rel=canonical href='http://b.com/de/'>"), (1001, "no address", None), (1002, "http://c.net/q", ""), (1002, "http://c.net/q", "")]
    expected = _brute([(p, u) for p, u, _ in rows], links)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in U.judge(frame, U.RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == expected
    assert {v for *_, v in got} == {"allow", "block"} and any(r is None and v == "block" for _, _, _, r, v in got)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        assert sorted(db.execute("SELECT page_id, host, path, rule, verdict FROM (" + U.ORACLE + ")").fetchall(), key=repr) == expected


def test_chain_of_redirects_and_precedence(spark):
    # A chain of many hops ends at a blocked page; another class has an allowed member too.
    chain = [(f"http://c{i}.net/", f"http://c{i + 1}.net/") for i in range(60)] + [("http://c60.net/", "http://x.com/de/")]
    both = [("http://n.net/1", "http://x.com/de/2"), ("http://n.net/1", "http://x.com/fr/2")]
    pages = [(i, f"https://c{i}.net/#f", "") for i in range(60)] + [(100, "http://n.net/1", ""), (101, "http://x.com/de/2", ""), (102, "http://alone.net/", "")]
    got = {r.page_id: r.verdict for r in U.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), U.RULES, spark.createDataFrame(chain + both, "source string, target string")).collect()}
    assert all(got[i] == "block" for i in range(60)) and (got[100], got[101], got[102]) == ("allow", "block", "allow")


def test_many_aliases_of_one_address(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://s', id, '.net/') AS url", "'<link rel=canonical href=\"http://hub.com/de/1\">' AS html")
    assert U.judge(pages, U.RULES).where("verdict = 'block'").count() == 3000


def test_empty_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, Host string, verdict int, _node int, _alias string"
    assert U.judge(spark.createDataFrame([], schema), U.RULES).count() == 0
    row = U.judge(spark.createDataFrame([(1, "http://X.com/de/", "x" * 1_000_000, "h", 3, 4, "k")], schema), U.RULES).collect()[0]
    assert (row.host, row.verdict, row._node, row._alias) == ("x.com", "block", 4, "k")
