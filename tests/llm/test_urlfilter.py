"""URL verdicts against a plain loop: rules, spellings, links of pages, redirect chains, hubs, odd urls."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import urlfilter
from tidemark.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host int, path int, row int, node int, rule int, id int, action int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1) for r in rows], SCHEMA)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def rule_of(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a == "allow", h + p, a) for h, p, a in rules if url and "://" in url and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def node(url):
    if "://" not in (url or ""):
        return None
    host, path = parts(url)
    query = re.match(r"(?s).*?://[^#?]*(?:\?([^#]*))?", url)[1] or ""
    query = "&".join(x for x in query.split("&") if x and not x.startswith("utm_"))
    return re.sub(r"^www\.", "", host) + re.sub("/$", "", path) + ("?" + query if query else "")


def brute(rows, links, rules):
    near = defaultdict(set)
    for a, b in links:
        a, b = node(a), node(b)
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    root = {}
    for start in list(near):
        if start not in root:
            todo, root[start] = [start], start
            while todo:
                for x in near[todo.pop()]:
                    if x not in root:
                        root[x] = start
                        todo.append(x)
    told = defaultdict(set)
    for _, url, _ in rows:
        told[root.get(node(url), node(url))].add(rule_of(url, rules)[1])
    out = []
    for page, url, _ in rows:
        rule, action = rule_of(url, rules)
        mates = told[root.get(node(url), node(url))] if node(url) is not None else set()
        out.append((page, *parts(url), rule, action or ("allow" if "allow" in mates else "block" if "block" in mates else "allow")))
    return sorted(out, key=str)


def same(got, want):
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want


def test_links_of_pages_and_redirects(spark):
    rng = random.Random(3)
    hosts = ["a.example.org", "www.a.example.org", "b.example.com", "example.net", "WWW.Example.NET", "m.shop.net", "org", "xorg", "de.com"]
    paths = ["", "/", "/de/1", "/fr/x", "/en/1", "/en/12/", "/en/2", "/es/", "/es", "/p?x=1", "/p?utm_source=a&x=1#top", "/q?utm_a=1"]
    url = lambda: f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '', '#f', f'?n={rng.randrange(60)}'])}"
    rows, links = [], []
    for k in range(200):
        u, html = url(), rng.choice([None, "", "<p>no links</p>"])
        if rng.random() < 0.1:
            to = url()
            html = rng.choice([f'<head><link rel="canonical" href="{to}"></head>', f"<link href='{to}' rel=canonical />", f'<META http-equiv="refresh" content="0; url={to}">'])
            links.append((u, to))
        elif rng.random() < 0.1:
            html = f'<!-- <link rel="canonical" href="{url()}"> --><script>"<link rel=canonical href={url()}>"</script><link rel="alternate" href="{url()}">'
        rows.append((k, u, html))
    log = [(url(), url()) for _ in range(6)]
    chain = [f"http://hop{k}.net/" for k in range(12)]
    log += list(zip(chain, chain[1:], strict=False)) + [(chain[-1], "http://only.com/de/z")]
    rows += [(300 + k, c, None) for k, c in enumerate(chain)] + [(350, "http://www.only.com/de/z/", None)]
    rows += [(400, None, None), (401, "", "x"), (402, "no scheme", '<link rel=canonical href="/de/1">'), (403, "http://", None), (404, "://org/", ""), (5, rows[5][1], None), (5, rows[5][1], None), (None, rows[6][1], None)]
    redirects = spark.createDataFrame([*log, (None, "http://x.net/"), ("http://x.net/", None)], "from_url string, to_url string")
    got = urlfilter.url_verdicts(frame(spark, rows).repartition(4), urlfilter.rule_table(spark, URL_RULES), redirects)
    want = brute(rows, links + log, URL_RULES)
    same(got, want)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}                # the classes decide both ways
    assert [r.verdict for r in got.where("page_id >= 300 AND page_id < 312").collect()] == ["block"] * 12


def test_relative_links(spark):
    u = F.lit("https://A.net/x/y?z#w")
    cases = {"/k": "https://a.net/k", "//b.net/k": "https://b.net/k", "k?a=1&amp;b=2": "https://a.net/x/k?a=1&b=2", "http://c.net": "http://c.net", "": None, "#top": None, "mailto:me": None}
    got = spark.range(1).select(*[urlfilter.resolved(u, F.lit(k)) for k in cases]).first()
    assert list(got) == list(cases.values())


def test_allow_precedence_and_hub(spark):
    pages = [(k, f"http://s{k}.net/p", '<link rel="canonical" href="http://hub.net/">') for k in range(300)]
    rules = [("com", "/de/", "block"), ("org", "/", "allow")]
    block, allow = (900, "http://z.com/de/", '<link rel=canonical href="http://hub.net">'), (901, "http://z.org/", '<meta content="5;URL=http://www.hub.net/" http-equiv=refresh>')
    table = urlfilter.rule_table(spark, rules)
    got = urlfilter.url_verdicts(frame(spark, [*pages, block]), table).collect()
    assert {r.verdict for r in got} == {"block"} and len({r.url_class for r in got}) == 1
    got = {r.page_id: r.verdict for r in urlfilter.url_verdicts(frame(spark, [*pages, block, allow]), table).collect()}
    assert got.pop(900) == "block" and set(got.values()) == {"allow"}


def test_longest_rule_ties_and_many_rules(spark):
    rng = random.Random(8)
    rules = [(rng.choice(["com", "a.com", "b.a.com", "net"]), "/" + "".join(rng.choices("ab/", k=rng.randrange(0, 4))), rng.choice(["allow", "block"])) for _ in range(80)]
    rules += [("A.com", "/a", "block"), ("a.com", "/a", "allow")]
    rows = [(k, "http://" + rng.choice(["com", "a.com", "x.b.a.com", "aa.com", "net", "c.net"]) + "/" + "".join(rng.choices("ab/", k=rng.randrange(0, 6))), None) for k in range(300)]
    same(urlfilter.url_verdicts(frame(spark, rows), urlfilter.rule_table(spark, rules)), brute(rows, [], [(h.lower(), p, a) for h, p, a in rules]))
    few = frame(spark, rows).where("page_id < 20")
    none = urlfilter.url_verdicts(few, urlfilter.rule_table(spark, rules[:1]).limit(0)).collect()
    assert len(none) == 20 and all(r.rule is None and r.verdict == "allow" for r in none)


def test_empty_and_very_long(spark):
    table = urlfilter.rule_table(spark, URL_RULES)
    assert urlfilter.url_verdicts(frame(spark, []), table).collect() == []
    rows = [(1, "http://" + "a." * 20_000 + "org/" + "x" * 300_000, "<p>" * 200_000), (2, "http://x.net/" + "y" * 300_000, "<!--" + "canonical " * 50_000)]
    same(urlfilter.url_verdicts(frame(spark, rows), table), brute(rows, [], URL_RULES))


def test_plan_is_native(spark, capsys):
    urlfilter.url_verdicts(frame(spark, [(1, "http://a.org/", "x")]), urlfilter.rule_table(spark, URL_RULES)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
