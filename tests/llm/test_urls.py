"""Rules, and what redirects and canonical links make of them."""

import random

import pytest

from talkloom.llm import components as C, urls as U

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "com", "/de/"), U.Rule("allow", "good.com", "/de/ok")]


def judged(spark, pages, links=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    found = U.judge(df, RULES, U.page_links(df) if links is None else links)
    return {r.page_id: r for r in found.collect()}


def page(i, url, html=""):
    return (i, url, html, "clash")


def test_hosts_paths_and_longest_rule(spark):
    pages = [
        page(1, "HTTP://WWW.Example.ORG/es/x?q#f"), page(2, "http://example.org?x=/es/"), page(3, "http://notexample.org/es/"),
        page(4, "no scheme"), page(5, None), page(6, "http://a.com/de/1://x"), page(7, "http://ex.good.com/de/ok/1"), page(8, "x://y://z/de/"),
        page(9, "http://É.com/DE/"), page(10, ""),
    ]
    found = {i: (r.host, r.path, r.rule, r.verdict) for i, r in judged(spark, pages).items()}
    assert found == {
        1: ("www.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "", None, "allow"),
        3: ("notexample.org", "/es/", "org/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("a.com", "/de/1://x", "com/de/", "block"), 7: ("ex.good.com", "/de/ok/1", "good.com/de/ok", "allow"),
        8: ("y:", "//z/de/", None, "allow"), 9: ("É.com", "/DE/", None, "allow"), 10: ("", "", None, "allow"),
    }


def test_blocks_reach_aliases_and_allows_win(spark):
    pages = [
        page(1, "http://a.com/de/1"),
        page(2, "http://b.net/x", '<LINK href="http://a.com/de/1?u=1" REL=canonical>'),
        page(3, "http://c.net/y", '<meta http-equiv="refresh" content="0; url=http://b.net/x/">'),
        page(4, "http://d.net/z", "<meta property='og:url' content='//c.net/y'>"),
        page(5, "http://e.net/", '<link rel="canonical" href="http://a.com/de/2">'),
        page(6, "http://f.net/", '<link rel="canonical" href="http://a.com/de/2"><meta property="og:url" content="http://x.org/"/>'),
        page(7, "http://a.com/de/2"),
        page(8, "http://g.net/p", '<link rel="canonical" href="/q">'), page(9, "http://g.net/q"),
        page(10, "http://h.net/1", '<link rel="stylesheet" href="http://a.com/de/1">'),
        page(11, "http://i.net/1", '<link rel="canonical" href="http://a.com/de/unseen">'),
        page(12, "http://b.net/x#again"), page(12, "http://b.net/x#again"), page(13, "http://j.net", None),
    ]
    found = {i: r.verdict for i, r in judged(spark, pages).items()}
    # 5 and 6 share a target with a block and an allow; 7 has a block of its own.
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow",
                     10: "allow", 11: "block", 12: "block", 13: "allow"}


def test_empty_tables(spark):
    assert judged(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    edges += [(200, i) for i in range(201, 260)]
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            old = {group.get(a, a), group.get(b, b)}
            group.setdefault(a, a), group.setdefault(b, b)
            group = {n: min(old) if g in old else g for n, g in group.items()}
    found = C.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.component) for r in found) == sorted(group.items())
