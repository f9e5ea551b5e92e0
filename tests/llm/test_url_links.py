"""Every form of a link against the standard library's resolution."""

from urllib.parse import urljoin, urlsplit

from talkloom.llm import urls as U

PAGES = ["http://a.net", "http://a.net/", "http://a.net/d/e/p.html", "http://A.net/d/e/?q=/x/y", "http://a.net/d/e/./p"]
LINKS = [
    "page2.html", "./page2.html", "../x", "../../../x/", "?p=2", "#f", "x/../y", "x/./z?u=/a/../b", "/go?u=https://other.net/x", "go?u=https://other.net/x",
    "/a/../b", "/..", "..", ".", "//h.net/x", "https://other.net/y", "HTTPS://Other.net/y?z", "mailto:me@other.net", "javascript:go()", "a/b:c", "g;x=1/../y",
]


def plain(page, link):
    if urlsplit(link).scheme and "://" not in link:
        return None
    whole = urlsplit(urljoin(page, link))
    return (whole.netloc.lower() + whole.path).rstrip("/")


def test_links_of_every_form(spark):
    rows = [(page, f'<link rel="canonical" href="{link}">') for page in PAGES for link in LINKS]
    found = U.page_links(spark.createDataFrame(rows, "url string, html string")).collect()
    source = lambda page: (urlsplit(page).netloc.lower() + urlsplit(page).path).rstrip("/")
    wanted = {(source(p), plain(p, k)) for p in PAGES for k in LINKS}
    assert {(r.source, r.target) for r in found} == {(s, t) for s, t in wanted if t is not None and s != t}


def test_blocks_reach_aliases_by_relative_links(spark):
    pages = [(1, "http://a.com/de/1", ""), (2, "http://b.net/x/1", '<link rel=canonical href="2">'),
             (3, "http://b.net/x/2", '<meta property="og:url" content="//a.com/de/1">'),
             (4, "http://c.net/p", '<link rel=canonical href="/go?u=https://a.com/de/1">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = U.judge(df, [U.Rule("block", "com", "/de/")], U.page_links(df)).collect()
    assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "block", 3: "block", 4: "allow"}
