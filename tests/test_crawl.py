"""Links, filters and the crawl against a sequential model."""

import heapq
import os.path
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from inkwell.functions import urls
from inkwell.operators import crawl
from inkwell.plans import catalogue

PAGES = [
    # page_id, url, final_url, status, content_type, html
    (1, "http://a.nz/", "http://a.nz/", 200, "text/html", '<a href="x.html">x</a> <A class=k HREF=\'/y\'>y</A> <a href="//b.nz/p">p</a> <a href="#top">t</a> <a href="mailto:m@a.nz">m</a> <a href="x.html#again">x</a>'),
    (2, "http://a.nz/x.html", "http://a.nz/x.html", 200, "text/html", '<base href="/deep/"><a href="z">z</a> <a href="../up">u</a> <a href="http://c.com/">c</a> <a href="/cgi-bin/q">g</a>'),
    (3, "http://a.nz/y", "http://b.nz/moved", 200, "text/html", '<a href="w?q=1">w</a> <a href="doc.pdf">d</a>'),
    (4, "http://b.nz/p", "http://b.nz/p", 404, "text/html", ""),
    (5, "http://a.nz/deep/z", "http://a.nz/deep/z", 200, "text/html", '<base><a href="f.pdf">f</a> <a href="http://foo.nzx.com/k">k</a> <a href="s.html">s</a>'),
    (6, "http://a.nz/up", "http://a.nz/up", 200, "application/pdf", ""),
    (7, "http://a.nz/doc.pdf", "http://a.nz/doc.pdf", 200, "application/pdf", ""),
    (8, "http://a.nz/deep/s.html", "http://a.nz/deep/s.html", 200, "text/html", None),
    (9, "http://foo.nzx.com/k", "http://foo.nzx.com/k", 200, "text/html", " ".join(f'<a href="http://m.nz/{k}">x</a>' for k in range(11))),
    (10, "http://a.nz/w?q=1", "http://a.nz/w?q=1", 200, "text/html", '<a href="/secret/s">s</a>'),
    (11, "http://a.nz/secret/s", "http://a.nz/secret/s", 200, "text/html", ""),
    (12, "http://m.nz/3", "http://m.nz/3", 200, "text/html", ""),
]
SCHEMA = "page_id long, url string, final_url string, status int, content_type string, html string"
ROBOTS = [("a.nz", "User-agent: *\nDisallow: /secret/\n"), ("m.nz", "not rules")]


def model(seeds, config, closed):
    """The same crawl, one URL at a time."""
    pages = {p[1]: p for p in PAGES}
    seen, counts, bad, queue, log = {*seeds}, {}, set(), [], []
    for s in seeds:
        counts[urlparse(s).netloc] = 1
        heapq.heappush(queue, (0, 0, s))
    while queue and len(log) < config.max_urls:
        _, depth, url = heapq.heappop(queue)
        if closed(url) or url not in pages:
            continue
        _, _, final, status, kind, html = pages[url]
        if not 200 <= status <= 299:
            log.append((len(log) + 1, depth, url, status, 0))
            continue
        if kind != "text/html":
            if ext := os.path.splitext(url)[1].lower():
                bad.add(ext)
            continue
        if final != url:
            seen.add(final)
            counts[urlparse(final).netloc] = counts.get(urlparse(final).netloc, 0) + 1
        log.append((len(log) + 1, depth, url, status, len((html or "").encode())))
        tag = re.search(r"(?is)<base\b[^>]*>", html or "")
        base = re.search(r"""href\s*=\s*["']?([^"'\s>]+)""", tag[0]) if tag else None
        base = urljoin(url, base[1]) if base else url
        for href in re.findall(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", html or ""):
            link = urldefrag(urljoin(base, href))[0]
            domain = urlparse(link).netloc
            if not link or os.path.splitext(link)[1].lower() in bad or "cgi" in link.lower() or config.tld not in domain or link in seen:
                continue
            seen.add(link)
            n = counts[domain] = counts.get(domain, 0) + 1
            heapq.heappush(queue, (1 if n in (2, 3) else 2 if n <= 9 else 3, depth + 1, link))
    return log


def test_links(spark):
    got = crawl.page_links(spark.createDataFrame(PAGES[:3], SCHEMA)).orderBy("page_id", "pos").collect()
    want = [["http://a.nz/x.html", "http://a.nz/y", "http://b.nz/p", "http://a.nz/", "mailto:m@a.nz", "http://a.nz/x.html"], ["http://a.nz/deep/z", "http://a.nz/up", "http://c.com/", "http://a.nz/cgi-bin/q"], ["http://a.nz/w?q=1", "http://a.nz/doc.pdf"]]
    assert [[r.href for r in got if r.page_id == k + 1] for k in range(3)] == want


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v][:1]


ODD_HTML = [
    '<a data-href="x" href="y">1</a>', '<a href="a b.html">2</a>', '<a href="?a=1&amp;b=2&copy=3">3</a>', '<!-- <a href="no">n</a> --><a href=yes>4</a>', '<a title="1>0" href="z">5</a>', "<A\nHREF = 'q\"q' >6</A>",
    "<abbr href=n>7</abbr><a>8</a><a href><a href=''>9</a>", "<script>var s = '<a href=\"no\">';</script><a x=1 href=s.html>10</a>", '<a title="href=no" href="r">11</a>', "<a/href=t>12</a>", "<a href=u href=v>13</a>", "<a hreflang=en href=w>14</a>", "<style>a{}</style>", "",
    '<a class="k" href="/p/&#39;&#x41;">15</a><a href="/q">16</a>',
]


def test_links_of_odd_pages(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(ODD_HTML)], "i int, h string").select("i", urls.links_of(F.col("h")).alias("x")).collect()
    for r in rows:
        parser = Anchors()
        parser.feed(ODD_HTML[r.i])
        assert r.x == parser.found, ODD_HTML[r.i]


def test_trailer(spark):
    stats = spark.createDataFrame([(3, 1333, 1, 3661)], "n_urls long, total_bytes long, n_errors long, seconds long")
    assert [r.value for r in crawl.trailer_lines(stats).collect()] == ["URLs: 3", "Bytes: 1333", "Errors: 1", "Time: 01:01:01"]


def test_queries_have_something_to_do(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    got = {n: catalogue.queries()[n](spark, sf).count() for n in ("robots_filter", "links_unseen", "link_first_seen", "crawl_simulation")}
    assert got["robots_filter"] < pages and got["links_unseen"] < got["link_first_seen"] and got["crawl_simulation"] > 20


def test_counts_of_a_domain_go_on_over_ranges_of_pages(spark):
    links = [(f"https://{h}.org/{s}-{p}", 1, s, p) for h in ("hot", "rare") for s in range(0, 5000, 700 if h == "hot" else 4000) for p in range(3)]
    prior = spark.createDataFrame([("hot.org", 4)], "domain string, cnt long")
    got = {r.url: (r.domain, r.cnt) for r in crawl.enqueue(spark.createDataFrame(links, "href string, depth int, seq long, pos long"), prior).collect()}
    want, count = {}, {"hot.org": 4, "rare.org": 0}
    for url, _, _, _ in sorted(links, key=lambda x: x[2:]):
        domain = url.split("/")[2]
        count[domain] += 1
        want[url] = (domain, count[domain])
    assert got == want


def test_whole_frontier(spark, sf):
    rows = catalogue.queries()["frontier_ranks"](spark, sf).collect()
    want = catalogue.frontier(spark, sf).collect()
    assert len(rows) == len(want) > 100
    order = sorted((r.priority, r.depth, r.url.encode(), r.domain, r.cnt) for r in want)
    assert [(r.priority, r.depth, r.url.encode(), r.domain, r.cnt) for r in sorted(rows, key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in rows) == [*range(1, len(rows) + 1)]


def test_crawl(spark):
    config = crawl.CrawlConfig(max_urls=30)
    rules = spark.createDataFrame(ROBOTS, "domain string, body string")
    got = crawl.simulate(spark.createDataFrame(PAGES, SCHEMA), ["http://a.nz/", " "], config, rules)
    want = model(["http://a.nz/"], config, lambda u: u.startswith("http://a.nz/secret/"))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 7


def test_limit_and_empty(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = crawl.simulate(pages, ["http://a.nz/"], crawl.CrawlConfig(max_urls=2))
    assert [r.url for r in got.orderBy("url_id").collect()] == [u for _, _, u, _, _ in model(["http://a.nz/"], crawl.CrawlConfig(max_urls=2), lambda u: False)]
    assert crawl.simulate(pages.limit(0), [], crawl.CrawlConfig()).count() == 0


def test_registered_crawl_has_no_cut(spark, monkeypatch):
    rows = [(k, f"http://a.nz/{k}.html", f'<a href="/{k + 1}.html">x</a>') for k in range(3)]
    budgets = []
    monkeypatch.setattr(catalogue, "pages", lambda s, d: s.createDataFrame(rows, "page_id long, url string, html string").union(s.range(10, 5_500).selectExpr("id", "concat('http://b.nz/', id, '.html')", "''")))
    monkeypatch.setattr(crawl, "simulate", lambda pages, seeds, config: budgets.append((config.max_urls, pages.count())))
    catalogue.crawl_simulation(spark, "")
    assert budgets == [(5_494, 5_494)]


def test_domain_rules(spark):
    rows = spark.createDataFrame([("http://foo.nzx.com/",), ("http://a.NZ/",), ("http://u@b.nz:80/",), ("x",)], "u string")
    got = rows.select(crawl.in_domain(F.col("u"), ".nz").alias("a"), crawl.in_domain(F.col("u"), ".nz", True).alias("s")).collect()
    assert [r.a for r in got] == [True, False, True, False] and [r.s for r in got] == [False, True, True, False]


def test_log(spark):
    log = spark.createDataFrame([(1, 0, "http://a/", 200, 5)], crawl.LOG)
    ts = F.lit("2026-01-05 03:04:05").cast("timestamp")
    line = crawl.log_lines(log, ts)
    assert line.first().value == "1 0 http://a/ Mon Jan  5 03:04:05 2026 200 5"
    back = crawl.parse_log(line.union(spark.createDataFrame([("Total: 1",)], "value string")))
    assert back.drop("ts").first() == log.first()
    assert tuple(crawl.log_stats(back).first()) == (1, 5, 0, 0)


def test_seeds():
    lines = [f"u{i}" for i in range(40)] + [""]
    assert crawl.sample_seeds(lines, 20) == crawl.sample_seeds(lines, 20) and len(crawl.sample_seeds(["a", "b"], 20)) == 2
