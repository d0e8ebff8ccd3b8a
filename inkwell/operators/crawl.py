"""Link extraction, filters, frontier and a crawl over a static snapshot of pages."""

from __future__ import annotations

import random
from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls
from ..functions.places import placed
from ..sources.shared import staged


PAGES = 1024  #: pages of a range that a domain's links are numbered by


@dataclass(frozen=True)
class CrawlConfig:
    """Limits and rules of a crawl. ``batch`` URLs are taken at once; with 1 the order is that of a sequential crawl."""

    max_urls: int = 5000
    seed_size: int = 20
    random_seed: int = 22
    tld: str = ".nz"
    strict_tld: bool = False
    priority_mode: str = "as_coded"
    learn_empty_extension: bool = False
    timeout: float = 1.0
    user_agent: str = "*"
    batch: int = 1


def sample_seeds(lines: list[str], size: int, seed: int = 22) -> list[str]:
    """``size`` distinct lines drawn with replacement until there are enough, by a generator of its own; blank ones are drawn but not kept. Sorted.

    Fewer distinct lines than ``size`` are all taken.
    """
    drawn, rng, most = set(), random.Random(seed), min(size, len({*lines}))
    while len(drawn) < most:
        drawn.add(rng.choice(lines))
    return sorted(x for x in drawn if x.strip())


def page_links(pages: DataFrame, *, resolved: bool = True) -> DataFrame:
    """``page_id``, ``pos`` (from 0) and ``href`` of every ``<a href>`` in document order, without fragments; empty ones are left out.

    With ``resolved`` references are resolved against the page's first ``<base href>``, itself resolved against the page's URL.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", urls.links_of(html).alias("hrefs"), F.get(urls.hrefs_of(html, "base"), F.lit(0)).alias("base"))
    if resolved:
        rows = rows.withColumn("base", F.when(F.col("base").isNull(), F.col("url")).otherwise(urls.resolve(F.col("url"), F.col("base"))))
        rows = rows.withColumn("hrefs", urls.resolve_all(F.col("base"), F.col("hrefs")))
    rows = rows.select("page_id", F.posexplode(F.transform("hrefs", urls.without_fragment)).alias("pos", "href"))
    return rows.filter("href is not null").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def in_domain(url, tld: str, strict: bool = False):
    """Whether the authority holds ``tld`` anywhere; with ``strict`` its host must end with it."""
    where = urls.netloc(url)
    return F.regexp_replace(F.lower(where), r"^.*@|:[0-9]*$", "").endswith(tld.lower()) if strict else F.contains(where, F.lit(tld))


def filtered_links(links: DataFrame, bad_extensions: DataFrame, *, tld: str, strict: bool = False) -> DataFrame:
    """Links without a bad extension and without ``cgi`` in any case, within the domain."""
    rows = links.withColumn("ext", urls.extension(F.col("href"))).filter(~urls.has_cgi(F.col("href")) & in_domain(F.col("href"), tld, strict))
    return rows.join(bad_extensions.select("ext").distinct(), "ext", "left_anti").drop("ext")


def first_seen(links: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each ``href``: an aggregate, so a much-linked page is not sorted in one task."""
    others = [c for c in links.columns if c != "href"]
    return links.groupBy("href").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("x")).select("href", *(F.col(f"x.{c}").alias(c) for c in others))


def robots_allowed(candidates: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``candidates`` whose ``url`` the rules of its domain (``robots(domain, body)``) allow; no rules, or broken ones, allow."""

    @F.pandas_udf("boolean")
    def allowed(page: pd.Series, body: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(u: str | None, b: str | None) -> bool:
            if b is None or u is None:
                return True
            if b not in known:
                known[b] = RobotFileParser()
                known[b].parse(b.splitlines())
            try:
                return known[b].can_fetch(agent, u)
            except ValueError:
                return True

        return pd.Series([one(u, b) for u, b in zip(page, body, strict=True)])

    rules = robots.groupBy("domain").agg(F.max("body").alias("__body"))
    joined = candidates.withColumn("domain", urls.netloc(F.col("url"))).join(rules, "domain", "left")
    return joined.filter(allowed(F.col("url"), F.col("__body"))).drop("domain", "__body")


def domain_counts(links: DataFrame) -> DataFrame:
    return links.withColumn("domain", urls.netloc(F.col("href"))).groupBy("domain").agg(F.count("*").alias("cnt"))


def enqueue(found: DataFrame, counts: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Frontier rows (``priority``, ``depth``, ``url``, ``domain``, ``cnt``) of new links ``found(href, depth, seq, pos)``, the count of a domain growing link by link.

    A domain's links are numbered by range of pages first, so a domain of many links is not sorted in one task.
    """
    rows = placed(found.withColumn("domain", urls.netloc(F.col("href"))), ["domain"], F.floor(F.col("seq") / PAGES), "seq", "pos")
    rows = rows.join(counts.withColumnRenamed("cnt", "prior"), "domain", "left")
    rows = rows.withColumn("cnt", F.coalesce("prior", F.lit(0)) + F.col("place") + 1)
    return rows.select(urls.priority(F.col("cnt"), mode).alias("priority"), "depth", F.col("href").alias("url"), "domain", F.col("cnt").cast("long").alias("cnt"))


def frontier_order(frontier: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = frontier.orderBy("priority", "depth", "url")
    return ordered if limit is None else ordered.limit(limit)


def frontier_ranks(frontier: DataFrame) -> DataFrame:
    """The whole frontier with ``rank`` from 1: ranges of the order are sorted and written, and places within a range are shifted by a count for each."""
    frontier = staged(frontier, "frontier")  # a sort by ranges reads its input twice
    rows = staged(frontier_order(frontier).withColumn("__m", F.monotonically_increasing_id()), "frontier-order")
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return rows.join(offsets, "__p").withColumn("rank", (F.col("__o") + F.col("__i") + 1).cast("long")).drop("__m", "__p", "__i", "__o")


LOG = "url_id long, depth int, url string, status int, bytes long"


def simulate(pages: DataFrame, seeds: list[str], config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None) -> DataFrame:
    """Crawl the snapshot ``pages(page_id, url, html[, final_url, status, content_type])`` from ``seeds``; the log (``LOG``).

    In turn the first URLs by priority, depth and text are taken. URLs that robots deny or that the snapshot lacks leave no trace; pages
    that aren't HTML teach their extension; a status outside 200 to 299 is logged with 0 bytes; other pages are logged, and their links
    enqueued. Every round's state is written to the shared folder; the driver holds one batch of URLs.
    """
    spark: SparkSession = pages.sparkSession
    for name, default in (("final_url", F.col("url")), ("status", F.lit(200)), ("content_type", F.lit("text/html"))):
        if name not in pages.columns:
            pages = pages.withColumn(name, default)
    pages = staged(pages.select("page_id", "url", "html", "final_url", "status", "content_type").dropDuplicates(["url"]), "crawl-pages")
    links = staged(page_links(pages), "crawl-links")
    start = sorted({s for s in (x.strip() for x in seeds) if s})
    frontier = spark.createDataFrame([(0, 0, s) for s in start], "priority int, depth int, url string")
    seen = frontier.select("url")
    counts = frontier.select(urls.netloc(F.col("url")).alias("domain"), F.lit(1).cast("long").alias("cnt")).distinct()
    bad, log, logged = spark.createDataFrame([], "ext string"), [], 0
    while logged < config.max_urls:
        batch = frontier_order(frontier, min(config.batch, config.max_urls - logged)).collect()  # ``batch`` rows
        if not batch:
            break
        taken = spark.createDataFrame([(i, r.depth, r.url) for i, r in enumerate(batch)], "seq int, depth int, url string")
        frontier = frontier.join(taken, "url", "left_anti")
        asked = robots_allowed(taken, robots, config.user_agent) if robots is not None else taken
        got = asked.join(pages, "url").cache()
        fetched = got.select("seq", "depth", "url", "status", "content_type", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"), "final_url").orderBy("seq").collect()
        ok = F.col("status").between(200, 299)
        html = ok & (F.col("content_type") == "text/html")
        for r in fetched:
            if not 200 <= r.status <= 299 or r.content_type == "text/html":
                logged += 1
                log.append((logged, r.depth, r.url, r.status, r.bytes if 200 <= r.status <= 299 else 0))
        taught = got.filter(ok & (F.col("content_type") != "text/html")).select(urls.extension(F.col("url")).alias("ext"))
        if not config.learn_empty_extension:
            taught = taught.filter("ext <> ''")
        moved = got.filter(html & (F.col("final_url") != F.col("url"))).select(F.col("final_url").alias("url"))
        bad, seen = bad.union(taught).distinct(), seen.union(moved).distinct()
        counts = counts.union(moved.select(urls.netloc(F.col("url")).alias("domain"), F.lit(1).cast("long"))).groupBy("domain").agg(F.sum("cnt").cast("long").alias("cnt"))
        new = got.filter(html).select("page_id", "seq", (F.col("depth") + 1).alias("depth")).join(links, "page_id").drop("page_id")
        new = filtered_links(new, bad, tld=config.tld, strict=config.strict_tld)
        new = first_seen(new.join(seen.withColumnRenamed("url", "href"), "href", "left_anti"), ["seq", "pos"])
        new = staged(enqueue(new, counts, config.priority_mode), "crawl-new")
        frontier = staged(frontier.select("priority", "depth", "url").union(new.select("priority", "depth", "url")), "crawl-frontier")
        seen, bad = staged(seen.union(new.select("url")), "crawl-seen"), staged(bad, "crawl-bad")
        grown = new.groupBy("domain").agg(F.max("cnt").alias("cnt"))
        counts = staged(counts.union(grown).groupBy("domain").agg(F.max("cnt").alias("cnt")), "crawl-counts")
        got.unpersist()
    return spark.createDataFrame(log, LOG)


LOG_LINE = r"^(\d+) (\d+) (\S+) (\w{3} \w{3} +\d+ \d\d:\d\d:\d\d \d{4}) (\d+) (\d+)$"


def parse_log(lines: DataFrame) -> DataFrame:
    """``url_id``, ``depth``, ``url``, ``ts``, ``status``, ``bytes`` of the log lines in ``value``; the trailer and other lines are left out."""
    part = lambda k: F.regexp_extract("value", LOG_LINE, k)
    rows = lines.filter(F.col("value").rlike(LOG_LINE))
    return rows.select(part(1).cast("long").alias("url_id"), part(2).cast("int").alias("depth"), part(3).alias("url"), urls.parse_ctime(part(4)).alias("ts"), part(5).cast("int").alias("status"), part(6).cast("long").alias("bytes"))


def log_stats(log: DataFrame) -> DataFrame:
    """One row: URLs, bytes, errors and seconds between the first line and the last."""
    return log.agg(
        F.count("*").alias("n_urls"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(~F.col("status").between(200, 299)).alias("n_errors"),
        F.coalesce(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.lit(0)).cast("long").alias("seconds"),
    )


def trailer_lines(stats: DataFrame) -> DataFrame:
    """``value``: the closing lines of a log, of the one row of ``log_stats``."""
    lines = [F.concat(F.lit(name), F.col(c).cast("string")) for name, c in (("URLs: ", "n_urls"), ("Bytes: ", "total_bytes"), ("Errors: ", "n_errors"))]
    return stats.select(F.explode(F.array(*lines, F.concat(F.lit("Time: "), urls.elapsed(F.col("seconds"))))).alias("value"))


def log_lines(log: DataFrame, ts) -> DataFrame:
    """``value``: the text of log rows, at time ``ts``."""
    cells = [F.col(c).cast("string") for c in ("url_id", "depth", "url")] + [urls.as_ctime(ts)] + [F.col(c).cast("string") for c in ("status", "bytes")]
    return log.select(F.concat_ws(" ", *cells).alias("value"))
