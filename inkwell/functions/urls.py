"""URL parts, resolution and crawl priorities."""

from __future__ import annotations

from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What holds no tags: comments, scripts and styles.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
#: A start tag's attributes; ``>`` may stand within quotes.
TAG = r"""(?is)<%s(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
#: The value of the first attribute ``href``, after any others.
HREF = r"""(?is)^(?:[\s/]*+(?!href[\s=/]|href$)[^\s=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)?+)?+)*+[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)"""
# The counts at which the priority rule changes.
LOW, MIDDLE = (2, 3), 9


def netloc(url: Column) -> Column:
    """Authority with user and port; ``''`` where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def extension(url: Column) -> Column:
    """From the last dot after the last slash of the whole URL, lower-cased; ``''`` where there is none."""
    return F.lower(F.regexp_extract(url, r"[^/](\.[^./]*)$", 1))


def without_fragment(url: Column) -> Column:
    """The URL before its ``#``; null if nothing is left."""
    return F.nullif(F.substring_index(url, "#", 1), F.lit(""))


def has_cgi(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("cgi"))


def resolve_all(base: Column, hrefs: Column) -> Column:
    """RFC 3986 resolution of an array of references. Where all are absolute or rooted paths it stays in the JVM; other arrays go through the standard library, a batch at a time."""

    @F.pandas_udf("array<string>")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else [safe_join(x, z) for z in y] for x, y in zip(b, h, strict=True)], dtype=object)

    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    simple = F.forall(hrefs, lambda h: h.rlike(r"^(?:https?://[^/?#]+)?/[^/?#;\s][^?#;\s]*$") & ~h.rlike(r"/\.{1,2}(?:/|$)|^/{2}"))
    return F.when(simple & (root != ""), F.transform(hrefs, lambda h: F.when(h.startswith("/"), F.concat(root, h)).otherwise(h))).otherwise(join(base, hrefs))


def resolve(base: Column, href: Column) -> Column:
    """Resolution of one reference."""
    return F.get(resolve_all(base, F.array(href)), F.lit(0))


def safe_join(base: str | None, href: str) -> str | None:
    """``urljoin``; None for what it refuses."""
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


def priority(count: Column, mode: str = "as_coded") -> Column:
    """Priority of a domain by how often it was met: as_coded gives 2 to a count of 1, documented gives 0 to counts up to 1."""
    if mode not in ("as_coded", "documented"):
        raise ValueError(mode)
    first = count.isNull() if mode == "as_coded" else count.isNull() | (count <= 1)
    return F.when(first, 0).when(count.between(*LOW), 1).when(count <= MIDDLE, 2).otherwise(3).cast("int")


def hrefs_of(html: Column, tag: str) -> Column:
    """The ``href`` values of all start tags ``tag``, in order; tags without one, or with an empty one, are left out.

    Comments, scripts and styles hold no tags. Values may be quoted either way or not at all, and are unescaped; where none has an ampersand
    that stays in the JVM.
    """

    @F.pandas_udf("array<string>")
    def unescaped(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [unescape(x) for x in v] for v in values], dtype=object)

    attributes = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(TAG % tag), F.lit(1))
    values = F.transform(attributes, lambda a: F.regexp_replace(F.regexp_extract(a, HREF, 1), r"""(?s)^(["'])(.*)\1$""", "$2"))
    values = F.array_remove(values, "")
    return F.when(F.exists(values, lambda v: F.contains(v, F.lit("&"))), unescaped(values)).otherwise(values)


def links_of(html: Column) -> Column:
    return hrefs_of(html, "a")


def parse_ctime(text: Column) -> Column:
    """Timestamp of ``Mon Jan  2 03:04:05 2006``."""
    return F.try_to_timestamp(F.regexp_replace(F.substr(text, F.lit(5)), " +", " "), F.lit("MMM d HH:mm:ss yyyy"))


def as_ctime(ts: Column) -> Column:
    """The day takes two places."""
    return F.concat(F.date_format(ts, "EEE MMM "), F.lpad(F.date_format(ts, "d"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy"))


def elapsed(seconds: Column) -> Column:
    """``HH:MM:SS``, modulo a day."""
    return F.format_string("%02d:%02d:%02d", F.expr("0") + F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, F.floor(seconds) % 60)
