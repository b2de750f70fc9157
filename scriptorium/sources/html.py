"""Fields of proceedings pages, as Column expressions over their HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import flip_author

_NO_P = r"(?:[^<]|<(?!/?p\b))*+"


def _hash(href: Column) -> Column:
    return F.substring_index(F.substring_index(href, "/", -1), "-", 1)


def _hashes(hrefs: Column) -> Column:
    return F.filter(F.transform(hrefs, _hash), lambda h: h != "")


def index_hashes_old(html: Column) -> Column:
    """Paper hashes of an index before 2020: links to papers in list items after the second fluid container."""
    part = F.regexp_extract(html, r"(?s)<div[^>]*container-fluid.*?<div[^>]*container-fluid[^>]*>(.*)", 1)
    items = F.regexp_extract_all(part, F.lit(r"(?s)<li\b.*?(?:</li>|$)"), F.lit(0))
    links = F.regexp_extract_all(F.array_join(items, " "), F.lit(r'<a\b[^>]*href="([^"]*/paper/[^"]*)"'), F.lit(1))
    return _hashes(links)


def index_hashes_new(html: Column) -> Column:
    """Paper hashes of an index from 2020 on: titled links in paper lists."""
    lists = F.regexp_extract_all(html, F.lit(r'(?s)<ul[^>]*paper-list.*?(?:</ul>|$)'), F.lit(0))
    anchors = F.regexp_extract_all(F.array_join(lists, " "), F.lit(r'<a\b[^>]*title="paper title"[^>]*>'), F.lit(0))
    return _hashes(F.transform(anchors, lambda a: F.regexp_extract(a, r'href="([^"]*)"', 1)))


def index_hashes(html: Column, other: Column, year: Column) -> Column:
    """Hashes of the first of two pages that has any, by the form of the year."""
    one = lambda c: F.when(year >= 2020, index_hashes_new(c)).otherwise(index_hashes_old(c))
    return F.when(F.size(F.coalesce(one(html), F.array().cast("array<string>"))) > 0, one(html)).otherwise(one(other))


def _meta(html: Column, name: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(rf'<meta\b[^>]*name="{name}"[^>]*>'), F.lit(0))
    return F.transform(tags, lambda t: F.trim(F.regexp_extract(t, 'content="([^"]*)"', 1)))


def citation_authors(html: Column) -> Column:
    return F.filter(F.transform(_meta(html, "citation_author"), flip_author), lambda x: x != "")


def citation_title(html: Column) -> Column:
    return F.coalesce(F.try_element_at(_meta(html, "citation_title"), F.lit(-1)), F.lit(""))


def paper_abstract(html: Column) -> Column:
    """Text of the abstract paragraph, with a paragraph inside it."""
    inner = rf"(?s)<p\b[^>]*paper-abstract[^>]*>((?:[^<]|<(?!/?p\b)|<p\b[^>]*>{_NO_P}</p>)*+)</p>"
    text = F.regexp_replace(F.regexp_extract(html, inner, 1), r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\(cid:\d+\)", ""))


def summary(xml: Column) -> Column:
    """The summary of a feed entry."""
    return F.nullif(F.trim(F.regexp_extract(xml, r"(?s)<summary>(.*?)</summary>", 1)), F.lit(""))


def abstract_links(html: Column, year: Column, mark: str = "Abstract") -> Column:
    """Targets of a page's links, in order, that hold the mark and the year; none of a null page."""
    link = r"""(?is)<a\b(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*["']([^"'>]*)["']"""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(link), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return F.filter(found, lambda x: x.contains(mark) & x.contains(year.cast("string")))


def link_key(link: Column, mark: str = "Abstract") -> Column:
    """The hexadecimal key of a link to an abstract; null if it has none."""
    return F.nullif(F.regexp_extract(link, rf"/hash/([a-f0-9]+)-{mark}", 1), F.lit(""))
