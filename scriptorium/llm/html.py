"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: a node is a path of tags
with their classes and ids, and keeps in how many pages it occurs, with which
sequences of children (presentation) and which texts (content). A node's
presentation importance is the entropy of its child sequences over the pages,
its content importance one less the mean normalised entropy of its texts over
the pages: a text found on each page tells nothing, one found on one page tells
all. Outside ``article`` and ``main`` it is multiplied by the share of the node's
signs that stand in no link, so that a menu of ever new words tells nothing too.
A branch has the mean importance of the nodes in it, weighted by
``decay ** distance``. A branch is noise, and removed from every page of the
host, if its importance and that of each text in it are below ``least``; this
needs ``min_pages`` pages that have it.

Entropy alone takes adverts and notices whose words are drawn anew for each page
for content, and mirrored articles for boilerplate. Two priors of a node stand
against that. A node that HTML or its author names as no content (navigation,
header, footer, aside, form, and classes, ids or roles that name such parts) has
the prior ``NAMED``, by which the importance of its branch is multiplied, unless
the branch holds ``HOLDS`` of all text of the pages that have it: a wrapper of
whole pages is not what it is called. A named node of fewer pages has its prior
for importance, as nothing else is known of it. Inside ``article`` and ``main`` a
node's importance is ``PRIOR`` and the rest by entropy, so only what nearly every
page repeats is removed; on a page that has one, text outside is kept only where
the tree has found its branch to be content. A page of which nothing is left so
keeps its ``article``, but for named branches. Only what a browser does not show
(head, scripts, hidden elements, ...) stays out of the tree. Numbers in classes
and ids are taken as one, so that ``comment-12`` and ``comment-13`` are one node.

Nodes of the tree are counted by grouping, never gathered; what a page needs of
its host is the list of its removed branches (the uppermost only) and that of
content outside ``article``.

Cases: a null or empty page has the empty text; unclosed, misnested and cut
markup is read as far as it goes; a page whose url has no host, or a null one,
forms a site with others like it; repeated rows count as pages of their own;
very long pages are read whole; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Set

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSHOWN, MAIN, OTHER = 0, 1, 2
#: Importance that a node has by lying inside article or main.
PRIOR = 0.25
#: Importance of a branch named as no content, as a share of that by entropy.
NAMED = 0.25
#: Share of the text of its pages from which on the name of a branch says nothing.
HOLDS = 0.8
SALTS = 64
_UNSHOWN = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map select option textarea".split()
)
_ASIDE = frozenset("nav footer aside form button label fieldset dialog menu header".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments "
    "cookie cookies consent notice notices notification sidebar side menu menubar nav navbar navigation footer header "
    "masthead breadcrumb breadcrumbs share sharing social newsletter subscribe subscription related popup modal login "
    "signup search widget toolbar pagination disqus respond replies".split()
)
#: Of these, what an article or main element may be.
_CARDS = frozenset("comment comments ad ads related sponsored".split())
_TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_SCOPE = frozenset("ul ol dl table select body article main nav section div".split())
_RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
#: One attribute after another, each with its whole value.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_READ = frozenset("class id role hidden aria-hidden".split())
_DIGITS = re.compile(r"[0-9]+")
#: Elements beyond which an unclosed link is not followed.
_ENDS_LINK = frozenset("article main section nav aside footer ul ol table body".split())
_SPLIT = re.compile(r"[_\-:./]+")
#: Pieces of a name that say where or how a part stands, not what it is.
_PLAIN = frozenset("area bar block bottom box container content group inner left links list main outer panel right section top wrap wrapper".split())


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(rest):
        if (name := m[1].lower()) in _READ:
            out.setdefault(name, (m[2] or "").strip("\"'"))
    return out


def _tells(name: str, telling: frozenset[str]) -> bool:
    """Whether a class or id says so as a whole: ``cookie-notice`` and ``ad-box`` do, ``related-work`` and ``side-by-side`` do not."""
    pieces = set(_SPLIT.split(name)) - {""}
    return not pieces.isdisjoint(telling) and pieces <= telling | _PLAIN


def _zone(tag: str, attrs: dict[str, str], above: int) -> int:
    if above == UNSHOWN or tag in _UNSHOWN or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return UNSHOWN
    if tag in ("article", "main") or attrs.get("role") in ("main", "article"):
        return MAIN
    return above


def _named(tag: str, attrs: dict[str, str], above: int) -> bool:
    """Whether an element's tag, role, class or id names it as no content."""
    if tag in _ASIDE and not (tag == "header" and above == MAIN):
        return True
    if not attrs:
        return False
    if attrs.get("role", "") in _ROLES:
        return True
    names = attrs.get("class", "").lower().split()
    if not (above == MAIN and tag in _TITLED):  # their ids are slugs of what they say
        names += attrs.get("id", "").lower().split()
    telling = _CARDS if tag in ("article", "main") else _NAMES
    return tag not in ("html", "body") and any(_tells(n, telling) for n in names)


class Page:
    """blocks: (zone, text, path of the branch down to the block, signs in links), of what is shown; children: tags
    below each path; mains and named: the paths inside article or main, and those named as no content."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str, tuple[int, ...], int]] = []
        self.children: dict[tuple[int, ...], list[str]] = {}
        self.mains: set[int] = set()
        self.named: set[int] = set()
        self._text: list[str] = []
        self._linked = 0
        # Tag, zone, path, whether an inline element around it is named, which the next node takes over, and whether in a link.
        self._stack: list[tuple[str, int, tuple[int, ...], bool, bool]] = [("", OTHER, (), False, False)]
        self._read(source or "")
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text and self._stack[-1][1] != UNSHOWN:
                _, zone, path, *_ = self._stack[-1]
                self.blocks.append((zone, text, path, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _open(self, tag: str, rest: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        stack = self._stack
        if tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPE:
                    break
        elif tag in _BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
        attrs = {}
        if rest.strip("/ "):
            attrs = _attributes(rest)
        _, above, path, inherited, linked = stack[-1]
        zone = _zone(tag, attrs, above)
        named = inherited or (zone != UNSHOWN and _named(tag, attrs, above))
        if zone != UNSHOWN and tag in _BLOCK:
            self.children.setdefault(path, []).append(tag)
            names = _DIGITS.sub("0", f"{attrs.get('class', '')}#{attrs.get('id', '')}")
            name = f"{path[-1] if path else 0}>{tag}.{names}{'+' if zone == MAIN else ''}{'!' if named else ''}"
            path = (*path, zlib.crc32(name.encode("utf-8", "replace")))
            self.children.setdefault(path, [])
            if zone == MAIN:
                self.mains.add(path[-1])
            if named:
                self.named.add(path[-1])
            named = False
        stack.append((tag, zone, path, named, tag == "a" or (linked and tag not in _ENDS_LINK)))

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                if self._text and any(t in _BLOCK for t, *_ in self._stack[i:]):
                    self._flush()
                del self._stack[i:]
                return
            if self._stack[i][0] in ("article", "main", "body", "html", "td", "th") and tag not in ("body", "html", "article", "main"):
                return

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._stack[-1][4]:
            self._linked += len(" ".join(entities.unescape(text).split()))

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            m = _TOKEN.search(s, at)
            if m is None:
                self._add(s[at:])
                return
            if m.start() > at:
                self._add(s[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["close"] or m["close2"]:
                self._close(tag)
                continue
            self._open(tag, m["rest"] or m["rest2"] or "")
            if tag in _RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(s, at)
                if tag == "title" and self._stack[-1][1] != UNSHOWN:
                    self._text.append(s[at : end.start() if end else n])
                at = end.start() if end else n

    def main_text(self, removed: Set[int], content: Set[int] = frozenset()) -> str:
        gone = self.named & removed
        main = [b for b in self.blocks if b[0] == MAIN and gone.isdisjoint(b[2])]
        kept = [
            t
            for z, t, p, _ in self.blocks
            if removed.isdisjoint(p) and (z == MAIN or not main or (p and p[-1] in content))
        ]
        return " ".join(kept or [b[1] for b in main])


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, kind (p: child sequence, c: text), feature, k: pages that have it; and with child sequences only, main
    (inside article or main), named, above (paths up to the root), chars, links (of these in links), page (signs of the
    pages that have it)."""
    schema = (
        "host string, path long, kind string, feature long, main boolean, named boolean, above array<long>, k long, "
        "chars long, links long, page long"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for x in batches:
            for at in range(0, len(x), 500):
                texts: Counter = Counter()
                nodes: dict = {}
                some = x.iloc[at : at + 500]
                for host, source in zip(some["host"], some["html"]):
                    page = Page(source)
                    chars, links = Counter(), Counter()
                    mine = set()
                    for _, text, path, linked in page.blocks:
                        if path:
                            chars[path[-1]] += len(text)
                            links[path[-1]] += linked
                            mine.add((host, path[-1], zlib.crc32(text.encode("utf-8", "replace"))))
                    texts.update(mine)
                    total = sum(chars.values())
                    for path, tags in page.children.items():
                        if path:
                            p = path[-1]
                            key = (host, p, zlib.crc32(" ".join(tags).encode()))
                            row = nodes.setdefault(key, [p in page.mains, p in page.named, list(path), 0, 0, 0, 0])
                            row[3:] = (a + b for a, b in zip(row[3:], (1, chars[p], links[p], total)))
                rows = [(h, p, "p", f, *row) for (h, p, f), row in nodes.items()]
                rows += [(h, p, "c", f, None, None, None, n, None, None, None) for (h, p, f), n in texts.items()]
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("chars", "links", "page")})

    got = pages.select("host", "html").mapInPandas(run, schema)
    first = lambda *names: [F.first(c, ignorenulls=True).alias(c) for c in names]
    return got.groupBy("host", "path", "kind", "feature").agg(
        *first("main", "named", "above"), *(F.sum(c).alias(c) for c in ("k", "chars", "links", "page"))
    )


def judged_branches(tree: DataFrame, least: float, min_pages: int, decay: float) -> DataFrame:
    """host, path, above, low (noise), outside (has text, outside article and main) of each branch that is judged."""
    log = F.log(F.col("k").cast("double"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    # A page has one child sequence for a path, so the counts of these sum to its pages. All but the logarithm of that
    # sum is summed feature by feature.
    nodes = tree.groupBy("host", "path").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("above", "main", "named")),
        *(F.sum(c).alias(c) for c in ("chars", "links", "page")),
        of("p", F.col("k")).alias("m"),
        of("p", F.col("k") * log).alias("p_logs"),
        of("c", log).alias("c_logs"),
        of("c", F.lit(1)).alias("texts"),
    )
    seen = (F.col("m") >= min_pages) & (F.col("m") > 1)
    base = F.when(seen, F.log(F.col("m").cast("double")))
    # A node with text counts by its text, one without by its presentation; a named one of few pages by its name.
    entropy = F.coalesce(1 - F.col("c_logs") / F.col("texts") / base, 1 - F.col("p_logs") / F.col("m") / base, F.lit(1.0))
    plain = 1 - F.coalesce(F.try_divide("links", "chars"), F.lit(0.0))
    importance = F.when(F.col("main"), PRIOR + (1 - PRIOR) * entropy).otherwise(entropy * plain)
    nodes = nodes.where(seen | F.col("named")).withColumn("importance", importance).withColumn("text", F.col("texts").isNotNull())
    up = nodes.select("*", F.posexplode("above").alias("at", "branch"), F.size("above").alias("n"))
    weight = F.pow(F.lit(decay), F.col("n") - 1 - F.col("at")) * F.when(F.col("text"), 1.0).otherwise(0.1)
    own = lambda c: F.max(F.when(F.col("path") == F.col("branch"), c))
    branch = up.groupBy("host", "branch").agg(
        (F.sum(weight * F.col("importance")) / F.sum(weight)).alias("importance"),
        F.max(F.when(F.col("text"), F.col("importance"))).alias("most"),
        F.sum("chars").alias("chars"),
        own(F.col("page")).alias("page"),
        own(F.col("named") & ~seen).alias("alone"),
        own(F.col("named")).alias("named"),
        own(F.col("above")).alias("above"),
        own(F.col("text") & ~F.col("main")).alias("outside"),
    )
    holds = ~F.col("alone") & (F.col("chars") >= HOLDS * F.col("page"))
    prior = F.when(F.col("named") & ~holds, NAMED).otherwise(1.0)
    low = (prior * F.col("importance") < least) & (prior * F.coalesce("most", F.lit(0.0)) < least)
    # A branch that is itself on too few pages, with named nodes in it, is not judged.
    return branch.where(F.col("named").isNotNull()).select("host", F.col("branch").alias("path"), "above", low.alias("low"), "outside")


def branches(tree: DataFrame, least: float, min_pages: int, decay: float) -> DataFrame:
    """host, removed: its uppermost branches of low importance; content: its other branches with text outside article and main."""
    judged = judged_branches(tree, least, min_pages, decay).where("low OR outside")
    got = judged.groupBy("host").agg(
        F.collect_list(F.when(F.col("low"), F.struct("path", "above"))).alias("lows"),
        F.collect_list(F.when(~F.col("low"), F.col("path"))).alias("content"),
    )
    under = lambda b: F.arrays_overlap(F.slice(b.above, 1, F.size(b.above) - 1), "lows.path")
    top = F.transform(F.filter("lows", lambda b: ~under(b)), lambda b: b.path)
    return got.select("host", top.alias("removed"), "content")


def extract(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: float = 0.3,
    min_pages: int = 4,
    decay: float = 0.9,
) -> DataFrame:
    """page_id, url, text of every page."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    pages = pages.withColumn("host", _host())
    judged = branches(style_tree(pages), least, min_pages, decay)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            gone, kept = ([frozenset(() if r is None else r) for r in x[c]] for c in ("removed", "content"))
            texts = [Page(h).main_text(g, k) for h, g, k in zip(x["html"], gone, kept)]
            yield pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": texts})

    # A host may have a third of all pages, so its few branches are copied, and its pages dealt to as many places.
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = pages.join(judged, ["host", "salt"], "left").select("page_id", "url", "html", "removed", "content")
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string")
