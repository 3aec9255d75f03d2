"""Main text of web pages by consensus paths of their host.

Every page is read once into blocks of text and the elements that hold them.  Parts that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments, hidden
parts) are left out.  The page then votes, with its host, for the generalised path (tags and
classes, numbers removed) of the container that holds its text, and for every path of a block beside what
the page is about, with the block's text and its share of links.  Spark counts the votes; the winning path of a
host is used to read all its pages again.  Blocks at paths that say the same on most pages of the host
(numbers aside), or hold links there, are its boilerplate and are left out, unless such a path holds a
large part of the text.  A page without an element at the winning path, and a page whose url has no
host, is read from its own best container.

Of containers with equal votes the one with more text wins, then the one with the larger path digest.
Very long pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.operators.skew import skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

# A container may go on to a child that holds at least this share of its text, if what it leaves out is
# the same on most pages of the host, and on so many at least.
SHARE, LEAST_PAGES = 0.75, 3
# An article or main element is the container if it holds at least this share of the page's text.
ARTICLE_SHARE = 0.3

# Paths are boilerplate on more than half of the host's different pages, and LEAST_PAGES of them; a path
# with at least LARGE_SHARE of a page's text is not, one with LINK_SHARE of its text in links may be.
LARGE_SHARE, LINK_SHARE = 0.3, 0.8

# Elements of HTML by the part they play here.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span
strike strong sub sup time tt u var wbr img br
""".split())  # fmt: skip
LEFT_OUT = frozenset("""
head nav footer aside form button select option dialog template svg canvas audio video object menu map datalist
fieldset
""".split())  # fmt: skip
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Opening one of these ends an open paragraph; each ends open elements of its own row.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("ul ol dl table body html div section article main blockquote".split())
# Words in a class, id or role that mark a part as no article text.
NOT_TEXT = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices notification alert comment comments reply replies respond disqus sidebar side aside rail
menu menubar nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead share sharing social related
recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget pagination pager
skip hidden toc search complementary contentinfo dialog form
""".split())  # fmt: skip

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>",
    re.DOTALL,
)
_LOOSE = re.compile(r"</?[a-zA-Z][^>]*+(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_MARK_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "inside", "own", "total", "blocks", "kids")

    def __init__(self, tag: str, parent: _Element | None, path: int, out: bool, inside: bool):
        self.tag, self.parent, self.path, self.out, self.inside = tag, parent, path, out, inside
        self.own = self.total = 0
        self.blocks: list[int] = []


def _marks(attributes: str, inside: bool) -> tuple[str, bool]:
    """The generalised classes of an element, and whether they mark it as no article text.

    A header inside an article is the article's own.
    """
    names, hide = "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            names = ".".join(sorted({re.sub(r"[\d_-]+", "", w).lower() for w in value.split()} - {""}))
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _MARK_WORDS.findall(value)}
            hide |= not words.isdisjoint(NOT_TEXT) or not inside and "header" in words
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hide = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hide = True
    return names, hide


class Page:
    """Blocks of a page in order, and its elements."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.holder: list[_Element] = []
        self.links: list[int] = []
        self._linked = 0
        root = _Element("", None, 0, False, False)
        self.elements = [root]
        self._open = [root]
        self._count: dict[str, int] = {}
        self._held: list[str] = []
        self._read(html)
        self._flush()
        for e in reversed(self.elements):
            e.total += e.own
            if e.parent is not None:
                e.parent.total += e.total

    def _flush(self) -> None:
        """End the current block."""
        if self._held:
            text = " ".join("".join(self._held).split())
            self._held, linked, self._linked = [], self._linked, 0
            top = self._block_element()
            if text and not top.out:
                top.own += len(text)
                self.texts.append(text)
                self.holder.append(top)
                self.links.append(min(linked, len(text)))

    def _block_element(self) -> _Element:
        for e in reversed(self._open):
            if e.tag not in INLINE:
                return e
        return self._open[0]

    def _pop(self, to: int) -> None:
        for e in self._open[to:]:
            self._count[e.tag] -= 1
        del self._open[to:]

    def _end_implied(self, tag: str) -> None:
        ended = ENDED_BY.get(tag, ())
        if not self._count.get("p") and not any(self._count.get(t) for t in ended):
            return
        for k in range(len(self._open) - 1, 0, -1):
            have = self._open[k].tag
            if have == "p" or have in ended:
                self._pop(k)
                if have in ended and have in ("li", "dt", "dd", "tr", "option"):
                    return
            elif have in SCOPES and have not in ended:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
            self._end_implied(tag)
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            if tag in ("br", "hr", "wbr"):
                self._held.append(" " if tag == "br" else "")
            return
        parent = self._open[-1]
        names, hide = _marks(attributes, parent.inside) if attributes else ("", False)
        inside = parent.inside or tag in ARTICLE
        out = parent.out or tag in LEFT_OUT or tag == "header" and not parent.inside
        out |= hide and tag not in ("html", "body") and tag not in ARTICLE
        path = parent.path
        if tag not in INLINE:
            path = xxhash.xxh3_64_intdigest(f"{parent.path}/{tag}.{names}") >> 1
        if out and not parent.out:
            self._flush_inline(tag)
        e = _Element(tag, parent, path, out, inside)
        self.elements.append(e)
        self._open.append(e)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _flush_inline(self, tag: str) -> None:
        """Text before a left-out inline part stays with the block it began."""
        if tag in INLINE:
            self._held.append("")

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag == "br":
            self._held.append(" ")
        if not self._count.get(tag):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag == tag:
                self._pop(k)
                return

    def _text(self, raw: str) -> None:
        if raw and not self._open[-1].out:
            self._held.append(unescape(raw) if "&" in raw else raw)
            if self._count.get("a"):
                self._linked += len(raw)

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            found = html.find("<", at)
            if found < 0:
                self._text(html[at:])
                return
            self._text(html[at:found])
            token = _TOKEN.match(html, found) or _LOOSE.match(html, found)
            if token is None:
                self._text("<")
                at = found + 1
                continue
            at = token.end()
            if token.re is _LOOSE or token[2] is None:
                continue
            tag = token[2].lower()
            if token[1]:
                self._end(tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if tag == "plaintext":
                self._text(html[at:])
                return
            self._start(tag, token[3])

    def container(self, share: float = 1.0) -> _Element | None:
        """The article, or the lowest element reached by children that hold ``share`` of the text; None without text."""
        root = self.elements[0]
        if not root.total:
            return None
        articles = [e for e in self.elements if e.tag in ARTICLE and e.total >= ARTICLE_SHARE * root.total]
        if articles:
            return max(articles, key=lambda e: e.total)
        children: dict[int, list[_Element]] = {}
        for e in self.elements[1:]:
            if e.tag not in INLINE and e.total:
                parent = e.parent
                while parent.tag in INLINE and parent.parent is not None:
                    parent = parent.parent
                children.setdefault(id(parent), []).append(e)
        at = root
        while below := children.get(id(at)):
            best = max(below, key=lambda e: e.total)
            if best.total < share * at.total or best.tag == "p":
                break
            at = best
        return at

    def text_at(self, path: int | None, dropped: frozenset[int] = frozenset()) -> str:
        """Blocks below the elements at ``path``, or below the page's own container, without the boilerplate at
        the paths in ``dropped``."""
        tops = {id(e) for e in self.elements if path is not None and e.path == path and e.total}
        if not tops:
            own = self.container()
            tops = {id(own)} if own is not None else set()
        inside = self.blocks_below(tops)
        for p, blocks in (self.block_paths()[1] if dropped else {}).items():
            if p in dropped:
                inside.difference_update(blocks)
        return "\n\n".join(t for i, t in enumerate(self.texts) if i in inside)

    def block_paths(self) -> tuple[str, dict[int, list[int]]]:
        """What the page is about, and the numbers of the blocks at each path that may be boilerplate.

        A page is about its articles' text or the blocks of one path, whichever is longer.  Articles,
        headings, and all that stands in one element with those blocks are no boilerplate.
        """
        paths: dict[int, list[int]] = {}
        for i, e in enumerate(self.holder):
            paths.setdefault(0 if e.inside else e.path, []).append(i)
        if not paths:
            return "", {}
        main = max(paths.values(), key=lambda blocks: sum(len(self.texts[i]) for i in blocks))
        kept = set(main)
        around = self.holder[main[0]].parent
        while around is not None and around.tag in INLINE:
            around = around.parent
        if around is not None and around.tag not in ("", "html", "body"):
            kept |= self.blocks_below({id(around)})
        kept |= {i for i, e in enumerate(self.holder) if e.inside or e.tag in HEADINGS}
        rest = {p: [i for i in blocks if i not in kept] for p, blocks in paths.items()}
        return "\n\n".join(self.texts[i] for i in main), {p: blocks for p, blocks in rest.items() if blocks}

    def blocks_below(self, tops: set[int]) -> set[int]:
        """Numbers of the blocks below the elements with these ids."""
        below: dict[int, bool] = {}
        for e in self.elements:  # parents come before their children
            below[id(e)] = id(e) in tops or e.parent is not None and below[id(e.parent)]
        return {i for i, e in enumerate(self.holder) if below[id(e)]}


def host_of(url: Column) -> Column:
    """Lower-case host of a url, NULL without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


VOTES = (
    "host string, page long, chars long, whole long, whole_weight long, low long, low_weight long, rest long, "
    "path long, said long, size long, links long"
)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page one row with the container of all its text, a lower one and the digest of the text outside
    that, and one row for each path of blocks with the digest of what they say, numbers aside."""
    names = [part.split()[0] for part in VOTES.split(", ")]
    for batch in batches:
        made = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html or "")
            whole, low = page.container(), page.container(SHARE)
            if whole is None:
                continue
            inside = page.blocks_below({id(low)})
            rest = "\n\n".join(t for i, t in enumerate(page.texts) if i not in inside)
            about, paths = page.block_paths()
            same = host, _digest(about), sum(map(len, page.texts))
            made.append((*same, whole.path, whole.total, low.path, low.total, _digest(rest), None, None, None, None))
            for path, blocks in paths.items():
                said = _digest("\n\n".join(re.sub(r"\d+", "0", page.texts[i]) for i in blocks))
                size = sum(len(page.texts[i]) for i in blocks)
                made.append((*same, None, None, None, None, None, path, said, size, sum(page.links[i] for i in blocks)))
        columns = zip(*made, strict=True) if made else [()] * len(names)
        kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def page_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    asked = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).filter("host IS NOT NULL")
    return durable(asked.mapInArrow(_votes, VOTES), "page-votes")


def boilerplate_paths(votes: DataFrame) -> DataFrame:
    """Columns ``host`` and ``dropped``, the block paths that are boilerplate of the host.

    Pages about the same, whose largest part is equal, count once: copies of an article with other menus
    do not make it boilerplate.
    """
    blocks = votes.filter("path IS NOT NULL").groupBy("host", "page", "path", "said").agg(
        F.first("size").alias("size"), F.first("links").alias("links"), F.first("chars").alias("chars")
    )
    said = blocks.groupBy("host", "path", "said").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("size", "links", "chars"))
    )
    paths = said.groupBy("host", "path").agg(
        F.max("n").alias("same"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("size", "links", "chars"))
    )
    different = votes.filter("path IS NULL").groupBy("host", "page").agg(F.lit(1).alias("one"))
    totals = different.groupBy("host").agg(F.count("*").alias("all"))
    small = F.col("size") < LARGE_SHARE * F.col("chars")
    often = (F.col("n") >= LEAST_PAGES) & (2 * F.col("n") > F.col("all")) & small
    repeated = (F.col("same") >= LEAST_PAGES) & (2 * F.col("same") > F.col("all"))
    linked = F.col("links") >= LINK_SHARE * F.col("size")
    found = paths.join(totals, "host").filter(often & (repeated | linked))
    return found.groupBy("host").agg(F.collect_list("path").alias("dropped"))


def host_paths(votes: DataFrame) -> DataFrame:
    """Columns ``host`` and ``path``: per host the path most pages vote for (then most text).

    A page votes for its lower container only where the text outside it is boilerplate of the host.
    """
    kinds = votes.filter("path IS NULL").groupBy("host", "whole", "low", "rest").agg(
        F.count("*").alias("n"), F.sum("whole_weight").alias("whole_weight"), F.sum("low_weight").alias("low_weight")
    )
    kinds = durable(kinds, "votes")
    shared = kinds.groupBy("host", "rest").agg(F.sum("n").alias("same"))
    totals = kinds.groupBy("host").agg(F.sum("n").alias("all"))
    common = shared.join(totals, "host").filter((F.col("same") >= LEAST_PAGES) & (2 * F.col("same") > F.col("all")))
    marked = kinds.join(common.select("host", "rest", F.lit(True).alias("common")), ["host", "rest"], "left")
    chosen = marked.select(
        "host",
        F.when(F.col("common"), F.col("low")).otherwise(F.col("whole")).alias("path"),
        "n",
        F.when(F.col("common"), F.col("low_weight")).otherwise(F.col("whole_weight")).alias("weight"),
    )
    counted = chosen.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    best = F.max(F.struct("n", "weight", "path"))
    return counted.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``page_id``, ``url``, ``text``, ``n_chars`` of every row; other columns play no part.

    NULL and empty html, and pages that hold no article text, give an empty text.  Rows that repeat
    an id, and rows without an id or url, are read like all others.
    """
    votes = page_votes(pages, url, html)
    winners = durable(host_paths(votes).join(boilerplate_paths(votes), "host", "left"), "host-paths")
    asked = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    # Pages of a host with very many are read by many tasks.
    both = skew_join(asked, winners, "host", ["page_id", "url"], "left").select("page_id", "url", "html", "path", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(h or "").text_at(p, frozenset(d or ()))
                for h, p, d in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    id_type = pages.schema[page_id].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
