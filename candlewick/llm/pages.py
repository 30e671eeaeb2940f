"""Main text of web pages by paths on which the pages of a host agree.

Each page's containers are scored by the running text they hold.  The tag-class
path of the best one is the page's vote; votes are counted per host in Spark, and
every page is then read again along its host's winning paths.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import saved

# a quote opens a value only after "="
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)\Z""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINER = {"html", "body", "div", "article", "main", "section", "td", "table", "tbody", "tr", "center", "blockquote"}
_SKIP = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video", "head"}
_BLOCK = _CONTAINER | _SKIP | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "hr", "address", "details", "summary",
                               "fieldset", "figure", "figcaption", "th", "thead", "tfoot", "caption"}
# words of a class, id or role that name what is not the article
_ASIDE = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
             "masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted recommended related respond share sharing "
             "sidebar skip social sponsor sponsored subscribe toolbar widget banners complementary contentinfo search signup login".split())
_MAIN = set("article body content entry main post story text".split())
# of those, what readers wrote
_READERS = set("comment comments disqus respond".split())
# first and last words of names that tell a state or the lack of a thing, not the thing
_STATE_FIRST = set("has have no not with without is are hide show".split())
_STATE_LAST = set("open opened closed enabled disabled allowed".split())
_ASIDE_WEIGHT = 0.2
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Container:
    path: str
    parent: int
    weight: float
    good: float = 0.0   # characters of running text below it
    links: float = 0.0  # of those, in links
    own_aside: bool = False  # its classes name what is not the article
    aside: bool = False      # or those of a container around it


@dataclass
class Page:
    containers: list[Container] = field(default_factory=lambda: [Container("", -1, 0.8)])
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (container, text) in page order


def _general(tag: str, words: list[str]) -> str:
    """Tag and classes without digits, so that numbered boxes share a path."""
    return tag + "".join("." + w for w in sorted(set(words)))


def _named(tag: str, values: list[str]) -> tuple[bool, bool]:
    """Whether an element's class, id and role name an aside, and whether reader comments.

    Each name counts by itself: ``no-sidebar`` and ``comments-open`` tell states and
    count for nothing, a name that is one word of the article's (``post``) outweighs
    asides, but not comments.
    """
    asides = readers = False
    article = tag in ("article", "main", "html", "body")
    for name in " ".join(values).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if not words or len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
            continue
        article |= len(words) == 1 and words[0] in _MAIN
        asides |= not _ASIDE.isdisjoint(words)
        readers |= not _READERS.isdisjoint(words)
    readers &= tag not in ("html", "body", "main")
    return asides and not article, readers


def read(text: str) -> Page:
    """Containers and text blocks of a page.

    Elements that are menus, forms and the like by their tag are left out whole (an
    article's own header and footer are not), as are reader comments and small elements
    whose classes name an aside.  Containers so named stay, marked: their text is not part
    of what is around them.
    """
    page = Page()
    stack: list[tuple[str, int, bool]] = []  # (tag, container, skipped)
    here, skipped, links = 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            block = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if block:
                page.blocks.append((here, block))
                at, inside = here, min(linked, len(block))
                while at >= 0:
                    page.containers[at].good += len(block) - inside
                    page.containers[at].links += inside
                    at = -1 if page.containers[at].own_aside else page.containers[at].parent
        linked = 0

    def pop() -> str:
        nonlocal here, skipped, links
        tag, before, skip = stack.pop()
        here = before
        skipped -= skip
        links -= tag == "a"
        return tag

    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        run = text[at:m.start() if m else size]
        if run and not skipped:
            parts.append(run)
            linked += len(run) if links else 0
        if not m:
            break
        at = m.end()
        group = 2 if m[2] else 5 if m[5] else 8 if m[8] else 0
        if not group:
            continue
        tag, closing = m[group].lower(), m[group - 1]
        block = tag in _BLOCK
        if block:
            flush()
        elif tag == "br" and not skipped:
            parts.append(" ")
        if closing:
            if any(t == tag for t, _, _ in stack):
                while pop() != tag:
                    pass
            continue
        if tag in _RAW:
            end = re.compile("</" + tag + r"\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else size
            continue
        attributes = m[group + 1]
        if tag in _VOID or attributes.endswith("/"):
            continue
        gone = _CLOSES.get(tag)
        if gone:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in gone:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _CONTAINER or stack[i][0] in ("ul", "ol", "dl"):
                    break
        elif block and stack and stack[-1][0] == "p":
            pop()
        values = [a or b or c for _, a, b, c in _NAMES.findall(attributes)] if attributes else []
        words = [w for w in _SPLIT.split(" ".join(values).lower()) if w]
        aside, readers = _named(tag, values) if words else (False, False)
        own = tag in ("header", "footer") and any(t in ("article", "main") for t, _, _ in stack)
        skip = (tag in _SKIP and not own) or readers or (aside and not own and tag not in _CONTAINER)
        stack.append((tag, here, skip))
        skipped += skip
        links += tag == "a"
        if tag in _CONTAINER and not skipped:
            weight = {"article": 1.6, "main": 1.5, "html": 0.8, "body": 0.9}.get(tag, 1.3 if not _MAIN.isdisjoint(words) else 1.0)
            around = page.containers[here]
            within = aside or around.aside
            page.containers.append(Container(around.path + "/" + _general(tag, words), here, weight * (_ASIDE_WEIGHT if within else 1.0), own_aside=aside, aside=within))
            here = len(page.containers) - 1
    flush()
    return page


def best(page: Page, asides: bool = False) -> int | None:
    """The container with most running text, weighed by what its tag says; the inner of equals.
    Those in asides only if ``asides``."""
    top, score = None, 0.0
    for i, c in enumerate(page.containers):
        if c.aside and not asides:
            continue
        worth = c.weight * (c.good - c.links)
        if worth > 0 and worth >= score:
            top, score = i, worth
    return top


def text_below(page: Page, chosen: set[int]) -> str:
    inside = [False] * len(page.containers)
    for i, c in enumerate(page.containers):
        inside[i] = i in chosen or (c.parent >= 0 and not c.own_aside and inside[c.parent])
    return "\n".join(text for c, text in page.blocks if inside[c])


def extract(html: str, paths: list[str]) -> str:
    """The text below the containers on the first of ``paths`` that has any, else below the page's own best."""
    page = read(html)
    for path in paths:
        chosen = {i for i, c in enumerate(page.containers) if c.path == path and c.good + c.links > 0}
        if chosen:
            return text_below(page, chosen)
    top = best(page)
    return "" if top is None else text_below(page, {top})


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, asides = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = read(html.as_py() or "")
            top = best(page, True)
            if top is not None:
                hosts.append(host)
                paths.append(page.containers[top].path)
                asides.append(page.containers[top].aside)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(asides, pa.bool_())], names=["host", "path", "aside"])


def _read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(html.as_py() or "", paths or []) for html, paths in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, least_share: float = 0.1, broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    A host's winning paths are those with ``least_share`` of its votes or more, most
    votes first (ties: by name); at most ``1 / least_share`` per host.  A path in what
    classes name an aside needs three votes and over half of the host's.  A page with
    none of them is read below its own best container, one without text is empty.
    Needs ``page_id``, ``url`` and ``html``; a null html is empty, a null url is the
    host "", other columns are ignored, repeated rows vote and are returned as rows,
    an empty table gives an empty result.  Votes are combined before the shuffle,
    so a host with a third of all pages is a few rows per task.  Winning paths are
    written down and counted: below ``broadcast_bytes`` they are sent to the pages,
    which then stay where they are read; beyond, both sides are dealt by host and one of
    ``salts`` numbers, so that no task holds a whole host.
    """
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = (pages.select("host", "html").mapInArrow(_vote, "host string, path string, aside boolean")
             .groupBy("host", "path", "aside").agg(F.count("*").alias("votes")))
    all_votes = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    enough = F.when(F.col("aside"), (F.col("votes") >= 3) & (2 * F.col("votes") > F.col("total"))).otherwise(F.col("votes") >= F.col("total") * F.lit(least_share))
    winners = saved(votes.join(all_votes, "host").filter(enough)
                    .groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths")))
    size = winners.agg(F.sum(64 + F.length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + 32 + F.length(p)))).first()[0] or 0
    if size <= broadcast_bytes:
        met = pages.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return met.select("page_id", "url", "html", "paths").mapInArrow(_read_again, schema)
