"""Main text of web pages by consensus host paths.

A page is read once as a stream of tags and texts. Blocks of text fall to their containers; a container is known by its
generalised path (tags and first classes from the root down, numbers as #), kept as a hash of its parent's and its own
name. Boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are known by tag,
or by the words of class and id; words never decide over an element that holds the page's heading or article, or without
which no paragraph would be left (a wrapper of class ``has-sidebar``, a form around the page). Containers are scored by
the text of their own blocks outside links, and by their children's scores: all of them if nothing in the container is
boilerplate, else half.

Spark then adds up the scores by host and path. The best paths of each host (``PATHS`` at most, for hosts with several
templates) are joined back to its pages: a page's text is that of the path that holds most of it, if that is at least
``SHARE`` of the page's own best container; else it is that container's, else that of all blocks left.

Edge cases: null or empty html has no text; unclosed, misnested and cut-off markup is read as far as it goes; pages
without a host (null url) vote together; repeated rows vote and return each; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .url_templates import host_and_path

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|select|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CONTAINERS = frozenset("html body div section article main nav header footer aside form fieldset ul ol dl table tbody thead tfoot tr td th blockquote figure details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption legend option title head".split())
VOID = frozenset("hr br img input meta link source area base col embed track wbr".split())
#: Elements without main text, and the words of class, id or role that mark such elements.
BOILERPLATE_TAGS = frozenset("head title nav footer aside form fieldset button menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline captcha comment comments commentlist"
    " complementary consent contentinfo cookie cookies copyright dialog discussion disqus feedback foot footer gdpr header login masthead menu menubar"
    " modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted"
    " promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " tags taboola teaser toolbar topbar widget widgets".split()
)
#: First words of classes that tell a state (``has-sidebar``), last ones (``comments-closed``), and first ones of an
#: article's own header (``entry-header``).
STATES = frozenset("has no with without is js".split())
CONDITIONS = frozenset("closed open enabled disabled active on off visible hidden".split())
OWN_HEADER = frozenset("article content entry post section story text title".split())
#: Words that may stand beside a boilerplate word in the class of an inline element.
PLAIN_WORDS = frozenset("bar block box button buttons btn count icon icons item items label link links list me more on text this to us wrap wrapper".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a container gets of its children's scores, if some of it is boilerplate.
UP = 0.5
#: Characters of a paragraph that must be left outside an element for its class to make it boilerplate.
PARAGRAPH = 80
#: Most paths of a host, the least share of its votes for each, and the least share of a page's own best container.
PATHS, VOTES, SHARE = 3, 0.1, 0.6


class _Node:
    __slots__ = ("tag", "path", "depth", "words", "junk", "parent", "score", "other", "clean", "whole", "inside")

    def __init__(self, tag, name, words, junk, parent):
        self.tag, self.words, self.junk, self.parent = tag, words, junk, parent
        self.path = xxhash.xxh64_intdigest(name, parent.path) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.score = 0.0  # text of its own blocks outside links
        self.other = 0  # own blocks that are no headings
        self.clean = True  # no boilerplate in it
        self.whole = False  # holds the page's heading or article


def _marks(value: str, inline: bool) -> bool:
    """Whether a class, id or role has a token that marks boilerplate."""
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or (len(words) > 1 and (words[0] in STATES or words[-1] in CONDITIONS)):
            continue
        found = BOILERPLATE_WORDS.intersection(words)
        if found == {"header"} and words[0] in OWN_HEADER:
            continue
        if found and (not inline or found.union(PLAIN_WORDS).issuperset(words)):
            return True
    return False


def _describe(tag: str, attributes: str, inline: bool = False) -> tuple[str, bool]:
    """Name of an element in a path, and whether its words mark boilerplate."""
    if not attributes or "=" not in attributes:
        return tag, False
    name, junk = tag, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        junk |= _marks(value, inline)
        if key.lower() == "class" and value.split():
            name = tag + "." + re.sub(r"\d+", "#", value.split()[0].lower())
    return name, junk


def read(html: str | None):
    """(nodes, blocks) of a page: containers in order, and (node, text, outside links, heading) for each block that stays."""
    root = _Node("", "", False, False, None)
    nodes, blocks = [root], []
    node, text, links, heading = root, [], 0, False
    in_link = article = 0
    mute: list[str] = []  # open inline elements of a boilerplate class

    def flush():
        nonlocal text, links
        if text:
            t = " ".join(unescape("".join(text)).split())
            if t:
                blocks.append((node, t, max(0, len(t) - links), heading))
            text, links = [], 0

    for m in _TOKEN.finditer(html or ""):
        tag = m[3]
        if tag is None:
            s = m[0]
            if m[1] or (s[0] == "<" and len(s) > 1):
                if m[1]:
                    text.append(" ")
                continue
            if mute:
                continue
            text.append(s)
            if in_link:
                links += len(s)
            continue
        tag = tag.lower()
        close = m[2]
        if tag == "a":
            in_link = not close
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in BOILERPLATE_TAGS:
            if close and mute and mute[-1] == tag:
                mute.pop()
            elif not close and tag not in VOID and (mute or _describe(tag, m[4], True)[1]):
                mute.append(tag)
            continue
        mute.clear()
        flush()
        heading = tag in HEADINGS and not close
        if tag in VOID:
            continue
        if tag not in CONTAINERS and tag not in BOILERPLATE_TAGS:
            # paragraphs and the like close by themselves; one of a boilerplate class is a container of its own
            if not close:
                if node.tag in ("p", "li", *HEADINGS):
                    node = node.parent
                name, junk = _describe(tag, m[4])
                if tag == "h1":
                    node.whole = True
                if junk:
                    node = _Node(tag, name, True, False, node)
                    nodes.append(node)
            elif node.tag == tag:
                node = node.parent
            continue
        if close:
            at = node
            while at is not root and at.tag != tag:
                at = at.parent
            if at is not root:
                while node is not at:
                    article -= node.tag in ("article", "main")
                    node = node.parent
                article -= node.tag in ("article", "main")
                node = node.parent
            in_link = 0
        else:
            if node.tag in ("p", "li", *HEADINGS):
                node = node.parent
            if node.tag == "head" and tag != "title":
                node = node.parent
            name, words = _describe(tag, m[4])
            # the header of an article is its title, that of a page is not
            junk = tag in BOILERPLATE_TAGS - {"form", "fieldset"} or (tag == "header" and not article)
            words = (words or tag in ("form", "fieldset")) and tag not in ("html", "body", "main")
            node = _Node(tag, name, words, junk, node)
            node.whole = tag == "main" or (tag == "article" and not words)
            nodes.append(node)
            article += tag in ("article", "main")
    flush()
    return nodes, _without_boilerplate(nodes, blocks)


def _without_boilerplate(nodes, blocks):
    """Settles which nodes are boilerplate, and returns the blocks of the others."""
    for node in reversed(nodes[1:]):
        node.parent.whole |= node.whole and not node.junk
    by_tag = [node.junk for node in nodes]
    while True:
        for node, junk in zip(nodes[1:], by_tag[1:]):
            node.junk = junk or node.parent.junk or (node.words and not node.whole)
        left = [b for b in blocks if not b[0].junk]
        size = sum(len(t) for _, t, _, _ in left)
        wrapper = _wrapper(blocks, nodes, by_tag, size) if size < PARAGRAPH else None
        if wrapper is None:
            break
        wrapper.words = False
    for node in reversed(nodes[1:]):
        node.parent.clean &= node.clean and not node.junk
    return left


def _wrapper(blocks, nodes, by_tag, left: int):
    """The outermost element whose words take the page's longest paragraph, if it is one around the page; else None."""
    tagged = {id(n) for n, junk in zip(nodes, by_tag) if junk}
    longest, found = 0, None
    for node, t, _, _ in blocks:
        if len(t) <= longest or len(t) < min(PARAGRAPH, 1 if not left else PARAGRAPH):
            continue
        outer = None
        while node is not None and id(node) not in tagged:
            outer = node if node.words and not node.whole else outer
            node = node.parent
        if node is None and outer is not None and (not left or outer.parent.tag in ("", "html", "body")):
            longest, found = len(t), outer
    return found


def _scored(html: str | None):
    """(nodes, blocks, scores): and for each generalised path of a page, its score and depth."""
    nodes, blocks = read(html)
    for node, t, free, heading in blocks:
        node.score += free
        node.other += 0 if heading else len(t)
    out: dict[int, tuple[float, int]] = {}
    passed: dict[int, float] = {}
    for node in reversed(nodes):
        up = 1.0 if node.clean and node.tag not in ("", "html", "body") else UP
        total = node.score + up * passed.get(id(node), 0.0)
        if node.parent is not None:
            # a parent that adds no more than headings, and an article around its parts, is as good as they are
            parent = node.parent
            share = 1 / UP if not parent.clean and (parent.tag in ("article", "main") or (not parent.other and parent.score)) else 1.0
            passed[id(parent)] = passed.get(id(parent), 0.0) + share * total
        if total and not node.junk:
            weight = 1.25 if node.tag in ("article", "main") else 1.0
            out[node.path] = (out.get(node.path, (0.0, 0))[0] + weight * total, node.depth)
    return nodes, blocks, out


def extract(html: str | None, paths) -> str:
    """Text of the containers of the path that holds most of the page, if that is enough; else of its best container."""
    nodes, blocks, scores = _scored(html)
    if not blocks:
        return ""
    best = max(scores, key=lambda p: scores[p]) if scores else None
    known = [p & (1 << 64) - 1 for p in paths or ()]
    known = [p for p in known if p in scores and scores[p][0] >= SHARE * scores[best][0]]
    path = max(known, key=lambda p: scores[p]) if known else best
    for node in nodes:
        node.inside = path is None or node.path == path or (node.parent is not None and node.parent.inside)
    return " ".join(t for node, t, _, _ in blocks if node.inside)


def _with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_and_path(F.col(url_col))[0].alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with the greatest sums of scores among each host's pages; ``pages`` has host and html."""

    def batches(it):
        for b in it:
            host, path, depth, score = [], [], [], []
            for h, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                scores = _scored(html)[2]
                total = sum(s for s, _ in scores.values())
                for p, (s, d) in scores.items():
                    host.append(h)
                    path.append(p - (1 << 64) if p >> 63 else p)
                    depth.append(d)
                    score.append(s / total)  # each page has one vote, long or short
            cols = [pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(depth, pa.int32()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "path", "depth", "score"])

    votes = pages.select("host", "html").mapInArrow(batches, "host string, path long, depth int, score double")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"), F.max("depth").alias("depth"))
    # among like paths, as of containers in one another, the deepest; a host keeps a few rows whatever its pages
    best = Window.partitionBy("host").orderBy(F.desc("score"), F.desc("depth"), "path")
    first = sums.withColumn("n", F.row_number().over(best)).where(F.col("n") <= PATHS)
    most = first.groupBy("host").agg(F.max("score").alias("most"), F.collect_list(F.struct("path", "score")).alias("x"))
    return most.select("host", F.transform(F.filter("x", lambda x: x["score"] >= VOTES * F.col("most")), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page: page_id, url, text and n_chars."""
    base = _with_host(pages, id_col, url_col, html_col)
    # a table of one row a host: Spark knows its size, and broadcasts it only below its limit
    best = saved(host_paths(base))
    joined = base.join(best, "host", "left").select("page_id", "url", "html", "paths")

    def batches(it):
        for b in it:
            texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    of = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"page_id {of}, url string, text string, n_chars long")


def op3_main_text(spark, sf_dir):
    """Main text of every whole page."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_main_text": op3_main_text}
