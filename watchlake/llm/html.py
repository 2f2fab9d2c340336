"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are never part of an article (menus, forms, scripts, adverts,
reader comments and so on, told by tag, role, class or id) are cut first. Each other node gets its composite text
density, characters per tag adjusted for link text. A block's density sum adds up the densities of the blocks right
below it, whatever inline elements lie between; the block of largest sum is the heart of the content. From there the
path to the body is climbed: the content is the highest node whose density is still half of the heart's, without blocks
beside the path that are mostly links. Beside the rest of the path, headings and blocks count that reach the least
density on the path. Tags such as article have no say.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, table

# Names of HTML elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody tfoot thead tr ul".split()
)
CUT = frozenset(
    "head script style title textarea noscript iframe xmp noembed noframes template svg math canvas object audio video map "
    "nav aside footer form dialog menu button select datalist input label fieldset".split()
)
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
SAME = {k: v.split() for k, v in {"li": "li", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}.items()}
LISTS = "ul ol table dl body".split()
WALLS = frozenset("article aside body div footer header main nav section table td th ul ol dl blockquote form figure html".split())
# Words in class, id or role that mark what isn't the article.
CUT_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share "
    "sharing social breadcrumb breadcrumbs pagination pager related recommended recommendations comment comments disqus respond "
    "replies reply widget toolbar masthead copyright login search skip complementary contentinfo navigation hidden outbrain taboola".split()
)
KEEP = frozenset("html body article main".split())
# What a class says after these words is about the page's state or layout, not about the element.
STATE = frozenset("has no not without with overflow".split())

UNITS = BLOCK | {"td", "th"}  # elements that have densities of their own in a sum
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


def _mark(value: str) -> int:
    """2 if one of the names is a mark, 1 if a part of a compound name is, 0 otherwise."""
    found = 0
    for name in value.split():
        if name.lower() in CUT_WORDS:
            return 2
        for piece in PIECES.findall(name):
            if piece.lower() in STATE:
                break
            if piece.lower() in CUT_WORDS:
                found = 1
    return found


def _is_cut(tag: str, attributes: str, in_article: bool) -> int:
    """2 for an element that is no article, 1 if only a part of a compound name says so, 0 otherwise."""
    if tag in CUT:
        return 2
    if tag == "header" and not in_article:
        return 2
    if not attributes or tag in KEEP:
        return 0
    found, seen = 0, set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in seen:  # the first of a repeated attribute counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return 2
        if name in ("class", "id", "role"):
            found = max(found, _mark(value))
    return found


class Page:
    """The tree of a page in document order, with the pieces of text; ``None`` among them ends a block.

    Pages are read in one pass whose time is in proportion to their length, however broken they are.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.cut, self.first = ["#root"], [-1], [False], [0]
        self.maybe = [False]  # whether only a part of a compound name marks a node
        self.article = [False]  # whether a node is, or is in, an article or main element
        self.events: list[tuple[int, str | None]] = []
        self.last: list[int] = [0]  # end of a node's events
        self.stack, self.open_at = [0], defaultdict(list)  # open nodes, and their places in the stack by tag
        self._read(html)
        self._pop(0)
        if any(self.maybe):
            self._settle()

    def _read(self, html: str) -> None:
        pos, at, size, last = 0, 0, len(html), html.rfind(">")
        no_more: set[str] = set()  # quotes that don't come again
        while (at := html.find("<", at)) >= 0:
            mark = html[at + 1 : at + 2]
            if mark == "!" or mark == "?":
                end = html.find("-->", at + 4) + 3 if html.startswith("<!--", at) else html.find(">", at) + 1
                self._text(html[pos:at])
                pos = at = end if end > 2 else size
                continue
            name = NAME.match(html, at + 1 + (mark == "/")) if at < last else None
            if not name:
                at += 1
                continue
            self._text(html[pos:at])
            tag, start = name[0].lower(), name.end()
            pos = at = self._tag_end(html, start, no_more)
            if mark == "/":
                self._end(tag)
                continue
            attributes = html[start : pos - 1]
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                end = RAW_END[tag].search(html, pos)
                pos = html.find(">", end.end()) + 1 if end else 0
                pos = at = pos or size
                self._pop(len(self.stack) - 1)
            elif tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                self._pop(len(self.stack) - 1)
        self._text(html[pos:])

    @staticmethod
    def _tag_end(html: str, start: int, no_more: set[str]) -> int:
        """After the first > outside quotes; quotes that aren't closed are letters. There is a > after ``start``."""
        at = start
        while stop := STOP.search(html, at):
            if stop[0] == ">":
                return stop.end()
            close = -1 if stop[0] in no_more else html.find(stop[0], stop.end())
            if close < 0:
                no_more.add(stop[0])
            at = max(close + 1, stop.end())
        return html.find(">", start) + 1

    def _settle(self) -> None:
        """Cut the nodes that part of a name marks, unless they hold most of the page's text."""
        chars = [0] * len(self.tag)
        for i, text in self.events:
            if text is not None:
                chars[i] += len(SPACE.sub(" ", text.strip()))
        for i in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        for i in range(1, len(self.tag)):
            self.cut[i] = self.cut[i] or self.cut[self.parent[i]] or self.maybe[i] and 2 * chars[i] <= chars[0]

    def _text(self, text: str) -> None:
        if text and not self.cut[self.stack[-1]]:
            self.events.append((self.stack[-1], unescape(text)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open_at[tag]:
            return
        if tag in CLOSES_P:
            self._close(("p",), WALLS)
        if tag in SAME:
            self._close(SAME[tag], LISTS)
        if tag == "body":
            self._close(("head",), ())
        up, i = self.stack[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        cut = _is_cut(tag, attributes, self.article[up])
        self.cut.append(self.cut[up] or cut == 2)
        self.maybe.append(cut == 1)
        self.article.append(self.article[up] or tag in ("article", "main"))
        if tag in BLOCK:
            self.events.append((up, None))
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        if tag in ("br", "td", "th"):
            self.events.append((up, " "))
        self.open_at[tag].append(len(self.stack))
        self.stack.append(i)

    def _pop(self, down_to: int) -> None:
        """Close all open elements from that place in the stack on."""
        while len(self.stack) > down_to:
            i = self.stack.pop()
            self.last[i] = len(self.events)
            if self.tag[i] in BLOCK:
                self.events.append((self.parent[i], None))
            if i:
                self.open_at[self.tag[i]].pop()

    def _close(self, tags: Iterable[str], walls: Iterable[str]) -> None:
        """Close the innermost open element of ``tags``, unless a wall lies above it."""
        at = self._innermost(tags)
        if at and at >= self._innermost(walls):
            self._pop(at)

    def _innermost(self, tags: Iterable[str]) -> int:
        """The place in the stack of the innermost open element of these, 0 if none is open."""
        found = 0
        for tag in tags:
            if (places := self.open_at.get(tag)) and places[-1] > found:
                found = places[-1]
        return found

    def _end(self, tag: str) -> None:
        if tag not in ("html", "body"):  # what follows these still belongs to the body
            self._close((tag,), () if tag in WALLS else WALLS)

    def densities(self) -> tuple[list[float], list[float], int]:
        """Composite text density and density sum of every node, and the body's place."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.events:
            if text is not None and not self.cut[i]:
                size = len(SPACE.sub(" ", text.strip()))
                chars[i] += size
                links[i] += size * in_link[i]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.cut[i]:
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += 1 + tags[i]
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        ratio = links[body] / max(1, chars[body])
        dense, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.cut[i] or not chars[i]:
                continue
            c, lc, t, lt = chars[i], links[i], max(1, tags[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            dense[i] = c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / base if c * t > max(1, lc) * lt else c / t / base * 0.01
            if i:
                sums[self.parent[i]] += dense[i] if self.tag[i] in UNITS else sums[i]
        self.linked = [2 * lc > c and 2 * c <= chars[body] for c, lc in zip(chars, links)]  # mostly links, and not most of the page
        return dense, sums, body

    def content(self) -> tuple[list[int], set[int]]:
        """The nodes whose text is the content, in page order, and the nodes below them that aren't part of it."""
        dense, sums, body = self.densities()
        inside = [False] * len(self.tag)
        inside[body] = True
        for i in range(body + 1, len(self.tag)):
            inside[i] = inside[self.parent[i]]
        alive = [i for i in range(body, len(self.tag)) if inside[i] and not self.cut[i]]
        best = max((i for i in alive if self.tag[i] in UNITS or i == body), key=lambda i: (sums[i], -i), default=body)
        path = [best if sums[best] else body]
        while path[-1] != body and path[-1] > 0:
            path.append(self.parent[path[-1]])
        least = min(dense[i] for i in path)
        top = max(k for k, i in enumerate(path) if dense[i] >= dense[path[0]] / 2)
        place = {i: k for k, i in enumerate(path)}
        nodes, dropped = [path[top]], set()
        for i in alive:
            k = place.get(self.parent[i])
            if k is None or i in place or k == 0 and path[0] != body:
                continue
            heading = self.tag[i] in HEADINGS
            if k <= top:
                if self.linked[i] and not heading and self.tag[i] in UNITS:
                    dropped.add(i)
            elif dense[i] and (heading or dense[i] >= least and not self.linked[i]):
                nodes.append(i)
        return sorted(nodes), dropped

    def text(self) -> str:
        blocks, now = [], []

        def end() -> None:
            if block := SPACE.sub(" ", "".join(now)).strip():
                blocks.append(block)
            now.clear()

        nodes, dropped = self.content()
        out = [i in dropped for i in range(len(self.tag))]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        for root in nodes:
            for i, text in self.events[self.first[root] : self.last[root]]:
                if text is None:
                    end()
                elif not self.cut[i] and not out[i]:
                    now.append(text)
            end()
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in order, one a line; empty if there is none."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns and text: one row per row of ``pages``.

    Null and empty pages have an empty text, broken ones what text they have; pages of any length are read whole, in time
    in proportion to it. Repeated rows stay repeated, and an empty table gives an empty result. Other columns may have any
    names; of the kept ones none may be called text.
    """
    body = free_name([*keep, "text"], "body")
    schema = pages.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                cols = [b.column(i) for i in range(b.num_columns - 1)]
                made = pa.array([main_text(x.as_py()) for x in b.column(b.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, made], names=[*keep, "text"])

    return pages.select(*keep, F.col(html).alias(body)).mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points; null, broken, long and repeated pages and empty tables as in ``extract``."""
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
