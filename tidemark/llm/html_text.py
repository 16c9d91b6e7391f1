"""HTML extraction by tree scoring: paragraphs pass points to their ancestors, the best container is kept.

A page is cut into tags and text, and the tree of block elements is built as browsers close open
paragraphs. What no reader sees (scripts, styles, hidden elements) and controls go at once. Elements that are no article by tag, role or
name (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are suspect: their points count for
PENALTY of theirs, and they go, with all that they hold, only if that is less than the points outside of suspects. So a wrapper
that is named after what it also holds ("with-sidebar") stays, and what it holds is judged in turn. Around the page's
foremost article or main no element goes, and suspects beside it always do. Names of containers
count by their parts ("cookie-notice"), those of paragraphs and inline elements as whole classes, and those of headings
not at all. Each paragraph gives points for its length and commas to its parent, half of them to the grandparent, a third
to the one above. Points are discounted by link density; the best container, or the outermost article or main
around it, is kept with those siblings that score well or have few links, short ones and headings too; so it goes on
upwards while what is kept is half of the next container's text or more. Of what is kept, every block is returned whole
and in page order.

Each step is linear in the page's length, however deeply elements nest and whatever is left open.
Defined results: null or empty html gives empty text, an empty table an empty result; a page without paragraphs gives the
text of its best block's container; a tag that never ends takes the rest of the page, a quote that never ends is no
quote; equal scores (the first container stays) and repeated rows are handled alike each time; very long pages are
read whole; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Where a tag ends, or a quoted value begins, in which it can't.
STOP = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Their content is text up to their own end tag.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Tags that never hold the article, and those that seldom do.
NEVER = frozenset(("button", "select", "option", "head", "template", "svg", "canvas", "object")) | RAW
SELDOM = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"))
APART = NEVER | SELDOM
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open paragraphs end where these begin.
ENDS_PARAGRAPH = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"} | APART - RAW
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "dd", "div", "section", "article", "main", "body"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"))
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|disqus|footer|foot|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s0-9])",
    re.I,
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "article", "main"))
CONTAINERS = frozenset(("div", "section", "ul", "ol", "dl", "table", "td", "details", "figure"))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Articles that are comments of readers.
REMARK = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|reply|replies|respond)(?:$|[-_\s0-9])", re.I)
#: What points of a suspect element count, against those outside of suspects.
PENALTY = 1 / 3
#: Articles that are comments of readers.
REMARK = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|reply|replies|respond)(?:$|[-_\s0-9])", re.I)
#: What points of a suspect element count, against those outside of suspects.
PENALTY = 1 / 3
#: Articles that are comments of readers.
REMARK = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|reply|replies|respond)(?:$|[-_\s0-9])", re.I)
#: What points of a suspect element count, against those outside of suspects.
PENALTY = 1 / 3
#: A sibling stays if it has this share of the best score, or fewer links than this.
SIBLING_SHARE, SIBLING_LINKS = 0.2, 0.25


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    parent: Node | None
    apart: bool = False
    suspect: bool = False
    held: float = 0.0
    clean: float = 0.0
    points: float = 0.0
    chars: int = 0
    links: int = 0
    kept: bool = False
    children: list[Node] = field(default_factory=list)

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0

    def score(self) -> float:
        return self.points * (1 - self.density())


@dataclass
class Block:
    node: Node
    text: str
    links: int

    def points(self) -> float:
        return (1 + self.text.count(",") + min(len(self.text) / 100, 3)) * (1 - self.links / max(1, len(self.text)))


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element goes at once, and whether it is suspect."""
    gone, suspect = tag in NEVER, tag in SELDOM
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        gone |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(HIDDEN.search(value))
        suspect |= name == "role" and value.lower() in ROLES
        if name in ("class", "id") and tag not in HEADINGS:
            suspect |= tag in CONTAINERS and bool(NAMES.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", value)))
            suspect |= name == "class" and any(NAMES.fullmatch(x) for x in value.split())
        suspect |= tag == "article" and name in ("class", "id") and bool(REMARK.search(value))
    return gone, suspect


class Scanner:
    """Tags and text of a page, one pass: what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Behind the tag's >, or the page's end."""
        while (m := STOP.search(self.page, at)) is not None:
            if m[1] is None:
                return m.end()
            at = max(m.end(), self.find(m[1], m.end()) + 1)
        return len(self.page)

    def parts(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before it, tag, whether it closes, attributes); at last the text behind the last tag, and no tag."""
        page, at, start = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after in ("!", "?") or page.startswith("</", at) and not NAME.match(page, at):
                if page.startswith("</", at) and not page[at + 2 : at + 3]:
                    break
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = self.find(mark, at + 2)
                yield page[start:at], "", False, ""
                at = start = end + len(mark) if end >= 0 else len(page)
                continue
            m = NAME.match(page, at)
            if m is None:
                at += 1
                continue
            end, tag, closing = self.tag_end(m.end()), m[1].lower(), after == "/"
            yield page[start:at], tag, closing, page[m.end() : end - 1]
            at = end
            if tag in RAW and not closing:
                stop = RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            start = at
        yield page[start:], "", False, ""


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The block elements in page order, parents before children, and the blocks of text, without what stands apart."""
    root = Node("#root", None)
    nodes, blocks, parts = [root], [], []
    stack, places = [root], defaultdict(list)
    inline, opened = [], Counter()
    link, linked, skip_inline = False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1].apart:
                blocks.append(Block(stack[-1], text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def close(tags: Iterable[str], within: Iterable[str] = ()) -> None:
        """Closes the nearest open element of ``tags``, unless one of ``within`` was opened in it."""
        last = lambda names: max((places[t][-1] for t in names if places[t]), default=0)
        at = last(tags)
        if at and at > last(within):
            while len(stack) > at:
                places[stack.pop().tag].pop()

    for text, tag, closing, attributes in Scanner(page).parts():
        if text and not stack[-1].apart and not skip_inline:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))
        if not tag or not closing and tag in RAW:
            continue
        if tag in BLOCKS or tag in APART:
            flush()
            inline.clear()
            opened.clear()
            link, skip_inline = False, 0
            if closing:
                if tag not in ("html", "body"):
                    close((tag,))
                continue
            if tag in ENDS_PARAGRAPH:
                close(("p",), ("td", "th", *APART))
            if tag in SAME_ENDS:
                close(SAME_ENDS[tag], ("ul", "ol", "dl", "table"))
            parent = stack[-1]
            gone, suspect = _judged(tag, attributes)
            child = Node(tag, parent, parent.apart or gone, suspect)
            parent.children.append(child)
            nodes.append(child)
            if not attributes.endswith("/") or tag not in ("svg", "canvas", "object"):
                places[tag].append(len(stack))
                stack.append(child)
        elif tag in ("br", "hr"):
            flush()
        elif tag in VOID:
            continue
        elif closing:
            if tag == "a":
                link = False
            if opened[tag]:
                while True:
                    last = inline.pop()
                    opened[last] -= 1
                    if last == tag:
                        break
                if len(inline) < skip_inline:
                    skip_inline = 0
        else:
            inline.append(tag)
            opened[tag] += 1
            if tag == "a":
                link = True
            if not skip_inline and not stack[-1].apart and any(_judged(tag, attributes)):
                skip_inline = len(inline)
    flush()
    return nodes, blocks


def foremost(nodes: list[Node]) -> Node | None:
    """The article or main with the most points outside of suspects in it; instead of it one inside that has half of these."""
    inner: dict[int, Node | None] = {}
    best = None
    for n in nodes:
        over = inner[id(n.parent)] if n.parent is not None else None
        inner[id(n)] = over
        if n.tag in ("article", "main") and not n.suspect and not n.apart:
            inner[id(n)] = n
            if best is None or n.clean > best.clean or over is best and 2 * n.clean >= best.clean:
                best = n
    return best


def cut_suspects(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """Marks suspects that go, and all that they hold, as apart; the blocks that stay."""
    own: dict[int, float] = defaultdict(float)
    above: dict[int, Node] = {}
    for n in nodes:
        above[id(n)] = n if n.suspect or n.parent is None else above[id(n.parent)]
    for b in blocks:
        points = b.points()
        b.node.held += points
        b.node.clean += points
        own[id(above[id(b.node)])] += points
    for n in reversed(nodes[1:]):
        n.parent.held += n.held
        n.parent.clean += 0 if n.suspect else n.clean
    article = foremost(nodes)
    around, at = set(), article
    while at is not None:
        around.add(id(at))
        at = at.parent
    within = {id(article)} if article is not None else set()
    for n in nodes[1:]:
        if id(n.parent) in within:
            within.add(id(n))
    clean = own[id(nodes[0])]
    gone = set()
    # those that hold more come first, so outer ones before those inside; the order of equals is the page's
    for n in sorted((n for n in nodes[1:] if n.suspect and not n.apart), key=lambda n: -n.held):
        if id(above[id(n.parent)]) in gone:
            gone.add(id(n))
        elif id(n) not in around and (article is not None and id(n) not in within or PENALTY * n.held < clean or not n.held):
            gone.add(id(n))
        else:
            clean += own[id(n)]
    for n in nodes[1:]:
        n.apart |= n.parent.apart or id(n) in gone
    return [b for b in blocks if not b.node.apart]


def main_blocks(page: str) -> list[str]:
    nodes, blocks = parse(page)
    blocks = cut_suspects(nodes, blocks)
    for b in blocks:
        b.node.chars += len(b.text)
        b.node.links += b.links
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.links += n.links
    ranked: dict[int, Node] = {}
    for b in blocks:
        if b.node.tag not in PARAGRAPHS and b.node.tag != "li" and b.node.parent is not None:
            continue
        points = b.points()
        at = b.node.parent if b.node.tag in ("p", "pre", "td", "blockquote", "dd", "li") and b.node.parent else b.node
        for share in (1, 1 / 2, 1 / 3):
            if at is None:
                break
            at.points += points * share
            ranked.setdefault(id(at), at)
            at = at.parent
    if not ranked:
        best = blocks[0].node if blocks else None
    else:
        best = max(ranked.values(), key=Node.score)
    if best is None:
        return []
    at = best.parent
    while at is not None:
        best, at = at if at.tag in ("article", "main") else best, at.parent
    best.kept = True
    least, at = max(2.0, SIBLING_SHARE * best.score()), best
    while at.parent is not None and at.tag not in ("article", "main", "body") and (at is best or 2 * at.chars >= at.parent.chars):
        for s in at.parent.children:
            s.kept |= s is not at and not s.apart and (s.score() >= least or s.density() < SIBLING_LINKS)
        at = at.parent
    for n in nodes[1:]:
        n.kept |= n.parent.kept
    return [b.text for b in blocks if b.node.kept]


def extract_text(page: str) -> str:
    return " ".join(main_blocks(page))


def extract(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """One row a page: its id, the main text and its length in code points."""

    def rows(texts: list[str]) -> Iterator[tuple[str, int]]:
        for t in texts:
            text = extract_text(t)
            yield text, len(text)

    return map_texts(pages, page_id, page, "text string, n_chars long", rows, [pa.string(), pa.int64()])


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.struct("page_id", "url").alias("page"), "html")
    return extract(pages, "page").select("page.page_id", "page.url", "text", "n_chars")
