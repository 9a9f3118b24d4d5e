"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks: block-level tags part them, inline tags don't. Each block is described by its own word count and
link density, those of the block before and after it, and by four marks of its surroundings (inside an element of page furniture, inside an
element whose class or id names furniture, inside an article, heading). A decision tree (Gini splits), trained at start on the blocks of the
small labelled pages below, says which blocks are main text; those are joined by newlines in page order.

A name alone never drops an article: an element that holds an article or main element is no furniture whatever it is called, nor is one
with the top heading, or (unless its name is one of comments) any, that holds half of the page's words. Attributes are read as such, so words of other attributes play no part.

Defined cases: null and empty pages, and pages without main text, give an empty text; unclosed and stray tags and quotes are tolerated, in
time proportional to the page; pages of any length are handled whole; the text of scripts, styles, templates, comments, forms and the page head
never counts; character references are decoded once; white space of any kind inside a block becomes one blank; repeated rows each give a
row; an empty table gives an empty result; other input columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
#: Fixed values of HTML: elements whose content is not text, elements without content, and elements inside a line of text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "svg", "object", "canvas", "audio", "video"}
MAIN = {"article", "main"}
#: Words of class, id and role values that name page furniture; those of reader comments; words that say how comments stand; first words that turn a name into another thing.
NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright",
    "dialog", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
STATES = {"open", "closed", "enabled", "allowed", "count", "link"}
OTHERWISE = {"with", "without", "no", "has", "hide", "entry", "post", "article", "page", "content", "open"}
#: What an element closes when it opens, if that is open and no container stands between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "blockquote"} | FURNITURE

#: The labelled pages: + before the blocks that are main text, - before the others; a number stands for so many words.
LABELLED = """
<header><a>-2</a><p>-6</p></header><nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><main><article><header><h1>+7</h1><p>+4</p></header><p>+60<p>+45<h2>+4</h2><p>+80<ul><li>+9<li>+12<li>+3</ul><p>+2<p>+30</article></main><aside><h3>-3</h3><p>-40<p><a>-5</a></aside><footer><p>-12<p><a>-2</a></footer>
<nav><a>-1</a><a>2</a></nav><div class=ad>-8</div><article><h1>+9</h1><p>+30 <a>3</a> 20<p>+1<p>+5 <a>4</a><p>+120<p><a>+6</a><blockquote>+18</blockquote><p>+55<form>-3</form><footer><a>-2</a><p>-9</footer></article><footer>-7</footer>
<div class=banner>-15</div><article><h1>+5</h1><p>+200</article><section id=comments><h2>-2</h2><article class=comment><p>-60</article><article class=comment><p>-25</article></section><footer>-20</footer>
<div class=cookie-notice><p>-28<p><a>-2</a></div><main><h1>+6</h1><p>+35<p>+3<p>+14<h3>+2</h3><p>+90<p>+16 <a>10</a><div class=related><h4>-2</h4><p>-35<p><a>-7</a></div></main>
<ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul><h1>+6</h1><p>+50<p>+44<p>+6<p>+70<ul><li><a>-3</a><li><a>-4</a></ul><p>-4
<div><a>-1</a> <a>1</a> <a>2</a></div><div><div>-3</div></div><h2>+8</h2><div>+110</div><div>+35 <a>4</a></div><div>+12</div><div>+48</div><div class=share>-3</div><div><a>-2</a></div><div>-5</div>
<p><a>-2</a><p><a>-3</a><p>+26<p>+33<p>+20 <a>2</a><p>+61<p><a>-4</a><p>-2 <a>3</a><p>-6
<table><tr><td><a>-2</a><td><a>-2</a></table><h1>+4</h1><table><tr><td>+75</table><h2>+3</h2><p>+40<p>+9<p>+58<div>-3 <a>5</a></div><div>-8 <a>6</a></div>
<div class=sidebar><p>-45<p>-60</div><div class=post><h1>+7</h1><p>+52<p>+31<pre>+24</pre><p>+66</div><div class=widget><h3>-2</h3><p>-30</div><div id=footer><p>-10 <a>4</a></div>
<header><h1>-3</h1></header><p>+150<nav><p>-12</nav><p>+85<aside><p>-50</aside><p>+27<dialog><p>-22</dialog>
<article><p>+40<p>+2<p>+1<p><a>+1</a><p>+10<ul><li><a>+4</a><li><a>+8</a></ul><aside><p>-75<p>-8</aside><p>+25</article><div class=promo><p>-90</div>
<div>-2</div><div>-4</div><div><a>-1</a></div><article><h1>+8</h1><p>+3</article><form><p>-18</form><div class=newsletter><h2>-5</h2><p>-22</div>
<div><a>-3</a></div><div>+180</div><div><a>-5</a></div><div>-3</div>
<p>-2<p><a>-1</a><p>-3 <a>3</a><p><a>-2</a><p>-1
<div><a>-1</a><a>2</a></div><h1>+2</h1><p>+60<p>+2<p>+30<p>+4<p>+25<p>+1<p>+41<h2>+3</h2><p>+26<p>+12<p>-3<p><a>-2</a>
<h1>+5</h1><p>+28<h2>+1</h2><p>+9<p>+33<h3>+2</h3><p>+17<p>+90<p>+3<p>+7<p>+45<ul><li><a>-2</a><li><a>-1</a></ul><h4>-2</h4><ul><li><a>-5</a><li><a>-6</a></ul><p>-5
<h2>-2</h2><ul><li><a>-3</a><li><a>-4</a></ul><div>-4 <a>1</a></div><h1>+9</h1><div>+31</div><div>+6</div><div>+38</div><div>+2</div><div>+64</div><h2>-1</h2><div><a>-7</a></div><div>-9</div><div><a>-1</a></div>
<article><h1>+2</h1><p>+60<p>+30</article>
<main><p>+3<p>+25<p>+1<p><a>+3</a></main>
<article><p><a>+1</a><p>+1</article>
<article><h1>+3</h1><p><a>+2</a><p>+9<p><a>+12</a></article>
<div><a>-1</a></div><article><p>+12<p><a>+5</a></article><div><a>-1</a></div>
<main><h2>+1</h2><ul><li><a>+1</a><li><a>+2</a><li><a>+9</a><li><a>+1</a></ul><p>+2</main><div><a>-3</a></div>
<article><p>+2<p><a>+4</a><p><a>+6</a><p>+3<p><a>+1</a><p>+7<p>+30<p><a>+2</a></article>
<h1>+3</h1><p>+60<p>+30
<h1>+2</h1><div>+45</div><div>+2</div><div>+60</div>
<h1>+1</h1><p>+70
<p>+80
<div>+25</div><div>+40</div>
<h2>+2</h2><p>+35<p>+5<p>+40
<div><a>-4</a></div><div><a>-2</a></div><p>-2
""".strip().split("\n")  # fmt: skip
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "furniture", "named", "article", "heading")
Tree = tuple  # (answer,) or (feature, bound, tree at or below, tree above)


def grow(rows: list[tuple], depth: int = 8) -> Tree:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest bound."""
    yes = sum(r[-1] for r in rows)
    if depth == 0 or yes in (0, len(rows)):
        return (int(2 * yes > len(rows)),)

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            left, right = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            cost = impurity(left) + impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, bound, left, right)
    if best is None:
        return (int(2 * yes > len(rows)),)
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree: Tree, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def labelled_blocks(pages: list[str] = LABELLED) -> list[tuple]:
    """(features..., label) of the blocks of the labelled pages."""
    rows = []
    for page in pages:
        written = re.sub(r"([+-]?)(\d+)", lambda m: " ".join([{"+": "yes", "-": "no", "": "w"}[m[1]], *["w"] * (int(m[2]) - 1)]), re.sub(r"h(\d)>", lambda m: f"h{'abcdefg'[int(m[1])]}>", page))
        found = blocks(re.sub(r"h([a-g])>", lambda m: f"h{'abcdefg'.index(m[1])}>", written))
        rows += [(*row, int("yes" in text.split(" "))) for text, row in zip([b[0] for b in found], described(found), strict=True)]
    return rows


@dataclass
class Element:
    """An open or closed element: what marks it as furniture, and what it holds."""

    name: str
    parent: int
    furniture: bool
    named: bool
    comments: bool
    main: bool
    holds_main: bool = False
    holds_title: bool = False
    words: int = 0


@dataclass
class Block:
    element: int
    heading: int
    pieces: list[str] = field(default_factory=list)
    link_pieces: list[str] = field(default_factory=list)


def _marks(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(furniture by its tag or because it is hidden, named as furniture, named as comments)."""
    furniture, named, comments = name in FURNITURE, False, False
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id", "role"):
                for token in value.split():
                    parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
                    ends = {parts[0], parts[-1]} if parts and parts[0] not in OTHERWISE else set()
                    named, comments = named or bool(ends & NAMES), comments or bool(ends & COMMENTS) and not STATES & set(parts)
            furniture |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(re.search(r"display\s*:\s*none", value, re.IGNORECASE))
    return furniture, named or comments, comments


class Scanner:
    """One pass over a page. Nothing is searched twice in vain, and every search ends where the next one begins."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.elements = [Element("", -1, False, False, False, False)]
        self.stack = [0]
        self.open: Counter = Counter()
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.links = self.headings = 0
        self.gone: set[str] = set()  # quotes and closing tags that don't occur any more

    def pop(self) -> None:
        name = self.elements[self.stack.pop()].name
        self.open[name] -= 1
        self.links, self.headings = self.links - (name == "a"), self.headings - (name in HEADINGS)

    def top(self) -> Element:
        return self.elements[self.stack[-1]]

    def text(self, piece: str) -> None:
        if self.current is None:
            if not piece.strip():
                return
            self.current = Block(self.stack[-1], int(self.headings > 0))
            self.blocks.append(self.current)
        self.current.pieces.append(piece)
        if self.links:
            self.current.link_pieces.append(piece)

    def find(self, what: str, at: int) -> int:
        """Like str.find, but what has been missed once is not looked for again."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, or of the end of the page. A quote after = hides what it encloses; one that is never closed counts as a letter."""
        while m := STOP.search(self.page, at):
            at = m.start()
            if m[0] == ">":
                return at
            closing = self.find(m[0], at + 1) if self.page[at - 1] in "= \t\r\n" else -1
            at = closing + 1 if closing > 0 else at + 1
        return len(self.page)

    def close_above(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def closed(self, name: str) -> None:
        """An inline element never closes a block around it; other end tags close all that stands inside their element."""
        if not self.open[name]:
            return
        for place in range(len(self.stack) - 1, 0, -1):
            here = self.elements[self.stack[place]].name
            if here == name:
                self.close_above(place)
                return
            if name in INLINE and here not in INLINE:
                return

    def opened(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            for place in range(len(self.stack) - 1, 0, -1):
                here = self.elements[self.stack[place]].name
                if here in CLOSES[name]:
                    self.close_above(place)
                    break
                if here in WALLS:
                    break
        if name == "a" and self.links:  # links don't nest
            self.closed("a")
        if name == "body":  # what the head left open ends here
            while len(self.stack) > 1 and self.top().name != "html":
                self.pop()
        furniture, named, comments = _marks(name, attributes)
        if name == "header" and any(self.open[m] for m in MAIN):
            furniture = False
        main = name in MAIN and not comments
        if (furniture or named) and name in INLINE:  # an inline element parts the text only where it is furniture
            self.current = None
        self.elements.append(Element(name, self.stack[-1], furniture, named, comments, main))
        self.stack.append(len(self.elements) - 1)
        self.open[name] += 1
        self.links, self.headings = self.links + (name == "a"), self.headings + (name in HEADINGS)

    def run(self) -> None:
        page, n = self.page, len(self.page)
        while self.at < n:
            less = page.find("<", self.at)
            if less < 0:
                self.text(page[self.at :])
                return
            if less > self.at:
                self.text(page[self.at : less])
            if page.startswith("<!--", less):
                end = page.find("-->", less + 4)
                self.at = end + 3 if end >= 0 else n
                continue
            if page.startswith("<![CDATA[", less):
                end = page.find("]]>", less)
                self.text(html.escape(page[less + 9 : end if end >= 0 else n], quote=False))
                self.at = end + 3 if end >= 0 else n
                continue
            if page.startswith(("<!", "<?"), less):
                end = page.find(">", less)
                self.at = end + 1 if end >= 0 else n
                continue
            m = NAME.match(page, less)
            if m is None:
                self.text("<")
                self.at = less + 1
                continue
            end = self.tag_end(m.end())
            self.at = end + 1
            name = m[1].lower()
            if name == "br":
                if self.current is not None:
                    self.text(" ")
                continue
            if name not in INLINE:
                self.current = None
            if m[0][1] == "/":
                self.closed(name)
            elif name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, self.at) if name not in self.gone else None
                if closing is None:
                    self.gone.add(name)
                    self.at = n
                else:
                    self.at = self.tag_end(closing.end()) + 1
            elif name not in VOID:
                self.opened(name, page[m.end() : end])


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, furniture, named, article, heading) of every non-empty block, in page order."""
    scanner = Scanner(page)
    scanner.run()
    elements, found = scanner.elements, []
    for b in scanner.blocks:
        whole = " ".join(html.unescape("".join(b.pieces)).split())
        if whole:
            words = len(whole.split(" "))
            linked = len(html.unescape(" ".join(b.link_pieces)).split())
            found.append((whole, words, min(1.0, linked / words), b))
            elements[b.element].words += words
    for e in reversed(elements[1:]):  # children stand behind their parents
        up = elements[e.parent]
        up.words += e.words
        up.holds_main |= (e.main or e.holds_main) and not e.comments
        up.holds_title |= e.name == "h1" or e.holds_title
    half = elements[0].words / 2
    # what an element passes on to the blocks in it
    furniture, named, article = [False], [False], [False]
    for e in elements[1:]:
        large = e.words > half
        wraps = e.holds_main or e.main and not e.comments
        free = wraps or (large and e.name in ("form", "div", "section", "span") and (e.holds_title or not e.comments))
        furniture.append(furniture[e.parent] or e.furniture and not free)
        named.append(named[e.parent] or e.named and not free)
        article.append(article[e.parent] or e.main)
    return [(text, words, density, int(furniture[b.element]), int(named[b.element]), int(article[b.element]), b.heading) for text, words, density, b in found]


def described(found: list[tuple]) -> list[tuple]:
    """The features of each block: its own numbers, those of its neighbours, its marks."""
    sizes = [(0, 0.0), *[b[1:3] for b in found], (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], *b[3:]) for i, b in enumerate(found)]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, row in zip(found, described(found), strict=True) if decide(tree, row))


def extracted(pages: DataFrame, labelled: list[str] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from the whole html."""
    source = pages.select("page_id", "url", "html")
    schema = pages.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    tree = grow(labelled_blocks(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in column(batch, "html")]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema)
