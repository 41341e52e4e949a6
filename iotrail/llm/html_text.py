"""Main text of web pages by composite text density.

A page is read once into arrays of its elements in page order. Text that cannot be an article (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, comments) is marked by element name, role or class words first. Over
the rest every node gets its characters per tag, adjusted for links; the sum over a node's children picks the densest
subtree, and the least density on its path to the body decides which other subtrees are text as well. The page's text is
what lies in those subtrees, with headings and short blocks between them. No page is shortened.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from iotrail.llm.common import pick, slices, table, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag inside one of these does not close what was opened outside.
BARRIERS = frozenset("table td th caption object template".split())
IN_TABLE = frozenset("td th tr tbody thead tfoot caption".split())
#: A start tag that ends an open element: (elements it ends, elements that protect them).
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas dialog menu search xmp noembed noframes audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that name what is not an article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay share sharing social related recommended "
    "comments comment commentlist disqus respond replies toolbar pagination pager".split()
)
#: ``with-sidebar`` says where an article stands, not what it is.
STANDS = frozenset("has with no without".split())

_TAG = {quotes: re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>{quotes}]++{''.join(f'|{q}[^{q}]*+{q}' for q in quotes)})*+)(>?)") for quotes in ("\"'", '"', "'", "")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


TEXT, HEADER, OUT = 0, 1, 2


class Page:
    """Elements of a page in page order: name, parent and state, and the runs of text with their elements.

    State ``TEXT`` may be an article, ``OUT`` never is, and of ``HEADER`` (the header of an article) only headings are.
    """

    def __init__(self, source: str) -> None:
        self.name, self.parent, self.state = ["body"], [-1], [TEXT]
        self.runs: list[tuple[int, str | None]] = []  # text None: a block begins or ends
        self.hinted: list[int] = []
        self.label = [""]  # name and class, of sections and classed elements
        self._open, self._at = [0], {}  # open elements; places of each name among them
        self._blocks, self._barriers = [0], [-1]
        self._read(source)

    def _read(self, source: str) -> None:
        at, n, quotes = 0, len(source), "\"'"
        while at < n:
            start = source.find("<", at)
            start = n if start < 0 else start
            if start > at:
                self._text(source[at:start])
            if start == n:
                return
            ahead = source[start + 1 : start + 3].ljust(2)
            if source.startswith(("<!-->", "<!--->"), start):
                at = source.index(">", start) + 1
            elif ahead[0] in "!?" or (ahead[0] == "/" and not (ahead[1].isascii() and ahead[1].isalpha())):
                end = source.find("-->" if source.startswith("<!--", start) else ">", start)
                at = n if end < 0 else source.index(">", end) + 1
            elif not (ahead[0] == "/" or (ahead[0].isascii() and ahead[0].isalpha())):
                self._text("<")
                at = start + 1
            else:
                while True:
                    found = _TAG[quotes].match(source, start)
                    if found[4] or found.end() == n:
                        break
                    quotes = quotes.replace(source[found.end()], "")  # no second one follows: from here on a plain character
                at = found.end()
                if not found[4]:
                    return  # the page ends inside a tag
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                    continue
                self._start(name, found[3])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII).search(source, at)
                    at = close.start() if close else n

    def _text(self, piece: str) -> None:
        self.runs.append((self._open[-1], html.unescape(piece)))

    def _pop(self, upto: int) -> None:
        for _ in range(len(self._open) - upto):
            name = self.name[self._open.pop()]
            self._at[name].pop()
            if name in BLOCKS:
                self._blocks.pop()
                self.runs.append((self._open[-1], None))
            if name in BARRIERS:
                self._barriers.pop()

    def _last(self, name: str) -> int:
        """Place of the innermost open element of the name, -1 without one."""
        held = self._at.get(name)
        return held[-1] if held else -1

    def _in_article(self) -> bool:
        return self._last("article") >= 0 or self._last("main") >= 0

    def _start(self, name: str, rest: str) -> None:
        if name in ("html", "body"):
            return
        block = name in BLOCKS
        if block and name not in IN_TABLE and (p := self._last("p")) > self._barriers[-1]:
            self._pop(p)
        if name in ENDS:
            ended, guards = ENDS[name]
            guard = max(map(self._last, guards))
            ending = [x for x in map(self._last, ended) if x > guard]
            if ending:
                self._pop(min(ending))
        element, over = len(self.name), self._open[-1]
        label = name if name == "section" else ""
        state = TEXT if self.state[over] == HEADER and name in HEADINGS else self.state[over]
        if name in NEVER:
            state = OUT
        elif name == "header":
            state = max(state, HEADER if self._in_article() else OUT)
        elif state == TEXT and rest and name not in ("article", "main"):
            given = {k.lower(): next((x for x in v if x), "") for k, *v in _ATTRIBUTE.findall(rest)}
            if given.get("role", "").strip().lower() in ROLES or "hidden" in given:
                state = OUT
            if given.get("class"):
                label = f"{name}.{given['class']}"
            words = _words(given.get("class", "")) | _words(given.get("id", ""))
            if words & WORDS or ("header" in words and not self._in_article()):
                self.hinted.append(element)
        self.name.append(name)
        self.parent.append(over)
        self.label.append(label)
        self.state.append(state)
        if block or name == "br":
            self.runs.append((over, None if block else " "))
        if name in VOID:
            return
        self._at.setdefault(name, []).append(len(self._open))
        if block:
            self._blocks.append(len(self._open))
        if name in BARRIERS:
            self._barriers.append(len(self._open))
        self._open.append(element)

    def _end(self, name: str) -> None:
        """Closes the innermost element of the name: blocks not across barriers, others not across blocks."""
        border = self._blocks[-1]
        if name in BARRIERS or name in IN_TABLE:
            border = -1
        elif name in BLOCKS or name in NEVER:
            border = self._barriers[-1]
        if (at := self._last(name)) > border:
            self._pop(at)


def _words(value: str) -> set[str]:
    """Words of a class or id value, lower-cased; those after *has*, *with*, *no* do not count."""
    out = set()
    for name in value.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        out |= {w for before, w in pairwise(["", *parts]) if before not in STANDS}
    return out


def _sums(page: Page, own: list[int]) -> list[int]:
    total = own[:]
    for i in range(len(own) - 1, 0, -1):
        total[page.parent[i]] += total[i]
    return total


def _drop_hinted(page: Page) -> None:
    """Puts out elements with telling class words, unless they hold an article or most of the text that could be one.

    That is the text of the article around them; without one, of the page if no article has text elsewhere in it.
    """
    if not page.hinted:
        return
    n, name, parent = len(page.name), page.name, page.parent
    own, around = [0] * n, [0] * n
    for element, piece in page.runs:
        if piece and page.state[element] == TEXT:
            own[element] += len(piece)
    for i in range(1, n):
        around[i] = parent[i] if name[parent[i]] in ("article", "main") else around[parent[i]]
    size = _sums(page, own)
    within = _sums(page, [s * (x in ("article", "main")) for s, x in zip(size, name, strict=True)])
    for i in page.hinted:
        elsewhere = not around[i] and within[0] > within[i]
        if not within[i] and (elsewhere or 2 * size[i] <= size[around[i]]):
            page.state[i] = OUT
    for i in range(1, n):
        if page.state[parent[i]] == OUT:
            page.state[i] = OUT


def densities(page: Page, chars: list[int], linked: list[int]) -> list[float]:
    """Composite text density of every node: characters per tag, less for text in links."""
    live = [int(x == TEXT) for x in page.state]
    c, lc = _sums(page, chars), _sums(page, linked)
    tags, links = _sums(page, live), _sums(page, [int(x == "a") * y for x, y in zip(page.name, live, strict=True)])
    share, out = lc[0] / max(c[0], 1), []
    for i in range(len(live)):
        t, inside = max(tags[i] - 1, 1), max(lc[i], 1)
        base = math.log(c[i] / max(c[i] - lc[i], 1) * inside + share * c[i] + math.e)
        ratio = max(c[i] / inside * t / max(links[i], 1), 1.0)
        out.append(c[i] / t * math.log(ratio) / math.log(base) if c[i] else 0.0)
    return out


def text_blocks(page: Page, holder: list[int], in_link: list[bool]) -> list[tuple[int, str, float]]:
    """``(block element, text, share of it in links)`` of every stretch of text between two borders of blocks."""
    out, held, at, linked = [], [], 0, 0
    for element, piece in [*page.runs, (0, None)]:
        if piece is None:
            text = " ".join("".join(held).split())
            if text:
                out.append((at, text, min(linked / len(text), 1.0)))
            held, linked = [], 0
        elif page.state[element] == TEXT:
            held.append(piece)
            at = holder[element]
            linked += len(piece.strip()) if in_link[element] else 0
    return out


def main_text(source: str) -> str:
    """Blocks of the page's main text in page order, one a line; empty if there is none."""
    page = Page(source)
    _drop_hinted(page)
    name, parent, n = page.name, page.parent, len(page.name)
    holder, in_link = [0] * n, [False] * n
    for i in range(1, n):
        holder[i] = i if name[i] in BLOCKS else holder[parent[i]]
        in_link[i] = in_link[parent[i]] or name[i] == "a"
    blocks = text_blocks(page, holder, in_link)
    if not blocks:
        return ""
    chars, linked = [0] * n, [0] * n
    for i, text, share in blocks:
        chars[i] += len(text)
        linked[i] += round(len(text) * share)
    density = densities(page, chars, linked)

    # Sums over children: the blocks below a node and the text it holds beside them. Without a block below, its own density.
    total, inner = [0.0] * n, [False] * n
    nodes = [i for i in range(n) if holder[i] == i and page.state[i] == TEXT]
    over = [holder[parent[i]] if i else -1 for i in range(n)]
    for i in nodes[1:]:
        total[over[i]] += density[i]
        inner[over[i]] = True
    for i, text, share in blocks:
        if inner[i]:
            total[i] += len(text) * (1 - share)
    for i in nodes:
        if not inner[i]:
            total[i] = density[i]
    best = max(nodes, key=lambda i: (total[i], -i))
    least, i = density[best], best
    while i > 0:
        i = over[i]
        least = min(least, density[i])

    # From the body down, every node at or above the threshold gives the densest subtree below it.
    top, reached, chosen = list(range(n)), [False] * n, [False] * n
    for i in reversed(nodes[1:]):
        top[over[i]] = max(top[over[i]], top[i], key=lambda k: (total[k], -k))
    for i in nodes:
        reached[i] = density[i] >= least and (i == 0 or reached[over[i]])
        if reached[i]:
            chosen[top[i]] = True
    # An article cut into equal parts (sections, or elements of one class) is whole with all of them.
    parts = {(over[i], page.label[i]) for i in nodes[1:] if chosen[i] and page.label[i]}
    for i in nodes[1:]:
        chosen[i] = chosen[i] or chosen[over[i]] or (over[i], page.label[i]) in parts
    picked = [k for k, (i, _, _) in enumerate(blocks) if chosen[i]]
    first, last = picked[0], picked[-1]
    while first and name[blocks[first - 1][0]] in HEADINGS:
        first -= 1
    # Within that stretch only lists of links go; outside it nothing is taken.
    return "\n".join(text for i, text, share in blocks[first : last + 1] if chosen[i] or share < 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row a page, from the whole page.

    Null and empty pages, and pages without text, give an empty text of 0 characters. Nulls in the id and the url, repeated
    rows and equal pages stay as they are; other columns are not read; an empty table gives no rows. A page that is plain
    text is one block. Unclosed and misplaced tags are closed as browsers do. Time grows with the length of the page.
    """
    given = pick(pages, page_id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = [main_text(x) for x in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; null, empty, odd and repeated pages: see ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
