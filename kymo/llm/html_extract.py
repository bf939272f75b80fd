"""Main text of web pages by scoring the tree.

Paragraphs pass points for their length and commas to their ancestors, less the farther up; a container's points are
discounted by its link density. The best container (or the article around it) and those of its siblings that score well
are kept, without the parts that are no article: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only behind an equals sign, and only where another closes it. Nothing is tried twice.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noframes xmp".split())
#: Where the content of a raw element ends; only ASCII letters match in either case.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd tr td th".split())
#: Starting the key ends an open one of the first set, unless one of the second lies between.
ENDS_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROP = frozenset("nav header footer aside form script style noscript template button select option textarea iframe object svg canvas dialog menu input head title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id that name parts other than the article.
DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside rail ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register social share sharing related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion pagination pager widget toolbar search skip hidden copyright legal disclaimer paywall".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
WEIGHT = {"article": 25.0, "main": 15.0, "div": 2.0, "section": 2.0, "blockquote": 1.0, "pre": 1.0, "td": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -1.0}


class _Open:
    """The open elements, by name too, so that no step goes through more of them than it closes."""

    #: Between an end tag of a paragraph or list item and its start, these make it a stray one.
    HOLDERS = ("article", "section", "div", "td", "body", "main")

    def __init__(self) -> None:
        self.items, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, k: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append(k)
        self.tags.append(tag)

    def cut(self, j: int) -> None:
        while len(self.items) > j:
            self.items.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The highest place of any of ``tags``, 0 where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def closes(self, name: str) -> int:
        """The place an end tag closes, 0 for a stray one."""
        j = self.last((name,))
        if name in INLINE and j < self.blocks[-1] or name in ("p", "li") and j < self.last(self.HOLDERS):
            return 0
        return j

    def end_paragraph(self) -> None:
        if self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])

    def end_own(self, ends: set[str], within: set[str]) -> None:
        while (j := self.last(ends)) > self.last(within):
            again = self.tags[j] in ("td", "th") and "tr" in ends
            self.cut(j)
            if not again:
                return


class _Tree:
    """Elements in page order as parallel lists; ``runs`` are the text runs between them."""

    def __init__(self, html: str):
        self.tag, self.up, self.dropped = ["#root"], [-1], [False]
        self.runs: list[tuple[int, str]] = []  # (element, text); (element, "") where a block begins or ends there
        stack = _Open()
        at = 0
        for m in iter(_TAG.scanner(html).search, None):
            if m.start() < at:
                continue
            if m.start() > at:
                self.runs.append((stack.items[-1], html[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if j := stack.closes(name):
                    if name not in INLINE:
                        self.runs.append((stack.items[j - 1], ""))
                    stack.cut(j)
                continue
            if name in ENDS_P:
                stack.end_paragraph()
            if name in ENDS_OWN:
                stack.end_own(*ENDS_OWN[name])
            k = len(self.tag)
            self.tag.append(name)
            self.up.append(stack.items[-1])
            self.dropped.append(name in DROP or bool(m[3]) and self._unwanted(name, m[3]))
            if name not in INLINE:
                self.runs.append((k, ""))
            elif name == "br":
                self.runs.append((stack.items[-1], " "))
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
                stack.push(k, name)
            elif name not in VOID and (name not in INLINE or not (m[3] or "").rstrip().endswith("/")):
                stack.push(k, name)  # a slash doesn't close an element that has content
        if at < len(html):
            self.runs.append((stack.items[-1], html[at:]))
        self.holds_article = [False] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            if self.holds_article[k] or self.tag[k] in ("article", "main"):
                self.holds_article[self.up[k]] = True

    @staticmethod
    def _unwanted(name: str, attributes: str) -> bool:
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = (m[2] or "").strip("\"'").lower()
            if key in ("class", "id") and name not in ("html", "body", "article", "main") and not DROP_WORDS.isdisjoint(_NAME.findall(value)):
                return True
            if key == "role" and value in DROP_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and ("display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")):
                return True
        return False


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, joined by one line feed; empty for null, empty and textless pages.

    Character references are decoded, white space in a block is one space. ``br`` is white space. Ties of two containers
    go to the one that begins first.
    """
    if not html:
        return ""
    tree = _Tree(html)
    n = len(tree.tag)
    tag, up = tree.tag, tree.up
    gone = [False] * n
    for k in range(1, n):
        own = tree.dropped[k] and not (tree.holds_article[k] and tag[k] not in DROP)
        gone[k] = own or gone[up[k]]
    # Text and link text of every element, and points of paragraphs for their ancestors.
    linked = [False] * n
    paragraph, block_of = [0] * n, [0] * n
    for k in range(1, n):
        linked[k] = tag[k] == "a" or linked[up[k]]
        block_of[k] = block_of[up[k]] if tag[k] in INLINE else k
        paragraph[k] = k if tag[k] in PARAGRAPHS else paragraph[up[k]] if tag[k] in INLINE else 0
    chars, links, anchors = [0] * n, [0] * n, [0] * n
    length, commas = [0] * n, [0] * n
    direct: dict[int, list[int]] = {}
    for k, run in tree.runs:
        if not run or gone[k]:
            continue
        size = len(run) if " " not in run[:1] else len(run.strip())
        if run.isspace():
            continue
        chars[k] += size
        if linked[k]:
            links[k] += size
        block, p = block_of[k], paragraph[k]
        if p and p != block and tag[block] in PARAGRAPHS:
            p = block
        at = p or block
        length[at] += size
        commas[at] += run.count(",") + run.count("،") + run.count("、")
        direct.setdefault(at, [])
    for k in range(1, n):
        if tag[k] == "a" and not gone[k]:
            anchors[k] += 1
    points: dict[int, float] = {}
    for at in sorted(direct):
        score = min(length[at] / 100, 3.0) + commas[at] + (1.0 if length[at] >= 25 else 0.1)
        holder = up[at] if tag[at] in PARAGRAPHS and at else at
        for share in (1.0, 0.5, 1 / 3, 0.25):
            if holder < 0:
                break
            points[holder] = points.get(holder, 0.0) + score * share
            holder = up[holder]
    for k in range(n - 1, 0, -1):
        chars[up[k]] += chars[k]
        links[up[k]] += links[k]
        anchors[up[k]] += anchors[k]
    if not points:
        return ""
    density = lambda k: links[k] / chars[k] if chars[k] else 0.0
    for k in points:
        points[k] = (points[k] + (WEIGHT.get(tag[k], 0.0) if chars[k] else 0.0)) * (1.0 - density(k))
    best = max(points, key=lambda k: (points[k], -k))
    climb = best
    while climb > 0:
        climb = up[climb]
        if tag[climb] in ("article", "main") and not gone[climb]:
            best = climb
            if tag[climb] == "article":
                break
    keep = [False] * n
    keep[best] = True
    around = up[best]
    if best > 0 and tag[best] != "main":
        for k in range(best + 1 if around < 0 else around + 1, n):
            if up[k] != around or k == best or gone[k] or not chars[k]:
                continue
            if points.get(k, 0.0) >= 0.2 * points.get(best, 0.0) or tag[k] == "p" and (length[k] > 80 and density(k) < 0.25 or length[k] and not links[k] and commas[k]):
                keep[k] = True
    inside = [False] * n
    for k in range(n):
        list_of_links = tag[k] in ("ul", "ol", "dl", "table") and anchors[k] >= 3 and density(k) > 0.8
        inside[k] = (keep[k] or k > 0 and inside[up[k]]) and not gone[k] and not list_of_links
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            words = unescape("".join(now)).split()
            if words:
                blocks.append(" ".join(words))
            now.clear()

    for k, run in tree.runs:
        if not run:
            end()
        elif inside[k]:
            now.append(run)
        elif now and not gone[k]:
            end()
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: its id columns, text and n_chars (code points).

    A null page has an empty text. Repeated rows and null ids stay; an empty table gives an empty result; other columns
    aren't read.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for a in range(0, len(batch), 500):
                texts = [main_text(x.as_py()) for x in html[a : a + 500]]
                own = [c.slice(a, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*map(str, range(len(own))), "text", "n_chars"])

    return pages.select(*(F.col(f"`{c}`") for c in id_cols), F.col(f"`{html_col}`").alias("h")).mapInArrow(run, f"{kinds}, text string, n_chars long")
