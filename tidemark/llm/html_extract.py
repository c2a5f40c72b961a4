"""HTML main text by tag-path ratios.

A page is read as a stream of tags; every block of text has its tag path, the
names from the root down (an element whose class, id or role tells of menus,
adverts, comments and the like is another name than one that does not).  For
each path, text length, punctuation and link text are summed over its blocks.
The three ratios per block are smoothed along the blocks of one element (a
short paragraph among long ones is content; a heading counts as what it
heads), then fused: length, punctuation, the share outside links, and a factor
for what the path's names say.  Paths whose mean reaches a share of the page's
mean are content.  The article is the element in which content outweighs the
rest most; its blocks are the text, but for paths inside it that are no
content by their names or their links.

What HTML itself marks as no article (nav, aside, footer, hidden, a page's
header, controls, and forms that hold no article) is left out before paths are
summed; nothing else is.

Each page is handled alone; time and memory grow with its length: a path is a
number, made of its parent's and a name, the elements open are found by name,
and an element's text is an interval of blocks.  Defined results: null or empty
html gives an empty text; null ids and urls are kept; repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty table;
of elements that tie the inner one is taken; damaged markup is read as far as
it goes, as browsers do.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, read

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select title audio video noframes".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup header footer nav aside form fieldset hr center dir menu search dialog head".split()
)
#: A start tag of these ends an open p.
ENDS_P = BLOCK - frozenset("html body head td th tr thead tbody tfoot caption".split())
NO_ARTICLE = frozenset("nav aside footer menu dialog head button fieldset search label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind is ended by a start tag of the second, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id or role that mark what is no article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies pagination pager widget widgets skip disclaimer copyright legal complementary contentinfo search outbrain taboola paywall dialog adbox adslot adunit adspace adbanner adwrapper cookiebar cookiebanner cookienotice commentbox commentform commentsection".split()
)
#: Words that deny the ones beside them: "no-sidebar" is no sidebar.
DENIALS = frozenset("no not non with without has free".split())
#: Classes and ids of an element whose headers are an article's, and words that make them a page's again.
ARTICLE_WORDS = frozenset("article post entry story content".split())
PAGE_WORDS = frozenset("page site wrapper wrap container outer sidebar".split())
#: Classes and ids of a page's header, outside an article.
PAGE_HEADERS = frozenset("header site-header main-header top-header global-header siteheader".split())
KEEPERS = frozenset({"article", "main"})
ROLES = frozenset("banner navigation complementary contentinfo search dialog alert".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…¿¡、。，！？]")
#: What names in a path are worth, in the fused ratio: marked as no article, inside article or main.
MARKED, KEPT = 1e-3, 8.0
#: A path is content from this share of the page's mean on.
THRESHOLD = 0.5
#: Weights of a block's neighbours in its element, by distance.
SMOOTHING = tuple(math.exp(-(d * d) / 2) for d in range(3))


def _words(value: str) -> list[set[str]]:
    """The words of each class or id."""
    return [{w.lower() for w in WORD.findall(x)} for x in value.split()]


def _marked_article(attributes: str) -> bool:
    values = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    return any(w & ARTICLE_WORDS and not w & (PAGE_WORDS | BOILERPLATE) for v in values for w in _words(v))


def _left_out(name: str, attributes: str, inside_keeper: bool) -> bool:
    """Whether HTML itself says that the element is no article, or not shown."""
    if name in NO_ARTICLE or name == "header" and not inside_keeper:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marked(name: str, attributes: str, inside_keeper: bool) -> bool:
    """Whether class, id or role tell of something other than the article."""
    if not attributes or name in KEEPERS or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key not in ("class", "id", "role") or key == "id" and name in HEADINGS:
            continue  # a heading's id is made of its text
        if any(w & BOILERPLATE and not w & DENIALS for w in _words(value)):
            return True
        if not inside_keeper and key != "role" and PAGE_HEADERS & set(value.lower().split()):
            return True
    return False


class Page:
    """A page's elements, numbered as they start, and its blocks of text outside what is left out.

    Elements are parallel lists: ``parent``, ``name``, ``path``, ``marks`` (how
    many marked elements it lies in, itself included) and ``kept`` (inside
    article or main, or what is named like one).  Blocks are too: ``node``,
    ``text`` and ``links`` (how many of its characters are link text).
    """

    def __init__(self, page: str) -> None:
        self.parent, self.name, self.path, self.marks, self.kept = [-1], [""], [0], [0], [False]
        self.node: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.paths: dict[tuple[int, str, bool], int] = {}
        self._parse(page)

    def _parse(self, page: str) -> None:
        stack = [0]
        places: dict[str, list[int]] = {}  # of each open element's name, in the stack
        block_places = [0]
        flags = [(False, False)]  # for each open element: left out, link
        forms: dict[int, bool] = {}  # outermost forms: whether they hold an article
        form_of = [-1]  # for each open element its outermost form
        parts: list[str] = []
        block_form: list[int] = []
        open_node, link_chars, open_form = -1, 0, -1

        def flush() -> None:
            nonlocal open_node, link_chars, parts
            if open_node >= 0:
                text = " ".join("".join(parts).split())
                if text:
                    self.node.append(open_node)
                    self.text.append(text)
                    self.links.append(min(link_chars, len(text)))
                    block_form.append(open_form)
                open_node, link_chars, parts = -1, 0, []

        def add(raw: str) -> None:
            nonlocal open_node, link_chars, open_form
            out, link = flags[-1]
            if out or not raw:
                return
            text = entities.unescape(raw) if "&" in raw else raw
            if open_node < 0:
                if not text.strip():
                    return
                open_node, open_form = stack[block_places[-1]], form_of[-1]
            parts.append(text)
            if link:
                link_chars += len(text.strip())

        def close(k: int) -> None:
            if block_places[-1] >= k:
                flush()
            for node in stack[k:]:
                places[self.name[node]].pop()
            while block_places[-1] >= k:
                block_places.pop()
            del stack[k:], flags[k:], form_of[k:]

        last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=-1)
        at, n = 0, len(page)
        while at < n:
            m = MARKUP.search(page, at)
            if m is None:
                add(page[at:])
                break
            add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                k = last((name,))
                # an inline end tag does not reach out of its block
                if k > 0 and (name in BLOCK or k > block_places[-1]):
                    close(k)
                elif name in BLOCK:
                    flush()
                continue
            if name in RAW:
                if not m[0].endswith("/>"):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if name in ENDS_P and (k := last(("p",))) > 0 and k == block_places[-1]:
                close(k)
            if name in IMPLIED:
                ended, boundary = IMPLIED[name]
                while (k := last(ended)) > last(boundary):
                    close(k)
                    if name != "tr":
                        break
            if name in BLOCK:
                flush()
            if name in VOID:
                if name == "br" and open_node >= 0:
                    add(" ")
                continue
            top, (out, link) = stack[-1], flags[-1]
            inside = self.kept[top]
            marked = _marked(name, m[3], inside)
            number = len(self.parent)
            out = out or _left_out(name, m[3], inside)
            form = form_of[-1]
            if form < 0 and name == "form":
                form = number
                forms[form] = False
            if form >= 0 and not out and (name in KEEPERS or name == "h1"):
                forms[form] = True
            self.parent.append(top)
            self.name.append(name)
            self.path.append(self.paths.setdefault((self.path[top], name, marked), len(self.paths) + 1))
            self.marks.append(self.marks[top] + marked)
            self.kept.append(inside or name in KEEPERS or _marked_article(m[3]))
            if not (m[3].endswith("/") and name not in BLOCK):
                places.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    block_places.append(len(stack))
                stack.append(number)
                flags.append((out, link or name == "a"))
                form_of.append(form)
        flush()
        if forms:
            stay = [k for k, f in enumerate(block_form) if f < 0 or forms[f]]
            for values in (self.node, self.text, self.links):
                values[:] = [values[k] for k in stay]

    def path_names(self, path: int) -> str:
        """The names of a path, for people."""
        by_number = {v: k for k, v in self.paths.items()}
        out = []
        while path:
            path, name, marked = by_number[path]
            out.append(name + "!" * marked)
        return "/".join(reversed(out))

    def path_sums(self) -> dict[int, tuple[int, int, int, int]]:
        """For each path: blocks, characters, punctuation, characters in links."""
        sums: dict[int, list[int]] = {}
        for node, text, links in zip(self.node, self.text, self.links, strict=True):
            s = sums.setdefault(self.path[node], [0, 0, 0, 0])
            for k, x in enumerate((1, len(text), len(PUNCTUATION.findall(text)), links)):
                s[k] += x
        return {p: tuple(s) for p, s in sums.items()}

    def smoothed(self, series: list[float]) -> list[float]:
        """Each block's mean with its neighbours among the blocks of one element."""
        by_parent: dict[int, list[int]] = {}
        for k, node in enumerate(self.node):
            by_parent.setdefault(self.parent[node], []).append(k)
        out = [0.0] * len(series)
        for ks in by_parent.values():
            for i, k in enumerate(ks):
                near = [(SMOOTHING[abs(j - i)], series[ks[j]]) for j in range(max(0, i - 2), min(len(ks), i + 3))]
                out[k] = sum(w * x for w, x in near) / sum(w for w, _ in near)
        return out

    def ratios(self, by_name: bool = True) -> list[float]:
        """Each block's fused ratio."""
        sums = self.path_sums()
        own = [sums[self.path[node]] for node in self.node]
        # a heading counts as the next block that is none
        for k in range(len(own) - 2, -1, -1):
            if self.name[self.node[k]] in HEADINGS and self.marks[self.node[k]] == self.marks[self.node[k + 1]]:
                own[k] = own[k + 1]
        length = self.smoothed([chars / n for n, chars, _, _ in own])
        punctuation = self.smoothed([p / n for n, _, p, _ in own])
        links = self.smoothed([x / chars for _, chars, _, x in own])
        out = [c * math.sqrt(1 + p) * (1 - x) ** 2 for c, p, x in zip(length, punctuation, links, strict=True)]
        if by_name:
            out = [r * (MARKED if self.marks[k] else 1.0) * (KEPT if self.kept[k] else 1.0) for r, k in zip(out, self.node, strict=True)]
        return out


def content_paths(page: Page, ratios: list[float], weights: list[float], threshold: float = THRESHOLD) -> set[int]:
    """Paths whose blocks' mean ratio reaches a share of the page's mean, by characters and ``weights``."""
    shares = [len(t) * w for t, w in zip(page.text, weights, strict=True)]
    level = threshold * sum(r * x for r, x in zip(ratios, shares, strict=True)) / sum(shares)
    by_path: dict[int, list[float]] = {}
    for node, r in zip(page.node, ratios, strict=True):
        by_path.setdefault(page.path[node], []).append(r)
    return {p for p, rs in by_path.items() if sum(rs) / len(rs) >= level}


def extract(html: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    if not page.text:
        return ""
    name = lambda k: page.name[page.node[k]]
    blocks = range(len(page.text))
    chars = [len(t) for t in page.text]
    # a whole article may lie in an element with a misleading name; its title tells it from an advert
    plain = [k for k in blocks if not page.marks[page.node[k]]]
    titled = any(name(k) == "h1" for k in blocks)
    if not plain and not titled:
        return ""
    by_name = bool(plain) and (any(name(k) == "h1" for k in plain) or not titled or 5 * sum(chars[k] for k in plain) >= sum(chars))
    ratios = page.ratios(by_name)
    weights = [MARKED if by_name and page.marks[node] else 1.0 for node in page.node]
    content = content_paths(page, ratios, weights, threshold)
    chosen = [page.path[node] in content for node in page.node]

    # what content outweighs the rest by, summed over each element; elements are numbered from the outside in
    gain = [0.0] * len(page.parent)
    for k in blocks:
        gain[page.node[k]] += chars[k] if chosen[k] else -chars[k]
    end = list(range(1, len(page.parent) + 1))
    for node in range(len(page.parent) - 1, 0, -1):
        gain[page.parent[node]] += gain[node]
        end[page.parent[node]] = max(end[page.parent[node]], end[node])
    root = max(range(len(gain)), key=lambda node: (gain[node], node))
    while page.name[root] not in ("div", "section", "article", "main", "body", "html", "") and page.parent[root] > 0 and page.name[root] in BLOCK and page.name[page.parent[root]] not in ("body", "html"):
        root = page.parent[root]  # a single long block, row or list: its neighbours belong to it
    if page.name[root] in ("p", "li", "td", "blockquote", "pre", *HEADINGS):
        root = max(0, page.parent[root])

    def stays(k: int) -> bool:
        node = page.node[k]
        if chosen[k]:
            return True
        if by_name and page.marks[node] > page.marks[root]:
            return False
        if page.kept[node]:
            return True
        menu = page.links[k] >= 0.8 * chars[k] and name(k) in ("li", "div", "section", "td", "dd", "ul")
        return not menu and name(k) not in ("div", "section", "body", "html", "")

    return "\n".join(page.text[k] for k in blocks if root <= page.node[k] < end[root] and stays(k))


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text) for each row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x.as_py(), threshold) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["page_id", "url", "text"])

    src = pick(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return src.mapInArrow(run, "page_id long, url string, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    df = extract_pages(read(spark, sf_dir, "pages"))
    return df.withColumn("n_chars", F.char_length("text").cast("long"))
