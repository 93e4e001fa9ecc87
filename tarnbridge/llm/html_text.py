"""Op 10: main text of web pages by composite text density.

A page is parsed into a tree. Scripts, controls and the like are left out. Elements that are
boilerplate by their nature (menus, page headers and footers, sidebars, notices, adverts, forms,
comments and the like, by tag, role, or whole words of class or id) are left out, too, unless they
hold the main element, the page's only article, or, where no such element is left otherwise, most
of the page's characters outside links. Inside an article, blocks of prose stay whose names may be those of a story, too (related, share). Every other node gets its composite text density, characters per tag
adjusted for the share of links. The least density on the path from the body to the node whose
children's densities sum to the most is the threshold. From the body down, every subtree at or
above it counts, by its node of the greatest sum. What lies between two such siblings, headings
before them and the paragraphs and lists around an article split over several belong to them.
Where the greatest node lies in an article or main element, these elements are taken whole and what
lies outside of them is left out. Link-dominated subtrees below the threshold go.

Text blocks are joined by two newlines, white space inside a block is one space, and character
references are decoded. A null or empty page has the empty text; nothing else is dropped or cut.
Pages of any length and depth are taken whole, in time that grows with their length; between nodes
whose sums tie the first in the page counts; repeated rows are extracted each on its own; only
page_id, url and html are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.sources.tables import spread

from .common import table

#: Element names and name parts with a meaning in HTML or in common use on pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset(
    "head title script style noscript template button select textarea input label option datalist iframe object embed applet svg math "
    "canvas audio video map noembed noframes xmp".split()
)
#: Boilerplate, unless the page's text is in it.
DOUBTFUL = frozenset("nav footer aside form menu search dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars rail nav navbar "
    "navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond replies reply widget widgets".split()
)
#: Names that, inside an article, blocks of prose have, too.
PROSE_NAMES = frozenset("notice notices promo promotion recommendations recommended related reply replies share sharing social".split())
#: Characters outside links from which such a block is prose, where links don't have most of it.
PROSE = 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
HEADER_NAMES = frozenset(("header",))
#: Elements of running text: an id with a number there is the key of a passage, not the kind of a block.
PASSAGES = HEADINGS | frozenset("p blockquote pre li dt dd td th figcaption a abbr b cite code em i mark q s small span strong sub sup u".split())
#: Parts that a word of a class or id may have beside a listed one: cookie-notice and sidebar-left are listed, has-sidebar is not.
NEUTRAL_PARTS = frozenset("area block body bottom box button container form global inner item items left link links list main outer page right section site text title top wrap wrapper".split())

#: An attribute: a quotation mark opens a value right after the sign of equality only.
_PAIR = r"""(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PAIR})*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_NAME = re.compile(r"[a-z]+")


def _listed(value: str, names: frozenset) -> bool:
    """Whether a word of a class or id consists of listed names and neutral parts."""
    for word in value.split():
        parts = set(_NAME.findall(word))
        if parts & names and not parts - names - NEUTRAL_PARTS:
            return True
    return False


def _doubtful(tag: str, attributes: str, in_article: bool, names: frozenset = DROPPED_NAMES) -> bool:
    if tag in DOUBTFUL or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or DROPPED_ROLES.intersection(found.get("role", "").split()):
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = names if in_article else names | HEADER_NAMES
    own_id = "" if tag in PASSAGES and (in_article or any(c.isdigit() for c in found.get("id", ""))) else found.get("id", "")
    return _listed(found.get("class", ""), names) or _listed(own_id, names)


class Page:
    """Nodes in page order: tag and parent of each, and the pieces of text with their nodes."""

    def __init__(self, source: str):
        self.tags, self.parents, self.pieces = ["#root"], [-1], []
        self.doubtful: set[int] = set()
        self.perhaps: set[int] = set()  # doubtful by a name that prose in an article has, too
        stack, dropped_at, at, end = [0], 0, 0, len(source)
        depths: dict[str, list[int]] = {}  # of the open elements of each name
        endless: set[str] = set()  # names without an end tag from here on
        last = source.rfind(">")

        def close(depth: int) -> None:
            nonlocal dropped_at
            while len(stack) > depth:
                depths[self.tags[stack.pop()]].pop()
            dropped_at = dropped_at if len(stack) > dropped_at else 0

        def implied(tags: tuple, scope: tuple) -> None:
            """An open element that the next one ends, unless another element holds it."""
            deepest = lambda names: max((depths[t][-1] for t in names if depths.get(t)), default=0)
            depth = deepest(tags)
            if depth > deepest(scope):
                close(depth)

        while at < end:
            m = _TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if m is None:
                if not dropped_at:
                    self.pieces.append((stack[-1], source[at:]))
                break
            if m.start() > at and not dropped_at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if depths.get(tag):
                    close(depths[tag][-1])
                continue
            if tag in CLOSES_P:
                implied(("p",), ("table", "td", "th", "button", "div", "section", "article"))
            if tag in SAME:
                implied(SAME[tag], SCOPE[tag])
            self.tags.append(tag)
            self.parents.append(stack[-1])
            if not dropped_at and (tag == "br" or tag in BLOCK):  # a line break is white space; a block ends the text before it
                self.pieces.append((stack[-1], "\n") if tag == "br" else (len(self.tags) - 1, ""))
            if tag in VOID:
                continue
            if tag in RAW:
                found = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                if found is None:
                    endless.add(tag)
                at = found.end() if found else (end if tag in ("script", "style") else at)
                continue
            stack.append(len(self.tags) - 1)
            depths.setdefault(tag, []).append(len(stack) - 1)
            if dropped_at:
                continue
            in_article = bool(depths.get("article") or depths.get("main"))
            if tag in DROPPED:
                dropped_at = len(stack) - 1
            elif _doubtful(tag, m[3] or m[6] or "", in_article):
                self.doubtful.add(stack[-1])
                if in_article and not _doubtful(tag, m[3] or m[6] or "", in_article, DROPPED_NAMES - PROSE_NAMES):
                    self.perhaps.add(stack[-1])
        if self.doubtful:
            self._settle()

    def _settle(self) -> None:
        """Takes out the text of doubtful elements, but for those that hold the page's text."""
        n = len(self.tags)
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tags[i] == "a" or in_link[self.parents[i]]
        chars = [0] * n
        plain = [0] * n
        for node, text in self.pieces:
            c = len(" ".join(text.split()))
            chars[node] += c
            plain[node] += 0 if in_link[node] else c
        mains, articles = [0] * n, [0] * n  # below a node, not the node itself
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            chars[p] += chars[i]
            plain[p] += plain[i]
            counts = chars[i] and i not in self.doubtful
            mains[p] += mains[i] + (counts and self.tags[i] == "main")
            articles[p] += articles[i] + (counts and self.tags[i] == "article")
        self.doubtful -= {i for i in self.perhaps if plain[i] >= PROSE and 2 * plain[i] > chars[i]}
        holds = {i for i in self.doubtful if mains[i] or (articles[i] and articles[0] == 1 and not mains[0])}
        gone = self._below(self.doubtful - holds)
        if not any(chars[i] and not gone[i] for i, t in enumerate(self.tags) if t in ("article", "main")):
            holds |= {i for i in self.doubtful if 2 * plain[i] > plain[0]}
            gone = self._below(self.doubtful - holds)
        # a block that is left out still ends the text before it
        self.pieces = [(node, text) if not gone[node] else (node, "") for node, text in self.pieces]

    def _below(self, tops: set[int]) -> list[bool]:
        inside = [False] * len(self.tags)
        for i in range(1, len(inside)):
            inside[i] = i in tops or inside[self.parents[i]]
        return inside


def densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """Per node: composite text density, sum of its children's, characters and link characters."""
    n = len(page.tags)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tags[i] == "a" or in_link[page.parents[i]]
    for node, text in page.pieces:
        c = len(" ".join(text.split()))
        chars[node] += c
        links[node] += c if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tags[i] == "a")
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    share = links[body] / chars[body] if chars[body] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, links[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - links[i]) * lc + share * c + math.e)
            density[i] = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt) if links[i] else c * t) / math.log(base))
        if i:
            sums[page.parents[i]] += density[i]
    return density, sums, chars, links


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = Page(source)
    if not any(text.strip() for _, text in page.pieces):
        return ""
    density, sums, chars, links = densities(page)
    inner = [i for i, t in enumerate(page.tags) if chars[i] and t not in ("#root", "html")]
    best = max(inner, key=lambda i: (sums[i], -i), default=0)
    if best and not sums[best]:
        best = max(inner, key=lambda i: (density[i], -i))
    path = [best]
    while page.parents[path[-1]] >= 0 and page.tags[path[-1]] != "body":
        path.append(page.parents[path[-1]])
    threshold = min(density[i] for i in path)
    linked = [2 * links[i] > chars[i] and density[i] < threshold for i in range(len(page.tags))]
    roots = _roots(page, path[-1], best, threshold, density, sums, chars, linked)
    inside = [False] * len(page.tags)
    for i in range(len(page.tags)):
        pruned = linked[i] and page.tags[i] in ("ul", "ol", "div", "section", "table", "dl")
        inside[i] = i in roots or (i > 0 and inside[page.parents[i]] and not pruned)
    return _blocks(page, inside)


def _roots(page: Page, top: int, best: int, threshold: float, density: list[float], sums: list[float], chars: list[int], linked: list[bool]) -> set[int]:
    """The nodes whose subtrees are the main text."""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    whole = [-1] * n  # the article or main element that a node lies in
    for i in range(1, n):
        whole[i] = i if tags[i] in ("article", "main") else whole[parents[i]]
    greatest = list(range(n))  # of each subtree: the node with the greatest sum
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if sums[greatest[i]] >= sums[greatest[p]] and sums[greatest[i]] > sums[p]:
            greatest[p] = greatest[i]
    walked = [False] * n
    for i in range(top, n):
        walked[i] = i == top or (walked[parents[i]] and chars[i] > 0 and density[i] >= threshold)
    found = {best} | {greatest[i] for i in range(top + 1, n) if walked[i]}
    if whole[best] >= 0:
        return {whole[i] for i in found if whole[i] >= 0}
    found = {i if whole[i] < 0 else whole[i] for i in found}
    home = [0] * n  # a single paragraph inside a block, or inline markup: the block is meant
    for i in range(1, n):
        home[i] = i if tags[i] in BLOCK or whole[i] == i else home[parents[i]]
    roots = {home[i] for i in found}
    children: dict[int, list[int]] = {}
    kept = {parents[i] for i in roots}
    for i in range(1, n):
        if parents[i] in kept:
            children.setdefault(parents[i], []).append(i)
    for parent, nodes in children.items():
        at = [k for k, i in enumerate(nodes) if i in roots]
        titles = [k for k, i in enumerate(nodes[: at[0]]) if tags[i] in HEADINGS]
        start = min(titles + at[:1])
        split = len(at) > 1 and tags[parent] not in ("body", "#root")
        for k, i in enumerate(nodes):
            if not linked[i] and (start <= k <= at[-1] or (split and tags[i] in FLOW)):
                roots.add(i)
    return roots


def _blocks(page: Page, inside: list[bool]) -> str:
    home = [0] * len(page.tags)
    for i in range(1, len(home)):
        home[i] = i if page.tags[i] in BLOCK else home[page.parents[i]]
    out: list[str] = []
    run: list[str] = []
    last = -1
    for node, text in page.pieces:
        if not inside[node]:
            continue
        if home[node] != last and run:
            out.append("".join(run))
            run = []
        last = home[node]
        run.append(html.unescape(text))
    if run:
        out.append("".join(run))
    cleaned = (" ".join(x.split()) for x in out)
    return "\n\n".join(x for x in cleaned if x)


def extract_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """The columns page_id and url with text and n_chars (code points) of each page's article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return spread(pages.select("page_id", "url", F.col(source).alias("html"))).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
