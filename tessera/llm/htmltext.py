"""Main text of web pages by minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

# HTML elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style template head title iframe object embed svg math audio video canvas map noscript noframes datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu button select textarea dialog search fieldset label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end where one of the same kind begins, unless a list or table lies between.
ENDED_BY = {
    "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"}, "optgroup": {"optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
#: Words in a class, an id or a role: those that name boilerplate, those that often do, those that name content.
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promoted promotion cookie cookies consent gdpr "
    "popup newsletter subscribe subscription signup share sharing social comment comments commentlist respond disqus sidebar widget widgets related recommended "
    "recommendations menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar copyright searchform tagcloud pagination pager paging "
    "complementary contentinfo outbrain taboola".split()
)
DOUBTFUL = frozenset("notice notices alert alerts modal overlay follow reply replies discussion side popular trending header legal disclaimer login search tags skip print hidden dialog form".split())
GOOD = frozenset("article articlebody body content entry main maincontent post postbody prose story text".split())
#: What follows one of these in a name says what the page has or lacks, not what the element is.
HAS = frozenset("has no with without layout is".split())

#: Log odds of content. Names and tags count against a block; what it says and where it stands can outvote them, but for
#: the clearest. A block of the page's main article or main element, of another one, outside of them; in the part of the
#: page that most of the likely text is in, or not.
STRUCTURE = {
    "primary": 2.5, "article": 0.5, "outside": -2.0, "good name": 1.0, "bad name": -8.0, "doubtful name": -3.5, "chrome": -8.0, "header": -0.5, "heading": 0.6, "in root": 1.0, "beside root": -2.5,
}
#: An element with so much of the words around it is what the page is about, whatever it is called.
WHOLE, MOST = 0.9, 0.6
#: Features of a block's text: one (a short text without any sign), the logarithm of its words, whether it ends as a
#: sentence does, the share of it in links. PRIOR is the mean of their weights before any example, with variance 1; each
#: class of examples counts as at most EVIDENCE of them. What a text says weighs MOST_TEXT at most.
PRIOR, EVIDENCE, MOST_TEXT = (-0.4, 0.9, 0.8, -3.5), 100.0, 2.5
#: Smoothness: of blocks side by side (by the square of their distance in the tree), and of neighbours under one parent.
ADJACENT, SIBLING = 3.2, 0.5
SPLIT = re.compile(r"[^a-z]+")


def _words_of_names(attrs) -> set[str]:
    out = set()
    for key in ("class", "id", "role"):
        for name in (attrs.get(key) or "").split():
            words = [w for w in SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            has = next((i for i, w in enumerate(words) if w in HAS), None)
            out.update(words[:has])
    return out


class _Element:
    __slots__ = ("tag", "parent", "depth", "names", "unseen", "serial", "words", "signs")

    def __init__(self, tag, attrs, parent, serial):
        self.tag, self.parent, self.serial, self.names = tag, parent, serial, _words_of_names(attrs)
        self.depth = parent.depth + 1 if parent else 0
        self.words, self.signs = 0.0, frozenset()
        style = re.sub(r"\s", "", attrs.get("style") or "").lower()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.unseen = tag in UNSEEN or hidden or bool(parent and parent.unseen)


#: What ``<`` begins; anything else after it is text.
MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?]|/(?=[^a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=]+)|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
#: Elements whose content is no markup, up to their own end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "iframe", "noframes", "noembed", "xmp", "title", "textarea")}
#: References of more digits than a code point has; Python refuses to read very long ones.
ZEROS, HUGE = re.compile(r"&#([xX]?)0{7,}"), re.compile(r"&#(?:[1-9]\d{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = HUGE.sub("\ufffd", ZEROS.sub(r"&#\g<1>0", text))
    return html.unescape(text)


class _Page:
    """Blocks of text of a page: ``(element, text, characters in links)``. Any input is a page; nothing is cut off.

    An unclosed comment, script or style reaches to the end, as in browsers; a marked section is text if it is CDATA and
    nothing if not; a ``<`` that begins no markup is text. Time is linear in the page: quotes that never close are looked
    for once, and open elements are found by name, not by walking the stack."""

    def __init__(self):
        self.open = [_Element("html", {}, None, 0)]
        self.all = [self.open[0]]
        self.at: dict[str, list[int]] = {"html": [0]}  # where elements of a name are open
        self.open_blocks, self.endless = [0], set()
        self.made, self.links, self.blocks, self.pieces, self.linked = 0, 0, [], [], 0

    def end_block(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append((self.open[self.open_blocks[-1]], text, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def close_to(self, n):
        while len(self.open) > n:
            tag = self.open.pop().tag
            self.at[tag].pop()
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.open_blocks.pop()

    def begin(self, tag, attrs):
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in BLOCKS:
            self.end_block()
            while len(self.open_blocks) > 1 and tag in ENDED_BY.get(self.open[self.open_blocks[-1]].tag, ()):
                self.close_to(self.open_blocks[-1])
        if tag in VOID:
            return
        self.made += 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.open_blocks.append(len(self.open))
        self.open.append(_Element(tag, attrs, self.open[-1], self.made))
        self.all.append(self.open[-1])
        self.links += tag == "a"

    def end(self, tag):
        if tag in BLOCKS:
            self.end_block()
        found = self.at.get(tag)
        # A stray inline end does not close blocks; nothing closes the page.
        if found and found[-1] and (tag in BLOCKS or found[-1] > self.open_blocks[-1]):
            self.close_to(found[-1])

    def text(self, data):
        if data and not self.open[-1].unseen:
            self.pieces.append(data)
            if self.links:
                self.linked += len("".join(data.split()))

    def read(self, page: str) -> list[tuple[_Element, str, int]]:
        at, done, size = 0, 0, len(page)
        while m := MARKUP.search(page, at):
            comment, cdata, bogus, closing, name = m.groups()
            if m.start() > done:
                self.text(_decoded(page[done : m.start()]))
            if comment:
                short = re.compile(r"-?>").match(page, m.end())
                to = short.end() if short else page.find("-->", m.end()) + 3
                at = to if to > 2 else size
            elif cdata:
                to = page.find("]]>", m.end())
                self.text(page[m.end() : to if to >= 0 else size])
                at = to + 3 if to >= 0 else size
            elif bogus:
                at = page.find(">", m.end()) + 1 or size
            else:
                at = self.tag(page, m.end(), name.lower(), bool(closing))
            done = at
        self.text(_decoded(page[done:]))
        self.end_block()
        self.judge()
        return self.blocks

    def judge(self):
        """The ``signs`` of every element, from its tags and names and those around it, each looked at once."""
        for element, text, linked in self.blocks:
            element.words += len(text.split()) * (1 - linked / max(1, len(text.replace(" ", ""))))
        for e in reversed(self.all[1:]):  # made after their parents
            e.parent.words += e.words
        total = self.all[0].words
        bodies = [e for e in self.all if e.tag in ("article", "main") and not e.names & {"comment", "comments"}]
        most = max((e.words for e in bodies), default=0.0)
        primary = max((e for e in bodies if e.words >= MOST * most), key=lambda e: e.depth, default=None)
        above, e = set(), primary
        while e is not None:
            above.add(e.serial)
            e = e.parent
        for e in self.all:
            up = e.parent.signs if e.parent else frozenset()
            signs = set(up - {"good name"} if e.tag in ("article", "main") else up)
            if e is primary:
                signs = {"primary"}
            elif e.tag in ("article", "main") and "primary" not in signs:
                signs.add("article")
            # What holds the article, or nearly all there is, is no boilerplate for its name or tag.
            whole = e.serial in above or e.tag in ("html", "body") or (e.words >= WHOLE * primary.words if "primary" in up else primary is None and e.words >= WHOLE * total)
            if e.names & GOOD and e.tag != "body":
                signs.add("good name")
            if not whole:
                if e.names & BAD:
                    signs.add("bad name")
                elif e.names & DOUBTFUL:
                    signs.add("header" if e.names & DOUBTFUL == {"header"} and up & {"primary", "good name"} else "doubtful name")
                if e.tag in CHROME:
                    signs.add("chrome")
                if e.tag == "header":
                    signs.add("header" if up & {"primary", "good name"} else "chrome")
            if e.tag in HEADINGS:
                signs.add("heading")
            e.signs = frozenset(signs)

    def tag(self, page: str, at: int, name: str, closing: bool) -> int:
        """Reads the rest of a tag; where what follows begins."""
        attrs = {}
        while not (stop := TAG_END.match(page, at)):
            a = ATTRIBUTE.match(page, at)
            if not a or a.end() == at:  # the page ends within the tag
                return len(page)
            if a[1]:
                attrs.setdefault(a[1].lower(), _decoded(next((v for v in a.groups()[1:] if v is not None), "")))
            at = a.end()
        at = stop.end()
        if closing:
            self.end(name)
            return at
        self.begin(name, attrs)
        if name in VOID:
            return at
        if stop[0][:-1].rstrip().endswith("/") and name not in UNSEEN:  # <x/>: nothing is in it
            self.end(name)
            return at
        if name == "plaintext":
            self.text(page[at:])
            return len(page)
        if name in RAW:
            to = None if name in self.endless else RAW[name].search(page, at)
            if to:
                if name == "xmp":
                    self.text(page[at : to.start()])
                return to.start()
            if name in ("script", "style"):
                return len(page)
            self.endless.add(name)  # no end from here on: the tag is nothing
            self.end(name)
        return at


def features(text: str, linked: int) -> tuple[float, float, float, float]:
    words = len(text.split())
    return 1.0, math.log1p(words / 8), float(text[-1] in ".!?…:;\"'”»)" and words > 3), linked / max(1, len(text.replace(" ", "")))


def by_itself(element: _Element, text: str, linked: int, weights, bodies: bool) -> float:
    """Log odds of a block being content from its tags, names and text; ``bodies``: the page has an article or main."""
    signs = element.signs
    where = "primary" if "primary" in signs else "article" if "article" in signs else "outside" if bodies else None
    against = min((STRUCTURE[x] for x in ("bad name", "doubtful name", "chrome") if x in signs), default=0.0)
    f = (STRUCTURE[where] if where else 0.0) + against + sum(STRUCTURE[x] for x in ("good name", "header", "heading") if x in signs)
    said = sum(w * x for w, x in zip(weights, features(text, linked)))
    return f + max(-MOST_TEXT, min(MOST_TEXT, said))


def costs(page: _Page, weights=PRIOR) -> list[float]:
    """What the cut pays for labelling each block boilerplate (negative: content): its log odds by itself, and whether it is
    in the part of the page with most of the text that is likely content by itself: going down from the page as long as
    one child has MOST of it and several blocks."""
    bodies = any("primary" in e.signs for e, _, _ in page.blocks)
    own = [by_itself(*b, weights, bodies) for b in page.blocks]
    mass, held = [0.0] * len(page.all), [0] * len(page.all)
    place = {e.serial: i for i, e in enumerate(page.all)}
    for (e, text, _), f in zip(page.blocks, own):
        mass[place[e.serial]] += len(text.split()) / (1 + math.exp(-f))
        held[place[e.serial]] += 1
    for i in range(len(page.all) - 1, 0, -1):
        up = place[page.all[i].parent.serial]
        mass[up] += mass[i]
        held[up] += held[i]
    heaviest: dict[int, int] = {}
    for i, e in enumerate(page.all[1:], 1):
        up = e.parent.serial
        if up not in heaviest or mass[i] > mass[heaviest[up]]:
            heaviest[up] = i
    root = 0
    while (down := heaviest.get(page.all[root].serial)) is not None and mass[down] >= MOST * mass[root] > 0 and held[down] > 1:
        root = down
    inside = [root == 0]
    for i, e in enumerate(page.all[1:], 1):
        inside.append(i == root or inside[place[e.parent.serial]])
    return [f + STRUCTURE["in root" if inside[place[e.serial]] else "beside root"] for (e, _, _), f in zip(page.blocks, own)]


def ties(page: _Page) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks; none where a tag sets one of the two apart."""
    edges, last = [], {}
    for i, (element, _, _) in enumerate(page.blocks):
        if i and ("chrome" in element.signs) == ("chrome" in page.blocks[i - 1][0].signs):
            edges.append((i - 1, i, ADJACENT / max(1, distance(page.blocks[i - 1][0], element)) ** 2))
        parent = (element.parent or element).serial, "chrome" in element.signs
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def example(element: _Element) -> int | None:
    """1 or 0 where the tags alone tell that a block is content or not; names don't."""
    if "chrome" in element.signs:
        return 0
    return 1 if "primary" in element.signs and not element.signs & {"bad name", "doubtful name"} else None


def fit(cells: list[tuple[int, float, float, float, int]], rounds: int = 25) -> tuple[float, ...]:
    """Weights of the text features: the most likely logistic regression of examples ``(label, *features without the one,
    count)`` under the prior, by Newton's steps."""
    w = np.array(PRIOR)
    if not cells:
        return PRIOR
    y, n = np.array([c[0] for c in cells]), np.array([c[4] for c in cells], float)
    x = np.array([(1.0, *c[1:4]) for c in cells])
    for label in (0, 1):
        n[y == label] *= min(1.0, EVIDENCE / max(1.0, n[y == label].sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(4), x.T @ (n * (p - y)) + w - np.array(PRIOR))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(pages: DataFrame, most_pages: int) -> tuple[float, ...]:
    """``fit`` on the blocks of about ``most_pages`` rows ``(page_id, url, html)``, those with small hashes of id and url. Features
    are rounded, so what comes to the driver is a table of counts of bounded size."""
    n = pages.count()
    some = pages
    if n > most_pages:
        some = pages.where(F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1) < int(most_pages / n * 2**63))

    def run(batches):
        seen: Counter = Counter()
        for b in small(batches):
            for page in b.column(0).to_pylist():
                for element, text, linked in _Page().read(page or ""):
                    if (label := example(element)) is not None:
                        _, words, stops, links = features(text, linked)
                        seen[label, round(words * 8), int(stops), round(links * 8)] += 1
        cols = list(zip(*[(*k, v) for k, v in seen.items()])) if seen else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["label", "words", "stops", "links", "n"])

    cells = some.select("html").mapInArrow(run, "label long, words long, stops long, links long, n long").groupBy("label", "words", "stops", "links").agg(F.sum("n").alias("n"))
    return fit(sorted((r.label, r.words / 8, float(r.stops), r.links / 8, r.n) for r in cells.collect()))


def distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source (content) in a minimum cut. ``costs``: capacity from the source where positive,
    to the sink where negative; ``edges``: capacities in both directions. Max-flow by shortest layers (Dinic)."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, forward, back):
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((forward, back))

    for i, c in enumerate(costs):
        if c > 0:
            link(source, i, c, 0.0)
        elif c < 0:
            link(i, sink, -c, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for a in queue:
            for e in out[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                back = next(i for i, e in enumerate(path) if left[e] <= 1e-9)
                a = to[path[back] ^ 1]
                del path[back:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def main_blocks(page: str, weights=PRIOR) -> list[str]:
    """Texts of the page's content blocks in page order."""
    read = _Page()
    if not read.read(page):
        return []
    keep = minimum_cut(costs(read, weights), ties(read))
    return [text for (_, text, _), ok in zip(read.blocks, keep) if ok]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_pages: int = 2000) -> DataFrame:
    """``(page_id, url, text, blocks)`` per page: the content blocks, and them joined by one line feed.

    A page's blocks are the runs of text between block elements, character references decoded and white space made
    one space; scripts, styles and what is hidden are none. A linear classifier gives each block a capacity to the
    source (content) or the sink (boilerplate): what the markup around it says, whether it is in the part of the page that
    most of the text is in, and features of its text, whose weights are learnt from blocks of about ``most_pages`` pages
    that the tags label clearly. Blocks side by side and
    neighbours under one parent are tied by capacities that fall with their distance in the tree; the minimum cut labels
    all blocks of the page at once. Null or empty html has no block; no html is malformed. Nothing is dropped for its length. Rows stay rows; other columns are not read.
    """

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    weights = train(given, most_pages)

    def run(batches):
        for b in small(batches):
            found = [main_blocks(h or "", weights) for h in b.column(2).to_pylist()]
            texts = ["\n".join(x).encode("utf-8", "replace").decode() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int32())], ["page_id", "url", "text", "blocks"])

    return given.mapInArrow(run, "page_id long, url string, text string, blocks int")
