"""Main text of web pages by consensus container paths per host."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise
from hourgrid.llm.common import small

#: What begins at a "<": a comment, a declaration, or a tag with its attributes. Attributes end at
#: ">", at the next "<" outside quotes, or with the page; a quote that is never closed is a character.
_TAG = re.compile(r"""<(?:!--(?P<note>)|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>[^<>"']*+(?:(?:"[^"]*"|'[^']*'|["'])[^<>"']*+)*+)>?)""")
#: A slash before ">" that is not the end of an unquoted value.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements without content, elements of raw text, and elements that never belong to a main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
APART = frozenset("nav header footer aside form script style noscript template iframe button select option textarea title head svg canvas object video audio dialog menu xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("body article main section div center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of the least run of text that counts as running text, and the share of it that a best container may leave out.
PROSE_CHARS, LEFT_OUT = 25, 0.05
#: Words in class, id or role that mark what surrounds a main text. An id of a heading or
#: paragraph is an anchor and says nothing.
SIDE_WORDS = re.compile(
    r"^(ads?|adverts?|adverti[sz]ements?|adverti[sz]ing|sponsors?|sponsored|promos?|promotions?|promoted|banners?|navs?|navbar|navmenu|navlinks|menus?|menubar|breadcrumbs?|sidebars?|aside|foot|footers?|header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|recommendations?|trending|widgets?|pagination|pager|comments?|commentlist|disqus|replies|respond|search|complementary|navigation|contentinfo)$"
)
#: Of these, words that mark surroundings whatever is written in them; others, such as related or alert, may
#: name a part of an article if it holds prose.
ALWAYS = re.compile(
    r"^(ads?|adverts?|adverti[sz]ements?|adverti[sz]ing|sponsors?|sponsored|promos?|promotions?|promoted|navs?|navbar|navmenu|navlinks|menus?|menubar|breadcrumbs?|sidebars?|footers?|masthead|topbar|cookies?|consent|gdpr|popup|modal|overlay|subscribe|newsletter|signup|login|pagination|pager|comments?|commentlist|disqus|replies|respond|complementary|navigation|contentinfo)$"
)
#: Words of layout. A name of a side word and any other word, such as related-work, may be a topic.
LAYOUT = frozenset("area article bar block body bottom box button buttons card center col column container content form group icon icons inner item items left link links list main module outer page panel post posts right row section side site text title top view wrap wrapper widget".split())
#: Marks of a node: none, a name that may be a topic, a bare side word, and what is always left out.
TOPIC, WORD, APART_MARK = 1, 2, 3
#: Characters outside links that make an element prose, and the share of these that its links may have.
PROSE_PART, LINK_SHARE = 120, 0.25
#: What a start tag closes before it opens, up to an element that shields.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "option": {"option"}}
SHIELDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
#: A paragraph is closed by these too.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}


#: Where an open paragraph stays open for what follows.
P_SHIELDS = frozenset("td th button table".split())


class Node:
    """An element. ``key`` stands for its path of names, ``p`` for the open paragraph around it,
    ``near`` for the outermost open element, by tag of ``CLOSES``, that this tag would close."""

    __slots__ = ("tag", "name", "mark", "side", "parts", "parent", "key", "p", "near", "story")

    def __init__(self, tag: str, name: str, mark: int, parent: Node | None) -> None:
        self.tag, self.name, self.mark, self.parent = tag, name, mark, parent
        # Whether an article or main is around it; such a header is the article's own.
        self.story = parent is not None and (parent.story or parent.tag in ("article", "main"))
        if tag == "header" and self.story and mark == APART_MARK and name == "header":
            self.mark = 0
        self.side = self.mark > 0
        self.parts: list[Node | str] = []
        self.key = hash((parent.key, name)) if parent else 0
        self.p = self if tag == "p" else parent.p if parent and tag not in P_SHIELDS else None
        self.near: dict[str, Node | None] = parent.near if parent else {}
        if tag in _NEAR:
            own = dict(self.near)
            for k in CLOSES:
                if tag in SHIELDS.get(k, ()):
                    own[k] = None
                if tag in CLOSES[k] and own.get(k) is None:
                    own[k] = self
            self.near = own

    @property
    def path(self) -> str:
        names, node = [], self
        while node.parent is not None:
            names.append(node.name)
            node = node.parent
        return ">".join(reversed(names))


_NEAR = frozenset().union(*CLOSES.values(), *SHIELDS.values())


def path_key(path: str) -> int:
    """The ``key`` of nodes at a path, in this process."""
    key = 0
    for name in path.split(">") if path else ():
        key = hash((key, name))
    return key


#: A class that begins or ends so says something about its element's surroundings or state.
NOT_SIDE = frozenset("has with no not is open closed enabled on off".split())


def _side_word(word: str) -> int:
    """The mark that a word of class, id or role gives."""
    parts = re.split(r"[-_]+", word)
    hits = [p for p in parts if SIDE_WORDS.match(p)]
    if not hits or {parts[0], parts[-1]} & NOT_SIDE:
        return 0
    if any(p not in LAYOUT and not p.isdigit() and p not in hits for p in parts):
        return TOPIC
    return APART_MARK if any(map(ALWAYS.match, hits)) else WORD


def _marks(tag: str, attrs: str) -> tuple[str, int]:
    """(generalised name: tag and classes without digits, mark)."""
    mark, classes = APART_MARK if tag in APART else 0, ""
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        key = key.lower()
        if key == "hidden":
            mark = APART_MARK
        if key not in ("class", "id", "role"):
            continue
        words = unescape(next((v for v in values if v), "")).lower().split()
        if key == "class":
            classes = "".join(sorted({"." + re.sub(r"\d+", "#", w).replace(">", "_") for w in words}))
        if mark < APART_MARK and tag not in ("html", "body", "article", "main") and not (key == "id" and (tag == "p" or tag in HEADINGS)):
            mark = max([mark, *map(_side_word, words)])
    return tag + classes, mark


def _settle(root: Node) -> None:
    """Elements that only a word marks stay if they hold prose with few links: those that may be topics anywhere, those of a bare
    side word inside an article or main. Inner elements are judged first."""
    order: list[tuple[Node, bool]] = [(root, False)]
    for node, linked in order:
        linked = linked or node.tag == "a"
        order += [(part, linked) for part in node.parts if not isinstance(part, str) and part.mark < APART_MARK]
    plain: dict[int, tuple[int, int, int]] = {}  # characters outside links, in links, of the longest run outside
    for node, linked in reversed(order):
        own = [len(part.strip()) for part in node.parts if isinstance(part, str)]
        sums = [sum(own), 0, max(own, default=0)] if not (linked or node.tag == "a") else [0, sum(own), 0]
        for part in node.parts:
            if not isinstance(part, str) and not part.side:
                a, b, c = plain[id(part)]
                sums = [sums[0] + a, sums[1] + b, max(sums[2], c)]
        plain[id(node)] = tuple(sums)
        if node.mark == TOPIC or node.mark == WORD and node.story:
            node.side = not (sums[0] >= PROSE_PART and sums[2] >= PROSE_CHARS and sums[1] <= LINK_SHARE * sums[0])


def parse(html: str) -> Node:
    """A lenient tree of a page: unclosed and misnested tags are closed as their kind asks. Time
    and memory grow with the page's length, whatever stands in it."""
    root = here = Node("", "", 0, None)
    at, n, doubtful = 0, len(html), False
    opened: Counter[str] = Counter()
    raw_ends: dict[str, re.Pattern] = {}

    def leave(upto: Node) -> Node:
        """Closes from ``here`` up to and with ``upto``."""
        node = here
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        opened[node.tag] -= 1
        return node.parent

    while at < n:
        start = html.find("<", at)
        if start < 0:
            break
        m = _TAG.match(html, start)
        if m is None:  # no tag: a character
            here.parts.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            here.parts.append(html[at:start])
        if m["tag"] is None:
            close = html.find("-->" if m["note"] is not None else ">", m.end())
            at = n if close < 0 else close + (3 if m["note"] is not None else 1)
            continue
        at, tag = m.end(), m["tag"].lower()
        if m["end"]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up)
            continue
        if tag in ENDS_P and here.p is not None:
            here = leave(here.p)
        if tag in CLOSES and here.near.get(tag) is not None:
            here = leave(here.near[tag])
        name, mark = _marks(tag, m["attrs"])
        node = Node(tag, name, mark, here)
        doubtful = doubtful or node.mark in (TOPIC, WORD)
        here.parts.append(node)
        if tag in RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(f"</{re.escape(tag)}", re.I)
            end = raw_ends[tag].search(html, at)
            close = html.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and (tag in CONTAINERS or not _CLOSED.search(m["attrs"])):
            here = node
            opened[tag] += 1
    if at < n:
        here.parts.append(html[at:])
    if doubtful:
        _settle(root)
    return root


def blocks(node: Node) -> list[str]:
    """The text of a node's blocks, without what stands beside the main text."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        top, i = stack.pop()
        if i == 0 and top.tag in BLOCKS:
            flush()
        for j in range(i, len(top.parts)):
            part = top.parts[j]
            if isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif part.side:
                if part.tag in BLOCKS:
                    flush()
            else:
                stack += [(top, j + 1), (part, 0)]
                break
        else:
            if top.tag in BLOCKS:
                flush()
    flush()
    return out


@dataclass
class Container:
    """``score`` by :func:`containers`; ``prose``: characters of the running text inside it, outside
    links; ``above``: the number of the container around it, or -1."""

    node: Node
    above: int
    bonus: float
    score: float = 0.0
    prose: int = 0


def containers(root: Node) -> list[Container]:
    """The containers outside the page's surroundings, in page order. Text counts in full for
    the score of the container that holds its paragraph and of the nearest article or main
    around it, and by half for the container above; text of links counts against them."""
    found: list[Container] = []
    stack: list[tuple[Node, int, int, int, bool]] = [(root, -1, -1, -1, False)]
    while stack:
        node, own, above, story, linked = stack.pop()
        if node.side:
            continue
        if node.parent is not None:
            linked = linked or node.tag == "a"
            if node.tag in CONTAINERS:
                own, above = len(found), own
                whole = node.tag in ("article", "main")
                story = own if whole else story
                found.append(Container(node, above, 1.3 if whole else 1.0))
        sizes = [len(part.strip()) for part in node.parts if isinstance(part, str)]
        n = sum(sizes)
        if n and own >= 0:
            gain = -n if linked else n
            for i in {own, story} - {-1}:
                found[i].score += gain
            if above not in (-1, story):
                found[above].score += gain / 2
            if not linked and max(sizes) >= PROSE_CHARS:
                found[own].prose += n
        stack += [(part, own, above, story, linked) for part in reversed(node.parts) if not isinstance(part, str)]
    for c in found:
        c.score *= c.bonus
    for c in reversed(found):
        if c.above >= 0:
            found[c.above].prose += c.prose
    return found


def _adds_article(inner: Container, outer: Container) -> bool:
    """Whether what ``outer`` holds besides ``inner`` is text of the same article: running text or a heading, and few
    links. A page's body may hold anything."""
    if outer.node.tag == "body":
        return False
    plain = linked = longest = headings = 0
    stack: list[tuple[Node, bool]] = [(outer.node, False)]
    while stack:
        node, within = stack.pop()
        if node is inner.node or node.side:
            continue
        within = within or node.tag == "a"
        sizes = [len(part.strip()) for part in node.parts if isinstance(part, str)]
        plain, linked = (plain, linked + sum(sizes)) if within else (plain + sum(sizes), linked)
        longest = max([longest, *sizes]) if not within else longest
        headings += node.tag in HEADINGS
        stack += [(part, within) for part in node.parts if not isinstance(part, str)]
    return (longest >= PROSE_CHARS or headings > 0) and linked <= LINK_SHARE * plain


def widen(best: Container, all_: list[Container]) -> Container:
    """The lowest container around ``best`` that leaves out less than ``LEFT_OUT`` of the page's
    running text, and then those around it that add nothing but text of the same article: an article may be laid out as several
    unlike containers. An article or main element that holds most of it is one as it is."""
    total = sum(c.prose for c in all_ if c.above < 0)
    around = best
    while around.above >= 0 and not (around.bonus > 1 and 2 * around.prose >= total):
        if around.prose >= (1 - LEFT_OUT) * total and not _adds_article(around, all_[around.above]):
            break
        around = all_[around.above]
    return around


def best_of(all_: list[Container]) -> Container | None:
    best = max(all_, key=lambda c: c.score, default=None)
    return best and widen(best, all_)


def main_text(root: Node, path: str | None = None) -> str:
    """Blocks of the containers at ``path``, in page order; of the page's own best one if there
    are none, or if they lack any of its running text."""
    all_ = containers(root)
    best = best_of(all_)
    if best is None:
        return "\n".join(blocks(root))
    key = path_key(path) if path is not None else None
    chosen = [c for c in all_ if c.node.key == key]
    if not chosen or sum(c.prose for c in chosen) < best.prose:
        chosen = [best]
    return "\n".join(b for c in chosen for b in blocks(c.node))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, vote): a page votes for its best container and, by their scores, for the next two."""
    for b in batches:
        hosts, paths, votes = [], [], []
        for lo in range(0, b.num_rows, 20):
            part = b.slice(lo, 20)
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                all_ = containers(parse(html or ""))
                best = best_of(all_)
                good = heapq.nlargest(3, (c for c in all_ if c.score > 0), key=lambda c: c.score)
                shares = {c.node.key: (c.node.path, c.score / good[0].score) for c in good}
                if good:
                    shares[best.node.key] = (best.node.path, 1.0)
                for p, share in shares.values():
                    hosts.append(host)
                    paths.append(p)
                    votes.append(round(1000 * share))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "vote"])


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and, added or replaced: ``text``, ``n_chars`` (long, code points)
    and ``path``, the generalised path that the page's host agreed on.

    Every page scores its containers and votes for their generalised paths (tags and
    classes, digits dropped). Votes are summed per host and path before and after the
    shuffle, so a large host is a few rows; the path with most votes wins (of equals the
    first by code points). Pages are then extracted by their host's path; one on which it
    is missing, or lacks some of the running text of its own best, goes by the latter.

    Blocks of the text are joined by line feeds; white space inside a block is one blank;
    menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are left out by element and by words in class, id and role. An element that such a word marks stays
    if it holds prose with few links and its name may be a topic (related-work), or if it is inside an article and the
    word isn't one of :data:`ALWAYS`. An article's own header stays.

    Defined cases: null html is empty and gives ''; pages without a host vote together; a
    page without containers gives all its text; long pages are read whole, in time and
    memory that grow with their length; repeated rows stay; an empty table gives an empty
    table; a column named ``__host`` is not for callers.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "path")]
    hosted = pages.select(host_of(F.col(url_col)).alias("__host"), *rest, html_col)
    votes = hosted.select("__host", html_col).mapInArrow(_votes, "host string, path string, vote long")
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    best = sums.groupBy(F.col("host").alias("__h")).agg(F.min(F.struct(-F.col("vote"), "path")).alias("__best")).select("__h", F.col("__best.path").alias("path"))
    ruled = hosted.join(small(materialise(best)), F.col("__host") == F.col("__h"), "left").select(*rest, html_col, "path")
    names = [*rest, html_col, "path", "text"]
    schema = ruled.select(*rest, html_col, "path", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [main_text(parse(h or ""), p) for h, p in zip(part.column(len(rest)).to_pylist(), part.column(len(rest) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return ruled.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
