"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives every block a cost for being called content and a cost for being called
boilerplate; these are the capacities to the two terminals. Blocks that follow one another, and blocks of the same parent element, are tied
by smoothness edges. The minimum cut is the cheapest labelling; blocks on the source side are the article. Blocks whose own
cost outweighs all their ties are settled beforehand, which leaves the minimum as it is; max-flow settles the others.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown, or belongs to a picture or a form.
RAW = frozenset("script style template textarea title noscript iframe noembed xmp svg select datalist annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that the start of one of these ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav footer aside form menu dialog button search fieldset label".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status note".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Words in class names and ids. The first say almost surely what a block is; the others are also used for parts of articles.
_SURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|breadcrumbs?|masthead|topbar|toolbar|sidebar\w*|widgets?|share|sharing|social|"
    r"comments?|commentlist|respond|repl(?:y|ies)|discussion|disqus|cookies?|consent|gdpr|newsletter|subscri\w*|popup|modal|overlay|login|signin|signup|pag(?:er|ination)|"
    r"copyright|disclaimer|skip|hidden)(?:$|[\s_-])"
)
_MAYBE = re.compile(r"(?:^|[\s_-])(?:foot\w*|side|related|recommend\w*|notices?|alerts?|register|search\w*|legal|tags|meta|byline|toc|form)(?:$|[\s_-])")
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|post|story|main|body|text|prose|page)(?:$|[\s_-])")
#: What readers wrote; of the sure words, those that an article can also be about; and names that tell of another element.
_COMMENT = re.compile(r"(?:^|\s)(?:comments?|commentlist|respond|repl(?:y|ies)|disqus)(?:$|[\s_-])")
_READERS_ARTICLE = re.compile(r"(?:^|\s)(?:comment|comment-body|reply)(?:$|\s)")
_TOPIC = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|discussion|banners?|menus?|widgets?|copyright|disclaimer|login|skip)(?=$|[\s_-])")
_OF_ANOTHER = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without)[_-]\S+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\b\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.IGNORECASE)
#: Unlinked words of a finished sentence that make a block prose.
PROSE_WORDS = 20


@dataclass(slots=True, eq=False)
class Element:
    """An open or closed element. ``at`` is its place among the open ones, ``block`` the nearest block element (itself included), ``depth`` the number of
    block elements around it. ``judge`` sets the rest."""

    tag: str
    parent: Element | None
    at: int = 0
    block: Element | None = None
    depth: int = 0
    marks: dict[str, str] | None = None
    link: bool = False
    prose: int = 0
    long: bool = False
    anchor: int = 0
    region: bool = False
    hidden: bool = False
    named: int = 0
    own: bool = False
    content: bool = False
    readers: bool = False


@dataclass(slots=True)
class Block:
    """A text block: the element that its text stands in, the block element around its own, its own tag, its linked characters, and what its elements say:
    ``region`` of a boilerplate tag or role, ``named`` 1 for doubtful and 2 for sure boilerplate names, one more if it is the block's own name, ``content`` of
    an article's element."""

    text: str
    last: Element
    around: Element
    tag: str
    links: int
    region: bool = False
    named: int = 0
    content: bool = False

    @property
    def prose(self) -> int:
        """Its words, if it is a finished sentence of some length without many links; else 0."""
        n = self.text.count(" ") + 1
        return n if n >= PROSE_WORDS and self.text[-1] in ".!?…\"”»" and self.links <= 0.2 * (len(self.text) - n + 1) else 0


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """All elements, each after its parent, and the text blocks in page order. Comments, scripts, styles and other elements that show no text are left out."""
    root = Element("", None)
    root.block = root
    elements, out, stack = [root], [], [root]
    open_: dict[str, list[int]] = {}
    text: list[str] = []
    links = 0

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag].pop()
        del stack[k:]

    def flush() -> None:
        nonlocal links
        if text:
            said = " ".join("".join(text).split())
            if said:
                own = stack[-1].block
                out.append(Block(said, stack[-1], own.parent.block if own.parent else own, own.tag, links))
            text.clear()
        links = 0

    def say(s: str) -> None:
        nonlocal links
        if s:
            said = html.unescape(s) if "&" in s else s
            text.append(said)
            if stack[-1].link:
                links += len("".join(said.split()))

    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        say(page[at:i])
        if page.startswith("<!--", i):
            empty = next((e for e in ("<!-->", "<!--->") if page.startswith(e, i)), "")  # comments that end where they begin
            end = page.find("-->", i + 4)
            at = i + len(empty) if empty else size if end < 0 else end + 3
            continue
        if i + 1 < size and page[i + 1] in "!?":
            end = page.find(">", i)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            end = page.find(">", i) if i + 1 < size and (page[i + 1].isalpha() or page[i + 1] == "/") else -1
            if end < 0:
                if i + 1 < size and (page[i + 1].isalpha() or page[i + 1] == "/"):
                    break  # a tag that the page's end cuts off
                say("<")
                at = i + 1
            else:
                at = end + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            k = open_[name][-1] if open_.get(name) else 0
            if k and (name in BLOCK or k > stack[-1].block.at):
                cut(k)
            elif name == "br":
                text.append(" ")
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else (size if name in ("script", "style") else at)
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            around = stack[-1].block
            if around.tag == "p" or name in CLOSED_BY.get(around.tag, ()):
                cut(around.at)
        if not m[3].endswith("/") or name in BLOCK:
            top = stack[-1]
            e = Element(name, top, len(stack))
            e.block, e.depth = (e, top.depth + 1) if name in BLOCK else (top.block, top.depth)
            e.link = name == "a" or (top.link and name not in BLOCK)
            if m[3].strip(" /"):
                e.marks = {x[1].lower(): (x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(m[3])}
            open_.setdefault(name, []).append(e.at)
            elements.append(e)
            stack.append(e)
    flush()
    return elements, out


def _names(e: Element) -> str:
    """Class names and id, without those of the kind ``has-sidebar``."""
    said = f"{e.marks.get('class', '')} {e.marks.get('id', '')}".lower() if e.marks else ""
    return _OF_ANOTHER.sub("", said).strip() if said else ""


def judge(elements: list[Element], found: list[Block]) -> None:
    """What tags, roles and names say of every element, and of the blocks below it.

    An element that holds most of the page's prose and its article (``main`` or the heading; if there is neither, an ``article`` or a content name) is a
    wrapper: its names say nothing, and a form around it is no form. Of what readers wrote, only ``main`` or the heading makes a wrapper.
    """
    names = [_names(e) for e in elements]
    for b in found:
        n = b.prose
        b.last.prose += n
        b.last.long |= n > 0
    aside = [False] * len(elements)  # in an element that holds no heading of the page
    number = {id(e): k for k, e in enumerate(elements)}
    for k, e in enumerate(elements):
        role = e.marks.get("role", "").lower() if e.marks else ""
        if e.parent:
            aside[k] = aside[number[id(e.parent)]]
        aside[k] = (aside[k] and e.tag not in CONTENT_TAGS) or e.tag in ("header", "nav", "aside", "footer")
        if e.tag == "main" or role == "main" or (e.tag == "h1" and not aside[k]):
            e.anchor = 2
        elif e.tag == "article" or (e.marks and e.marks.get("itemprop", "").lower() == "articlebody") or (names[k] and e.tag not in ("html", "body") and _CONTENT.search(names[k])):
            e.anchor = 1
    for e in reversed(elements[1:]):
        e.parent.prose += e.prose
        e.parent.long |= e.long
        e.parent.anchor = max(e.parent.anchor, e.anchor)
    prose, anchor = elements[0].prose, elements[0].anchor
    for k, e in enumerate(elements[1:], 1):
        top, named, marks = e.parent, names[k], e.marks or {}
        region, kind, content, e.readers, e.hidden = top.region, top.named, top.content, top.readers, top.hidden
        most = 2 * e.prose > prose
        wrapper = most and e.anchor == anchor > 0
        if e.tag == "article" and named and _READERS_ARTICLE.search(named):
            e.readers = True
            kind, e.own = 2, True
        if e.tag in CONTENT_TAGS and not e.readers:
            kind = 0  # a wrapper of the article may be named after what else it holds
        if e.tag in BLOCK or e.tag in BOILER_TAGS or named:
            role = marks.get("role", "").lower()
            in_article = content and not region
            e.hidden = e.hidden or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true"
            if e.tag in BOILER_TAGS or role in BOILER_ROLES:
                region = region or not (wrapper and (e.tag == "form" or e.tag not in BOILER_TAGS) and role in ("", "form"))
            region = region or e.hidden or e.tag == "head" or (e.tag == "header" and not in_article)
            if named and e.tag not in ("html", "body", "article", "main", "p", "h1"):
                readers = bool(_COMMENT.search(named))
                if not (wrapper and (not readers or anchor == 2)):
                    e.readers |= readers
                    sure = _SURE.search(named)
                    if sure and in_article and e.long and not _SURE.search(_TOPIC.sub(" ", named)):
                        kind = max(kind, 1)  # the article may be about such a thing
                    else:
                        is_named = 2 if sure else 1 if _MAYBE.search(named) else 0
                        e.own, kind = is_named > 0, max(kind, is_named)
            content = content or e.tag in CONTENT_TAGS or role == "main" or marks.get("itemprop", "").lower() == "articlebody" or bool(named and e.tag not in ("html", "body") and _CONTENT.search(named))
        e.region, e.named, e.content = region, kind, content and not e.readers
    for b in found:
        own, last = b.last.block, b.last  # inline elements can hold the region too
        named = max(own.named, last.named)
        b.region, b.named, b.content = own.region or last.region, named + (1 if named and (own.own or last.own) else 0), own.content or last.content


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what their elements say."""
    elements, found = parse(page)
    judge(elements, found)
    return found


#: Fixed weights of the classifier.
WEIGHTS = {"bias": -1.0, "words": 0.1, "linked": -4.0, "text": 1.0, "heading": 0.5, "item": -0.5, "ended": 0.5, "content": 1.5, "region": -8.0, "named": (0.0, -4.0, -7.0, -9.0)}


def evidence(b: Block) -> float:
    """The classifier: positive for content. A linear score of region, names, tag, link share and length."""
    w = WEIGHTS
    n = b.text.count(" ") + 1
    score = w["bias"] + w["words"] * min(n, 40) + w["linked"] * min(1.0, b.links / max(1, len(b.text) - n + 1))
    score += w["text"] if b.tag in ("p", "blockquote", "pre") else w["heading"] if b.tag in ("h1", "h2", "h3") else w["item"] if b.tag in ("li", "td", "option") else 0.0
    score += w["ended"] if b.text[-1] in ".!?…\"”»" else 0.0
    return score + w["content"] * b.content + w["region"] * b.region + w["named"][b.named]


#: Ties of blocks that follow one another, halved for each element between them, and of blocks of one parent with others between them.
NEXT, SIBLING = 2.5, 1.0


def min_cut(own: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: ``|own|`` for each label against its sign, and the tie for each pair of different labels. Ties of cost: content."""
    label: list[bool | None] = [None] * len(own)
    near: list[list[tuple[int, float]]] = [[] for _ in own]
    for i, j, c in ties:
        near[i].append((j, c))
        near[j].append((i, c))
    own = list(own)
    work = deque(range(len(own)))
    while work:  # settle what no labelling of its neighbours can turn
        i = work.popleft()
        if label[i] is None and abs(own[i]) > sum(c for j, c in near[i] if label[j] is None):
            label[i] = own[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    own[j] += c if label[i] else -c
                    work.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        for i, x in zip(left, _flow([own[i] for i in left], [(place[i], place[j], c) for i, j, c in ties if i in place and j in place])):
            label[i] = x
    return [bool(x) for x in label]


def _flow(own: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Max-flow by shortest augmenting paths; content is everything that can't reach the sink in the rest."""
    n = len(own)
    source, sink = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, x in enumerate(own):
        a, b = (source, i) if x > 0 else (i, sink)
        cap[a][b], cap[b][a] = abs(x), cap[b].get(a, 0.0)
    for i, j, c in ties:
        cap[i][j] = cap[i].get(j, 0.0) + c
        cap[j][i] = cap[j].get(i, 0.0) + c
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        room = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= room
            cap[b][a] += room
    reach, queue = {sink}, deque([sink])
    while queue:
        b = queue.popleft()
        for a in cap[b]:  # every arc has its reverse
            if a not in reach and cap[a].get(b, 0.0) > 1e-9:
                reach.add(a)
                queue.append(a)
    return [i not in reach for i in range(n)]


def _between(a: Element, b: Element) -> int:
    """Block elements on the way from one to the other; beyond 40 no tie is left to speak of, so it ends there."""
    steps = 0
    while a is not b and steps < 40:
        if a.depth >= b.depth:
            a = a.parent.block
        else:
            b = b.parent.block
        steps += 1
    return steps


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of adjacency and of proximity in the page's tree."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEXT * 0.5 ** _between(found[i - 1].around, b.around)))
        if last.get(id(b.around), i - 1) < i - 1:
            out.append((last[id(b.around)], i, SIBLING))
        last[id(b.around)] = i
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty if there are none."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, min_cut([evidence(b) for b in found], ties(found))) if keep)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row per page, from the whole html. Null or empty html gives an empty text; repeated rows are kept.

    Decoded character references; any white space inside a block is one space. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
