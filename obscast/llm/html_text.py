"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks of text in page order (`read_blocks`), each with the tags
around it. A linear classifier turns a block's length, links, punctuation, tags and class
words into costs of calling it content or boilerplate (`all_costs`): the capacities of its edges
to the two terminals. Length is counted in words where words are spaced and in characters
where they are not. All of it is evidence of like size, containers too: only navigation and
hidden parts are out for certain. A container that names boilerplate says nothing where
nothing outside of it could be the main text, and all it says otherwise, whatever its size
(`votes_out`): thirty comments below one paragraph are comments, a form around the page is no
form. Links tell less against a block, the less linked the rest of its article is: a list of
sources stays, a teaser goes. Blocks that follow each other, on the page or in one container,
are tied by smoothness edges that weaken with their distance in the tree of tags and where
one lies in a container that the other does not (`ties`).
The minimum cut is the labelling of least total cost: a short line among paragraphs stays, a
sentence among links goes, whatever its own words say.

Defined results: a null or empty html has no text; white space inside a block becomes one
space and blocks are joined by line breaks; character references are decoded; unclosed and
stray tags are taken as browsers do, near enough; a quote that never closes is a plain
character, and a tag that never ends takes the rest of the page; a block whose costs tie is
boilerplate; a page without any content block has the empty text; equal pages have equal
texts; pages of any length and depth are read whole, in time that grows with their length;
other columns of the input are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose text is never shown as text of the page (fixed).
SILENT = frozenset("script style template noscript title svg math iframe object canvas select textarea".split())
#: Tags that take no content (fixed).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that begin a new block (fixed).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers of boilerplate and of content by tag, and words that name them in class, id and role.
SURE_TAGS = frozenset(["nav"])
OUT_TAGS = frozenset("footer aside form button menu dialog search".split())
IN_TAGS = {"article": 3, "main": 2}
OUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer form gdpr login menu"
    " modal nav navbar navigation newsletter notice overlay pagination pager popup promo promotion recommended related"
    " replies respond search share sharing shoutbox sidebar signup social sponsor sponsored subscribe tags toolbar"
    " widget".split()
)
#: Those of them that also name ordinary things when they are part of a name.
WEAK_WORDS = frozenset(
    "banner discussion footer form login menu notice promo promotion recommended related search share sharing social"
    " tags widget".split()
)
IN_WORDS = frozenset("article content entry main post story".split())
#: Words that name boilerplate only outside of content.
TOP_WORDS = frozenset("header masthead topbar".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>=]")
LEAD = re.compile(r"\s*")
SHUT = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in SILENT}
ITEMS, LISTS = frozenset("li dt dd td th tr option".split()), frozenset("ul ol dl table select".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Characters of scripts written without spaces, and ends of a sentence with what may close it (fixed).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FULL_STOP = re.compile("[.!?\u2026\u3002\uff01\uff1f\uff0e\u0964\u06d4\u061f\u1362\u104b\u17d4][\"'\u2019\u201d\u00bb\u300d\u300f)\\]]*$|[\"'\u201d\u00bb\u300d\u300f]$")

#: Weight of the smoothness edges between neighbours, capacity that no cut of the others
#: reaches, and what is left of a tie between a named container's inside and outside.
SMOOTH, SURE, PARTED = 1.2, 1e6, 0.1
#: Evidence for content by rank of the container, against blocks outside of all where the page
#: names one, and against blocks in a container that is boilerplate by all of its name.
INSIDE, OUTSIDE, OUT = (0.0, 1.2, 1.6, 2.0), 0.7, 6.0
#: Characters that make up a word where there are no spaces, evidence against a block of links,
#: what is left of it where nothing else of its article is linked, and the score from which a
#: block could be main text by itself.
PER_WORD, LINKED, RARE, SOLID = 1.7, 3.0, 0.2, 0.3


@dataclass
class Container:
    """An open or closed tag that names boilerplate: where it hangs and how clearly it does."""

    above: int
    vote: float


@dataclass
class Article:
    """A container of content: how long its text is and how much of it is linked."""

    size: int = 0
    linked: int = 0


@dataclass
class Block:
    text: str
    holder: int  # the innermost container that votes
    parent: int  # the block tag around the block's own
    depth: int  # block tags around the text
    low: int  # least depth since the block before
    sure: bool
    inside: int
    heading: bool
    linked: int
    article: Article | None  # the innermost container of content


def named_out(value: str) -> float:
    """How far the names in a class, id or role say boilerplate: "comment-list" nearly as much
    as "comments", "share-price" much less than "share"."""
    most = 0.0
    for name in value.lower().split():
        words = WORD.findall(name)
        told = sum(w in OUT_WORDS for w in words) / max(1, len(words))
        sure = any(w in OUT_WORDS and w not in WEAK_WORDS for w in words)
        most = max(most, told, 0.9) if sure else max(most, told * told)
    return most


def tokens(page: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(text before, begin, end, tag or closing tag, attributes) of the page's tags in order.

    Every character is passed a bounded number of times: what cannot end any more is not
    looked for again.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    at = seek = 0
    while (begin := page.find("<", seek)) >= 0:
        if begin > last[">"]:
            break  # no tag ends any more
        m = NAME.match(page, begin)
        if m is None:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), begin):
                end = page.find(">", begin) + 1
            else:
                seek = begin + 1
                continue
            yield page[at:begin], begin, end, "", ""
            at = seek = end
            continue
        pos = m.end()
        while (stop := STOP.search(page, pos)) and stop[0] == "=":
            pos = LEAD.match(page, stop.end()).end()
            quote = page[pos : pos + 1]
            if quote and quote in "\"'" and pos < last[quote]:
                pos = page.find(quote, pos + 1) + 1
        end = stop.end() if stop else len(page)
        if stop:
            yield page[at:begin], begin, end, m[1] + m[2].lower(), page[m.end() : end - 1]
        else:
            yield page[at:begin], begin, end, "", ""
        at = seek = end
    yield page[at:], len(page), len(page), "", ""


def read_blocks(page: str) -> tuple[list[Block], list[Container]]:
    """The page's blocks of text in order, and the containers that vote on them."""
    containers = [Container(-1, 0.0)]
    # An open tag: name, block number or 0, and what holds below it: depth, voting container,
    # rank as content, out for certain, links, headings, container of content.
    stack: list[tuple[str, int, int, int, int, bool, int, int, Article | None]] = [("", 0, 0, 0, 0, False, 0, 0, None)]
    opened: dict[str, list[int]] = {}
    lists: list[int] = []  # where in the stack lists and tables are
    around: list[int] = []  # numbers of the open block tags
    blocks: list[Block] = []
    parts: list[str] = []
    linked = numbers = low = 0

    def flush() -> None:
        nonlocal linked, low
        text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            _, _, depth, holder, inside, sure, _, headings, article = stack[-1]
            parent = around[-2] if len(around) > 1 else 0
            blocks.append(Block(text, holder, parent, depth, min(low, depth), sure, inside, headings > 0, linked, article))
            if article and not sure:
                article.size += len(text)
                article.linked += min(linked, len(text))
            low = depth
        linked = 0

    def close(upto: int) -> None:
        nonlocal low
        while len(stack) > upto:
            name, number, *_ = stack.pop()
            opened[name].pop()
            if name in LISTS:
                lists.pop()
            if number:
                around.pop()
        low = min(low, stack[-1][2])

    silent = ""
    skip = 0
    for data, begin, end, tag, attributes in tokens(page):
        if begin < skip:
            continue
        if silent:
            silent = ""
            data = page[skip:begin]
        if data:
            parts.append(data)
            linked += len(data.strip()) * bool(stack[-1][6])
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCKS:
                flush()
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in SILENT:
            shut = SHUT[tag].search(page, end)
            silent, skip = tag, shut.end() if shut else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            if opened.get("p"):  # a block ends an open paragraph
                place = opened["p"][-1]
                if stack[-1][2] == stack[place][2]:
                    close(place)
            if tag in ITEMS and opened.get(tag):
                place = opened[tag][-1]
                if place > (lists[-1] if lists else -1):
                    close(place)
        if tag in VOID or attributes.endswith("/"):
            continue
        _, _, depth, holder, rank, sure, links, headings, article = stack[-1]
        out, inside = float(tag in OUT_TAGS), IN_TAGS.get(tag, 0)
        if tag == "header" and not rank:
            out = 1.0
        if attributes:
            values = ["".join(a[1:]) for a in ATTRIBUTE.findall(attributes)]
            named = {w for v in values for w in WORD.findall(v.lower())}
            if named and tag not in ("html", "body"):
                out = max(out, *map(named_out, values))
                if named & TOP_WORDS and not named & IN_WORDS and not rank:
                    out = 1.0
                # "post share-enabled" is content, "comment-content" is not
                if any(set(w) & IN_WORDS and not set(w) & OUT_WORDS for v in values for w in map(WORD.findall, v.lower().split())):
                    inside = max(inside, 1)
            sure = sure or bool(HIDDEN.search(attributes))
        number = 0
        if tag in BLOCKS:
            numbers += 1
            number = numbers
            around.append(number)
        if inside:
            article = Article()
        if out:
            containers.append(Container(holder, out))
            holder = len(containers) - 1
        if tag in LISTS:
            lists.append(len(stack))
        opened.setdefault(tag, []).append(len(stack))
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        stack.append((
            tag, number, depth + (number > 0), holder, max(rank, inside), sure or tag in SURE_TAGS, links + (tag == "a"), headings + heading, article,
        ))
    flush()
    return blocks, containers


def evidence(block: Block, named: bool) -> float:
    """What the block and its containers of content say for main text (named: there are such on the page)."""
    unspaced = len(UNSPACED.findall(block.text))
    words = block.text.count(" ") + 1 + unspaced / PER_WORD
    score = 0.08 * min(words, 40) - 1.2 + 0.6 * bool(FULL_STOP.search(block.text[-8:])) + 1.0 * block.heading
    of_all = block.article.linked / max(1, block.article.size) if block.article else 1.0
    score -= LINKED * (RARE + (1.0 - RARE) * of_all**2) * min(1.0, block.linked / len(block.text))
    return score + INSIDE[block.inside] - OUTSIDE * (named and not block.inside)


def votes_out(blocks: list[Block], containers: list[Container], scores: list[float]) -> list[float]:
    """How strongly each block's containers name it boilerplate, 0 to 1.

    A container's vote counts if a block outside of it, in containers that say less against it,
    could be main text by its score; what lies around both is left out of account.
    """
    never = float("inf")
    # Least that containers below say against a block of main text, the same of all but the best part.
    least, second = [never] * len(containers), [never] * len(containers)

    def meet(k: int, value: float) -> None:
        if value < least[k]:
            least[k], second[k] = value, least[k]
        else:
            second[k] = min(second[k], value)

    for block, score in zip(blocks, scores, strict=True):
        if score >= SOLID and not block.sure:
            least[block.holder] = second[block.holder] = 0.0
    for k in range(len(containers) - 1, 0, -1):
        meet(containers[k].above, max(containers[k].vote, least[k]))
    outside, strength = [never] * len(containers), [0.0] * len(containers)
    for k, c in enumerate(containers[1:], start=1):
        own = max(c.vote, least[k])
        outside[k] = min(outside[c.above], second[c.above] if own == least[c.above] else least[c.above])
        empty = least[k] == never
        strength[k] = max(strength[c.above], c.vote if empty or outside[k] < c.vote else 0.0)
    return [strength[b.holder] for b in blocks]


def all_costs(blocks: list[Block], containers: list[Container]) -> list[tuple[float, float]]:
    """What it costs to call each block content, and to call it boilerplate."""
    named = any(b.inside for b in blocks if not b.sure)
    scores = [evidence(b, named) for b in blocks]
    out = [score - OUT * vote for score, vote in zip(scores, votes_out(blocks, containers, scores), strict=True)]
    return [(SURE, 0.0) if b.sure else (max(0.0, -x), max(0.0, x)) for b, x in zip(blocks, out, strict=True)]


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, weight) by page order and by nearness in the tree of tags."""
    out: list[tuple[int, int, float]] = []
    last_in: dict[tuple[int, int], int] = {}
    for j, block in enumerate(blocks):
        if j:
            # Steps from one block's tag to the other's, by way of the deepest that holds both.
            steps = blocks[j - 1].depth + block.depth - 2 * block.low
            out.append((j - 1, j, SMOOTH * PARTED ** (blocks[j - 1].holder != block.holder) / max(1, steps - 1)))
        # The sibling before, past what other containers put in between.
        place = block.parent, block.holder
        if last_in.get(place, j - 1) != j - 1:
            out.append((last_in[place], j, SMOOTH))
        last_in[place] = j
    return out


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (blocking flows over shortest levels).

    source[i] is lost if i leaves the source, sink[i] if it stays; an edge's weight if its
    ends part.
    """
    n, tiny = len(source), 1e-9
    # What source and sink of one node share flows straight through it.
    left = [max(0.0, a - b) for a, b in zip(source, sink, strict=True)]
    need = [max(0.0, b - a) for a, b in zip(source, sink, strict=True)]
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for i, j, w in edges:  # arc k and its reverse k ^ 1
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += (j, i)
        room += (w, w)
    while True:
        level = [0 if x > tiny else -1 for x in left]
        queue = [i for i in range(n) if level[i] == 0]
        met = False
        for i in queue:
            met = met or need[i] > tiny
            for k in arcs[i]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not met:
            return [x >= 0 for x in level]
        tried = [0] * n
        for begin in range(n):
            path: list[int] = []
            at = begin
            while left[begin] > tiny:
                if need[at] > tiny:
                    flow = min(left[begin], need[at], *(room[k] for k in path))
                    left[begin] -= flow
                    need[at] -= flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    path, at = [], begin
                elif tried[at] < len(arcs[at]):
                    k = arcs[at][tried[at]]
                    if room[k] > tiny and level[to[k]] == level[at] + 1:
                        path.append(k)
                        at = to[k]
                    else:
                        tried[at] += 1
                elif path:  # a dead end is not entered again in this round
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    blocks, containers = read_blocks(page or "")
    if not blocks:
        return ""
    both = all_costs(blocks, containers)
    kept = min_cut([b for _, b in both], [a for a, _ in both], ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return pages.mapInArrow(run, "page_id long, url string, text string")
