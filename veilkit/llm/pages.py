"""Main text of web pages by two passes of block rules.

A page is cut in blocks at block-level tags. The first pass decides what it can: blocks in a boilerplate place
(navigation, footers, forms, side bars, notices, adverts, comments, hidden parts) or made mostly of links are
bad. Where only a name or a form says so, an element that holds most of the page's text is none (a wrapper that is
called no-sidebar); its own short blocks are. Beside an article or main element with text of its own no such name is
ever taken back. Of the others long blocks with many stop words are good, wherever they stand. If at least half of these blocks' text is in
elements that are articles by tag or name, the other blocks there are good, too. Of the rest long blocks with few
stop words are bad, and the others stay undecided. Where no long block of the page has as many stop words as prose in a
listed language has, these words say nothing: there long blocks are good by their length. The second pass
gives every undecided block the label of the nearest decided neighbours: theirs if both agree, else the nearer one's,
bad at equal distance. On a page without any good block undecided ones are good: what is bad says nothing about them.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty
line. Nothing is cut, capped or repaired: a page that ends in the middle of a tag loses that tag only. Scripts, styles,
drawings, templates, frames and form fields have no text; without an end tag scripts, styles and comments go on to the
end of the page, as in a browser, and the others lose their tag only. Formulas and objects keep theirs. Null,
empty and markup-only pages give an empty text. Pages are read one by one, so repeated rows and an empty table
need no rule; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: comments, tags with quoted attributes, tags without, other declarations
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?\Z", re.S | re.I)
#: elements whose content goes up to their end tag; without one script and style go on to the end, others lose the tag only
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
           for name in "script style noscript template svg textarea select iframe title".split()}
CODE = frozenset(("script", "style"))
MARKS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
WORD_OF_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLACE_TAGS = frozenset("aside button datalist dialog fieldset footer head label menu nav".split())
ARTICLE_TAGS = frozenset("article main".split())
PLACE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus dropdown footer footnav gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notification pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar warning "
    "widget widgets".split())
#: places of other people's text or other pages', which may be longer than the page's own
OTHERS_WORDS = frozenset("comment comments discussion disqus recommended related replies reply respond teaser".split())
ARTICLE_WORDS = frozenset("article articlebody main mainbody maincontent entry post story".split())
STOP_WORDS = frozenset((
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but they you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se son sur un une "
    "als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht oder "
    "sich sie sind und von war wie wird zu zum zur "
    "al como con del el ella en era es esta este fue ha la las lo los mas no o para pero por que se sin su sus un una y").split())

LONG, MIN_LONG_STOPS, FEW_STOPS, KNOWN_STOPS, MANY_LINKS = 70, 0.12, 0.05, 0.2, 0.5
BAD, SHORT, GOOD = -1, 0, 1
NO_MARK, NAMED, OTHERS = 0, 1, 2


class _Place:
    """An open element; bad and article hold for what is inside, too. A mark is what only a name or a form says: it
    makes everything inside bad unless _settle() takes it back. around is the next marked element outwards."""
    __slots__ = ("name", "bad", "article", "tagged", "mark", "others", "around", "depth")

    def __init__(self, name: str, bad: bool, article: bool, mark: int, outer: _Place | None):
        self.name = name
        self.tagged = (article and name in ARTICLE_TAGS) or (outer is not None and outer.tagged)
        self.bad = bad or (outer is not None and outer.bad)
        self.article = article or (outer is not None and outer.article)
        self.mark = mark
        self.others = mark == OTHERS or (outer is not None and outer.others)
        self.around = None if outer is None else outer if outer.mark else outer.around
        self.depth = 0 if self.around is None else self.around.depth + 1


def _marked(rest: str) -> set[str]:
    return {w.lower() for m in MARKS.finditer(rest) for w in WORD_OF_MARK.findall(m[1] or m[2] or m[3] or "")}


def _mark(words: set[str]) -> int:
    return NO_MARK if not words else OTHERS if words & OTHERS_WORDS else NAMED


def blocks(html: str) -> Iterator[tuple[str, int, _Place | None]]:
    """(text, characters inside links, innermost open element) of every block that has text."""
    stack: list[_Place] = []
    held: list[str] = []
    open_names: Counter[str] = Counter()
    links = in_link = 0

    def push(name: str, is_bad: bool, is_article: bool, mark: int) -> None:
        stack.append(_Place(name, is_bad, is_article, mark, stack[-1] if stack else None))
        open_names[name] += 1

    def pop() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    def flush() -> str:
        text = " ".join("".join(held).split())
        held.clear()
        return text

    def text_of(piece: str) -> None:
        nonlocal links
        if "&" in piece:
            piece = unescape(piece)
        held.append(piece)
        if in_link:
            links += len("".join(piece.split()))

    at = 0
    endless: set[str] = set()
    while token := TOKEN.search(html, at):
        if token.start() > at:
            text_of(html[at: token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        closing = bool(token["end"] or token["end2"])
        if name in RAW_END and not closing:
            empty = name == "svg" and (token["rest"] or token["rest2"] or "").endswith("/")
            if not empty and name not in endless:
                end = RAW_END[name].search(html, at)
                if end:
                    at = end.end()
                elif name in CODE:
                    at = len(html)
                else:
                    endless.add(name)
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            held.append(" ")
        elif name in BLOCK_TAGS or name in PLACE_TAGS:
            text = flush()
            if text:
                yield text, links, stack[-1] if stack else None
            links = 0
            outer = stack[-1] if stack else None
            if outer is not None and outer.name == "p" and not (closing and name in VOID):  # a block ends a paragraph
                pop()
                outer = stack[-1] if stack else None
            rest = token["rest"] or token["rest2"] or ""
            marks = _marked(rest) if rest and not closing else set()
            hidden = bool(rest) and HIDDEN.search(rest) is not None
            if closing:
                if open_names[name]:
                    while pop() != name:
                        pass
            elif name == "p":
                push("p", hidden, False, _mark(PLACE_WORDS & marks))
            elif name not in VOID:
                inside = outer is not None and outer.article
                own_head = inside and name in ("header", "hgroup", "h1", "h2", "h3")  # an article's title
                words = PLACE_WORDS - {"header"} if own_head else PLACE_WORDS
                place = hidden or name in PLACE_TAGS or (name == "header" and not inside)
                mark = NO_MARK if name in ("html", "body", "article", "main") else _mark(words & marks) or NAMED * (name == "form")
                named = bool(ARTICLE_WORDS & marks) and name in ("div", "section", "td") and not mark
                push(name, place, (name in ARTICLE_TAGS or named) and not place, mark)
    if at < len(html):
        text_of(html[at:])
    text = flush()
    if text:
        yield text, links, stack[-1] if stack else None


def _settle(places: list[_Place | None], nearest: list[_Place | None], size: list[int], speaks: list[int]) -> None:
    """Takes back the marks of elements that hold the page's text, from the innermost outwards, and makes bad what stays
    marked. nearest has the marked element around each block, size its characters, speaks those of blocks that are
    long with many stop words or in an article. A mark goes if what speaks inside is longer than all text beside; one
    that stands for others' text only if the page has no such block without a mark, and it holds most of them. Where an
    article or main element has text without any mark, only marks inside such an element can go."""
    marks: dict[_Place, list[int]] = {}
    for at in nearest:
        while at is not None and at not in marks:
            marks[at] = []
            at = at.around
    if not marks:
        return
    inner_first = sorted(marks, key=lambda m: -m.depth)
    clear = any(n and at is None and place.tagged for n, at, place in zip(speaks, nearest, places) if place is not None)

    def beside() -> int:
        for m in reversed(inner_first):
            m.bad = m.bad or bool(m.mark) or (m.around is not None and m.around.bad)
        return sum(n for n, at in zip(speaks, nearest) if at is None or not at.bad)

    def take_back(kinds: tuple[int, ...], counted: list[int]) -> None:
        inside, text, total = dict.fromkeys(marks, 0), dict.fromkeys(marks, 0), sum(counted)
        for at, n, m in zip(nearest, counted, speaks):
            if at is not None:
                inside[at] += m
                text[at] += n
        for m in inner_first:
            if m.mark in kinds and (OTHERS in kinds or not m.others) and inside[m] > total - text[m] and (m.tagged or not clear):
                m.mark = NO_MARK
            if m.around is not None:
                text[m.around] += text[m]
                inside[m.around] += 0 if m.mark else inside[m]

    hard = {m: m.bad for m in marks}
    take_back((NAMED,), [0 if at is not None and at.others else n for at, n in zip(nearest, size)])
    if not beside():
        for m, bad in hard.items():
            m.bad = bad
        take_back((NAMED, OTHERS), speaks)
        beside()


def main_text(html: str | None) -> str:
    read = list(blocks(html or ""))
    nearest = [None if place is None else place if place.mark else place.around for *_, place in read]
    stops, dense = [], []
    most = {False: [], True: []}  # shares of stop words in long blocks, without and with a mark
    for (text, links, place), near in zip(read, nearest):
        words = text.lower().split()
        stops.append(sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words))
        dense.append(links / max(1, len(text.replace(" ", ""))) > MANY_LINKS)
        if len(text) >= LONG and not dense[-1] and not (place is not None and place.bad):
            most[near is not None].append(stops[-1])
    known = max(most[not most[False]], default=0) >= KNOWN_STOPS  # else in a language without a list
    rich = [len(text) >= LONG and (share >= MIN_LONG_STOPS or not known) and not d for (text, *_), share, d in zip(read, stops, dense)]
    size = [0 if d or (place is not None and place.bad) else len(text) for (text, _, place), d in zip(read, dense)]
    _settle([place for *_, place in read], nearest, size, [n if r or (place is not None and place.article) else 0 for n, r, (*_, place) in zip(size, rich, read)])
    found = [(text, links, place is not None and (place.bad or (near is not None and near.bad) or (near is place and not r)),
              place is not None and place.article) for (text, links, place), near, r in zip(read, nearest, rich)]
    labels = []
    # an article place says something of open blocks if most of the page's long text is in such places
    inside = sum(len(text) if article else -len(text) for (text, _, bad, article), r in zip(found, rich) if r and not bad)
    for (text, _, bad, article), share, d, r in zip(found, stops, dense, rich):
        if bad or d:
            labels.append(BAD)
        elif r or (article and inside >= 0):
            labels.append(GOOD)
        elif len(text) >= LONG and share < FEW_STOPS:
            labels.append(BAD)
        else:
            labels.append(SHORT)
    if GOOD not in labels:
        labels = [GOOD if label == SHORT else label for label in labels]
    decided = [i for i, label in enumerate(labels) if label]
    out, nxt = [], 0
    for i, (text, *_) in enumerate(found):
        while nxt < len(decided) and decided[nxt] < i:
            nxt += 1
        label = labels[i]
        if label == SHORT:
            after = decided[nxt] if nxt < len(decided) else None
            before = decided[nxt - 1] if nxt else None
            if before is None or after is None:
                label = labels[after if before is None else before]
            elif labels[before] == labels[after]:
                label = labels[before]
            else:
                label = labels[before] if i - before < after - i else labels[after] if after - i < i - before else BAD
        if label == GOOD:
            out.append(text)
    return "\n\n".join(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, text, n_chars (code points)."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_texts, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
