"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides what it can from each block: the
elements around it, its link density, its length and its density of stop words. Long prose is good,
links and boilerplate elements are bad, and what is short or has few stop words stays open. In the second
pass open blocks take the label of their nearest decided neighbours: when both sides agree, that one;
else the nearer, and of two equally near ones, good.

A page that has ``article`` or ``main`` elements speaks of its article there: outside them every block
is bad, and inside them a block is never bad for its words alone, so an article in a language without
known stop words, a list of figures or a one-word paragraph is kept. On other pages the words decide.
Linked blocks of an article stay open; where nothing near is decided, linked headings are good and others bad.

Words in class and id names hint at boilerplate, but not after words such as ``no`` or ``has`` and not before
words such as ``open``, which tell of the page's layout. A hinted element is a guess: on a page without an article
elsewhere it is taken back where the element encloses an article that has most of the page's text, or, if the
hint is one of layout, where it holds most of the long prose.

A page of which no long block reaches the lower density of stop words is in a language that the list does not know. There length and link
density decide alone: long blocks and those that end as a sentence are good, others open, and where none is good, all of some
length are. Characters of scripts without spaces count three times.

Pages are rows: each is read whole by one task and nothing is shuffled.

Defined cases: a null or empty html gives an empty text. A tag cut off at the end of the page is
dropped, unclosed elements end with the page or with what encloses them, and an unclosed comment,
script or style reaches to the end. Repeated rows are read each. A very long page is one row and held by one task with its blocks.
Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

MAX_LINK_DENSITY = 0.5
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
STOP_WORDS = frozenset(
    """the of and to a in is that for it was on with as be are this by at from or an not have but they which
    der die das und ist von zu mit den dem ein eine nicht auf für im sich des auch als an es bei aus nach wird
    le la les de des et est un une du que qui dans pour pas sur au par avec ce il sont plus se ne en elle
    el los las y que en un una por con para no es del se lo como más su al o pero sus son""".split()
)
_BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
    select summary table tbody td tfoot th thead title tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea audio video noembed noframes xmp".split())
_BOILER = frozenset("nav aside footer form head title menu dialog select button search".split())
_HINTS = frozenset(
    """ad ads adv advert adverts advertisement adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar sidenav widget menu nav navbar
    navigation breadcrumb breadcrumbs masthead header footer comment comments disqus reply replies related recommended
    share sharing social toolbar pagination pager login signup search skip hidden copyright disclaimer""".split()
)
#: Of the hints, those that no amount of prose takes back.
_STRICT = frozenset(
    """ad ads adv advert adverts advertisement adbox sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal
    newsletter comment comments disqus reply replies related recommended login signup hidden copyright disclaimer""".split()
)
#: Before a hint, after it: the name tells of the layout around the content, or of the content's own header.
_LAYOUT, _STATES = frozenset("no not non has have with without".split()), frozenset("open closed enabled disabled active inactive on off visible".split())
_CONTENT, _TITLES = frozenset("entry post article content story".split()), frozenset("header masthead".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_COMMENTS = frozenset("comment comments reply replies".split())
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*)>""",
    re.DOTALL,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_ENDS = re.compile(r"""[.!?…。！？।۔؟։။។][”"'»）)」』]*$""")
SOFT, STRICT, COMMENTS, HARD = 1, 2, 3, 4


@dataclass
class Block:
    """Text of one block and what stands around it.

    ``wrapper`` is the innermost hinted element around a block that is boilerplate by hints alone (its kind),
    ``held`` says that an article in it encloses the block.
    """

    boiler: bool
    inside: bool
    wrapper: list[int] | None
    held: bool
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    good: bool | None = None


def _hints(value: str, known: frozenset[str], inside: bool) -> set[str]:
    """The hints of a class or id."""
    found = set()
    for name in value.split():
        words = _NAME.findall(name)
        if not words or words[-1] in _STATES:
            continue
        for i, word in enumerate(words):
            if word in _LAYOUT:
                break
            if word in known and not (word in _TITLES and (inside or (i and words[i - 1] in _CONTENT))):
                found.add(word)
    return found


def _boiler(name: str, attributes: str, inside: bool) -> int:
    """0, or how surely an element is boilerplate."""
    if name in _BOILER or (name == "header" and not inside):
        return HARD
    if not attributes or name in ("html", "body", "main"):
        return 0
    kind = 0
    for a in _ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
        if key == "role":
            if value in _ROLES:
                return HARD
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return HARD
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return HARD
        elif key in ("class", "id"):
            if hints := _hints(value, _COMMENTS if name == "article" else _HINTS, inside):
                kind = max(kind, COMMENTS if hints & _COMMENTS else STRICT if hints & _STRICT else SOFT)
    return kind


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[Block] = []
    # open block elements: name, boilerplate, inside the article, hinted element, inside an article of that
    stack: list[tuple[str, bool, bool, list[int] | None, bool]] = []
    links = at = breaks = 0
    heading = False
    block = Block(False, False, None, False, False)

    def end() -> None:
        nonlocal block
        if block.pieces:
            block.text = " ".join("".join(block.pieces).split())
            if block.text:
                found.append(block)
        block = Block(*(stack[-1][1:] if stack else (False, False, None, False)), heading)

    def say(text: str) -> None:
        nonlocal breaks
        text = html.unescape(text) if "&" in text else text
        block.pieces.append(text)
        if not text.isspace():
            breaks = 0
        if links:
            block.linked += len("".join(text.split()))

    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        tag = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not tag:
            say("<")
            at = start + 1
            continue
        at = tag.end()
        if not tag.lastindex:
            continue
        closing, name, attributes = tag[1], tag[2].lower(), tag[3] or ""
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else n
                block.pieces.append(" ")
            continue
        if name == "br":
            breaks += 1
            block.pieces.append(" ")
            if breaks == 2:
                end()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        hinted = name not in _BLOCK and not closing and attributes and name not in _VOID and _boiler(name, attributes, bool(stack and stack[-1][2]))
        if name not in _BLOCK and not hinted and not (closing and any(e[0] == name for e in stack)):
            continue
        # a block element, or an inline one that is boilerplate by its attributes
        links, breaks = 0, 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            heading = False
        elif name not in _VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
            if name == "body":
                stack[:] = [e for e in stack if e[0] == "html"]
            boiler, inside, wrapper, held = stack[-1][1:] if stack else (False, False, None, False)
            kind, main = _boiler(name, attributes, inside or held), name in ("article", "main")
            if kind == HARD or (boiler and not wrapper):
                wrapper, held = None, False
            elif kind:
                wrapper, held = [kind], False
            elif wrapper:
                held = held or main
            boiler = boiler or kind > 0
            stack.append((name, boiler, (inside or main) and not (boiler and not inside), wrapper, held))
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        end()
    end()
    return found


def _linked(block: Block) -> bool:
    return block.linked > MAX_LINK_DENSITY * max(1, len(block.text) - block.text.count(" "))


def _stops(block: Block) -> float:
    words = _WORD.findall(block.text.casefold())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def _take_back(found: list[Block]) -> None:
    """Frees what hints alone call boilerplate, on a page without another article."""
    spoken = [b for b in found if (b.held or b.wrapper[0] == SOFT if b.wrapper else not b.boiler) and not _linked(b)]
    prose = [b for b in spoken if len(b.text) > LONG and _stops(b) >= STOP_HIGH]
    for wrapper in {id(b.wrapper): b.wrapper for b in spoken if b.wrapper}.values():
        own = [b for b in found if b.wrapper is wrapper]
        share = sum(len(b.text) for b in spoken if b.wrapper is wrapper and b.held)
        if wrapper[0] < COMMENTS and 2 * share > sum(len(b.text) for b in spoken):
            for b in own:
                b.boiler, b.inside = not b.held, b.held
        elif wrapper[0] == SOFT and 2 * sum(len(b.text) for b in prose if b.wrapper is wrapper) > sum(len(b.text) for b in prose):
            for b in own:
                b.boiler = False


def classify(found: list[Block]) -> list[Block]:
    """Sets ``good`` of every block."""
    if any(b.wrapper for b in found) and not any(b.inside for b in found):
        _take_back(found)
    has_article = any(b.inside for b in found)
    foreign = not any(_weight(b) >= SHORT and _stops(b) >= STOP_LOW for b in found if not b.boiler and not _linked(b))
    for b in found:
        if foreign and not (b.boiler or _linked(b) or (has_article and not b.inside)):
            sentence = _weight(b) > LONG or (_weight(b) >= SHORT // 2 and _ENDS.search(b.text) is not None)
            b.good = True if sentence and not b.inside else None
            if not b.inside and "©" in b.text and len(b.text) < LONG:
                b.good = False
            continue
        length, dense = len(b.text), _linked(b)
        if b.boiler or (dense and not b.inside) or (has_article and not b.inside):
            b.good = False
            continue
        if dense:
            continue
        stops = _stops(b)
        if length > LONG and stops >= STOP_HIGH:
            b.good = True
        elif b.inside or b.heading or length < SHORT or stops >= STOP_LOW:
            b.good = None
        else:
            b.good = False
        if not b.inside and "©" in b.text and length < LONG:
            b.good = False
    if foreign and not any(b.good for b in found):
        for b in found:
            if b.good is None and not b.inside and not _linked(b) and _weight(b) >= SHORT:
                b.good = True
    # second pass: nearest decided neighbours of the same region; boilerplate says nothing of an article beside it
    for region in (True, False):
        part = [b for b in found if b.inside == region and not (region and b.good is False)]
        decided = [b.good for b in part]
        before: list[tuple[int, bool | None]] = []
        last: tuple[int, bool | None] = (-1, None)
        for i, good in enumerate(decided):
            last = (i, good) if good is not None else last
            before.append(last)
        last = (-1, None)
        for i in range(len(part) - 1, -1, -1):
            if decided[i] is not None:
                last = (i, decided[i])
                continue
            (p, left), (q, right) = before[i], last
            if left is None and right is None:
                part[i].good = (part[i].heading or not _linked(part[i])) if region else _prose(part[i])
            elif left is None or right is None:
                part[i].good = right if left is None else left
            else:
                part[i].good = left if left == right or i - p < q - i else right if q - i < i - p else True
    return found


def _weight(block: Block) -> int:
    """Length, with characters of scripts without spaces counted three times."""
    return len(block.text) + 2 * len(_UNSPACED.findall(block.text))


def _prose(block: Block) -> bool:
    """For a page without any decided block: does the block read as a sentence?"""
    words = _WORD.findall(block.text.casefold())
    return len(words) > 3 and sum(map(STOP_WORDS.__contains__, words)) >= STOP_LOW * len(words)


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.good)


def extract(pages: DataFrame) -> DataFrame:
    """Per page its id, its url, the main text and the text's code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = batch["html"].map(main_text)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": text.map(len).astype("int64")})

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
