"""HTML main text by two-pass block rules.

First pass: stop-word density, length and link density decide blocks; containers
that never hold an article (menus, forms, comments, ...) decide theirs.  Second
pass: blocks too short or too mixed to decide take the label of the nearest
decided block of the same container.  A page where nothing is surely the article
keeps every block that is not surely something else.

Input: pages with an id, a url and html.  Null and empty html give an empty text;
markup cut off anywhere is read as far as it goes.  Every row is extracted for
itself, so null ids, ties and repeated rows go through unchanged.  Extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the four languages.
STOP_WORDS = frozenset(
    (
        "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they "
        "which one you were all her she there would their we him been has when who will no more if out so said what "
        "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce se sa son il elle ne plus ou "
        "der die das und den dem des ein eine einer eines zu von mit ist im auf für sich nicht es auch als an nach wie "
        "bei aus zum zur sind er sie über wird oder am um "
        "el los las y o del al una con por para su sus no lo como más se es entre sobre"
    ).split()
)

# Elements whose content is never text of a page.
RAW = "script|style|title|textarea"  # to their end tag, or to the end of the page
SILENT = "template|noscript|svg|math|iframe|object|canvas|select|button|audio|video|map"  # only where they are closed
# Elements that begin or end a block.
BLOCKS = frozenset(
    (
        "html body div p article main section nav aside header footer form fieldset ul ol li dl dt dd table thead tbody tfoot "
        "tr td th caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 hr address details summary center dialog menu search"
    ).split()
)
CONTAINERS = frozenset("div article main section nav aside header footer form fieldset ul ol li table figure dialog menu details search".split())
BOILER_TAGS = frozenset("nav aside footer form fieldset dialog menu search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
# Words of a class or id that name something other than the article.
BOILER_NAMES = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
        "menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar toolbar cookie cookies "
        "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
        "comment comments commentlist reply replies respond disqus discussion share sharing social related recommended "
        "recommendations trending pagination pager skip copyright legal disclaimer tags taglist metadata byline"
    ).split()
)
ARTICLE_NAMES = frozenset("article content main post entry story body text".split())

# Those of them that stand even beside a word for the article.
STRONG_NAMES = BOILER_NAMES - frozenset(
    "header masthead banner notice notices notification legal copyright disclaimer alert discussion reply tags taglist metadata byline widget widgets aside skip overlay".split()
)

ATTRIBUTES = r"\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
SILENCE = re.compile(rf"<!--|<({RAW}){ATTRIBUTES}|<({SILENT}){ATTRIBUTES}", re.S | re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RAW.split("|"), *SILENT.split("|"))}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z")
NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PARTS = re.compile(r"[a-z]+")
MARKS = re.compile(r"^\W+|\W+$")

LONG = 70  # characters from which a block can be decided by its words
DENSE, SPARSE = 0.2, 0.08  # share of stop words: surely prose; surely not
LINKED = 0.5  # share of characters inside links: surely a menu


class Block:
    __slots__ = ("text", "linked", "boiler", "inside", "box", "heading", "good")

    def __init__(self, text, linked, boiler, inside, box, heading):
        self.text, self.linked, self.boiler, self.inside, self.box, self.heading = text, linked, boiler, inside, box, heading
        self.good: bool | None = None


def _kind(tag: str, attributes: str, inside: bool, names: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate for certain, and whether it is an article's own container.

    ``names``: whether the words of its class and id count.
    """
    words: set[str] = set()
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in BOILER_ROLES:
            return True, False
        if name == "hidden" and "hidden" in attributes.lower().replace("aria-hidden", "") or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if names and name in ("class", "id"):
            words.update(PARTS.findall(value))
    own = tag in ("article", "main")
    named = words & BOILER_NAMES and not (words & ARTICLE_NAMES and not words & STRONG_NAMES)
    if tag in BOILER_TAGS or tag == "header" and not inside:
        return True, False
    return bool(named) and not own, own


def spoken(page: str) -> str:
    """The page without comments and elements that are never text.

    An end that was once sought in vain is not sought again, so elements left
    open cost no more than closed ones.
    """
    out, at, endless = [], 0, set()
    while m := SILENCE.search(page, at):
        name = (m[1] or m[2] or "").lower()
        if name in endless:
            out.append(page[at : m.end()])
            at = m.end()
            continue
        if name:
            end = ENDS[name].search(page, m.end())
            stop = end.end() if end else None
        else:
            stop = page.find("-->", m.end())
            stop = stop + 3 if stop >= 0 else None
        if stop is None and m[2]:
            endless.add(name)
            out.append(page[at : m.end()])
            at = m.end()
            continue
        out.append(page[at : m.start()])
        at = len(page) if stop is None else stop
    out.append(page[at:])
    return "".join(out)


def blocks_of(page: str, names: bool = True) -> list[Block]:
    """Blocks in page order, with what their containers say about them."""
    page = spoken(page)
    stack: list[tuple[str, bool, bool, int]] = []  # tag, boiler, inside an article, number of the article's box
    found: list[Block] = []
    text: list[str] = []
    linked = boxes = at = 0
    in_link = heading = False

    def close():
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                top = stack[-1] if stack else ("", False, False, 0)
                found.append(Block(line, linked, top[1], top[2], top[3], heading))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "a":
            in_link = not m[1]
        elif tag in ("br", "wbr", "img", "input"):
            add(" ")
        elif tag in BLOCKS:
            close()
            heading = tag[0] == "h" and tag[1:].isdigit() and not m[1]
            if tag not in CONTAINERS:
                continue
            in_link = False
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif not m[3].endswith("/"):
                _, boiler, inside, box = stack[-1] if stack else ("", False, False, 0)
                bad, own = _kind(tag, m[3], inside, names)
                if own and not inside:
                    boxes += 1
                    box = boxes
                stack.append((tag, boiler or bad, inside or own, box))
    add(page[at:])
    close()
    return found


def decide(found: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    for b in found:
        words = [MARKS.sub("", w) for w in b.text.lower().split()]
        dense = sum(w in STOP_WORDS for w in words) / len(words)
        links = b.linked / len(b.text)
        if b.boiler or links > LINKED:
            b.good = False
        elif len(b.text) >= LONG:
            if dense >= DENSE:
                b.good = True
            elif dense < SPARSE and not b.inside:
                b.good = False
            elif b.inside and links < 0.2:
                b.good = True
    labels = [b.good for b in found]
    before, after = _neighbours(found, labels, 1), _neighbours(found, labels, -1)
    # Nothing on the page is surely the article: what is not surely something else is all there is.
    only = not any(labels) and not any(b.inside and labels[i] is None for i, b in enumerate(found))
    for i, b in enumerate(found):
        if labels[i] is not None:
            continue
        near = [(abs(i - j), side, j) for side, j in ((b.heading, before[i]), (not b.heading, after[i])) if j is not None]
        # A heading belongs to what follows; otherwise what precedes comes first.
        b.good = True if only else labels[min(near)[2]] if near else b.inside


def _neighbours(found: list[Block], labels: list, step: int) -> list[int | None]:
    """For every block the nearest decided one of its box on one side, boilerplate left out."""
    last: dict[int, int] = {}
    out: list[int | None] = [None] * len(found)
    for i in range(len(found))[::step]:
        out[i] = last.get(found[i].box)
        if labels[i] is not None and not found[i].boiler:
            last[found[i].box] = i
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    # A container of everything may be named after a part of it; a page left without text is read without names.
    for names in (True, False):
        found = blocks_of(page, names)
        decide(found)
        if any(b.good for b in found):
            break
    return " ".join(b.text for b in found if b.good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.pandas_udf(run, "string")(F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text")).select(
        "*", F.char_length("text").cast("long").alias("n_chars")
    )
