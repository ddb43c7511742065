"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements. The first pass decides what it can from a block
alone: marked boilerplate, link density, length and stop-word density. The second pass gives each
block that is still open, mostly short ones, the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to a in that is it for on are with as was be by this from at or an not have "
          "has but which you they his her we their been were will would there can all if one",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
          "an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il "
          "sont la avec son elle aux ou mais leur cette nous vous",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus "
          "le ha me si sin sobre este ya entre cuando",
}
# Elements whose text is never part of an article …
DROPPED = set("script style noscript template iframe object svg math canvas select datalist button "
              "textarea title audio video map".split())
BOILERPLATE = set("nav aside footer form menu dialog fieldset".split())
# … elements that hold several blocks, and those that part blocks
CONTAINERS = set("html body main article section div nav aside header footer form menu dialog "
                 "fieldset ul ol dl table tbody thead tfoot tr figure details blockquote "
                 "center hgroup search address".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre hr legend "
                          "summary option".split())
# … and words of class, id and role names that mark what isn't the article
MARKS = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo "
            "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar "
            "footer masthead cookie cookies consent gdpr notice notices newsletter subscribe "
            "subscription signup login popup modal overlay share sharing social related recommended "
            "teaser teasers widget toolbar skip complementary contentinfo search alert".split())
COMMENTS = set("comment comments commentlist reply replies respond disqus discussion".split())

#: Shares of link characters and of stop words, and lengths in code points, that decide a block.
MOST_LINKS, LINKS_OF_ARTICLE = 0.2, 0.5
FEW_STOPS, MANY_STOPS = 0.15, 0.30
SHORT, LONG = 70, 200

GOOD, NEAR, OPEN, BAD = "good", "near", "open", "bad"

_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
_TAG_END = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKING = re.compile(
    r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END_OF = {name: re.compile(f"</{name}(?![a-z0-9])", re.I) for name in DROPPED}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    marked: bool
    #: Number of the innermost article or main element around the block, 0 outside of any.
    scope: int
    #: Number of the innermost element around the block that holds several.
    parent: int
    label: str = OPEN


@dataclass
class _Element:
    name: str
    #: Whether its text is boilerplate by its own mark, and whether that mark is only a name.
    marked: bool
    named: bool
    scope: int
    number: int
    first: int  # index of its first block


def _mark(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """(boilerplate, by a name only, reader comments) for a start tag."""
    if not attributes:
        return name in BOILERPLATE, False, False
    marked, named, comments = name in BOILERPLATE, False, False
    for m in _MARKING.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                key == "style" and _HIDDEN.search(value)):
            marked = True
        elif key in ("class", "id", "role") and name not in ("html", "body", "main"):
            parts = set(_PARTS.findall(_CAMEL.sub(" ", value).lower()))
            if parts & COMMENTS:
                marked = comments = True
            elif name != "article" and parts & MARKS:
                marked = named = True
    return marked, named, comments


class _Reader:
    """Blocks of one page, from a single walk over its markup."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.sizes = [0]  # code points of all blocks up to each
        self.stack: list[_Element] = []
        self.opened: Counter[str] = Counter()  # names on the stack
        self.marks = 0  # marked elements on the stack
        self.numbers = 0
        self.text: list[tuple[str, bool]] = []
        self.links = 0
        self.heading = False
        self.breaks = 0
        self.scopes = 0
        self.unclosed: set[str] = set()  # names without a further end tag

    def scope(self) -> int:
        return self.stack[-1].scope if self.stack else 0

    def flush(self) -> None:
        if self.text:
            pieces = [(entities.unescape(t), link) for t, link in self.text]
            whole = " ".join("".join(t for t, _ in pieces).split())
            if whole:
                linked = sum(len("".join(t.split())) for t, link in pieces if link)
                self.blocks.append(Block(whole, linked, self.heading, self.marks > 0, self.scope(),
                                         self.stack[-1].number if self.stack else 0))
                self.sizes.append(self.sizes[-1] + len(whole))
            self.text = []
        self.breaks = 0

    def add(self, text: str) -> None:
        if text:
            if self.breaks and not text.isspace():
                self.breaks = 0
            # a reference is never continued by what follows a tag
            self.text.append((text, self.links > 0))

    def open(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links = 1
        elif name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            else:
                self.text.append((" ", False))
        elif name in BLOCKS:
            self.flush()
            self.links = 0
            self.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name in CONTAINERS:
                self.push(name, attributes)

    def push(self, name: str, attributes: str) -> None:
        marked, named, comments = _mark(name, attributes)
        article = name in ("main", "article") and not comments
        if article and self.marks:
            # what should have been closed before the article is: else its end would be lost
            for k, e in enumerate(self.stack):
                if e.marked and (e.named or e.name in BOILERPLATE or e.name == "header"):
                    self.leave(k)
                    break
        scope = self.scope()
        if name == "header" and not scope:
            marked = True
        if article:
            self.scopes += 1
            scope = self.scopes
        self.numbers += 1
        self.marks += marked
        self.opened[name] += 1
        self.stack.append(_Element(name, marked, named, scope, self.numbers, len(self.blocks)))

    def leave(self, k: int) -> None:
        """Close the element ``k`` of the stack and all within it."""
        while len(self.stack) > k:
            e = self.stack.pop()
            self.marks -= e.marked
            self.opened[e.name] -= 1
            if e.named and not self.marks:
                self.revoke(e)

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        elif name in BLOCKS:
            self.flush()
            self.links, self.heading = 0, False
            if name in CONTAINERS and self.opened[name]:
                self.leave(max(k for k, e in enumerate(self.stack) if e.name == name)
                           if self.stack[-1].name != name else len(self.stack) - 1)

    def revoke(self, e: _Element) -> None:
        """A mark by name only doesn't count where the element holds a heading and half the page."""
        half = 2 * (self.sizes[-1] - self.sizes[e.first]) > self.sizes[-1]
        if half and any(b.heading for b in self.blocks[e.first:e.first + 3]):
            for b in self.blocks[e.first:]:
                b.marked = False

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        while at < end:
            start = page.find("<", at)
            if start < 0:
                self.add(page[at:])
                break
            self.add(page[at:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 2)
                at = end if stop < 0 else stop + 3
                continue
            if page[start + 1:start + 2] in ("!", "?"):
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
                continue
            m = _NAME.match(page, start + 1)
            if not m:
                self.add("<")
                at = start + 1
                continue
            stop = _TAG_END.match(page, m.end())
            # a quote that is never closed, or a tag that the page's end cuts off
            close = stop.end() if stop else page.find(">", m.end()) + 1
            if not close:
                break
            name, attributes = m[1].lower(), page[m.end():close - 1]
            at = close
            if page[start + 1] == "/":
                self.close(name)
                continue
            if name in DROPPED:
                if attributes.endswith("/") and name in ("svg", "math", "object"):
                    continue
                stop = None if name in self.unclosed else _END_OF[name].search(page, at)
                if not stop:  # never closed: only the tag goes, scripts and styles to the end
                    self.unclosed.add(name)
                    if name in ("script", "style"):
                        at = end
                    continue
                gt = page.find(">", stop.end())
                at = end if gt < 0 else gt + 1
                continue
            self.open(name, attributes)
        self.flush()
        self.leave(0)
        return self.blocks


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in _STOPS for w in words) / len(words) if words else 0.0


def first_pass(blocks: list[Block]) -> None:
    """Labels that a block's own text decides."""
    for b in blocks:
        size = max(1, len(b.text) - b.text.count(" "))
        links = b.link_chars / size
        if b.marked or links > (LINKS_OF_ARTICLE if b.scope else MOST_LINKS):
            b.label = BAD
        elif "©" in b.text and len(b.text) < LONG and not b.scope:
            b.label = BAD
        elif len(b.text) < SHORT or b.heading:
            b.label = OPEN
        else:
            stops = stop_density(b.text)
            if stops >= MANY_STOPS and len(b.text) > LONG:
                b.label = GOOD
            elif stops >= FEW_STOPS:
                b.label = GOOD if b.scope else NEAR
            else:
                b.label = OPEN


def second_pass(blocks: list[Block]) -> list[bool]:
    """Whether each block belongs to the article: open ones as their nearest decided neighbours.

    Neighbours are looked for within the same article element, whose edges count as good; outside
    of any, the page's edges count as bad and a heading goes with what follows it. Where both
    sides differ, the nearer one counts; at equal distance the one within the same element, and if
    that is neither or both, near-good blocks are good and others bad.
    """
    n = len(blocks)
    before: list[tuple[bool, int, int]] = [(False, 0, 0)] * n
    after: list[tuple[bool, int, int]] = [(False, 0, 0)] * n
    decided = any(b.label == GOOD for b in blocks)

    def walk(order: range, seen: list[tuple[bool, int, int]]) -> None:
        good, distance, parent, scope = False, 1, -1, 0
        for k in order:
            b = blocks[k]
            if b.scope != scope:
                scope = b.scope
                # text of another element decides nothing about an article's
                good, distance = (True, 1) if scope else (good, distance)
            seen[k] = (good, distance, parent)
            if b.label in (GOOD, BAD):
                if b.label == GOOD or not (b.scope and b.marked):
                    good, distance, parent = b.label == GOOD, 1, b.parent
            else:
                distance += 1

    walk(range(n), before)
    walk(range(n - 1, -1, -1), after)
    kept = []
    for k, b in enumerate(blocks):
        if b.label in (GOOD, BAD):
            kept.append(b.label == GOOD)
            continue
        (left, to_left, by_left), (right, to_right, by_right) = before[k], after[k]
        if not decided and not b.scope:
            kept.append(b.label == NEAR)
        elif left == right:
            kept.append(left)
        elif b.heading:
            kept.append(right)
        elif to_left != to_right:
            kept.append(left if to_left < to_right else right)
        elif (by_left == b.parent) != (by_right == b.parent):
            kept.append(left if by_left == b.parent else right)
        else:
            kept.append(b.label == NEAR)
    return kept


def main_text(page: str | None) -> str:
    """The article of a whole page, blocks parted by an empty line; empty if there is none."""
    if not page:
        return ""
    blocks = _Reader().read(page)
    first_pass(blocks)
    return "\n\n".join(b.text for b, keep in zip(blocks, second_pass(blocks)) if keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
            ) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null or empty page has an empty text; null ids and urls stay null and repeated rows are
    taken each. Pages of any length are read whole, in time in proportion. No rows: no rows.
    Further columns are left out.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                     texts(F.col(html)).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long")))
