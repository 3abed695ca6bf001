"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags.  First pass: markup decides where it speaks (menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are dropped, blocks of an article or main element
are kept unless they are mere links); where it is silent, length, link density and the density of stop words
decide.  Short blocks without clear signs stay open.  Second pass: an open block takes the label of its nearest
decided neighbours; between two labels the nearer wins, and a heading goes with what follows it.

A class, id or role names what is around an article if one of its names holds such a word and beside it plain words
only (``sidebar-left``, but not ``social-science``); attributes go by their names, so a title that says "hidden" hides nothing.

Null or empty html gives an empty text, and an empty table no rows.  Unclosed elements end with their parents, and a tag cut off by the end of
the page is dropped.  A page of any length and any markup is read once, in time and memory that grow with its length.  Between two
labels equally near an open block counts as text.  Repeated rows are read each; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemeter.llm.stopwords import STOP_WORDS

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|select|button|noembed|noframes|xmp"
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr
 ul""".split())
_NO_TEXT = frozenset("nav footer aside form menu dialog head".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name what is around an article.
_AROUND = frozenset("""ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar menu nav navbar navigation
 breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe subscription share sharing
 social comment comments disqus replies respond related recommended widget pagination pager login signup toolbar copyright
 complementary contentinfo search alert""".split())

# Words that beside one of those above say no more than which part or form of it is meant.
_PLAIN = frozenset("""area bar block body bottom box btn button buttons card cell col column container content entry fixed form global group header heading holder
 icon icons id image images inner item items js label large left level link links list local main mid middle mobile module notification outer page panel
 part policy post posts primary right row secondary section shell site slot small static sticky strip tab tabs text thread title toggle top unit
 up view with wrap wrapper zone""".split())

# Possessive throughout: what one part has taken is not tried in another way, so every place of a page is read a bounded number of times.
_ATTRIBUTES = r"(?>[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{_ATTRIBUTES}(?:(?<=/)>|>?.*?(?:</\1\s*>|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>?|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]++)))?")
_NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Characters, stop-word and link shares of the first pass where markup is silent.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.25, 0.2
GOOD, BAD, OPEN = 1, -1, 0
#: Elements that a stray inline end tag does not reach out of.
_WALLS = frozenset("article main nav aside footer td th".split())


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    region: int  # BAD around an article, GOOD inside one, OPEN if markup is silent
    label: int = OPEN


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by name in lower case; of equal names the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _around(name: str) -> bool:
    """Whether one name of a class, id or role means what is around an article: a word that says so, and beside it plain words only."""
    parts = {p.lower() for p in _NAME_PARTS.findall(name)}
    return not _AROUND.isdisjoint(parts) and parts <= _AROUND | _PLAIN


def _region(tag: str, raw: str, now: int, in_article: bool) -> int:
    if tag in _NO_TEXT or (tag == "header" and now != GOOD):
        return BAD
    found = _attributes(raw) if raw and not raw.isspace() else {}
    names = [n for c in ("class", "id", "role") for n in found.get(c, "").split()]
    if any(map(_around, names)):
        # an article is around the text if nothing else names it, or as part of another (a reader's comment) or of what is around
        alone = _AROUND.issuperset(p.lower() for n in names for p in _NAME_PARTS.findall(n))
        own = tag == "main" or (tag == "article" and now != BAD and not in_article and not alone)
        if not own and tag not in ("html", "body"):
            return BAD
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(found.get("style", "")):
        return BAD
    return GOOD if tag in _ARTICLE or "article" in (n.lower() for n in names) else now


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, region, hard: an article inside does not lift it
    places: dict[str, list[int]] = {}  # of each element's name, where it is in the stack
    walls: list[int] = []
    pieces: list[str] = []
    linked = links = 0
    region, heading = OPEN, False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            pieces.append(plain)
            if links:
                linked += len(plain.strip())

    def close() -> None:
        nonlocal linked
        if pieces:
            plain = " ".join("".join(pieces).split())
            if plain:
                out.append(Block(plain, linked, heading, region))
        pieces.clear()
        linked = 0

    def cut_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        while walls and walls[-1] >= k:
            walls.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        ends, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
        if name in _BLOCKS:
            close()
        if ends:
            if name == "a":
                links = max(0, links - 1)
            own = places.get(name)
            if own and (name in _BLOCKS or not walls or walls[-1] <= own[-1]):
                cut_to(own[-1])
        elif name not in _VOID:
            if name == "a":
                links += 1
            hard = bool(stack) and stack[-1][2]
            new = BAD if hard else _region(name, attributes, stack[-1][1] if stack else OPEN, name == "article" and bool(places.get(name)))
            if name == "p":
                while stack and stack[-1][0] == "p":
                    cut_to(len(stack) - 1)
            if name in _BLOCKS or new != (stack[-1][1] if stack else OPEN):
                # what an article calls its surroundings stays out, whatever it holds
                places.setdefault(name, []).append(len(stack))
                if name in _WALLS:
                    walls.append(len(stack))
                stack.append((name, new, hard or name in _NO_TEXT or (new == BAD and region == GOOD)))
        if name in _BLOCKS:
            links = 0 if ends and name != "a" else links
            region = stack[-1][1] if stack else OPEN
            heading = not ends and name in _HEADINGS
        elif (stack[-1][1] if stack else OPEN) != region:
            close()
            region = stack[-1][1] if stack else OPEN
    text(page[at:])
    close()
    return out


def classify(blocks: list[Block]) -> None:
    """Both passes; sets every block's label."""
    article = any(b.region == GOOD for b in blocks)
    for b in blocks:
        words = b.text.split()
        stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
        links = b.linked / len(b.text)
        if b.region == BAD or (article and b.region == OPEN):
            b.label = BAD
        elif b.region == GOOD:
            b.label = BAD if links > 0.8 and not b.heading else GOOD if len(words) >= 5 or stops > 0 else OPEN
        elif links > LINKS:
            b.label = BAD
        elif b.heading or len(b.text) < SHORT:
            b.label = BAD if b.linked else OPEN
        elif stops >= STOP_HIGH or (stops >= STOP_LOW and len(b.text) >= LONG):
            b.label = GOOD
        elif stops < STOP_LOW:
            b.label = BAD
    for same in (GOOD, OPEN):  # inside an article only its own blocks are neighbours
        row = [b for b in blocks if b.region == same]
        left, lefts = (OPEN, 0), []
        for i, b in enumerate(row):
            lefts.append(left)
            if b.label != OPEN:
                left = (b.label, i)
        right, ends = (OPEN, 0), []
        for i in range(len(row) - 1, -1, -1):
            if row[i].label != OPEN:
                right = (row[i].label, i)
            else:
                ends.append((i, lefts[i], right))
        for i, (a, k), (z, n) in ends:
            if a == OPEN or z == OPEN or a == z:
                row[i].label = a or z or (GOOD if same == GOOD else BAD)
            else:
                row[i].label = z if row[i].heading or n - i < i - k else a if i - k < n - i else GOOD


def main_text(page: str | None) -> str:
    """The kept blocks in page order, one to a line."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every page; a narrow map without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["k0", "k1", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    found = pages.select(pages[key].alias("k0"), pages[url].alias("k1"), pages[source].alias("__html")).mapInArrow(
        run, f"k0 {kinds[0]}, k1 {kinds[1]}, text string, n_chars long")
    return found.withColumnsRenamed({"k0": key, "k1": url})
