"""A lenient reading of HTML into block elements and texts, and block features.

Inline elements melt into the block that holds them. Scripts, styles, heads and
controls are left out while reading.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Kinds of elements in the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head script style textarea title xmp iframe noembed noframes template svg math select "
                     "button option object video audio canvas".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# What may stand in a head; any other start tag ends one that is still open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# What a start tag closes, and the elements that shield what lies outside of them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
          "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
          "body": ({"head"}, set())}

# Words in class, id and role that hint at content or at what surrounds it.
FOR = frozenset("article content entry main post story text body prose".split())
AGAINST = frozenset(
    "ad ads advert advertisement advertising banner bottom breadcrumb breadcrumbs byline captcha comment comments "
    "complementary contentinfo cookie cookies copyright discussion disqus footer foot form gdpr header login masthead "
    "menu message modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion rail "
    "recommended related remark replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "tags teaser toolbar topbar widget alert consent search".split())
TAGS_FOR = frozenset("article main".split())
TAGS_AGAINST = frozenset("nav aside footer form header menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = (
    "text", "own_text", "words", "link_share", "density", "tags", "stops", "paragraphs", "depth", "place",
    "sibling_place", "siblings", "sibling_text", "sibling_links", "parent_text", "parent_links", "is_p",
    "is_heading", "is_list", "is_cell", "tag_for", "tag_against", "words_for", "words_against",
    "above_for", "above_against", "inner_against", "capital", "comma_share")
#: The features that tell of markup meant for readers of the markup.
SEMANTIC = [FEATURES.index(n) for n in ("tag_for", "tag_against", "words_for", "words_against",
                                        "above_for", "above_against", "inner_against")]


@dataclass
class Page:
    """Blocks by number, the root being 0; texts as (block, run, text, in a link).
    A run is a stretch without a block's start or end."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    hints: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    texts: list[tuple[int, int, str, bool]] = field(default_factory=list)


def _hints(attributes: str) -> tuple[int, int]:
    """How many words in class, id and role speak for and against content."""
    words = set()
    for groups in _ATTRIBUTE.findall(attributes):
        words.update(_TOKEN.findall(_CAMEL.sub(" ", "".join(groups)).lower()))
    return len(words & FOR), len(words & AGAINST)


def read_page(source: str) -> Page:
    page, stack, run, at = Page(), [("#root", 0)], 0, 0
    hidden = links = 0  # open elements that are left out; open links

    def say(text: str) -> None:
        if text and not hidden:
            page.texts.append((stack[-1][1], run, html.unescape(text) if "&" in text else text, links > 0))

    def drop(place: int) -> None:
        """Closes all elements from a place of the stack on."""
        nonlocal hidden, links, run
        for name, _ in stack[place:]:
            hidden -= name in LEFT_OUT
            links -= name == "a"
            run += name not in INLINE
        del stack[place:]

    def innermost(names: set | frozenset, shields: set) -> int:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place][0] in names:
                return place
            if stack[place][0] in shields:
                break
        return 0

    find = _TAG.search
    while (m := find(source, at)) is not None:
        say(source[at: m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            place = innermost({name}, set())
            if place and name in INLINE and any(n not in INLINE for n, _ in stack[place + 1:]):
                links -= name == "a"
                del stack[place]  # ends an inline element around open blocks
            elif place:
                drop(place)
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            drop(len(stack) - 1)
        if name in ENDS_P:
            place = innermost({"p"}, {"table", "td", "th", "button", "object"})
            if place:
                drop(place)
        if name in CLOSES:
            # tr closes an open cell together with its row
            while place := innermost(*CLOSES[name]):
                drop(place)
        if name in VOID:
            run += name == "hr"
            if name == "br":
                say(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            continue
        block = stack[-1][1]
        if name not in INLINE:
            run += 1
            page.tags.append(name)
            page.parents.append(block)
            page.hints.append(_hints(attributes) if "=" in attributes else (0, 0))
            block = len(page.tags) - 1
        hidden += name in LEFT_OUT
        links += name == "a"
        stack.append((name, block))
    say(source[at:])
    return page


def _totals(values: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Sums over subtrees; children have larger numbers than their parents."""
    out = values.tolist()
    for n in range(len(out) - 1, 0, -1):
        out[parents[n]] += out[n]
    return np.array(out, float)


def features(page: Page) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(page.tags)
    parents = page.parents
    own = np.zeros((n, 6))  # characters, characters in links, words, stops, commas, capitals
    for block, _, text, linked in page.texts:
        size = len(text) - text.count(" ")
        row = own[block]
        row[0] += size
        row[1] += size * linked
        row[2] += text.count(" ") + (size > 0)
        row[3] += text.count(". ") + text.endswith(".") + text.count("!") + text.count("?")
        row[4] += text.count(",")
        row[5] += text[:1].isupper()
    tags = page.tags
    is_p = np.array([t == "p" for t in tags], float)
    against_tag = np.array([t in TAGS_AGAINST for t in tags], float)
    for_tag = np.array([t in TAGS_FOR for t in tags], float)
    words_for, words_against = (np.array([h[k] for h in page.hints], float) for k in (0, 1))
    chars, linked, words, stops, commas = (_totals(own[:, k], parents) for k in range(5))
    count = _totals(np.ones(n), parents)
    paragraphs = _totals(is_p, parents)
    inner_against = _totals(np.minimum(against_tag + words_against, 1), parents)
    depth, above_for, above_against = np.zeros(n), np.zeros(n), np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        p = parents[k]
        children[p].append(k)
        depth[k] = depth[p] + 1
        above_for[k] = max(above_for[p], for_tag[p], min(words_for[p], 1))
        above_against[k] = max(above_against[p], against_tag[p], min(words_against[p], 1))
    place, siblings, sibling_chars, sibling_linked = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for p in range(n):
        if inner := children[p]:
            m = len(inner)
            total, total_linked = chars[inner].sum(), linked[inner].sum()
            place[inner] = np.arange(m) / m
            siblings[inner] = m
            sibling_chars[inner] = (total - chars[inner]) / max(m - 1, 1)
            sibling_linked[inner] = (total_linked - linked[inner]) / np.maximum(total - chars[inner], 1)
    up = np.array(parents)
    up[0] = 0
    share = linked / np.maximum(chars, 1)
    log = np.log1p
    columns = [
        log(chars), log(own[:, 0]), log(words), share, log(chars / count), log(count),
        log(stops), log(paragraphs), depth, np.arange(n) / n, place, log(siblings), log(sibling_chars),
        sibling_linked, log(chars[up]), share[up], is_p, np.array([t in HEADINGS for t in tags]),
        np.array([t in ("ul", "ol", "li", "dl", "menu") for t in tags]),
        np.array([t in ("table", "tr", "td", "th", "tbody") for t in tags]),
        for_tag, against_tag, np.minimum(words_for, 2), np.minimum(words_against, 2), above_for, above_against,
        log(inner_against), own[:, 5] > 0, commas / np.maximum(words, 1)]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def text_of(page: Page, kept: np.ndarray) -> str:
    """The texts of the kept blocks: white space within a run is one space, runs
    stand on lines of their own."""
    lines, last, parts = [], None, []
    for block, run, text, _ in page.texts:
        if run != last:
            lines.append("".join(parts))
            parts, last = [], run
        if kept[block]:
            parts.append(text)
    lines.append("".join(parts))
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)
