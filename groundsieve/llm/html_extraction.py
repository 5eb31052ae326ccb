"""Main text of web pages: boosted trees over block features, decoded along the tree.

Each block of a page (an element that is not inline) has features: text and tag
density of its subtree, share of links, depth, place, its siblings and parent,
and the words in its class, id and role. Boosted trees give the odds that the
block is or holds main text. Decoding picks the most likely set of blocks in
which no kept block lies in a dropped one, so ancestors and descendants never
contradict each other.

There are no labelled pages. The trees learn from pages of the corpus whose
markup names its parts (``article`` or ``main`` against ``nav``, ``footer``,
telling class names), a bounded, hash-chosen sample. So that they learn what the
parts look like too, half of the examples have those names hidden, and blocks
of the surroundings, or prose under a telling name (as reader comments are),
are put into the main text as counterexamples. So that they do not take the markup of
these pages for that of all pages, lists, tables, listings, figures and quotes made
of its words are put into the main text too, paragraphs become plain blocks, and
the element around it goes, each in a part of the examples.

Defined results: a null or empty page, or one without main text, gives an empty
text; repeated pages give equal texts; without pages to learn from, blocks with
telling names alone decide; other columns are ignored.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.boosting import BoostingOptions, Trees, fit_trees
from groundsieve.llm.common import sliced
from groundsieve.llm.dom import FEATURES, SEMANTIC, TAGS_AGAINST, TAGS_FOR, Page, features, read_page, text_of

_KINDS = [FEATURES.index(n) for n in ("is_p", "is_list", "is_cell")]
_REGION = re.compile(r"<(article|main)\b([^>]*)>(.*)</\1\s*>", re.S | re.I)
_PARAGRAPH = re.compile(r"<(/?)p\b", re.I)
_BEGINNING = re.compile(r"<(?:p|h[1-6]|div)\b", re.I)
_MARKUP = re.compile(r"<[^>]*>")
_FLAGS = [FEATURES.index(n) for n in ("tag_against", "words_against", "above_against")]


@dataclass(frozen=True)
class ExtractionOptions:
    sample_pages: int = 1500   # pages to learn from, at most about so many
    boosting: BoostingOptions = field(default_factory=BoostingOptions)
    batch_bytes: int = 4 * 1024 * 1024


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for blocks that are, lie in or hold named main text, 0 for the others;
    None if the page does not name its main text."""
    n = len(page.tags)
    label, holds = [-1] * n, [False] * n
    for k in range(1, n):
        inside = label[page.parents[k]] == 1
        for_it = page.tags[k] in TAGS_FOR
        against = page.tags[k] in TAGS_AGAINST or page.hints[k][1] > page.hints[k][0]
        label[k] = 0 if against or label[page.parents[k]] == 0 else 1 if inside or for_it else -1
    if 1 not in label:
        return None
    for k in range(n - 1, 0, -1):
        holds[k] = holds[k] or label[k] == 1
        holds[page.parents[k]] |= holds[k]
    return np.array([1 if h else 0 for h in holds])


def _moved(page: Page, label: np.ndarray, rng: random.Random) -> Page:
    """The page with counterexamples inside of its main text."""
    inner = [k for k in range(1, len(page.tags)) if label[k] and page.tags[k] in TAGS_FOR]
    if not inner:
        return page
    home, out = rng.choice(inner), Page()
    out.tags, out.parents = list(page.tags), list(page.parents)
    out.hints, out.texts = list(page.hints), list(page.texts)
    run = max((t[1] for t in page.texts), default=0) + 1
    outer = [k for k in range(1, len(page.tags)) if not label[k] and label[page.parents[k]]]
    prose = [t for t in page.texts if label[t[0]] and not t[3]]
    extra: list[tuple[int, int, str, bool]] = []

    def add(tag: str, parent: int, hint: tuple[int, int]) -> int:
        out.tags.append(tag)
        out.parents.append(parent)
        out.hints.append(hint)
        return len(out.tags) - 1

    if outer and rng.random() < 0.3:  # a copy of a part of the surroundings
        top, copies = rng.choice(outer), {}
        for k in range(top, len(page.tags)):
            if k == top or page.parents[k] in copies:
                copies[k] = add(page.tags[k], copies.get(page.parents[k], home), page.hints[k])
        extra = [(copies[b], run + r, t, link) for b, r, t, link in page.texts if b in copies]
    elif prose:  # readers' prose, adverts or notices under a telling name
        tag = rng.choice(["div", "section", "aside", "form"])
        box = add(tag, home, (0, 0 if tag in TAGS_AGAINST and rng.random() < 0.5 else 1))
        for k in range(rng.randint(1, 4)):
            block = add(rng.choice(["p", "div", "li"]), box, (0, 0)) if rng.random() < 0.7 else box
            text = rng.choice(prose)[2]
            extra.append((block, run + k, text if rng.random() < 0.5 else text[: rng.randint(1, 40)], rng.random() < 0.2))
    out.texts += extra
    return out


def _varied(source: str, rng: random.Random) -> str:
    """The page with markup in its named main text that its writer did not use but others do: lists,
    tables, listings, figures, quotes, and plain blocks in the place of paragraphs and of the
    elements around them."""
    region = _REGION.search(source)
    if region is None:
        return source
    inner = region.group(3)
    words = [w for w in _MARKUP.sub(" ", inner).split() if "&" not in w] or ["text"]

    def some(most: int) -> str:
        size, at = rng.randint(1, most), rng.randrange(len(words))
        return " ".join((words[at:] + words)[:size]).capitalize() + rng.choice(["", ".", ":"])

    def part() -> str:
        size = rng.choice([3, 12, 40])
        kind = rng.choice(["ul", "ol", "table", "pre", "dl", "figure", "blockquote", "div", "links"])
        if kind in ("ul", "ol", "links"):
            mark = "<a href=x>{}</a> {}" if kind == "links" else "{} {}"
            items = "".join(f"<li>{mark.format(some(3), some(size))}</li>" for _ in range(rng.randint(1, 9)))
            kind = "ul" if kind == "links" else kind
            return f"<{kind}>{items}</{kind}>"
        if kind == "table":
            wide = rng.randint(1, 4)
            rows = "".join("<tr>" + "".join(f"<td>{some(rng.choice([2, size]))}</td>" for _ in range(wide)) + "</tr>"
                           for _ in range(rng.randint(1, 6)))
            body = rng.random() < 0.5
            return f"<table>{'<tbody>' * body}{rows}{'</tbody>' * body}</table>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{some(3)}</dt><dd>{some(size)}</dd>" for _ in range(rng.randint(1, 5))) + "</dl>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{some(12)}</figcaption></figure>"
        text = "\n  ".join(some(rng.choice([3, 8])).lower() for _ in range(rng.randint(1, 5))) if kind == "pre" else some(size)
        return f"<{kind}>{text}</{kind}>"

    if rng.random() < 0.3:
        inner = _PARAGRAPH.sub(r"<\1div", inner)
    for _ in range(rng.randint(0, 3)):
        places = [m.start() for m in _BEGINNING.finditer(inner)] + [len(inner)]
        at = rng.choice(places)
        inner = inner[:at] + part() + inner[at:]
    if rng.random() < 0.15:  # one block alone
        inner = f"<div>{some(300)}</div>"
    return source[: region.start(3)] + inner + source[region.end(3):]


def _unwrapped(page: Page, *rows: np.ndarray) -> tuple[Page, ...]:
    """The page, and rows of its blocks the first of which are the labels, without the elements that name its main text; what they held stands in their place."""
    own = {block for block, _, text, _ in page.texts if text.strip()}
    gone = [k > 0 and page.tags[k] in TAGS_FOR and rows[0][k] == 1 and k not in own for k in range(len(page.tags))]
    number = np.cumsum(~np.array(gone)) - 1
    home = list(range(len(page.tags)))
    for k in range(1, len(home)):
        if gone[k]:
            home[k] = home[page.parents[k]]
    left = [k for k, g in enumerate(gone) if not g]
    out = Page([page.tags[k] for k in left],
               [-1 if k == 0 else int(number[home[page.parents[k]]]) for k in left],
               [page.hints[k] for k in left],
               [(int(number[home[block]]), run, text, link) for block, run, text, link in page.texts])
    return out, *(r[left] for r in rows)


def training_rows(pages: Iterator[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [np.empty((0, len(FEATURES)), np.float32)], [np.empty(0, int)]
    for n, source in enumerate(pages):
        rng = random.Random(seed * 1_000_003 + n)
        page = read_page(_varied(source, rng) if rng.random() < 0.6 else source)
        label = weak_labels(page)
        if label is None:
            continue
        for _ in range(rng.choice([0, 1, 2])):
            page = _moved(page, label, rng)
            label = weak_labels(page)
        row = features(page)
        above = row[:, FEATURES.index("above_for")]
        if rng.random() < 0.3:
            page, label, above = _unwrapped(page, label, above)
            row = features(page)
        held = row[1:]
        # Where the names are hidden, prose under a telling name looks like main text: leave it out.
        seen = np.ones(len(held), bool)
        if rng.random() < 0.5:
            seen = ~((held[:, _FLAGS].sum(1) > 0) & (above[1:] > 0))
            held = held.copy()
            held[:, SEMANTIC] = 0
        if rng.random() < 0.5:  # nor do kinds of elements tell everywhere what they are used for
            held = held.copy()
            held[:, _KINDS] = 0
        rows.append(held[seen])
        labels.append(label[1:][seen])
    return np.concatenate(rows), np.concatenate(labels)


def _named_only() -> Trees:
    """Trees for a corpus without pages to learn from."""
    at = [FEATURES.index(n) for n in ("above_against", "words_against", "tag_against")]
    return Trees(np.array([[f] for f in at]), np.full((3, 1), 0.5), np.array([[0.0, -4.0]] * 3), 1.0)


def decode(page: Page, margins: np.ndarray) -> np.ndarray:
    """The most likely kept blocks such that what holds a kept block is kept."""
    n = len(page.tags)
    keep, drop = margins.tolist(), [0.0] * n  # log odds; all of a dropped subtree counts nothing
    best = [0.0] * n
    for k in range(n - 1, 0, -1):
        best[k] = max(drop[k], keep[k])
        keep[page.parents[k]] += best[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[page.parents[k]] and keep[k] > 0
    return kept


def extract_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [read_page(s) for s in sources]
    rows = [features(p) for p in pages]
    margins = trees.margins(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page, row in zip(pages, rows):
        out.append(text_of(page, decode(page, margins[at: at + len(row)])))
        at += len(row)
    return out


def fit_extractor(pages: DataFrame, options: ExtractionOptions = ExtractionOptions()) -> Trees:
    share = min(1.0, options.sample_pages / max(pages.count(), 1))
    rows = pages.select(F.coalesce(pages["html"], F.lit("")).alias("html"))
    spot = F.pmod(F.xxhash64("html"), F.lit(1 << 60))
    # Copies of a page have one hash; each is learnt from once.
    sample = rows.where(spot < int(share * (1 << 60)) + 1).groupBy(F.sha2("html", 256).alias("digest")).agg(
        F.first("html").alias("html"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((d, h) for b in batches for d, h in zip(*(b.column(c).to_pylist() for c in ("digest", "html"))))
        rows, labels = training_rows(h for _, h in held)
        trees = fit_trees(rows, labels, options.boosting) if len(set(labels.tolist())) == 2 else _named_only()
        state = (trees.features, trees.thresholds, trees.leaves, trees.base)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(state)], pa.binary())})

    model = sample.repartition(1).mapInArrow(train, "model binary").collect()
    return Trees(*pickle.loads(bytes(model[0].model))) if model else _named_only()


def extract(pages: DataFrame, trees: Trees, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast((trees.features, trees.thresholds, trees.leaves, trees.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shared.value)
        for rows in sliced(batches, "html", options.batch_bytes):
            texts = extract_texts(rows.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        F.coalesce(pages["html"], F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    return extract(pages, fit_extractor(pages, options), options)
