"""Main text of web pages by a tree-structured graphical model.

Each element and each block of text is a node that is main text or not. A node's own potential comes from
its tag, its class names and its text; a potential on each parent-child edge lets neighbours agree.
Messages passed up the tree and down again (sum-product, exact on a tree) give every block's marginal.
The weights are fitted on labelled pages by maximum likelihood with the same messages.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidied, utf8
from .labelled_pages import labelled_pages

_TAG = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without an end tag, whose content is no markup, that never show their
# text, that do not break a line, and whose start ends others left open.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head title script style noscript template iframe object svg math canvas audio video select option optgroup datalist button textarea input map noembed noframes".split())
# What a head may hold, and whose start ends a drawing or formula.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
_ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul center".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "table", "button", "li", "div", "article", "section")}

#: Tags and class or id words that are features; others tell nothing.
_TAGS = "body article main section nav header footer aside form dialog p h1 h2 h3 h4 h5 h6 li ul ol td tr table div blockquote pre figure figcaption dl dt dd address details menu ins".split()
_WORDS = (
    "nav navbar navigation menu breadcrumb breadcrumbs topmenu header masthead banner footer bottom copyright contentinfo sidebar side aside rail widget widgets complementary "
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay alert dialog "
    "newsletter subscribe subscription signup form search login register comment comments commentlist reply replies respond response responses disqus thread reader readers related recommended more share sharing social "
    "pagination pager tags tag author bio toolbar "
    "article content main post entry body story text page wrapper container"
).split()
_ROOMS = (3, 9, 24)
FEATURES = {name: k for k, name in enumerate(["bias", "element", "block", "header in an article", "body around an article", *(f"<{t}>" for t in _TAGS), *_WORDS, *(f"words>{n}" for n in _ROOMS), "links>30%", "links>80%", "ends in . ! or ?"])}


@dataclass
class Page:
    """Nodes in page order: parents come before their children, text blocks are leaves."""

    parent: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)


@functools.lru_cache(4096)
def _element(tag: str, rest: str) -> tuple[tuple[int, ...], int | None]:
    """Features and, on labelled pages, the label of an element."""
    found = [FEATURES["bias"], FEATURES["element"]]
    if f"<{tag}>" in FEATURES:
        found.append(FEATURES[f"<{tag}>"])
    label = None
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "y":
            label = int(value) if value in ("0", "1") else None
        else:
            found += [FEATURES[w.lower()] for w in _NAME.findall(value) if w.lower() in FEATURES]
    return tuple(dict.fromkeys(found)), label


class _Open(list):
    """Names of open elements, the last one innermost, and where each name stands, so that no search walks the list."""

    def __init__(self) -> None:
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self))
        self.append(name)

    def cut(self, k: int) -> None:
        """Close all from number k on; each element is closed once."""
        while len(self) > k:
            self.places[self.pop()].pop()

    def last(self, names: tuple[str, ...]) -> int:
        """The number of the innermost element of these names, -1 if none is open."""
        return max((places[-1] for n in names if (places := self.places.get(n))), default=-1)


def parse(source: str) -> Page:
    """The page's tree. Unclosed elements end where HTML ends them; a missing or broken tag never fails."""
    page = Page()
    stack, nodes = _Open(), []  # open block elements and their nodes
    pieces: list[tuple[str, bool]] = []  # the open block's text, and whether it is in a link
    hidden: list[tuple[str, int]] = []  # open hidden elements, and how many elements were open inside when they began
    inside = _Open()  # open elements inside hidden ones
    links = articles = 0

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            linked = sum(len(t) for t, inside in pieces if inside) / max(1, sum(len(t) for t, _ in pieces))
            found = [FEATURES["bias"], FEATURES["block"]]
            n = text.count(" ") + 1
            found += [FEATURES[f"words>{room}"] for room in _ROOMS if n > room]
            found += [FEATURES[f"links>{share}%"] for share in (30, 80) if linked > share / 100]
            if text[-1] in ".!?":
                found.append(FEATURES["ends in . ! or ?"])
            add(found, text, None)
        pieces.clear()

    def add(features: list[int] | tuple[int, ...], text: str | None, label: int | None) -> int:
        page.parent.append(nodes[-1] if nodes else -1)
        page.features.append(features)
        page.text.append(text)
        page.label.append(label)
        return len(page.parent) - 1

    def end(names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Close the nearest open element of these names, and all in it, unless a wall stands before it."""
        k = stack.last(names)
        if k > stack.last(walls) or k >= 0 and stack[k] in walls:
            flush()
            stack.cut(k)
            del nodes[k:]

    def show(k: int) -> None:
        """End the hidden elements from number k on."""
        if k < len(hidden):
            inside.cut(hidden[k][1])
            del hidden[k:]

    def within(tag: str, closing: bool) -> bool:
        """Whether a tag between hidden elements is theirs; if it ends them instead they are shown."""
        if not closing:
            drawing = hidden[-1][0] in ("svg", "math")
            if drawing and tag in _ENDS_FOREIGN and inside.last(("foreignobject",)) < hidden[-1][1]:
                show(len(hidden) - 1)
            elif tag not in _VOID and tag not in _INLINE:
                inside.push(tag)
            return bool(hidden)
        k = inside.last((tag,))
        if k >= 0:
            inside.cut(k)
            while hidden[-1][1] > k:
                hidden.pop()
            return True
        if stack.last((tag,)) >= 0:
            show(0)
        return bool(hidden)

    def say(text: str) -> None:
        if len(hidden) == 1 and hidden[0][0] == "head" and text.strip():
            show(0)
        if text and not hidden:
            pieces.append((html.unescape(text) if "&" in text else text, links > 0))

    at = 0
    while m := _TAG.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if hidden and hidden[-1][0] == "head" and not closing and tag not in _IN_HEAD:
            show(len(hidden) - 1)
        if tag in _HIDDEN:
            if not closing and tag in _RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else len(source)
            elif tag in _VOID or rest.endswith("/"):
                pass
            elif not closing:
                hidden.append((tag, len(inside)))
            else:
                show(max((k for k, (t, _) in enumerate(hidden) if t == tag), default=len(hidden)))
            if not hidden:
                say(" ")
            continue
        if hidden:
            if tag == "body" and any(t == "head" for t, _ in hidden):
                show(0)
            elif rest.endswith("/") or within(tag, closing):
                continue
        if tag in _INLINE and not (tag == "ins" and _ATTRIBUTE.search(rest)):
            if tag == "a":
                links = max(0, links + (-1 if closing else 1)) if closing else 1
            elif tag == "br":
                say(" ")
            continue
        links = 0 if tag in _ENDS_P else links
        if closing:
            end((tag,), ())
            continue
        if tag == "html" or (tag == "body" and stack.last(("body",)) >= 0):
            continue
        if tag in _ENDS_P:
            end(("p",), _SCOPE["p"])
        elif tag in _ENDS:
            end(_ENDS[tag], _SCOPE[tag])
        flush()
        if tag in _VOID:
            continue
        features, label = _element(tag, rest)
        articles += tag in ("article", "main")
        if tag == "header" and stack.last(("article", "main")) >= 0:
            features = tuple(FEATURES["header in an article"] if f == FEATURES["<header>"] else f for f in features)
        nodes.append(add(features, None, label))
        stack.push(tag)
    if source[at:]:
        say(source[at:])
    flush()
    if articles:
        page.features = [(*f, FEATURES["body around an article"]) if FEATURES["<body>"] in f else f for f in page.features]
    return page


@dataclass(frozen=True)
class Model:
    """Log potentials: of label 1 for each feature; of each pair (parent's label, child's label), for elements and for text blocks as children."""

    weight: np.ndarray
    edge: np.ndarray

    def marginals(self, page: Page) -> np.ndarray:
        """Each node's probability of being main text."""
        n = len(page.parent)
        weight, edge = self.weight.tolist(), [(*a, *b) for a, b in self.edge.tolist()]
        kind = [int(t is not None) for t in page.text]
        own = [sum(map(weight.__getitem__, f)) for f in page.features]
        up_from = [0.0] * n  # each node's message to its parent, as log odds
        belief = own[:]  # own potential and all messages from below
        parent = page.parent
        for k in range(n - 1, -1, -1):
            b = belief[k]
            w00, w01, w10, w11 = edge[kind[k]]
            up_from[k] = _log_add(w10, w11 + b) - _log_add(w00, w01 + b)
            if parent[k] >= 0:
                belief[parent[k]] += up_from[k]
        for k in range(n):
            if parent[k] >= 0:
                b = belief[parent[k]] - up_from[k]
                w00, w01, w10, w11 = edge[kind[k]]
                belief[k] += _log_add(w01, w11 + b) - _log_add(w00, w10 + b)
        return 1 / (1 + np.exp(-np.clip(np.array(belief), -500, 500)))


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(pages: list[str] | None = None, steps: int = 500) -> Model:
    """Fit the potentials on labelled pages (those of ``labelled_pages`` if none are given) by maximum likelihood.

    The gradient is observed less expected counts; the expectations are exact, from messages passed level
    by level over all trees at once.
    """
    features, parents, labels, depths, kinds = [], [], [], [], []
    for source in labelled_pages() if pages is None else pages:
        page = parse(source)
        base = len(parents)
        features += page.features
        labels += _labels(page)
        kinds += [int(t is not None) for t in page.text]
        for p in page.parent:
            parents.append(base + p if p >= 0 else -1)
            depths.append(depths[base + p] + 1 if p >= 0 else 0)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate([np.array(f) for f in features])
    y, parent, depth, kind = np.array(labels), np.array(parents), np.array(depths), np.array(kinds)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    up = parent[child]
    seen = np.bincount(4 * kind[child] + 2 * y[up] + y[child], minlength=8).reshape(2, 2, 2).astype(float)
    seen_features = np.bincount(column, y[row], len(FEATURES))
    value = [np.zeros(len(FEATURES)), np.array([[[1.0, -1.0], [-1.0, 1.0]]] * 2)]
    first, second = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
    for step in range(1, steps + 1):
        w, (e00, e01, e10, e11) = value[0], value[1].reshape(2, 4).T
        w00, w01, w10, w11 = (e[kind] for e in (e00, e01, e10, e11))
        below = np.bincount(row, w[column], len(y))
        message = np.zeros(len(y))
        for level in reversed(levels):
            b = below[level]
            message[level] = np.logaddexp(w10[level], w11[level] + b) - np.logaddexp(w00[level], w01[level] + b)
            below += np.bincount(parent[level], message[level], len(y))
        belief = below.copy()
        for level in levels:
            b = belief[parent[level]] - message[level]
            belief[level] += np.logaddexp(w01[level], w11[level] + b) - np.logaddexp(w00[level], w10[level] + b)
        around = belief[up] - message[child]
        joint = np.stack([w00[child], w01[child] + below[child], w10[child] + around, w11[child] + around + below[child]])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
        pairs = np.stack([np.bincount(kind[child], j, 2) for j in joint], axis=1).reshape(2, 2, 2)
        expected = 1 / (1 + np.exp(-np.clip(belief, -500, 500)))
        grads = [(np.bincount(column, expected[row], len(FEATURES)) - seen_features) / len(y) + 3e-5 * w, (pairs - seen) / len(y) + 3e-5 * value[1]]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            value[k] = value[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return Model(*value)


def _labels(page: Page) -> list[int]:
    """Labels of all nodes of a labelled page: of the nearest element around that has one."""
    near: list[int] = []
    for own, p in zip(page.label, page.parent, strict=True):
        near.append(own if own is not None else near[p] if p >= 0 else 0)
    return near


def blocks(model: Model, source: str) -> list[tuple[str, float]]:
    """(text, marginal) of every block of text in page order."""
    page = parse(source)
    if not page.parent:
        return []
    return [(t, float(m)) for t, m in zip(page.text, model.marginals(page), strict=True) if t is not None]


def main_text(model: Model, source: str, least: float = 0.5) -> str:
    return "\n".join(t for t, m in blocks(model, source) if m >= least)


def extracted(pages: DataFrame, model: Model, least: float = 0.5, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row's whole html, blocks joined by line ends.

    Null and empty html, and pages without main text, give an empty text. Rows are kept as they are,
    repeated ones and null ids included. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), utf8(html_column).alias("html"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, h.decode("utf-8", "replace"), least) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
