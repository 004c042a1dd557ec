"""Main text of web pages, by a tree-structured graphical model over DOM nodes.

A page is parsed into block elements and text blocks.  Each node is content or not; unary
potentials come from tags, class and id names, length and link density, pairwise ones connect
parent and child.  Sum-product messages, first upward and then downward, give every node's exact
marginal; text blocks whose marginal is at least one half are the main text.  Weights are fitted by
gradient ascent on the likelihood of labelled pages, whose gradient needs the same messages.

The labelled pages are made from a seed (``pagegen``), ``fit_pages`` of them; the tables hold no labels
for pages.  The fitted weights are written once to the shared folder, under a name that the code of
the generator and of the fitting decides, and read from there by later sessions.

Results in odd cases: a null or empty page has empty text; unclosed, stray and cut-off tags are
handled as browsers do, roughly; a line break counts as white space; repeated rows each get a row;
extra columns are not read.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import inspect
import pickle
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import filesystem, shared_dir
from .pagegen import PageMaker

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</(?:\Z|[^a-zA-Z][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Page:
    """Nodes of one page, parents first: parent, tag, attributes; for text blocks the text, link characters and where it began."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.attributes, self.text, self.linked, self.begun = [-1], ["#page"], [""], [None], [0], [0]
        if html:
            self._read(html)

    def _add(self, parent: int, tag: str, attributes: str, text: str | None, linked: int, begun: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.attributes, attributes), (self.text, text), (self.linked, linked), (self.begun, begun)):
            column.append(value)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        open_nodes, pieces, linked, begun, in_link, at = [0], [], 0, 0, 0, 0
        lower = None

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self._add(open_nodes[-1], "#text", "", text, linked, begun)
                pieces, linked = [], 0

        def add_text(raw: str, where: int) -> None:
            nonlocal begun, linked
            begun = begun if pieces else where
            shown = unescape(raw) if "&" in raw else raw
            pieces.append(shown)
            linked += len(shown.strip()) if in_link else 0

        size = len(html)
        while at < size:
            found = _TOKEN.search(html, at)
            if found is None:
                add_text(html[at:], at)
                break
            if found.start() > at:
                add_text(html[at : found.start()], at)
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            closing, attributes = found[1] or found[4], found[3] or found[6] or ""
            if name in RAW:
                if not closing:
                    lower = html.lower() if lower is None else lower
                    if len(lower) != size:  # a character whose lower case is longer
                        end = re.compile(f"</{name}", re.I).search(html, at)
                        stop = end.start() if end else -1
                    else:
                        stop = lower.find(f"</{name}", at)
                    at = size if stop < 0 else stop
                    if name == "textarea":
                        flush()
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                elif name == "br":
                    add_text(" ", found.start())
                continue
            if closing:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if self.tag[open_nodes[k]] == name:
                        flush()
                        del open_nodes[k:]
                        break
                continue
            flush()
            in_link = 0
            if name in CLOSES_P and self.tag[open_nodes[-1]] == "p":
                open_nodes.pop()
            if name in CLOSED_BY:
                same, bounds = CLOSED_BY[name]
                for k in range(len(open_nodes) - 1, 0, -1):
                    tag = self.tag[open_nodes[k]]
                    if tag in bounds:
                        break
                    if tag in same:
                        del open_nodes[k:]
                        break
            if name not in VOID:
                node = self._add(open_nodes[-1], name, attributes, None, 0, found.start())
                if not attributes.rstrip().endswith("/") or name in CLOSES_P:
                    open_nodes.append(node)
        flush()


def _names(attributes: str) -> list[str]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden", "style"):
            out += ["hidden"] if (key == "hidden" or "true" in value or "none" in value.replace(" ", "")) else []
            continue
        for word in _NAME.findall(value):
            word = word.lower()
            out += [word, "^" + word[:4]] if len(word) > 4 else [word]
    return out


@functools.lru_cache(maxsize=50_000)
def _element_features(tag: str, attributes: str, above: str) -> tuple[str, ...]:
    names = (f"name {x}" for x in sorted(set(_names(attributes)))) if attributes else ()
    return ("element", f"tag {tag}", f"{tag} in {above}", *names)


def _text_features(page: Page, k: int) -> tuple[str, ...]:
    text = page.text[k]
    n = text.count(" ") + 1
    share = page.linked[k] / max(1, len(text))
    return ("text", f"in {page.tag[page.parent[k]]}", f"words {min(6, n.bit_length())}", f"links {int(min(1.0, share) * 3)}", "stop" if text[-1] in ".!?" else "no stop")


class Forest:
    """Nodes of several pages in arrays, by depth."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int], grow: bool = False):
        parent, node_of, feature_of, base, is_text = [], [], [], 0, []
        for page in pages:
            for k, p in enumerate(page.parent):
                parent.append(p + base if p >= 0 else -1)
                text = page.text[k] is not None
                is_text.append(text)
                for f in _text_features(page, k) if text else _element_features(page.tag[k], page.attributes[k], page.tag[p] if p >= 0 else ""):
                    number = vocabulary.setdefault(f, len(vocabulary)) if grow else vocabulary.get(f)
                    if number is not None:
                        node_of.append(k + base)
                        feature_of.append(number)
            base += len(page.parent)
        self.parent, self.kind = np.array(parent), np.array(is_text, dtype=np.int64)
        self.node_of, self.feature_of = np.array(node_of, dtype=np.int64), np.array(feature_of, dtype=np.int64)
        depth = np.zeros(base, dtype=np.int64)
        for k, p in enumerate(parent):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]  # without the roots


@dataclass
class TreeModel:
    """Feature weights of being content, and log-potentials [kind of child, parent's label, child's label]."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def infer(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each node being content, and of (parent's label, child's label) at each node but roots."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.node_of, weights=self.weights[forest.feature_of], minlength=n)
        up = np.zeros((n, 2))
        for level in reversed(forest.levels):
            joint = self.edges[forest.kind[level]] + own[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(own, forest.parent[level], up[level])
        whole = own.copy()
        pairs = np.zeros((n, 2, 2))
        for level in forest.levels:
            above = whole[forest.parent[level]] - up[level]
            joint = above[:, :, None] + self.edges[forest.kind[level]] + own[level][:, None, :]
            whole[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500))), pairs


def labelled_page(seed: int) -> tuple[Page, np.ndarray, list[str]]:
    """A made page, its nodes' labels, and its content blocks."""
    runs = PageMaker(seed).runs()
    ends = np.cumsum([len(r[0]) for r in runs])
    page = Page("".join(r[0] for r in runs))
    labels = np.array([bool(b >= 0 and k and runs[int(np.searchsorted(ends, b, side="right"))][1]) for k, b in enumerate(page.begun)])
    return page, labels.astype(np.int64), [t for t, y in zip(page.text, labels) if t is not None and y]


def train(examples: list[tuple[Page, np.ndarray]], steps: int = 300, rate: float = 0.1, decay: float = 3e-5) -> TreeModel:
    """Weights by gradient ascent (Adam) on the likelihood of the labels."""
    vocabulary: dict[str, int] = {}
    forest = Forest([p for p, _ in examples], vocabulary, grow=True)
    y = np.concatenate([labels for _, labels in examples])
    model = TreeModel(vocabulary, np.zeros(len(vocabulary)), np.zeros((2, 2, 2)))
    below = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[below], y[forest.parent[below]], y[below]), 1)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (model.weights, model.edges)]
    for t in range(1, steps + 1):
        content, pairs = model.infer(forest)
        expected = np.stack([pairs[below][forest.kind[below] == k].sum(axis=0) for k in (0, 1)])
        up = np.bincount(forest.feature_of, weights=(y - content)[forest.node_of], minlength=len(vocabulary))
        for value, slope, m in ((model.weights, up / len(examples) - decay * model.weights, moments[0]), (model.edges, (seen - expected) / len(examples) - decay * model.edges, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.999 * m[1] + 0.001 * slope**2
            value += rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return model


@functools.cache
def fitted(fit_pages: int = 1000, seed: int = 11) -> TreeModel:
    return train([labelled_page(seed * 1_000_000 + k)[:2] for k in range(fit_pages)])


def stored_model(spark: SparkSession, fit_pages: int = 1000, seed: int = 11) -> TreeModel:
    """fitted(), from the shared folder where an earlier session wrote it."""
    from . import pagegen

    code = "".join(inspect.getsource(m) for m in (pagegen, sys.modules[__name__]))
    mark = hashlib.sha256(f"{code}{fit_pages},{seed}".encode()).hexdigest()[:16]
    root = f"{shared_dir(spark).rstrip('/')}/siftline-models"
    store, path = filesystem(f"{root}/html-{mark}.pickle")
    if store.get_file_info(path).is_file:
        with store.open_input_file(path) as source:
            return TreeModel(*pickle.loads(source.readall()))
    model = fitted(fit_pages, seed)
    store.create_dir(filesystem(root)[1], recursive=True)
    trial = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(trial) as out:
        out.write(pickle.dumps((model.vocabulary, model.weights, model.edges)))
    with contextlib.suppress(OSError):  # another session was quicker, where moves do not replace
        store.move(trial, path)
    return model


def main_texts(model: TreeModel, pages: list[str | None]) -> list[str]:
    parsed = [Page(p) for p in pages]
    content, _ = model.infer(Forest(parsed, model.vocabulary))
    out, base = [], 0
    for page in parsed:
        out.append("\n".join(t for k, t in enumerate(page.text) if t is not None and content[base + k] >= 0.5))
        base += len(page.text)
    return out


def extract(pages: DataFrame, model: TreeModel, at_once: int = 100) -> DataFrame:
    """page_id, url and text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                texts = main_texts(shared.value, some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    slim = pages.select("page_id", "url", "html")
    return slim.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string")
