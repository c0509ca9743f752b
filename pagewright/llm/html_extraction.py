"""Main text of pages by a graphical model over their trees.

Every node of a page's tree is content or not. What a node looks like gives each state a weight;
a potential for each kind of child joins the states of parent and child. Sum-product messages
pass upward from the texts to the root and back down, which gives the exact probability that a
node is content, given the whole page. Texts with at least ``keep`` are the main text. Weights and
potentials are those of the greatest likelihood of labelled pages; its slope is the difference
between the labels and the marginals of the same messages.

Labelled pages come from the table: pages whose markup names their article. At most ``sample`` of
them (the smallest hashes of their html), of at most ``sample_bytes`` bytes each, are taken. The
model must not rest on that one tag, so each is also laid out anew ``layouts`` times: its texts
are put into other containers, with or without telling names, among menus, notices, adverts,
forms, sidebars and reader comments. Where no page names its article, pages of invented words
stand in.

Defined results: a null or empty page has no text. Rows that repeat a page are extracted each.
An empty table gives an empty result. Other columns are ignored. Nothing is cut from a page.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .dom import HINT, TAG, TAGS, Tree, parse
from .page_layouts import invented_page, laid_out, named_article
from .words import slices

#: Kinds of children, each with a potential of its own.
_KINDS = {"text": "text", "block": "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th summary address",
          "group": "ul ol menu dl table thead tbody tr figure details", "apart": "header footer nav aside form fieldset"}
KINDS = [*_KINDS, "box"]
KIND_OF = np.full(len(TAGS), len(KINDS) - 1)
for _i, _names in enumerate(_KINDS.values()):
    for _name in _names.split():
        KIND_OF[TAG[_name]] = _i

FIGURES = 14


@dataclass(frozen=True)
class Extraction:
    sample: int = 96
    sample_bytes: int = 1 << 20
    layouts: int = 4
    blind: int = 3
    rounds: int = 150
    l2: float = 0.3
    keep: float = 0.5


class Forest:
    """Trees of several pages side by side; children lie behind their parents."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(trees)), sizes)

        def joined(name: str) -> np.ndarray:
            return np.array([x for t in trees for x in getattr(t, name)], np.int64)

        parent, self.depth, self.tag = joined("parent"), joined("depth"), joined("tag")
        self.root = parent < 0
        self.parent = np.where(self.root, 0, parent) + self.first[self.page]
        self.kind = KIND_OF[self.tag]
        self.hints = joined("hints")
        order = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.figures = self._figures(*(joined(c) for c in ("chars", "words", "linked", "points", "flags")))

    def _sole(self, tag: int) -> np.ndarray:
        """The only element of its kind on its page."""
        has = self.tag == tag
        return has & (np.bincount(self.page[has], minlength=len(self.first))[self.page] == 1)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Per node the sum over all nodes below it and itself."""
        out = values.astype(np.float64)
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def _figures(self, chars, words, linked, points, flags) -> np.ndarray:
        """Columns of what texts (the first seven) and elements (the others) look like."""
        leaf = self.tag == 0
        all_chars, all_linked, leaves, ends = (self.summed(x) for x in (chars, linked, leaf, leaf & (flags & 1 > 0)))
        of_page = np.maximum(all_chars[self.first[self.page]], 1)
        some = ~leaf & (leaves > 0)
        safe_chars, safe_leaves = np.maximum(all_chars, 1), np.maximum(leaves, 1)
        columns = [
            leaf * np.log1p(np.minimum(words, 60)) / 3,
            leaf * linked / safe_chars,
            leaf * (flags & 1 > 0),
            leaf * (flags & 2 > 0),
            leaf * np.minimum(points / np.maximum(words, 1), 1),
            leaf * (words < 4),
            leaf,
            some * np.log1p(np.minimum(all_chars, 3000)) / 6,
            some * all_linked / safe_chars,
            some * all_chars / of_page,
            some * np.log1p(np.minimum(all_chars / safe_leaves, 300)) / 4,
            some * ends / safe_leaves,
            ~leaf & (leaves == 0),
            self._sole(TAG["article"]) | self._sole(TAG["main"]),
        ]
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


class Model:
    """Weights of tags, hints and figures for the state content, and potentials by kind of
    child, state of the parent and of the child."""

    def __init__(self, values: np.ndarray | None = None) -> None:
        sizes = [len(TAGS), len(HINT), FIGURES, 4 * len(KINDS)]
        self.values = np.zeros(sum(sizes)) if values is None else values
        parts = np.split(self.values, np.cumsum(sizes)[:-1])  # views
        self.tag, self.hint, self.figure = parts[:3]
        self.pair = parts[3].reshape(len(KINDS), 2, 2)

    def unary(self, forest: Forest) -> np.ndarray:
        out = self.tag[forest.tag] + forest.figures @ self.figure
        for bit, weight in enumerate(self.hint):
            out += weight * (forest.hints >> bit & 1)
        return out


def messages(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log beliefs of every node (normalized), what it says to its parent, and its belief from
    below alone."""
    n = len(forest.tag)
    below = np.zeros((n, 2))
    below[:, 1] = model.unary(forest)
    up = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        at = model.pair[forest.kind[level]] + below[level][:, None, :]
        up[level] = np.logaddexp(at[:, :, 0], at[:, :, 1])
        np.add.at(below, forest.parent[level], up[level])
    belief = below.copy()
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - up[level]
        at = model.pair[forest.kind[level]] + rest[:, :, None]
        belief[level] += np.logaddexp(at[:, 0, :], at[:, 1, :])
    belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
    return belief, up, below


def marginals(forest: Forest, model: Model) -> np.ndarray:
    """The probability of every node to be content."""
    return np.exp(messages(forest, model)[0][:, 1])


def slope(forest: Forest, labels: np.ndarray, model: Model) -> np.ndarray:
    """Slope of the log-likelihood of ``labels``: what the labels show, less what the marginals
    of nodes and of pairs expect."""
    belief, up, below = messages(forest, model)
    out = Model()
    more = labels - np.exp(belief[:, 1])
    np.add.at(out.tag, forest.tag, more)
    out.figure += more @ forest.figures
    out.hint += [more @ (forest.hints >> bit & 1) for bit in range(len(HINT))]
    child = np.flatnonzero(~forest.root)
    parent, kind = forest.parent[child], forest.kind[child]
    pair = model.pair[kind] + (belief[parent] - up[child])[:, :, None] + below[child][:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    np.subtract.at(out.pair, kind, pair)
    np.add.at(out.pair, (kind, labels[parent], labels[child]), 1.0)
    return out.values


def node_labels(forest: Forest, trees: list[Tree]) -> np.ndarray:
    """Texts as labelled; an element is content if most of its text is."""
    told = np.array([x for t in trees for x in t.label], np.int64) == 1
    chars = np.array([x for t in trees for x in t.chars], np.int64)
    return (2 * forest.summed(chars * told) > forest.summed(chars)).astype(np.int64)


def fitted(trees: list[Tree], cfg: Extraction) -> Model:
    """Greatest likelihood by steps whose size follows the signs of the slope. One page in
    ``blind`` shows its tags and names only, so that they count beside odd texts too."""
    forest = Forest(trees)
    forest.figures[forest.page % cfg.blind == 0, :-1] = 0
    labels = node_labels(forest, trees)
    model = Model()
    step, last = np.full(len(model.values), 0.1), np.zeros(len(model.values))
    for _ in range(cfg.rounds):
        now = slope(forest, labels, model) - cfg.l2 * model.values
        turned = now * last
        step = np.clip(step * np.where(turned > 0, 1.2, np.where(turned < 0, 0.5, 1.0)), 1e-6, 1.0)
        last = np.where(turned < 0, 0.0, now)
        model.values += np.sign(last) * step
    return model


def _fit(cfg: Extraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = sorted({x for batch in batches for x in batch.column(0).to_pylist()})
        rng = random.Random(len(pages))
        labelled = [named_article(parse(x)) for x in pages]
        labelled = [t for t in labelled if t is not None] or [invented_page(rng) for _ in range(16)]
        trees = list(labelled)
        for tree in labelled:
            trees += [parse(laid_out(tree, rng)) for _ in range(cfg.layouts)]
        yield pa.record_batch([pa.array(fitted(trees, cfg).values)], ["value"])

    return run


def train(pages: DataFrame, cfg: Extraction = Extraction()) -> Model:
    """``pages`` has a column ``html``. The sample is found by narrow hashes and read in one
    task, which returns some hundred numbers."""
    named = pages.filter(F.col("html").rlike("(?i)<article[\\s>]") & (F.octet_length("html") <= cfg.sample_bytes))
    named = named.select("html", F.xxhash64("html").alias("hash"))
    hashes = [r[0] for r in named.select("hash").distinct().orderBy("hash").limit(cfg.sample).collect()]  # bounded
    chosen = named.filter(F.col("hash").isin(hashes)).select("html") if hashes else named.limit(0).select("html")
    found = prepare(chosen.dropDuplicates(["html"])).coalesce(1).mapInArrow(_fit(cfg), "value double").collect()
    if found:
        return Model(np.array([r[0] for r in found]))
    return Model(next(_fit(cfg)(iter([]))).column(0).to_numpy().copy())


def main_texts(pages: list[str | None], model: Model, keep: float) -> list[str]:
    trees = [parse(x or "") for x in pages]
    if not trees:
        return []
    forest = Forest(trees)
    content = marginals(forest, model) >= keep
    return [
        "\n".join(said for said, kept in zip(tree.texts, content[first : first + len(tree.texts)].tolist()) if kept and said)
        for tree, first in zip(trees, forest.first.tolist())
    ]


def _extract(values: np.ndarray, cfg: Extraction, html: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(values)
        for batch in slices(batches, html):
            texts = main_texts(batch.column(html).to_pylist(), model, cfg.keep)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != html]
            names = [n for i, n in enumerate(batch.schema.names) if i != html]
            yield pa.record_batch([*kept, pa.array(texts, pa.string())], [*names, "text"])

    return run


def extract_text(
    pages: DataFrame, cfg: Extraction = Extraction(), page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (empty if none) and ``n_chars``."""
    rows = prepare(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    model = train(rows.select("html"), cfg)
    kinds = rows.schema
    schema = f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string"
    out = rows.mapInArrow(_extract(model.values, cfg, 2), schema)
    return out.select(
        F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars")
    )
