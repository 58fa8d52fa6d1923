"""HTML extraction by a tree-structured graphical model.

A page is a tree: block elements, and their text runs as leaves. Every node is
content or not; how well either fits a node is linear in its features, and how
well parent and child go together is a table for each kind of edge. Messages
passed up to the root and down again (sum-product) give every node's exact
probability of being content. Runs above one half are the text.

The model learns from labelled pages, those that mark their article: what is
inside is content. As most pages have more kinds of clutter than these, and no
such mark, half of the training pages are varied: the marking element becomes
a plain box, and clutter (comments, notices, forms, side boxes) that other
parts of pages consist of is put inside articles as not content. The
parameters maximise the likelihood, whose gradient is observed minus expected
counts, from the same messages.

All pages of a batch are one forest, so messages move level by level in numpy.

Defined cases: null and empty pages give an empty text; pages without text
too. Without labelled pages to learn from, the features' built-in signs decide.
Repeated rows are read each for itself. Extra columns stay or are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, parts, utf8
from vitaeflow.llm.dom import BIT, FEATURES, Page, read_page

#: Pages that are learned from, and their greatest length in characters.
TRAINING_PAGES, TRAINING_CHARS = 250, 100_000
STEPS, RATE, PENALTY = 120, 0.2, 2e-3
#: Nodes of one forest.
_NODES = 200_000
MARKED = ("article", "main")


@dataclass(frozen=True)
class Forest:
    """Nodes of several pages; parents come before their children."""

    parent: np.ndarray
    features: np.ndarray
    edge: np.ndarray
    levels: tuple[np.ndarray, ...]


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.parent) for p in pages]
    starts = np.cumsum([0, *sizes[:-1]])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts)])
    bits = np.concatenate([np.array(p.bits, np.int64) for p in pages])
    depth = np.concatenate([np.array(p.depth) for p in pages])
    features = (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float32)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
    return Forest(parent, features, (bits & BIT["leaf"] > 0).astype(np.int64), tuple(levels))


@dataclass(frozen=True)
class Model:
    """``weight`` of each feature for being content; ``fit[kind, parent, child]``, kinds: element, leaf."""

    weight: np.ndarray
    fit: np.ndarray


def built_in() -> Model:
    weight = np.zeros(len(FEATURES), np.float64)
    for name, value in (("against_tag", -3), ("against_cue", -3), ("hidden", -4), ("for_tag", 3), ("for_cue", 1), ("linked", -2),
                        ("paragraph", 1), ("long", 1), ("medium", 0.5)):
        weight[FEATURES.index(name)] = value
    return Model(weight, np.array([[[0.5, -0.5], [0.0, 1.0]], [[1.0, -1.0], [-1.0, 1.0]]]))


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Each node's probability of content, each edge's joint ``(n, 2, 2)``, and the log of all paths' sum."""
    n = len(trees.parent)
    alone = np.zeros((n, 2))
    alone[:, 1] = trees.features @ model.weight
    below = alone.copy()  # what the node and everything under it say, for both labels
    sent = np.zeros((n, 2))
    for level in reversed(trees.levels[1:]):
        said = below[level][:, None, :] + model.fit[trees.edge[level]]
        sent[level] = np.logaddexp(said[:, :, 0], said[:, :, 1])
        up = trees.parent[level]
        for label in (0, 1):
            below[:, label] += np.bincount(up, sent[level, label], minlength=n)
    belief = below.copy()
    joint = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        up = trees.parent[level]
        above = belief[up] - sent[level]  # what the parent knows from everyone else
        pair = above[:, :, None] + model.fit[trees.edge[level]] + below[level][:, None, :]
        belief[level] = np.logaddexp(pair[:, 0], pair[:, 1])
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        joint[level] = pair / pair.sum((1, 2), keepdims=True)
    roots = trees.levels[0]
    total = float(np.logaddexp(below[roots, 0], below[roots, 1]).sum())
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, total


# --- learning -------------------------------------------------------------------


def marked_nodes(page: Page) -> np.ndarray | None:
    """1 for every node in the page's article or above it; nothing if the page marks none."""
    inside = np.zeros(len(page.parent), np.int64)
    found = False
    for node, tag in enumerate(page.tag):
        if tag in MARKED or (node and inside[page.parent[node]] == 1):
            inside[node] = 1
            found = found or tag in MARKED
    if not found:
        return None
    for node in range(len(inside) - 1, 0, -1):
        if inside[node]:
            inside[page.parent[node]] = 1
    return inside


_CLUTTER = (("aside", BIT["against_tag"]), ("form", BIT["against_tag"]), ("header", BIT["against_tag"]),
            ("div", BIT["box"] | BIT["against_cue"]), ("section", BIT["box"] | BIT["against_cue"]), ("ul", BIT["list"] | BIT["against_cue"]))
_INSIDE = ((BIT["paragraph"], BIT["under_paragraph"]), (BIT["item"], BIT["under_item"]), (BIT["heading"], BIT["under_heading"]), (BIT["box"], 0))


def varied(page: Page, label: np.ndarray, rng: np.random.Generator, texts: list[tuple[str, int]]) -> tuple[Page, np.ndarray]:
    """A copy whose article may be a plain box and may have clutter inside, with runs like those in ``texts``."""
    made = Page()
    made.parent, made.bits, made.tag, made.depth = (list(x) for x in (page.parent, page.bits, page.tag, page.depth))
    labels = label.tolist()
    loose = rng.random() < 0.2  # paragraphs are plain boxes on some pages
    for node, tag in enumerate(page.tag):
        if loose and tag == "p" and label[node]:
            made.bits[node] = made.bits[node] & ~BIT["paragraph"] | BIT["box"]
        if tag == "#text" and loose and label[node]:
            made.bits[node] &= ~BIT["under_paragraph"]
    for node in [i for i, tag in enumerate(page.tag) if tag in MARKED]:
        kind = rng.random()
        if kind < 0.6:  # the article is a box, mostly one that says so
            made.bits[node] = made.bits[node] & ~BIT["for_tag"] | BIT["box"] | (BIT["for_cue"] if kind < 0.4 else 0)
        for _ in range(rng.integers(0, 4)):
            tag, bits = _CLUTTER[rng.integers(len(_CLUTTER))]
            box = made.add(node, BIT["element"] | bits, tag)
            labels.append(0)
            for _ in range(rng.integers(1, 7)):
                inner, under = _INSIDE[rng.integers(len(_INSIDE))]
                place = made.add(box, BIT["element"] | inner, "p")
                bits = texts[rng.integers(len(texts))][1] & ~(BIT["under_heading"] | BIT["under_paragraph"] | BIT["under_item"])
                made.add(place, bits | under, "#text")
                labels += [0, 0]
    return made, np.array(labels)


def fit_pages(pages: list[Page], seed: int = 11) -> Model:
    """Maximum likelihood on the pages that mark their article, with the variations beside them."""
    rng = np.random.default_rng(seed)
    known = [(p, m) for p in pages if (m := marked_nodes(p)) is not None]
    if not known:
        return built_in()
    texts = [(t, p.bits[i]) for p, _ in known for i, t in p.texts.items()] or [("", BIT["leaf"] | BIT["tiny"])]
    known += [varied(p, m, rng, texts) for p, m in known]
    trees, label = forest([p for p, _ in known]), np.concatenate([m for _, m in known])
    start = built_in()
    weight, table = start.weight.copy(), start.fit.copy()
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (trees.edge[child], label[trees.parent[child]], label[child]), 1.0)
    observed = trees.features.T @ label
    moments = [np.zeros_like(weight), np.zeros_like(table)]
    squares = [np.zeros_like(weight), np.zeros_like(table)]
    for step in range(1, STEPS + 1):
        content, joint, _ = marginals(trees, Model(weight, table))
        expected = np.stack([joint[child][trees.edge[child] == kind].sum(0) for kind in (0, 1)])
        slopes = ((observed - trees.features.T @ content) / len(known) - PENALTY * weight, (seen - expected) / len(known) - PENALTY * table)
        for k, (value, slope) in enumerate(zip((weight, table), slopes)):
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            squares[k] = 0.99 * squares[k] + 0.01 * slope * slope
            value += RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-6)
    return Model(weight, table)


def train(pages: DataFrame) -> Model:
    """Learn from at most ``TRAINING_PAGES`` different pages of at most ``TRAINING_CHARS``, chosen by a hash of the page."""
    rows = pages.where(F.col("html").isNotNull() & (F.length("html") <= TRAINING_CHARS)).select("html", F.xxhash64("html").alias("h"))
    # a hash lets about four times as many different pages through, so that no task sends more than its part of them
    share = min(1.0, 4 * TRAINING_PAGES / max(1, rows.agg(F.approx_count_distinct("h")).first()[0]))
    drawn = rows.where(F.shiftrightunsigned("h", 11) <= F.lit(share * 2.0**53)).dropDuplicates(["h"])
    found = drawn.orderBy("h").limit(TRAINING_PAGES).collect()
    return fit_pages([read_page(r["html"]) for r in found])


# --- extraction -------------------------------------------------------------------


def chances(pages: list[Page], model: Model) -> list[list[tuple[str, float]]]:
    """The runs of every page in order, each with its probability of being content."""
    if not pages:
        return []
    content, _, _ = marginals(forest(pages), model)
    made, start = [], 0
    for page in pages:
        made.append([(text, float(content[start + node])) for node, text in sorted(page.texts.items())])
        start += len(page.parent)
    return made


def _extract(shared):
    def make():
        model = Model(*shared.value)

        def work(sources: pa.Array) -> pa.Array:
            texts, counts, waiting, nodes = [], [], [], 0

            def done() -> None:
                for runs in chances(waiting, model):
                    texts.append("\n".join(text for text, chance in runs if chance > 0.5))
                    counts.append(len(runs))
                waiting.clear()

            for data in sources.to_pylist():
                waiting.append(read_page(data.decode("utf-8", "replace") if data else None))
                nodes += len(waiting[-1].parent)
                if nodes >= _NODES:
                    done()
                    nodes = 0
            done()
            return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "blocks"])

        return work

    return array_function(make, "struct<text: string, blocks: int>")


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` of every page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(parts(model))
    rows = pages.select("page_id", "url", _extract(shared)(utf8("html")).alias("x"))
    return rows.select("page_id", "url", F.col("x.text").alias("text"), F.length("x.text").cast("bigint").alias("n_chars"),
                       F.col("x.blocks").alias("n_blocks"))
