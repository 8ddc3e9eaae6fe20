"""Main text of pages by a tree-structured graphical model over their DOM.

Every element of a page is a binary variable, content or not. Its own potential is linear in what the
element is (kind, words of its classes, how much text, how much of it in links, how it is punctuated);
a parent and a child share a potential that depends on what the child is. A page's model is a tree,
so messages from the leaves up and from the root down (sum-product) give exact marginals; text is kept
where its element is content with probability one half or more.

The weights maximise the likelihood of labelled pages (``html_layouts``): at most ``MOST_PAGES`` pages
of at most ``MOST_CHARS`` characters, those of the smallest id hashes, and pages composed from their
parts. Fitting takes place once, on the driver; pages are then read in one pass without a shuffle, and
messages of all pages of a slab are passed together, a level of depth at a time.

Defined cases: null html gives '' and 0; null ids and urls are kept; repeated rows each give a row; an
empty table gives none; a table without labelled pages is fitted on pages composed from a few plain
sentences; html of any length is read whole; broken markup never fails (``html_tree``); other columns
are not read.
"""

from __future__ import annotations

import html
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import html_layouts as layouts
from plumbline.llm import html_tree as ht
from plumbline.llm import textkit as tk

#: Pages that the model is fitted on at most, their longest, and the pages composed from their parts.
MOST_PAGES, MOST_CHARS, COMPOSED = 120, 40_000, 600
#: Characters of html whose messages are passed together.
SLAB = 1 << 20

#: Characters beyond which a text counts as no longer: weights aren't carried on beyond what was fitted.
LONG = 2000

_N_KINDS = len(ht.KINDS)
_KIND = {name: i for i, name in enumerate(ht.KINDS)}
_OUT_KINDS = [_KIND[k] for k in ("nav", "header", "footer", "aside", "form", "noscript")]
_OUT = layouts._OUT | ht.HINT["header"] | ht.HINT["footer"]
#: Kinds of edges, by the child: inline, named as something beside the article, named as content, a part of a list or table, a block, a child of the page's root.
EDGES = 6


def _up(a: dict, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each node and all below it."""
    total = values.astype(np.float64)
    for d in range(len(a["levels"]) - 2, 0, -1):
        part = slice(a["levels"][d], a["levels"][d + 1])
        np.add.at(total, a["parent"][part], total[part])
    return total


def _within(a: dict, flag: np.ndarray) -> np.ndarray:
    """Whether an element above a node has the flag."""
    out = np.zeros(len(flag), bool)
    for d in range(1, len(a["levels"]) - 1):
        part = slice(a["levels"][d], a["levels"][d + 1])
        up = a["parent"][part]
        out[part] = out[up] | flag[up]
    return out


def _beside(a: dict) -> np.ndarray:
    """Elements whose kind or name says that they stand beside the article."""
    return ((a["hints"] & _OUT) > 0) | np.isin(a["kind"], _OUT_KINDS)


def features(a: dict) -> np.ndarray:
    """(nodes, features) from a page's arrays."""
    kind, hints, chars, parent = a["kind"], a["hints"], a["chars"], a["parent"]
    n = len(kind)
    rows = np.arange(n)
    kinds = np.zeros((n, _N_KINDS), np.float32)
    kinds[rows, kind] = 1
    bits = ((hints[:, None] >> np.arange(ht.N_HINTS)) & 1).astype(np.float32)
    below, linked, stops, paragraphs, items = (_up(a, v) for v in (chars, a["linked"], a["stops"], (kind == _KIND["paragraph"]) & (chars > 0), kind == _KIND["link"]))
    density = linked / np.maximum(below, 1)
    size = np.digitize(below, [1, 25, 100, 400, 2000])
    sizes = np.zeros((n, 6), np.float32)
    sizes[rows, size] = 1
    whole = below[np.maximum(0, np.flatnonzero(parent < 0))] if n else below
    share = below / np.maximum(1, whole[a["page"]] if n else below)
    beside = _beside(a)
    under = _within(a, beside)
    fair = ~(beside | under)
    article, named = kind == _KIND["article"], (hints & ht.HINT["content"]) > 0
    heads = (kind == _KIND["heading"]).astype(np.float64)
    more = [
        np.ones(n), density > 0.3, density > 0.7, stops > 0, stops > 2, np.log1p(np.minimum(stops, 10)), paragraphs > 1, paragraphs > 4, items > 2, share > 0.3, share > 0.7, _up(a, a["sign"]) > 0, (chars > 0) & (a["stops"] == 0), chars > 80,
        np.log1p(np.minimum(chars, LONG)) / 5, np.log1p(np.minimum(below, LONG)) / 5, (_up(a, heads) > 0) & (kind != _KIND["heading"]), a["sign"] > 0, beside, under, article & fair, named & fair, _within(a, article & fair) & fair, _within(a, named & fair) & fair, (kind == _KIND["root"]) & (chars > 0),
    ]
    return np.concatenate([kinds, bits, sizes, np.stack([np.asarray(m, np.float32) for m in more], axis=1)], axis=1)


def edge_kinds(a: dict) -> np.ndarray:
    """The kind of each node's edge to its parent."""
    kind, hints = a["kind"], a["hints"]
    named_out = _beside(a)
    out = np.full(len(kind), 4)
    out[np.isin(kind, [_KIND[k] for k in ("item", "table", "paragraph", "heading", "quote", "list")])] = 3
    out[((hints & ht.HINT["content"]) > 0) | (kind == _KIND["article"])] = 2
    out[np.isin(kind, [_KIND[k] for k in ("inline", "link")])] = 0
    out[named_out] = 1
    top = a["parent"] >= 0
    out[top] = np.where((kind[a["parent"][top]] == _KIND["root"]) & (out[top] > 2), 5, out[top])
    return out


def sum_product(a: dict, score: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of content, pair marginals with the parent, log partition functions of the pages).

    ``score`` is each node's potential of being content against not; ``edges`` is (kinds, parent, child).
    Pair marginals are (nodes, parent, child); those of roots are 0.
    """
    n, parent, levels = len(score), a["parent"], a["levels"]
    own = np.stack([np.zeros(n), score], axis=1)
    sent = np.zeros((n, 2))
    for d in range(len(levels) - 2, 0, -1):
        part = slice(levels[d], levels[d + 1])
        sent[part] = np.logaddexp.reduce(own[part][:, None, :] + edges[kinds[part]], axis=2)
        np.add.at(own, parent[part], sent[part])
    roots = levels[1] if len(levels) > 1 else 0
    logs = np.logaddexp(own[:roots, 0], own[:roots, 1])
    belief, pairs = own.copy(), np.zeros((n, 2, 2))
    for d in range(1, len(levels) - 1):
        part = slice(levels[d], levels[d + 1])
        rest = belief[parent[part]] - sent[part]
        joint = rest[:, :, None] + edges[kinds[part]] + own[part][:, None, :]
        belief[part] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[part] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs, logs


@dataclass
class TextModel:
    """Weights of the features, and potentials (edge kind, parent, child)."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, a: dict) -> np.ndarray:
        return sum_product(a, features(a) @ self.weights, self.edges, edge_kinds(a))[0]


def loss_and_slopes(weights: np.ndarray, edges: np.ndarray, a: dict, x: np.ndarray, kinds: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the labels with a penalty on all weights, a page on average, and its slopes."""
    score = x @ weights
    marginal, pairs, logs = sum_product(a, score, edges, kinds)
    child = a["parent"] >= 0
    up = y[a["parent"][child]]
    told = (y * score).sum() + edges[kinds[child], up, y[child]].sum()
    pages = max(1, len(logs))
    loss = (logs.sum() - told) / pages + decay / 2 * ((weights**2).sum() + (edges**2).sum())
    slope = np.zeros_like(edges)
    np.add.at(slope, kinds[child], pairs[child])
    np.add.at(slope, (kinds[child], up, y[child]), -1.0)
    return float(loss), x.T @ (marginal - y) / pages + decay * weights, slope / pages + decay * edges


def fit_pages(pages: list[str], composed: int = COMPOSED, seed: int = 11, steps: int = 220, rate: float = 0.08, decay: float = 5e-4) -> TextModel:
    """The model of pages labelled by their markup, and of pages composed from their parts."""
    tree, labels = ht.Tree(), []
    for page in pages:
        one = ht.Tree()
        ht.add_page(one, page)
        found = layouts.labels_by_markup(one)
        if found is not None:
            ht.add_page(tree, page)
            labels += found
    parts, rng = layouts.Parts(pages), random.Random(seed)
    for _ in range(composed):
        page = layouts.compose(parts, rng)
        one = ht.Tree()
        ht.add_page(one, page)
        ht.add_page(tree, page)
        labels += layouts.labels_by_marks(one)
    a = ht.arrays(tree)
    x, kinds, y = features(a).astype(np.float64), edge_kinds(a), np.array(labels, np.int64)[a["order"]]
    params = [np.zeros(x.shape[1]), np.zeros((EDGES, 2, 2))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(loss_and_slopes(*params, a, x, kinds, y, decay)[1:]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return TextModel(*params)


def fit_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MOST_PAGES, longest: int = MOST_CHARS) -> TextModel:
    """The model fitted on at most ``most`` of the pages."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).where(F.length("html").between(1, longest))
    rows = rows.select(F.xxhash64("id").alias("a"), F.xxhash64("html").alias("b"), "html")
    last = rows.select("a", "b").orderBy("a", "b").limit(most).collect()
    # tasks first send hashes alone; pages come from those tasks that hold some of the sample
    sample = rows.where(F.col("a") <= last[-1]["a"]).orderBy("a", "b").limit(most).collect() if last else []
    return fit_pages([r["html"] for r in sample])


def texts(pages: list[str], model: TextModel) -> list[str]:
    """The main text of each page: white space is one space, blocks are joined by one space."""
    tree = ht.Tree()
    for page in pages:
        ht.add_page(tree, page)
    a = ht.arrays(tree)
    content = np.zeros(len(tree.tags), bool)
    content[a["order"]] = model.marginals(a) >= 0.5
    keep, out = content.tolist(), []
    ends = [p[1] for p in tree.pages[1:]] + [len(tree.pieces)]
    for (_, first), end in zip(tree.pages, ends, strict=True):
        blocks, block = [], []
        for piece in [*tree.pieces[first:end], None]:
            if piece is None:
                if block:
                    blocks.extend("".join(block).split())
                    block = []
            elif keep[piece[0]]:
                block.append(html.unescape(piece[1]) if "&" in piece[1] else piece[1])
        out.append(" ".join(blocks))
    return out


def extract_text(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            for rows, _, _ in tk.slabs(batch, "html", SLAB):
                found = texts([h or "" for h in rows.column(2).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every page's main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, fit_text(pages))
