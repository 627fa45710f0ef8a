"""Main text of web pages by a tree-structured graphical model over their DOM.

Block elements are nodes with two states, main text or not. Features of an element (tag, names, amount of own text and of
text below it, share of link text, sentence ends) give its own potential, learned parent-child potentials tie it to its parent, and sum-product messages upward and downward give
exact marginals. Text goes with its nearest block element; inline markup is no node. Trees of many pages are worked on
together, one depth at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole

# Fixed values of HTML: elements that run inside a line, that hold no markup, that are empty, and what closes what.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video".split())
FOREIGN = frozenset("svg math".split())  # only these may close themselves with a slash
EMPTY = frozenset("area base col embed hr img input link meta param source track".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "option optgroup", "thead": "", "tbody": "thead", "tfoot": "tbody", "body": "head"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
BARRIERS = frozenset("table ul ol dl select body html article section div main nav aside header footer form".split())
IN_PARAGRAPH = frozenset("p option".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
LABEL = re.compile(r"\bdata-label=\"([01])\"")
ENDS = re.compile(r"[.!?;:,\u3002\uff0c](?:\s|$)")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BUCKETS = 1 << 12
#: Nodes worked on together
AT_ONCE = 50_000
#: Trees of this depth or more are worked on node by node, which is cheaper than level by level where levels are narrow
DEEP = 300
GROUPS = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 pre blockquote figcaption address".split()} | {t: 2 for t in "ul ol dl table figure".split()}
GROUPS |= {t: 3 for t in "li dt dd thead tbody tfoot tr td th caption".split()}  # parts of what is above them
KINDS = 4
REGIONS = frozenset("main article nav header footer aside form".split())


@dataclass
class Tree:
    """One page: nodes in page order (a parent before its children) and text runs with their node."""

    parents: list[int]
    depths: list[int]
    groups: list[int]
    features: list[list[str]]
    labels: list[int]
    runs: list[tuple[int, str]]


def parse(page: str) -> Tree:
    """The tree of block elements of a page, however broken its markup. Text outside all elements belongs to the root.

    In training pages ``data-label`` carries labels; that of the root stands in the document type.
    """
    top = LABEL.search(page, 0, 60) if page.startswith("<!") else None
    tree = Tree([-1], [0], [0], [["tag:#"]], [int(top[1]) if top else 0], [])
    stack, tags = [0], ["#"]
    buffer: list[str] = []
    words, linked, ends, links = [0], [0], [0], 0
    regions = [""]  # nearest element around each node, or itself, whose tag names a region

    def flush() -> None:
        nonlocal buffer
        if buffer:
            if run := " ".join(html.unescape("".join(buffer)).split()):
                tree.runs.append((stack[-1], run))
            buffer = []

    def text(raw: str) -> None:
        if raw:
            buffer.append(raw)
            n = len(raw.split())
            words[stack[-1]] += n
            ends[stack[-1]] += len(ENDS.findall(raw)) if n else 0
            if links:
                linked[stack[-1]] += n

    def pop(to: int) -> None:
        del stack[to:], tags[to:]

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        slash, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            if not slash and not (tag in FOREIGN and rest.endswith("/")):
                close = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "br":
            flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if slash else 1
            continue
        flush()
        links = 0
        if slash:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == tag:
                    pop(k)
                    break
            continue
        if tag in EMPTY:
            continue
        if tag in CLOSES:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in CLOSES[tag]:
                    pop(k)
                    break
                if tags[k] in BARRIERS:
                    break
        if tags[-1] in IN_PARAGRAPH and tag != "option":
            pop(len(tags) - 1)
        names = {p.lower() for m in NAMES.findall(rest) for p in PART.findall(m)}
        label = LABEL.search(rest)
        tree.parents.append(stack[-1])
        tree.depths.append(len(stack))
        tree.groups.append(GROUPS.get(tag, 0))
        tree.features.append([f"tag:{tag}", *(f"name:{n}" for n in sorted(names))] if names else [f"tag:{tag}", f"bare:{tag}"])
        regions.append(tag if tag in REGIONS else regions[stack[-1]])
        tree.features[-1].append(f"in:{regions[-1]}")
        if tree.groups[-1] == 3:  # a part of a list or table knows the names of the whole
            tree.features[-1] += [f"up:{f.partition(':')[2]}" for f in tree.features[stack[-1]] if f.startswith(("name:", "up:"))]
        tree.labels.append(int(label[1]) if label else tree.labels[stack[-1]])
        words.append(0)
        linked.append(0)
        ends.append(0)
        stack.append(len(tree.parents) - 1)
        tags.append(tag)
    flush()
    below, below_linked = words.copy(), linked.copy()
    for k in range(len(words) - 1, 0, -1):
        below[tree.parents[k]] += below[k]
        below_linked[tree.parents[k]] += below_linked[k]
    total = max(1, below[0])
    plain = not below_linked[0] and not any(f.startswith("name:") for names in tree.features for f in names)
    for n, l, e, m, o, names in zip(words, linked, ends, below, below_linked, tree.features):
        # Amounts in powers of two; shares in quarters.
        if n:
            names += (f"links:{4 * l // n}", f"own:{n.bit_length()}", f"ends:{min(e, 4)}:{min(n.bit_length(), 5)}", f"plain:{plain}")
        if m:
            names += (f"below:{m.bit_length()}", f"under:{4 * o // m}", f"part:{min(8, (total // m).bit_length())}")
        else:
            names.append("void")
    return tree


def bucket(name: str) -> int:
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS, log odds of main text
    ties: np.ndarray  # groups of elements x parent state x own state


def _deep_beliefs(parents: list[int], groups: list[int], own: list[float], ties: np.ndarray) -> list[float]:
    """Marginals of state 1 of one tree, node by node: the same messages as ``_Forest.beliefs`` sends level by level."""
    add = lambda a, b: (a if a > b else b) + log1p(exp(-abs(a - b)))
    t = ties.tolist()
    n = len(parents)
    zero, one = [0.0] * n, list(own)
    to_zero, to_one = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):  # children come after their parents
        (a, b), (c, d) = t[groups[k]]
        up = parents[k]
        to_zero[k], to_one[k] = add(a + zero[k], b + one[k]), add(c + zero[k], d + one[k])
        zero[up] += to_zero[k]
        one[up] += to_one[k]
    for k in range(1, n):
        (a, b), (c, d) = t[groups[k]]
        up = parents[k]
        x, y = zero[up] - to_zero[k], one[up] - to_one[k]
        zero[k] += add(x + a, y + c)
        one[k] += add(x + b, y + d)
        low = min(zero[k], one[k])  # only the difference matters; keep numbers small down long chains
        zero[k] -= low
        one[k] -= low
    return [1 / (1 + exp(min(500.0, max(-500.0, z - o)))) for z, o in zip(zero, one)]


class _Forest:
    """Arrays of several trees; nodes grouped by depth."""

    def __init__(self, trees: list[Tree], known: dict[str, int]):
        sizes = np.array([len(t.parents) for t in trees])
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parents = np.array([p for t in trees for p in t.parents])
        self.parents = np.where(parents < 0, -1, parents + base)
        self.groups = np.array([g for t in trees for g in t.groups])
        depths = np.array([d for t in trees for d in t.depths])
        order = np.argsort(depths, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depths))[:-1])
        names = [f for t in trees for f in t.features]
        self.owner = np.repeat(np.arange(len(names)), [len(f) for f in names])
        for f in names:
            for x in f:
                if x not in known:
                    known[x] = bucket(x)
        self.buckets = np.array([known[x] for f in names for x in f])

    def beliefs(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials from below, and marginals of state 1 and of (parent state, own state)."""
        n = len(self.parents)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.owner, model.weights[self.buckets], n)
        message = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            both = model.ties[self.groups[level]] + up[level][:, None, :]
            message[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parents[level], message[level])
        down, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = self.parents[level]
            rest = up[above] + down[above] - message[level]
            both = rest[:, :, None] + model.ties[self.groups[level]]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            joint = both + up[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), pair


def train(pages: Iterable[str], epochs: int = 200, rate: float = 0.6) -> Model:
    """Maximum likelihood on pages whose elements carry labels; expected counts come from message passing."""
    trees = [parse(p) for p in pages]
    weights, ties = np.zeros(BUCKETS), np.zeros((KINDS, 2, 2))
    if not trees:
        return Model(weights, ties)
    forest = _Forest(trees, {})
    y = np.array([l for t in trees for l in t.labels])
    child = np.flatnonzero(forest.parents >= 0)
    target = np.zeros((len(y), 2, 2))
    target[child, y[forest.parents[child]], y[child]] = 1
    sums = [np.full(BUCKETS, 1e-6), np.full((KINDS, 2, 2), 1e-6)]
    for _ in range(epochs):
        node, pair = forest.beliefs(Model(weights, ties))
        g = np.bincount(forest.buckets, (y - node)[forest.owner], BUCKETS) / len(trees) - 2e-4 * weights
        h = np.zeros((KINDS, 2, 2))
        np.add.at(h, forest.groups[child], (target - pair)[child])
        h = h / len(trees) - 2e-4 * ties
        for value, grad, square in ((weights, g, sums[0]), (ties, h, sums[1])):
            square += grad * grad
            value += rate * grad / np.sqrt(square)
    return Model(weights, ties)


def main_texts(model: Model, pages: Iterable[str]) -> Iterator[str]:
    """Main text of every page: runs of main-text nodes in page order, joined by one space."""
    known: dict[str, int] = {}
    held: list[Tree] = []
    size = 0

    def flush() -> Iterator[str]:
        flat = [t for t in held if max(t.depths) < DEEP]
        node, _ = _Forest(flat, known).beliefs(model) if flat else ([], None)
        base = 0
        for tree in held:
            if max(tree.depths) < DEEP:
                own = node[base : base + len(tree.parents)]
                base += len(tree.parents)
            else:
                weight = {x: float(model.weights[bucket(x)]) for f in tree.features for x in f}
                own = _deep_beliefs(tree.parents, tree.groups, [sum(map(weight.__getitem__, f)) for f in tree.features], model.ties)
            yield " ".join(run for at, run in tree.runs if own[at] > 0.5)
        if len(known) > 100_000:
            known.clear()

    for page in pages:
        held.append(parse(page))
        size += len(held[-1].parents)
        if size >= AT_ONCE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text, n_chars of every row; text is empty where nothing is main text or the page is missing or empty.

    Pages are read whole. Character references are decoded, white space within a block becomes one space, blocks are
    joined by one space in page order. Repeated rows give repeated rows, missing keys and addresses pass through, and an
    empty table gives an empty result.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        texts = list(main_texts(model, batch["h"]))
        n = np.array([len(t) for t in texts], np.int64)
        return pd.DataFrame({"u": batch["u"], "text": pd.Series(texts, dtype=object), "n_chars": n})

    kinds = dict(pages.select(key, url).dtypes)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("u"), whole(source).alias("h"))
    out = map_keyed(rows, run, f"u {kinds[url]}, text string, n_chars long")
    return out.select(F.col("id").alias(key), F.col("u").alias(url), "text", "n_chars")
