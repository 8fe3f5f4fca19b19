"""Similarity flooding between two schema graphs.

A schema graph has a node for each field and nodes for what fields share: tokens of their
names, their JSON types, shapes of their values, words of their prose, and the keys nested
in them. Pairs of nodes joined by edges of one label in both graphs pass their similarity
on to each other, divided among the pairs they feed, until the scores stand still. What is
taken for one field is selected from those scores alone, by how a pair stands to its rivals
and to the fields that both schemas have.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\x00-\x7f]+")


@dataclass
class Field:
    """What one file's records show of a field."""

    name: str
    type: str | None
    shapes: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    children: dict[str, "Field"] = field(default_factory=dict)


def name_tokens(name: str) -> list[str]:
    """Words and numbers of a name, in lower case: ``climbAltitude_2`` is climb, altitude, 2."""
    found = [t.lower() for t in _TOKEN.findall(name)]
    # a number belongs to the letters before it: q7 is not q8
    joined: list[str] = []
    for t in found:
        if t.isdigit() and joined:
            joined[-1] += t
        else:
            joined.append(t)
    return joined or [name.lower()]


def token_likeness(a: str, b: str) -> float:
    """1 for equal tokens, 0.8 if one of three letters or more begins the other, else the
    share of a common beginning of three letters or more; 0 if their numbers differ."""
    if a == b:
        return 1.0
    if re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return 0.0
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if common < 3:
        return 0.0
    return 0.8 if common == min(len(a), len(b)) else common / max(len(a), len(b))


def name_likeness(a: str, b: str) -> float:
    """Mean over the shorter name's tokens of their best likeness in the other."""
    x, y = sorted((name_tokens(a), name_tokens(b)), key=len)
    return sum(max(token_likeness(s, t) for t in y) for s in x) / len(x)


def _spread(weight: np.ndarray) -> np.ndarray:
    """Each node's edges of one label share its weight."""
    total = weight.sum(axis=0, keepdims=True)
    return np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)


def _nodes(weights: list[dict[str, float]]) -> list[str]:
    return sorted({n for w in weights for n in w})


def _edges(weights: list[dict[str, float]], nodes: list[str]) -> np.ndarray:
    at = {n: i for i, n in enumerate(nodes)}
    edges = np.zeros((len(weights), len(nodes)))
    for i, weight in enumerate(weights):
        for n, w in weight.items():
            if n in at:
                edges[i, at[n]] = w
    return edges


def _sums(weights: list[dict[str, float]], power: int) -> np.ndarray:
    return np.array([math.fsum(x**power for x in w.values()) for w in weights], float)


class _Alike:
    """A layer in which any two nodes can be alike: a score for every pair of nodes."""

    def __init__(self, wa: list[dict[str, float]], wb: list[dict[str, float]], like) -> None:
        na, nb = _nodes(wa), _nodes(wb)
        ea, eb = _edges(wa, na), _edges(wb, nb)
        self.start = np.array([[like(x, y) for y in nb] for x in na]).reshape(len(na), len(nb))
        self.score = self.start
        self.down_a, self.down_b, self.up_a, self.up_b = _spread(ea), _spread(eb), _spread(ea.T), _spread(eb.T)
        self.product = ea @ self.start @ eb.T

    def down(self) -> np.ndarray:
        return self.down_a @ (self.start + self.score) @ self.down_b.T

    def up(self, held: np.ndarray) -> np.ndarray:
        return self.start + self.score + self.up_a @ held @ self.up_b.T * (self.start > 0)


class _Equal:
    """A layer in which only equal nodes are alike: a score for every node that both schemas
    have. Time and memory follow their number and not its square, so a field may have as many
    words as it likes.

    What a pair of fields takes from its nodes is weighted by the root of their shares in
    either field, which sum to 1 at most: many words count no more than few.
    """

    def __init__(self, wa: list[dict[str, float]], wb: list[dict[str, float]]) -> None:
        self.shape = len(wa), len(wb)
        # fields without a node pass nothing on
        self.at = [i for i, w in enumerate(wa) if w], [j for j, w in enumerate(wb) if w]
        wa, wb = [wa[i] for i in self.at[0]], [wb[j] for j in self.at[1]]
        nodes = sorted(set().union(*wa) & set().union(*wb))
        ea, eb = _edges(wa, nodes), _edges(wb, nodes)
        self.start = np.ones(len(nodes))
        self.score = self.start
        # what a field passes on goes to the nodes that only one schema has, too
        share_a, share_b = ea / _sums(wa, 1)[:, None], eb / _sums(wb, 1)[:, None]
        self.up_a, self.up_b = share_a.T, share_b.T
        self.down_a, self.down_b = _spread(ea) * np.sqrt(share_a), _spread(eb) * np.sqrt(share_b)
        self.product = self._placed(ea @ eb.T)

    def _placed(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape)
        out[np.ix_(*self.at)] = found
        return out

    def down(self) -> np.ndarray:
        return self._placed((self.down_a * (self.start + self.score)) @ self.down_b.T)

    def up(self, held: np.ndarray) -> np.ndarray:
        return self.start + self.score + ((self.up_a @ held[np.ix_(*self.at)]) * self.up_b).sum(axis=1)


def _tokens(f: Field) -> dict[str, float]:
    tokens = name_tokens(f.name)
    return {t: 1.0 / len(tokens) for t in tokens}


def _kinds(f: Field) -> dict[str, float]:
    return {f.type or "?": 1.0}


def _shapes(f: Field) -> dict[str, float]:
    total = sum(f.shapes.values())
    return {s: n / total for s, n in f.shapes.items()} if total else {}


def _children(f: Field) -> dict[str, float]:
    return {c.lower(): 1.0 / len(f.children) for c in f.children}


def _words(f: Field) -> dict[str, float]:
    total = sum(f.words.values())
    return {w: n / total for w, n in f.words.items()} if total else {}


#: nodes of a field, likeness of two such nodes; without one only equal nodes are alike
_LAYERS = ((_tokens, token_likeness), (_kinds, None), (_shapes, None), (_words, None), (_children, token_likeness))
#: Least likeness of name and content from which a pair of fields is a node of the graph.
LEAST_START = 0.15
#: What a flooded score must be of the best in its row and column, and of the usual score of a field with itself.
RELATIVE, USUAL = 0.7, 0.2


def initial(a: list[Field], b: list[Field], alike: list[np.ndarray]) -> np.ndarray:
    """Mean likeness of name and content. Content is the words of prose, the keys of objects,
    the shapes of other values; booleans have none that tells one from another."""
    name, _, shapes, words, keys = alike
    both = lambda has: np.array([has(f) for f in a], bool)[:, None] & np.array([has(f) for f in b], bool)[None, :]
    plain = both(lambda f: f.type == "boolean")
    content = np.where(both(lambda f: bool(f.words)), words, np.where(both(lambda f: bool(f.children)), keys, np.where(plain, 0.0, shapes)))
    start = (name + content) / 2
    return np.where(start < LEAST_START, 0.0, start)


def flood(a: list[Field], b: list[Field], rounds: int = 100, still: float = 1e-4) -> np.ndarray:
    """Similarity of each field of ``a`` to each of ``b``, at the fixpoint, 1 for the best pair.

    Pairs that are alike in nothing at the start are no nodes and stay at 0. Empty schemas
    give an empty matrix.
    """
    if not a or not b:
        return np.zeros((len(a), len(b)))
    layers, alike = [], []
    for of, like in _LAYERS:
        wa, wb = [of(f) for f in a], [of(f) for f in b]
        layer = _Equal(wa, wb) if like is None else _Alike(wa, wb, like)
        if layer.start.size:
            layers.append(layer)
        size = np.sqrt(_sums(wa, 2))[:, None] * np.sqrt(_sums(wb, 2))[None, :]
        alike.append(np.minimum(1.0, np.divide(layer.product, size, out=np.zeros((len(a), len(b))), where=size > 0)))
    base = initial(a, b, alike)
    node = base > 0
    now = base.copy()
    for _ in range(rounds):
        held = base + now
        grown = held.copy()
        passed = []
        for layer in layers:
            grown += layer.down() * node
            passed.append(layer.up(held))
        top = max([grown.max(), *(p.max() for p in passed), 1e-12])
        grown /= top
        for layer, p in zip(layers, passed):
            layer.score = p / top
        done = np.abs(grown - now).max() < still
        now = grown
        if done:
            break
    return now / max(now.max(), 1e-12)


def correspondences(a: list[Field], b: list[Field], gone: set[str], new: set[str]) -> list[tuple[str, str]]:
    """Renamed fields: a stable matching of the fields that vanish with those that appear.

    Pairs are taken in the order of their flooded similarity (names break ties). A pair is
    one field if its score reaches ``RELATIVE`` of the best that either of its fields has
    with any field, and ``USUAL`` of the median score of the fields of one name in both.
    """
    if not gone or not new:
        return []
    score = flood(a, b)
    place = {f.name: j for j, f in enumerate(b)}
    kept = [score[i, place[f.name]] for i, f in enumerate(a) if f.name in place]
    usual = float(np.median(kept)) if kept else 1.0
    rival = np.maximum(score.max(axis=1)[:, None], score.max(axis=0)[None, :])
    one = (score > 0) & (score >= RELATIVE * rival) & (score >= USUAL * usual)
    pairs = [(-score[i, j], x.name, y.name) for i, x in enumerate(a) for j, y in enumerate(b) if x.name in gone and y.name in new and one[i, j]]
    taken: set[tuple[int, str]] = set()
    out = []
    for _, x, y in sorted(pairs):
        if (0, x) not in taken and (1, y) not in taken:
            taken |= {(0, x), (1, y)}
            out.append((x, y))
    return out
