"""A two-state graphical model on trees: each node has binary features, each
edge a potential by the kind of its child. Sum-product messages upward and
downward give exact marginals; training maximises the labels' likelihood, whose
gradient the marginals are.

Many trees are handled as one forest, a level at a time in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Forest:
    """``parent`` (-1 for roots, else an earlier node), ``kind`` of each node,
    ``rows``/``features``/``values``: the features that are set, as (node,
    feature, weight) triples."""
    parent: np.ndarray
    kind: np.ndarray
    rows: np.ndarray
    features: np.ndarray
    values: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Nodes by depth, which pointer doubling finds."""
        up = np.where(self.parent < 0, len(self.parent), self.parent)
        up = np.append(up, len(self.parent))
        steps = np.append((self.parent >= 0).astype(np.int64), 0)
        while (up[:-1] < len(self.parent)).any():
            steps, up = steps + steps[up], up[up]
        order = np.argsort(steps[:-1], kind="stable")
        return np.split(order, np.flatnonzero(np.diff(steps[order])) + 1)


@dataclass
class Model:
    weights: np.ndarray   # of the features, for state 1
    edges: np.ndarray     # (kinds, parent's state, child's state)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of state 1 of each node, joint (node, parent's state, own
    state) of each edge, log of the normalising constant)."""
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.rows, weights=model.weights[forest.features] * forest.values, minlength=n)
    below, message = own.copy(), np.zeros((n, 2))
    edge = model.edges[forest.kind]
    levels = forest.levels
    for level in reversed(levels[1:]):
        message[level] = _log_sum(below[level, None, 0] + edge[level, :, 0], below[level, None, 1] + edge[level, :, 1])
        np.add.at(below, forest.parent[level], message[level])
    above = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        up = forest.parent[level]
        rest = below[up] + above[up] - message[level]
        both = rest[:, :, None] + edge[level]
        above[level] = _log_sum(both[:, 0], both[:, 1])
        joint[level] = both + below[level][:, None, :]
    belief = below + above
    total = _log_sum(belief[:, 0], belief[:, 1])
    joint = np.exp(joint - total[:, None, None])
    joint[forest.parent < 0] = 0.0
    return np.exp(belief[:, 1] - total), joint, float(total[levels[0]].sum())


def likelihood(forest: Forest, labels: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of the labels, gradient of weights, gradient of edges)."""
    p, joint, log_z = marginals(forest, model)
    inner = forest.parent >= 0
    yp = labels[forest.parent[inner]]
    kind = forest.kind[inner]
    score = (model.weights[forest.features] * forest.values * labels[forest.rows]).sum() \
        + model.edges[kind, yp, labels[inner]].sum()
    grad = np.bincount(forest.features, weights=(labels - p)[forest.rows] * forest.values,
                       minlength=len(model.weights))
    edges = np.zeros_like(model.edges)
    np.add.at(edges, (kind, yp, labels[inner]), 1.0)
    np.add.at(edges, kind, -joint[inner])
    return float(score) - log_z, grad, edges


def train(forest: Forest, labels: np.ndarray, n_features: int, n_kinds: int, steps: int = 200, rate: float = 0.4,
          decay: float = 0.02) -> Model:
    """Weights and edge potentials of the greatest likelihood less
    ``decay`` / 2 times their squares, by full-gradient Adam steps."""
    model = Model(np.zeros(n_features), np.zeros((n_kinds, 2, 2)))
    size = model.weights.size
    x, first, second = np.zeros(size + model.edges.size), 0.0, 0.0
    for t in range(1, steps + 1):
        _, grad, edges = likelihood(forest, labels, model)
        g = np.concatenate([grad, edges.ravel()]) - decay * x
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x + rate * (1 - t / (steps + 1)) ** 0.5 * (first / (1 - 0.9 ** t)) / (
            np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        model = Model(x[:size], x[size:].reshape(n_kinds, 2, 2))
    return model
