"""A binary graphical model on a tree: node potentials from features, edge potentials by kind of child.

Sum-product messages go from the leaves up and from the root down, which gives each node's marginal and
each edge's joint in one pass each; the same pass gives the exact gradient of the likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np


@dataclass
class TreeModel:
    unary: np.ndarray  # score of state 1 less that of state 0, by feature
    edge: np.ndarray  # score by kind of child, parent's state and child's state

    def messages(self, features: list[list[int]], parent: list[int], kind: list[int]) -> tuple[list[float], list]:
        """Marginals of state 1, and (child, kind, joint 2 x 2) for each edge. Parents come before their children."""
        n, u = len(parent), self.unary.tolist()
        psi = np.exp(self.edge).tolist()
        own = [[1.0, exp(max(-30.0, min(30.0, sum(u[f] for f in fs))))] for fs in features]
        below = [x[:] for x in own]  # a node's potential and all messages from its children
        up = [[1.0, 1.0]] * n
        for i in range(n - 1, 0, -1):
            b, e = below[i], psi[kind[i]]
            m0, m1 = e[0][0] * b[0] + e[0][1] * b[1], e[1][0] * b[0] + e[1][1] * b[1]
            s = m0 + m1
            up[i] = [m0 / s, m1 / s]
            p = below[parent[i]]
            p[0] *= up[i][0]
            p[1] *= up[i][1]
            s = p[0] + p[1]
            p[0] /= s
            p[1] /= s
        marginal, edges = [0.0] * n, []
        s = below[0][0] + below[0][1]
        belief = [[below[0][0] / s, below[0][1] / s]] + [[0.0, 0.0]] * (n - 1)
        marginal[0] = belief[0][1]
        for i in range(1, n):
            p, e, b = belief[parent[i]], psi[kind[i]], below[i]
            # What the parent believes without this child.
            d0, d1 = p[0] / up[i][0], p[1] / up[i][1]
            j = [[d0 * e[0][0] * b[0], d0 * e[0][1] * b[1]], [d1 * e[1][0] * b[0], d1 * e[1][1] * b[1]]]
            s = sum(j[0]) + sum(j[1])
            j = [[x / s for x in r] for r in j]
            belief[i] = [j[0][0] + j[1][0], j[0][1] + j[1][1]]
            marginal[i] = belief[i][1]
            edges.append((i, kind[i], j))
        return marginal, edges


def fit(pages: list[tuple], n_features: int, n_kinds: int, steps: int = 120, rate: float = 0.5, decay: float = 0.02) -> TreeModel:
    """Ascends the penalised likelihood of ``pages`` (features, parent, kind, states) by Adagrad."""
    model = TreeModel(np.zeros(n_features), np.zeros((n_kinds, 2, 2)))
    seen_u, seen_e = np.full(n_features, 1e-8), np.full((n_kinds, 2, 2), 1e-8)
    for _ in range(steps):
        gu, ge = -decay * model.unary, -decay * model.edge
        for features, parent, kind, state in pages:
            marginal, edges = model.messages(features, parent, kind)
            for fs, m, y in zip(features, marginal, state):
                for f in fs:
                    gu[f] += y - m
            for i, k, j in edges:
                ge[k] -= j
                ge[k][state[parent[i]]][state[i]] += 1
        seen_u += gu * gu
        seen_e += ge * ge
        model.unary += rate * gu / np.sqrt(seen_u)
        model.edge += rate * ge / np.sqrt(seen_e)
    return model


def log_loss(model: TreeModel, pages: list[tuple]) -> float:
    """Mean negative log of the marginals of the given states."""
    losses = [-log(max(1e-12, m if y else 1 - m)) for f, p, k, s in pages for m, y in zip(model.messages(f, p, k)[0], s)]
    return sum(losses) / max(1, len(losses))
