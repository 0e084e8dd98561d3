"""Small gradient boosted trees for a logistic loss: fitted on the driver on bounded samples, scored as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Tree = float | tuple[int, float, "Tree", "Tree"]  # a leaf, or feature, threshold, left (<=), right


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    leaf = float(-g.sum() / (h.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(x) - at - 1 >= least)]
        if len(at):
            own = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - whole
            k = int(own.argmax())
            if own[k] > gain:
                gain, best = float(own[k]), (f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return leaf
    left = x[:, best[0]] <= best[1]
    return (*best, _grow(x[left], g[left], h[left], depth - 1, least, ridge), _grow(x[~left], g[~left], h[~left], depth - 1, least, ridge))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _apply(left, x), _apply(right, x))


def _sql(tree: Tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, t, left, right = tree
    return f"if({names[f]} <= {t:.6f}D, {_sql(left, names)}, {_sql(right, names)})"


@dataclass
class Boosted:
    names: list[str]
    start: float
    rate: float
    trees: list[Tree]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def p(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def sql(self, prefix: str) -> str:
        """Calibrated probability over the fields ``prefix.name``."""
        own = [f"{prefix}.{n}" for n in self.names]
        total = " + ".join([f"{self.start:.6f}D", *[f"{self.rate:.6f}D * {_sql(t, own)}" for t in self.trees]])
        return f"(1D / (1D + exp(-({self.scale:.6f}D * ({total}) + {self.shift:.6f}D))))"


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.99) -> Boosted:
    """Every third row is held out: Platt scaling and the threshold, the lowest with that precision, come from these."""
    held = np.arange(len(x)) % 3 == 0
    tx, ty = x[~held], y[~held].astype(float)
    mean = min(max(ty.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(names, float(np.log(mean / (1 - mean))), rate, [])
    z = np.full(len(tx), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(tx, p - ty, p * (1 - p), depth, 8, 1.0)
        model.trees.append(tree)
        z += rate * _apply(tree, tx)
    from regspark.llm.quality import _platt

    raw, truth = model.raw(x[held]), y[held].astype(bool)
    model.scale, model.shift = _platt(raw, truth)
    p = model.p(x[held])
    good = [t for t in np.linspace(0.5, 0.99, 50) if (p >= t).any() and truth[p >= t].mean() >= precision]
    model.threshold = float(good[0]) if good else 0.99
    return model
