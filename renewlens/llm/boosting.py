"""Small boosted models on binned features: additive tables with pairs, tree ensembles, isotonic calibration.

They are fitted on the bounded samples of labelled rows that the operators
gather, and scored by table lookups inside tasks. Everything is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RIDGE = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges per column; fewer where values repeat."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value equal to an edge belongs below it."""
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1).astype(np.int32)


def _log_loss(y: np.ndarray, raw: np.ndarray) -> float:
    return float((np.logaddexp(0, raw) - y * raw).mean())


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """(gain, position) of the best cut of bins into two."""
    if len(g) < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(hl < least) | (hr < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over the bins of one feature, as its value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], least), n) for n, (a, b) in enumerate(parts)]
        gain, at, n = max(cuts)
        if gain <= 1e-9:
            break
        a, b = parts.pop(n)
        parts += [(a, a + at + 1), (a + at + 1, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _patches(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """A shallow tree over the grid of two features: one cut, then a cut of the other feature on each side."""
    axis = max((0, 1), key=lambda a: _best_cut(g.sum(axis=1 - a), h.sum(axis=1 - a), least)[0])
    if axis:
        return _patches_first(g.T, h.T, least).T
    return _patches_first(g, h, least)


def _patches_first(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    _, at = _best_cut(g.sum(axis=1), h.sum(axis=1), least)
    sides = [(0, at + 1), (at + 1, len(g))] if at >= 0 else [(0, len(g))]
    out = np.zeros(g.shape)
    for a, b in sides:
        out[a:b] = _steps(g[a:b].sum(axis=0), h[a:b].sum(axis=0), 2, least)[None, :]
    return out


@dataclass
class Additive:
    """A generalised additive model with pairs: an intercept, a table per feature, a grid per chosen pair."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, c = binned(x, self.edges), binned(x, self.coarse)
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (f, g), grid in zip(self.pairs, self.grids):
            out += grid[c[:, f], c[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def fit_additive(
    x: np.ndarray, y: np.ndarray, bins: int = 48, grid: int = 10, rounds: int = 400, rate: float = 0.08, pairs: int = 5, leaves: int = 4
) -> Additive:
    """Cyclic boosting: every round gives each feature one shallow tree on the current residuals; then the chosen pairs.

    A seventh of the rows decides when to stop. Pairs are those whose grid explains the residuals of the
    single features best. Without both classes the model is its intercept.
    """
    model = Additive(quantile_edges(x, bins), quantile_edges(x, grid))
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    b, c = binned(x, model.edges), binned(x, model.coarse)
    check = np.arange(len(y)) % 7 == 3
    fit = ~check
    raw, least = np.full(len(y), model.base), 2.0

    def boost(slots: list[np.ndarray], tables: list[np.ndarray], grow) -> None:
        nonlocal raw
        best, kept, since = _log_loss(y[check], raw[check]), [t.copy() for t in tables], 0
        start = raw.copy()
        for _ in range(rounds):
            for slot, t in zip(slots, tables):
                p = _sigmoid(raw[fit])
                g = np.bincount(slot[fit], weights=y[fit] - p, minlength=t.size).reshape(t.shape)
                h = np.bincount(slot[fit], weights=p * (1 - p), minlength=t.size).reshape(t.shape)
                step = rate * grow(g, h)
                t += step
                raw += step.ravel()[slot]
            loss = _log_loss(y[check], raw[check])
            if loss < best - 1e-6:
                best, kept, since = loss, [t.copy() for t in tables], 0
            elif (since := since + 1) >= 25:
                break
        raw = start
        for slot, t, k in zip(slots, tables, kept):
            t[...] = k
            raw = raw + k.ravel()[slot]

    boost(list(b.T), model.tables, lambda g, h: _steps(g, h, leaves, least))
    sizes = [len(e) + 1 for e in model.coarse]
    p = _sigmoid(raw)
    found = []
    for f in range(x.shape[1]):
        for k in range(f + 1, x.shape[1]):
            slot = c[:, f] * sizes[k] + c[:, k]
            g = np.bincount(slot[fit], weights=(y - p)[fit], minlength=sizes[f] * sizes[k]).reshape(sizes[f], sizes[k])
            h = np.bincount(slot[fit], weights=(p * (1 - p))[fit], minlength=sizes[f] * sizes[k]).reshape(sizes[f], sizes[k])
            values = _patches(g, h, least)
            found.append((float((2 * values * g - values**2 * h).sum()), f, k))
    chosen = sorted(found, reverse=True)[:pairs]
    model.pairs = [(f, k) for gain, f, k in chosen if gain > 0]
    model.grids = [np.zeros((sizes[f], sizes[k])) for f, k in model.pairs]
    if model.pairs:
        boost([c[:, f] * sizes[k] + c[:, k] for f, k in model.pairs], model.grids, lambda g, h: _patches(g, h, least))
    return model


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree the feature and bin of each inner node, and the leaf values."""

    edges: list[np.ndarray]
    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    above: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def _leaf_of(self, b: np.ndarray, feature: np.ndarray, above: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > above[node])
        return node - (2**self.depth - 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for f, a, v in zip(self.feature, self.above, self.leaf):
            out += v[self._leaf_of(b, f, a)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, bins: int = 32, trees: int = 80, depth: int = 3, rate: float = 0.12) -> Trees:
    """Gradient boosting of the logistic loss, level by level on binned features."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(quantile_edges(x, bins), float(np.log(share / (1 - share))), depth)
    if len(np.unique(y)) < 2:
        return model
    b = binned(x, model.edges)
    sizes = [len(e) + 1 for e in model.edges]
    raw = np.full(len(y), model.base)
    for _ in range(trees):
        p = _sigmoid(raw)
        g, h = y - p, p * (1 - p)
        feature, above = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 1 << 30)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            best = [(1e-9, 0, 1 << 30)] * 2**level
            for f, size in enumerate(sizes):
                slot = (node - first) * size + b[:, f]
                gs = np.bincount(slot, weights=g, minlength=2**level * size).reshape(-1, size)
                hs = np.bincount(slot, weights=h, minlength=2**level * size).reshape(-1, size)
                for n in range(2**level):
                    gain, at = _best_cut(gs[n], hs[n], 1.0)
                    if gain > best[n][0]:
                        best[n] = gain, f, at
            for n, (_, f, at) in enumerate(best):
                feature[first + n], above[first + n] = f, at
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > above[node])
        leaves = node - (2**depth - 1)
        value = rate * np.bincount(leaves, weights=g, minlength=2**depth) / (np.bincount(leaves, weights=h, minlength=2**depth) + RIDGE)
        raw += value[leaves]
        model.feature.append(feature)
        model.above.append(above)
        model.leaf.append(value)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw, probability) points of the increasing step function closest to the labels, by pooling adjacent violators.

    Each pool counts one more row, split by the overall share, so that no probability is 0 or 1.
    """
    order = np.argsort(raw, kind="stable")
    share = (y.sum() + 0.5) / (len(y) + 1)
    pools: list[list[float]] = []  # sum, rows, lowest raw, highest raw
    for r, label in zip(raw[order].tolist(), y[order].tolist()):
        pools.append([label, 1, r, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, low, high = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], high]
    at = [v for _, _, low, high in pools for v in (low, high)]
    chance = [v for total, n, _, _ in pools for v in [(total + share) / (n + 1)] * 2]
    return np.array(at), np.maximum.accumulate(np.array(chance))
