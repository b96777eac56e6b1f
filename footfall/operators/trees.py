"""Small tree models on numpy arrays, for groups of some hundred rows: a regression forest and a boosted quantile.

Splits are exact: between any two neighbouring values of a feature. Many trees grow together, a level at
a time. The rows of each feature stay sorted by (tree, node, value), so cumulative sums give every split of
every node at once, and a level only deals the rows of a node to its children, in the same order. All
trees of a forest grow in this way, and so do the boosted trees of all folds of a backtest.
"""

from __future__ import annotations

import io
import zlib

import numpy as np

#: Rows of all trees that grow together; a level's sums then stay in a processor's cache.
ROWS_AT_ONCE = 6_000


def seed_of(*parts: object) -> int:
    """A seed from names, the same in every process and for every partitioning."""
    return zlib.crc32("|".join(map(str, parts)).encode()) + 42


class Rows:
    """Rows of several trees, and for each feature their order by tree and value. ``weight`` is trees x rows; 0: not in the tree.

    ``by_value`` has the rows of each feature by value; it serves all trees, so none sorts again.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, by_value: np.ndarray | None = None):
        self.x, (self.trees, self.rows) = x, weight.shape
        self.tree, self.row = np.nonzero(weight)
        self.weight = weight[self.tree, self.row].astype(float)
        self.alike = bool((self.weight == 1).all())
        self.sizes = np.bincount(self.tree, minlength=self.trees)
        by_value = sorted_rows(x) if by_value is None else by_value
        entry = np.full(weight.shape, -1, np.int64)
        entry[self.tree, self.row] = np.arange(len(self.row))
        in_order = (entry[:, rows].ravel() for rows in by_value)
        self.order = np.stack([e[e >= 0] for e in in_order]) if len(by_value) else np.zeros((0, len(self.row)), np.int64)


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """For each feature its rows by value; rows of one value in their order."""
    return np.ascontiguousarray(np.argsort(x, 0, kind="stable").T)


def of_first(by_value: np.ndarray, n: int) -> np.ndarray:
    """``sorted_rows`` of the first ``n`` rows, from those of more."""
    return by_value[by_value < n].reshape(len(by_value), n)


def _running(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums within each group, and the groups' sums (those of the first row of ``value``: all rows have the same)."""
    total = value.cumsum(1)
    before = total[:, starts] - value[:, starts]
    return total - before[:, group], total[0, ends] - before[0]


def _grow(rows: Rows, target: np.ndarray, depth: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: leaf) and threshold of each node of each tree, and the node of each of ``rows``; ``target`` is by row of ``rows``.

    A node's children are 2n+1 and 2n+2; a row goes left if its value is at most the threshold.
    """
    shape = rows.trees, 2 ** (depth + 1) - 1
    feature, cut = np.full(shape, -1, np.int64), np.zeros(shape)
    node = np.zeros(len(rows.row), np.int64)
    weighted = rows.weight * target
    order, tree_of, node_of, sizes = rows.order, np.arange(rows.trees), np.zeros(rows.trees, np.int64), rows.sizes
    values = rows.x[rows.row].T  # feature x row
    for _ in range(depth):
        if not order.size:
            break
        starts = np.cumsum(sizes) - sizes
        some = np.flatnonzero(sizes)
        n, at = order.shape[1], starts[some]
        group = np.repeat(np.arange(len(some)), sizes[some])
        here = np.take_along_axis(values, order, 1)
        ends = at + sizes[some] - 1
        weights = rows.weight[order[:1] if rows.alike else order]  # of rows that weigh alike every feature has the same sums
        left_n, all_n = _running(weights, at, ends, group)
        left_s, all_s = _running(weighted[order], at, ends, group)
        right_n = all_n[group] - left_n
        last = np.zeros(n, bool)
        last[ends] = True
        can = (left_n >= leaf) & (right_n >= leaf) & ~last
        with np.errstate(divide="ignore", invalid="ignore"):
            score = left_s * left_s / left_n
            np.subtract(all_s[group], left_s, out=left_s)
            left_s *= left_s
            left_s /= right_n
            score += left_s
        can = np.broadcast_to(can, score.shape)[:, :-1] & (here[:, :-1] != here[:, 1:])
        score[:, :-1][~can] = -np.inf
        score[:, -1] = -np.inf
        best = np.maximum.reduceat(score, at, 1)
        chosen = best.argmax(0)
        gain = best[chosen, np.arange(len(some))] - all_s**2 / all_n
        split = gain > 1e-9
        if not split.any():
            break
        first = np.where(score[chosen[group], np.arange(n)] == best[chosen, np.arange(len(some))][group], np.arange(n), n)
        where = np.minimum.reduceat(first, at)
        where = np.where(split, np.minimum(where, n - 2), 0)
        threshold = (here[chosen, where] + here[chosen, where + 1]) / 2
        feature[tree_of[some[split]], node_of[some[split]]] = chosen[split]
        cut[tree_of[some[split]], node_of[some[split]]] = threshold[split]
        entry = order[0]  # every feature lists the same rows of a node
        right = values[chosen[group], entry] > threshold[group]
        child = np.full(len(rows.row), -1, np.int64)
        number = np.cumsum(split) - 1
        child[entry] = np.where(split[group], 2 * number[group] + right, -1)
        node[entry] = np.where(split[group], 2 * node_of[some[group]] + 1 + right, node[entry])
        tree_of = np.repeat(tree_of[some[split]], 2)
        node_of = np.stack([2 * node_of[some[split]] + 1, 2 * node_of[some[split]] + 2], 1).ravel()
        keep = split[group]
        kept = order[:, keep] if keep.all() else order[np.broadcast_to(keep, order.shape)].reshape(len(order), -1)
        to = child[kept].astype(np.uint16 if 2 * split.sum() < 1 << 16 else np.int64)
        order = np.take_along_axis(kept, np.argsort(to, 1, kind="stable"), 1)
        sizes = np.bincount(child[entry][keep], minlength=len(tree_of))
    return feature, cut, node


def _leaves(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The node at which each row ends in each tree."""
    trees, rows = len(feature), len(x)
    node, tree = np.zeros((trees, rows), np.int64), np.arange(trees)[:, None]
    for _ in range(depth):
        f = feature[tree, node]
        value = x[np.arange(rows)[None, :], np.maximum(f, 0)] if x.shape[1] else np.zeros(node.shape)
        node = np.where(f >= 0, 2 * node + 1 + (value > cut[tree, node]), node)
    return node


def _varying(x: np.ndarray) -> np.ndarray:
    """The features that have more than one value: no other can split, such as the weekday within a segment."""
    return np.flatnonzero((x != x[:1]).any(0))


def _named(feature: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Numbers among ``live`` features to those among all; -1 stays."""
    return np.where(feature >= 0, np.append(live, -1)[feature], -1)


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int, trees: int = 400, depth: int = 8, leaf: int = 2, by_value: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Bootstrap forest of variance-reducing trees. ``by_value`` are the ``sorted_rows`` of ``x``, where they are known."""
    by_value = sorted_rows(x) if by_value is None else by_value
    live = _varying(x)
    x, by_value = x[:, live], by_value[live]
    draws = np.random.default_rng(seed).integers(0, len(y), (trees, len(y)))
    weight = np.stack([np.bincount(d, minlength=len(y)) for d in draws])
    together, parts = max(1, ROWS_AT_ONCE // max(1, len(y))), []
    for i in range(0, trees, together):
        rows = Rows(x, weight[i : i + together], by_value)
        feature, cut, node = _grow(rows, y[rows.row], depth, leaf)
        key = rows.tree * feature.shape[1] + node
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.bincount(key, rows.weight * y[rows.row], feature.size) / np.bincount(key, rows.weight, feature.size)
        parts.append((_named(feature, live), cut, _fill_down(value.reshape(feature.shape), float(y.mean()))))
    return _packed(*(np.concatenate(p) for p in zip(*parts, strict=True)), 0.0)


def _fill_down(value: np.ndarray, otherwise: float) -> np.ndarray:
    value[:, 0] = np.where(np.isfinite(value[:, 0]), value[:, 0], otherwise)
    for n in range(1, value.shape[1]):
        value[:, n] = np.where(np.isfinite(value[:, n]), value[:, n], value[:, (n - 1) // 2])
    return value


def _quantiles(value: np.ndarray, group: np.ndarray, n_groups: int, quantile: float) -> np.ndarray:
    """Linear quantile of the values of each group; 0 where there are none."""
    order = np.lexsort((value, group))
    sizes = np.bincount(group, minlength=n_groups)
    starts, ranked = np.cumsum(sizes) - sizes, np.append(value[order], 0.0)
    at = starts + quantile * np.maximum(sizes - 1, 0)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, starts + np.maximum(sizes - 1, 0))
    return np.where(sizes > 0, ranked[low] + (at - low) * (ranked[high] - ranked[low]), 0.0)


def fit_quantiles(x: np.ndarray, y: np.ndarray, sizes: list[int], quantile: float = 0.8, rounds: int = 500, depth: int = 4, leaf: int = 20, rate: float = 0.05) -> list[dict[str, np.ndarray]]:
    """For each of ``sizes``, boosted trees for the pinball loss on so many first rows; with fewer rows than two leaves take, the quantile itself."""
    nodes = 2 ** (depth + 1) - 1
    start = np.array([np.quantile(y[:n], quantile) for n in sizes])
    if not sizes or max(sizes) < 2 * leaf:
        return [_packed(np.full((1, nodes), -1), np.zeros((1, nodes)), np.zeros((1, nodes)), float(q)) for q in start]
    live = _varying(x)
    rows = Rows(x[:, live], np.arange(len(y)) < np.array(sizes)[:, None])
    own, now = y[rows.row], start[rows.tree]
    features, cuts, values = [], [], []
    for _ in range(rounds):
        feature, cut, node = _grow(rows, (own < now).astype(float), depth, leaf)  # the gradient but for a constant: whole numbers add up exactly
        key = rows.tree * nodes + node
        value = rate * _quantiles(own - now, key, feature.size, quantile)
        now = now + value[key]
        features.append(_named(feature, live)), cuts.append(cut), values.append(value.reshape(feature.shape))
    parts = [np.stack(p, 1) for p in (features, cuts, values)] if rounds else [np.full((len(sizes), 1, nodes), -1), np.zeros((len(sizes), 1, nodes)), np.zeros((len(sizes), 1, nodes))]
    live = np.array(sizes) >= 2 * leaf
    return [_packed(parts[0][i], parts[1][i], parts[2][i] * live[i], float(start[i])) for i in range(len(sizes))]


def fit_quantile(x: np.ndarray, y: np.ndarray, quantile: float = 0.8, rounds: int = 500, depth: int = 4, leaf: int = 20, rate: float = 0.05) -> dict[str, np.ndarray]:
    """``fit_quantiles`` on all rows."""
    return fit_quantiles(x, y, [len(y)], quantile, rounds, depth, leaf, rate)[0]


def checked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x``, if every feature and target is a finite number and there are rows."""
    if not len(y):
        raise ValueError("There are no rows to learn from.")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("Features and targets must be finite numbers.")
    return x


def _packed(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: float) -> dict[str, np.ndarray]:
    return {"feature": feature.astype(np.int16), "cut": cut, "value": value, "start": np.array([start])}


def predict(model: dict[str, np.ndarray], x: np.ndarray, mean: bool) -> np.ndarray:
    """Mean over the trees (a forest), or start plus their sum (boosting)."""
    feature = model["feature"].astype(np.int64)
    node = _leaves(feature, model["cut"], x, (feature.shape[1] + 1).bit_length() - 1)
    each = np.take_along_axis(model["value"], node, 1)
    return each.mean(0) if mean else model["start"][0] + each.sum(0)


def to_bytes(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}
