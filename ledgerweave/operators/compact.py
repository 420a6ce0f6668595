"""Graph kernels for edge lists of a checked, small size: one task, whole arrays.

A round over a small graph costs Spark more to plan than to run. Where the number of edges was counted
and is at most ``EDGES``, an iteration therefore runs from start to end within one task over NumPy arrays
(about 100 bytes an edge); the operators of ``graph`` give the same result by distributed rounds beyond it.
``Paths`` takes up to ``PATH_EDGES``: it needs less for an edge and works on small parts of them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

EDGES = 2_000_000
PATH_EDGES = 9_000_000
PART = 1_000_000


def in_one_task(df: DataFrame, kernel: Callable[..., dict], schema: str) -> DataFrame:
    """``kernel`` applied to the columns of ``df`` as arrays; it returns the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            columns = pa.Table.from_batches(parts).columns
            out = kernel(*[c.combine_chunks() for c in columns])
            whole = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})
            for i in range(0, whole.num_rows, 100_000):
                yield whole.slice(i, 100_000)

    return df.coalesce(1).mapInArrow(run, schema)


def numbered(u: pa.Array, v: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids in their order, place of each u, place of each v)"""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[coded.indices.to_numpy(zero_copy_only=False)]
    return coded.dictionary.take(order), at[: len(u)], at[len(u) :]


def components(u: pa.Array, v: pa.Array) -> dict:
    """(node, root): the least node of each one's component."""
    ids, a, b = numbered(u, v)
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return {"node": ids, "root": ids.take(pa.array(label))}


def core(u: pa.Array, v: pa.Array) -> dict:
    """The edges left when nodes with at most one end are taken away, again and again."""
    _, a, b = numbered(u, v)
    at = np.arange(len(u))
    while True:
        degree = np.bincount(np.concatenate([a[at], b[at]]), minlength=1)
        left = at[(degree[a[at]] > 1) & (degree[b[at]] > 1)]
        if len(left) == len(at):
            return {"u": u.take(pa.array(at)), "v": v.take(pa.array(at))}
        at = left


def ranks(rounds: int, alpha: float, tol: float) -> Callable[..., dict]:
    def kernel(u: pa.Array, v: pa.Array, weight: pa.Array) -> dict:
        (ids, a, b), w = numbered(u, v), weight.to_numpy()
        n, loose = len(ids), np.bincount(a, minlength=len(ids)) == 0
        r = np.full(n, 1.0 / n)
        for _ in range(rounds):
            got = np.bincount(b, w * r[a], n)
            after = alpha * (got + r[loose].sum() / n) + (1 - alpha) / n
            change, r = np.abs(after - r).sum(), after
            if change < tol:
                break
        return {"id": ids, "r": r}

    return kernel


def walks(steps: int, damping: float, terms: bool) -> Callable[..., dict]:
    """Terms of the walk from ones, or their sum, for the nodes that are reached."""

    def kernel(u: pa.Array, v: pa.Array, weight: pa.Array) -> dict:
        (ids, a, b), w = numbered(u, v), weight.to_numpy()
        x, n = np.ones(len(ids)), len(ids)
        total, here, out = np.zeros(n), np.zeros(n, bool), []
        there = np.ones(n, bool)
        for k in range(1, steps + 1):
            x, there = damping * np.bincount(b, w * x[a], n), np.bincount(b, there[a], n) > 0
            total, here = total + x, here | there
            if terms:
                at = np.flatnonzero(there)
                out.append((at, np.full(len(at), k, np.int64), x[at]))
        if terms:
            at, k, x = (np.concatenate(p) for p in zip(*out, strict=True))
            return {"id": ids.take(pa.array(at)), "k": k, "x": x}
        at = np.flatnonzero(here)
        return {"id": ids.take(pa.array(at)), "x": total[at]}

    return kernel


def growth(rounds: int) -> Callable[..., dict]:
    """Growth of the norm in one more step after ``rounds`` of the power method."""

    def kernel(u: pa.Array, v: pa.Array, weight: pa.Array) -> dict:
        (ids, a, b), w = numbered(u, v), weight.to_numpy()
        x, norm = np.ones(len(ids)), 0.0
        for _ in range(rounds + 1):
            x = np.bincount(b, w * x[a], len(ids))
            norm = float(np.sqrt((x * x).sum()))
            if not norm:
                break
            x = x / norm
        return {"radius": np.array([norm])}

    return kernel


def _runs(x: np.ndarray) -> np.ndarray:
    """The distinct values of ``x``, which is sorted."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Paths:
    """Shortest paths over edges between 64-bit ids that count in both directions.

    Nodes are numbered by falling degree, so that the ones that are looked up most lie together.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        ids = np.concatenate([a, b])
        ids.sort()
        ids = _runs(ids)
        n, x, y = len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b)
        order = np.argsort(-(np.bincount(x, minlength=n) + np.bincount(y, minlength=n)), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, x, y = ids[order], place[x], place[y]
        m, pair = len(x), np.empty(2 * len(x), np.int64)
        for half, u, v in ((pair[:m], x, y), (pair[m:], y, x)):
            np.multiply(u, n, out=half)
            half += v
        del ids, order, place, x, y, u, v, half
        pair.sort()
        pair = _runs(pair)
        self.first = np.searchsorted(pair, np.arange(n + 1) * n)
        self.tail = (pair % max(1, n)).astype(np.int32)

    def _steps(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(from, to) of all ways out of ``nodes``, in parts of at most ``PART`` ways or of one node."""
        n = self.first[nodes + 1] - self.first[nodes]
        ends, k = np.cumsum(n), 0
        while k < len(nodes):
            done = ends[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(ends, done + PART, "right")))
            at = np.arange(ends[to - 1] - done) + np.repeat(self.first[nodes[k:to]] - (ends[k:to] - n[k:to] - done), n[k:to])
            yield np.repeat(nodes[k:to], n[k:to]), self.tail[at]
            k = to

    def dependencies(self, pivot: int, total: np.ndarray, met: np.ndarray, most: int | None = None) -> None:
        """Add the dependencies of the paths of at most ``most`` steps from ``pivot`` to ``total``, and mark in ``met`` what is reached."""
        n = len(self.ids)
        new, paths, share = np.ones(n, bool), np.zeros(n), np.zeros(n)
        new[pivot], paths[pivot] = False, 1
        levels, ways = [np.array([pivot])], []
        while len(levels[-1]) and (most is None or len(levels) <= most):
            ways.append([(x[k].astype(np.int32), y[k]) for x, y in self._steps(levels[-1]) if (k := new[y]).any()])
            for x, y in ways[-1]:
                _add(paths, y, paths[x])
            if sum(len(y) for _, y in ways[-1]) * 8 > n:
                levels.append(np.flatnonzero(new & (paths > 0)))
            else:
                levels.append(np.unique(np.concatenate([np.empty(0, np.int32), *(y for _, y in ways[-1])])))
            new[levels[-1]] = False
        for upper, lower, between in zip(reversed(levels[:-1]), reversed(levels), reversed(ways), strict=False):
            total[lower] += share[lower]
            met[lower] = True
            share[lower] = (1 + share[lower]) / paths[lower]  # from here on what each path to it hands back
            for x, y in between:
                _add(share, x, share[y])
            share[upper] *= paths[upper]


def _add(to: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Add each of ``x`` to the place ``at``; the time follows their number, however large ``to`` is."""
    if len(at) * 4 > len(to):
        to += np.bincount(at, x, len(to))
    else:
        np.add.at(to, at, x)
