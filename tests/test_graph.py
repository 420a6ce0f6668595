"""Graph operators on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.compact import EDGES
from ledgerweave.operators.graph import betweenness, pagerank, peel, spectral_radius, walk_sum, walk_terms, weak_components


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


both_ways = pytest.mark.parametrize("compact", [0, EDGES], ids=["rounds", "one task"])


@both_ways
def test_components_of_a_chain_a_star_and_loops(spark, compact):
    rng = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"leaf{i}") for i in range(80)]
    pairs = chain + star + [("lone", "lone"), ("a", "b"), ("b", "a"), ("a", "b")]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, "z"), ("z", None)], "a string, b string")
    assert {r["node"]: r["root"] for r in weak_components(df, "a", "b", compact).collect()} == groups(pairs)
    assert weak_components(df.limit(0), "a", "b", compact).count() == 0


@both_ways
def test_triangle_with_a_tail_peels_to_the_triangle(spark, compact):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r["src"] for r in peel(df, compact=compact).collect()} == {"a", "b", "c"}
    assert peel(df, 1).count() == 4


@both_ways
def test_spread_is_linear_in_damping_per_step(spark, compact):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "src string, dst string, weight double")
    full = {(r["node"], r["k"]): r["x"] for r in walk_terms(e, 2, compact=compact).collect()}
    half = {(r["node"], r["k"]): r["x"] for r in walk_terms(e, 2, 0.5, compact).collect()}
    assert full == {("b", 1): 0.5, ("c", 1): 0.5, ("c", 2): 0.25}
    assert half == {k: v / 2 ** k[1] for k, v in full.items()}


@both_ways
def test_a_hub_and_others_walk_alike(spark, compact):
    """Beside the same in memory: a hub, a cycle, weights, nodes without an edge out."""
    import numpy as np

    rng = random.Random(2)
    edges = [("hub", f"n{i:02d}", 0.1 + i / 100) for i in range(40)] + [(f"n{i:02d}", "hub", 0.05) for i in range(0, 40, 3)]
    edges += [(f"n{i:02d}", f"n{j:02d}", rng.random() / 4) for i, j in {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[names.index(b), names.index(a)] += w
    x, total = np.ones(len(names)), np.zeros(len(names))
    for _ in range(6):
        x = 0.3 * (m @ x)
        total += x
    got = {r["node"]: r["c"] for r in walk_sum(df, 6, 0.3, compact=compact).collect()}
    assert all(abs(got.get(n, 0) - t) < 1e-9 for n, t in zip(names, total, strict=True))
    y = np.ones(len(names))
    for _ in range(9):
        y, before = m @ y, y
    assert abs(spectral_radius(df, 8, compact) - np.linalg.norm(y) / np.linalg.norm(before)) < 1e-9
    out = m.sum(0)
    r = np.full(len(names), 1 / len(names))
    for _ in range(5):
        r = 0.85 * (m @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() / len(names)) + 0.15 / len(names)
    got = {x["node"]: x["r"] for x in pagerank(df, 5, compact=compact).collect()}
    assert set(got) == set(names) and all(abs(got[n] - v) < 1e-12 for n, v in zip(names, r, strict=True))


@both_ways
def test_pagerank_sums_to_one_with_dangling_nodes(spark, compact):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    assert abs(pagerank(df, 6, compact=compact).agg(F.sum("r")).first()[0] - 1) < 1e-9


@both_ways
def test_betweenness_of_a_path_and_a_square(spark, compact):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    pivots = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    got = {r["node"]: r["score"] for r in betweenness(path, pivots, 4, compact=compact).collect() if r["score"]}
    assert got == {"b": 4.0, "c": 4.0}
    square = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    assert {r["score"] for r in betweenness(square, pivots, 4, compact=compact).collect()} == {1.0}


def test_factors_equal_the_updates_in_memory(spark):
    import numpy as np

    from ledgerweave.operators.factors import factorise

    rows = [(i, float(i % 5), 2.0 * (i % 5), 1.0 if i % 2 else 0.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    read = lambda w: np.array([[r["w0"], r["w1"]] for r in w.orderBy("id").collect()])
    x = np.array([[v or 0.0 for v in r[1:]] for r in rows])
    w0, h0 = factorise(df, "id", ["a", "b", "c", "d"], 2, 0)
    w, h = read(w0), h0.copy()
    before = np.square(w @ h - x).sum()
    for _ in range(6):
        h = h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
    w1, h1 = factorise(df, "id", ["a", "b", "c", "d"], 2, 6)
    assert np.allclose(read(w1), w) and np.allclose(h1, h)
    assert np.square(w @ h - x).sum() < before / 10
