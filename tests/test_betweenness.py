"""Betweenness over whole shortest paths from every pivot."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import compact as kernels
from ledgerweave.operators import graph
from ledgerweave.operators.graph import betweenness
from ledgerweave.plans import extras


def dependencies(edges, pivots):
    near, score = {}, {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for p in pivots:
        level, paths, order = {p: 0}, {p: 1.0}, [p]
        for x in order:
            for y in near.get(x, ()):
                if y not in level:
                    level[y], paths[y] = level[x] + 1, 0.0
                    order.append(y)
                if level[y] == level[x] + 1:
                    paths[y] += paths[x]
        share = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near.get(y, ()):
                if level[x] == level[y] - 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
        for x in order:
            if x != p:
                score[x] = score.get(x, 0.0) + share[x]
    return score


@pytest.mark.parametrize("compact", [0, 1000])
def test_long_paths_and_more_than_sixteen_pivots_count(spark, monkeypatch, compact):
    rng = random.Random(4)
    edges = sorted({(f"p{i:02d}", f"p{i + 1:02d}") for i in range(12)} | {(f"r{rng.randrange(20):02d}", f"r{rng.randrange(20):02d}") for _ in range(40)} | {("p03", "r05"), ("solo", "solo")})
    df = spark.createDataFrame(edges, "src string, dst string")
    names = sorted({x for e in edges for x in e})
    want = dependencies(edges, names)
    few = spark.createDataFrame([("p00",), ("r05",), ("solo",)], "node string")
    got = {r["node"]: r["score"] for r in betweenness(df, few, rows=40, compact=compact).collect()}
    part = dependencies(edges, ["p00", "r05"])
    assert set(got) == set(part) and all(abs(got[x] - part[x]) < 1e-9 for x in part)
    monkeypatch.setattr(extras, "pairs", lambda spark, sf_dir: df)
    monkeypatch.setattr(extras, "graph_degrees", lambda spark, sf_dir: spark.createDataFrame([(x,) for x in names], "addr string"))
    rows = {r["addr"]: r["score"] for r in extras.q_betweenness(spark, "small").collect()}
    assert set(rows) == set(names) and all(abs(rows[x] - want.get(x, 0.0)) < 2e-6 for x in names)


def test_more_than_two_million_edges_go_to_the_tasks(spark, monkeypatch):
    monkeypatch.delattr(graph, "Walker")
    tree = spark.range(2, 2**21).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    got = betweenness(tree, spark.createDataFrame([(1,)], "node long")).withColumn("level", F.floor(F.log2("node"))).groupBy("level").agg(F.count("score"), F.min("score"), F.max("score")).collect()
    assert {tuple(r) for r in got} == {(k, 2**k, 2 ** (21 - k) - 2, 2 ** (21 - k) - 2) for k in range(1, 21)}


def test_small_parts_of_the_ways_give_the_same(monkeypatch):
    monkeypatch.setattr(kernels, "PART", 3)
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)] + [(40 + i, 41 + i) for i in range(300)]
    a, b = np.array([e for e in edges if e[0] != e[1]], np.int64).T * 10**15
    g = kernels.Paths(a, b)
    total, met = np.zeros(len(g.ids)), np.zeros(len(g.ids), bool)
    for p in (0, 40):
        g.dependencies(int(np.flatnonzero(g.ids == p * 10**15)[0]), total, met)
    want = dependencies(edges, [0, 40])
    assert {int(x) // 10**15 for x in g.ids[met]} == set(want)
    assert all(abs(total[i] - want[int(x) // 10**15]) < 1e-9 for i, x in enumerate(g.ids) if met[i])


def test_other_hashes_are_taken_if_two_nodes_share_one(spark, monkeypatch):
    monkeypatch.setattr(graph, "_short", lambda c, turn: F.ascii(F.substring(c, turn + 1, 1)).cast("bigint"))
    path = spark.createDataFrame([("ka", "kb"), ("kb", "kc"), ("kc", "kd"), (None, "ka")], "src string, dst string")
    got = {r["node"]: r["score"] for r in betweenness(path, spark.createDataFrame([("ka",), ("zz",)], "node string")).collect()}
    assert got == {"kb": 2.0, "kc": 1.0, "kd": 0.0}
