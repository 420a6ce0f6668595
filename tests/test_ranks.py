"""Rankings followed to their stated tolerance or number of steps, beside the same in memory."""

import random
from decimal import Decimal

import numpy as np

from ledgerweave.operators.graph import spectral_radius
from ledgerweave.plans import networks


def ledger(seed=5, n=40):
    rng = random.Random(seed)
    ends = sorted({(rng.randrange(n - 6), rng.randrange(n)) for _ in range(3 * n)})
    return [(f"n{a:02d}", f"n{b:02d}", 1, Decimal(rng.randrange(1, 10**7))) for a, b in ends]


def test_ranks_radius_and_katz_equal_the_same_in_memory(spark, monkeypatch):
    rows = ledger()
    df = spark.createDataFrame(rows, "src string, dst string, cnt long, w decimal(20,6)")
    monkeypatch.setattr(networks, "pairs", lambda spark, sf_dir: df)
    names = sorted({x for r in rows for x in r[:2]})
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    link, weight = np.zeros((n, n)), np.zeros((n, n))
    for a, b, _, w in rows:
        link[at[b], at[a]] = 1
        weight[at[b], at[a]] = min(1, max(1e-6, np.log1p(float(w)) * 0.1 / np.log1p(1e8)))
    out = link.sum(0)
    r = np.full(n, 1 / n)
    for _ in range(100):
        after = 0.85 * (link @ np.where(out > 0, r / np.maximum(out, 1), 0) + r[out == 0].sum() / n) + 0.15 / n
        change, r = np.abs(after - r).sum(), after
        if change < 1e-10:
            break
    got = {x["addr"]: x["rank_ppm"] for x in networks.q_pagerank(spark, "ranks").collect()}
    assert set(got) == set(names) and max(abs(got[x] - r[at[x]] * 1e6) for x in names) < 2e-4
    rho = max(abs(np.linalg.eigvals(weight)))
    assert abs(networks.q_spectral(spark, "ranks").first()["radius"] - rho) < 2e-6
    x, c = np.ones(n), np.zeros(n)
    for _ in range(60):
        x = 0.5 / rho * (weight @ x)
        c += x
    got = {x["addr"]: x["score"] for x in networks.q_katz(spark, "ranks").collect()}
    assert max(abs(got.get(x, 0) - c[at[x]] / c.max()) for x in names) < 2e-6


def test_without_a_cycle_the_radius_is_zero(spark):
    assert spectral_radius(spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.1)], "src string, dst string, weight double"), 12) == 0
