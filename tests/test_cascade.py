"""Cascades from every source, to the end."""

from ledgerweave.operators.graph import reached_by
from ledgerweave.plans.extras import q_mc_agreement
from ledgerweave.plans.networks import graph_degrees
from ledgerweave.plans.scoring import CASCADE_DRAWS, q_cascade_mc


def followers(edges):
    """How many other nodes reach each node, one source after the other."""
    out, n = {}, {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    for u in out:
        seen, front = {u}, [u]
        while front:
            front = sorted({v for x in front for v in out.get(x, [])} - seen)
            seen.update(front)
        for v in seen - {u}:
            n[v] = n.get(v, 0) + 1
    return n


def test_a_chain_longer_than_six_a_cycle_and_loops_in_blocks(spark):
    edges = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (22, 20), (22, 5), (30, 30), (0, 1)]
    df = spark.createDataFrame(edges, "u long, v long")
    for block in (5, 50_000):
        assert {r["node"]: r["n"] for r in reached_by(df, block).collect()} == followers(edges)
    assert reached_by(df.limit(0)).count() == 0


def test_every_address_is_a_source_and_has_a_row(spark, sf):
    from ledgerweave.plans.base import pairs, stage

    rows = {r["addr"]: (r["hits"], r["coverage"]) for r in q_cascade_mc(spark, sf).collect()}
    nodes = {r["addr"] for r in graph_degrees(spark, sf).collect()}
    assert set(rows) == nodes
    live = stage(spark, sf, "live", lambda: pairs(spark, sf).limit(0)).collect()  # written by the query
    want = followers([((r["draw"], r["node"]), (r["draw"], r["dst"])) for r in live])
    hits = {}
    for (_, addr), n in want.items():
        hits[addr] = hits.get(addr, 0) + n
    assert hits and rows == {a: (hits.get(a, 0), hits.get(a, 0) / (len(nodes) * CASCADE_DRAWS)) for a in nodes}
    assert q_mc_agreement(spark, sf).first()["n"] == len(nodes)
