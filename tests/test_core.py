"""The exact 2-core of the pairs."""

from ledgerweave.plans import networks


def core(pairs):
    now = set(pairs)
    while True:
        degree = {}
        for pair in now:
            for x in pair:
                degree[x] = degree.get(x, 0) + 1
        after = {(a, b) for a, b in now if degree[a] > 1 and degree[b] > 1}
        if after == now:
            return now
        now = after


def test_two_core_is_peeled_to_the_end(spark, monkeypatch):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("l", "l")] + [("c", "t00")] + [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(9)] + [(f"u{i}", f"u{i + 1}") for i in range(14)]
    df = spark.createDataFrame(rows, "src string, dst string")
    monkeypatch.setattr(networks, "pairs", lambda spark, sf_dir: df)
    got = {tuple(r) for r in networks.q_two_core(spark, "small").collect()}
    assert got == core(rows) and ("a", "b") in got and ("t08", "t09") not in got
