"""Numbering and chunked work per key."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.operators.chunks import RANK, latest_before, number_rows, per_key, running_total


def test_numbers_are_gapless_per_key_with_a_hot_key(spark):
    rows = [("hot",)] * 500 + [("a",)] * 3 + [(None,)] * 4 + [("b",)]
    df = spark.createDataFrame(rows, "k string").repartition(7)
    got = number_rows(df, ["k"]).df.groupBy("k").agg(F.sort_array(F.collect_list(RANK)).alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {"hot": list(range(500)), "a": [0, 1, 2], "b": [0]}


def test_order_is_kept_over_partitions(spark):
    df = spark.range(200).select(F.lit("x").alias("k"), (199 - F.col("id")).alias("v")).repartition(5)
    got = number_rows(df, ["k"], [F.col("v")]).df.collect()
    assert all(r[RANK] == r["v"] for r in got)


def test_per_key_equals_group_by_and_keeps_extra_columns_apart(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"), F.lit(1).alias("n"))
    got = per_key(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, chunk_rows=10)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert number_rows(df, ["k"]).df.count() == 0
    assert per_key(df, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50), st.one_of(st.none(), st.integers(-5, 5))), max_size=40))
def test_running_total_and_latest_before(spark, rows):
    rows = [(k, t * 100 + i, v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    run = {(r["k"], r["t"]): r["running"] for r in running_total(df, ["k"], "v", [F.col("t")], 4).collect()}
    last = {(r["k"], r["t"]): (r["t_before"], r["v_before"]) for r in latest_before(df, ["k"], ["t", "v"], [F.col("t")], 4).collect()}
    for k, t, _ in rows:
        before = [(b, c) for a, b, c in rows if a == k and b < t]
        assert run[k, t] == sum(c or 0 for a, b, c in rows if a == k and b <= t)
        assert last[k, t] == (max((b for b, _ in before), default=None), max((c for _, c in before if c is not None), default=None))


def test_first_below_equals_looking_ahead(spark):
    import random

    from ledgerweave.operators.passage import first_below

    rng = random.Random(12)
    rows = [(k, i + 1, rng.randint(0, 30), rng.randint(-2, 12), i * 10) for k in "ab" for i in range(60 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, seq long, v long, lvl long, t long")
    got = {(r["k"], r["seq"]): r["hit"] for r in first_below(df, "k", "seq", "v", "lvl", "t", 7).collect()}
    for k, i, _, lvl, _ in rows:
        assert got[k, i] == min((t for a, j, v, _, t in rows if a == k and j > i and v < lvl), default=None)
