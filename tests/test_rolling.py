"""Trailing totals against a brute-force sum."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerweave.operators.rolling import dense_days, trailing_totals

FIRST = datetime.date(2024, 1, 3)


def test_every_day_of_every_window(spark):
    rng = random.Random(5)
    days = [FIRST + datetime.timedelta(i) for i in range(80)]
    data = {(e, d): rng.randint(1, 9) for e in "xy" for d in days if rng.random() < 0.15}
    entities = spark.createDataFrame([("x",), ("y",), ("idle",)], "e string")
    daily = spark.createDataFrame([(e, d, v) for (e, d), v in data.items()], "e string, day date, v long")
    dense = dense_days(entities, "e", daily, "day", "v", str(days[-1]), str(FIRST))
    got = trailing_totals(dense, "e", "day", "v", [1, 7, 30]).collect()
    assert len(got) == 3 * len(days)
    for r in got:
        for w in (1, 7, 30):
            want = sum(data.get((r["e"], r["day"] - datetime.timedelta(i)), 0) for i in range(w))
            assert r[f"total_{w}d"] == want and abs(r[f"mean_{w}d"] - want / w) < 1e-9


def test_empty_input(spark):
    none = spark.createDataFrame([], "e string")
    daily = spark.createDataFrame([], "e string, day date, v long")
    assert trailing_totals(dense_days(none, "e", daily, "day", "v", "2024-01-05", "2024-01-01"), "e", "day", "v", [7]).count() == 0
    one = spark.createDataFrame([("x",)], "e string")
    assert [r[0] for r in trailing_totals(dense_days(one, "e", daily, "day", "v", "2024-01-02", "2024-01-01"), "e", "day", "v", [7]).select(F.col("total_7d")).collect()] == [0, 0]


def test_days_begin_with_the_first_active_one(spark):
    entities = spark.createDataFrame([("x",), ("y",)], "e string")
    daily = spark.createDataFrame([("x", datetime.date(2021, 12, 20), 5), ("y", datetime.date(2022, 1, 9), 2), ("x", datetime.date(2025, 1, 1), 9)], "e string, day date, v long")
    rows = trailing_totals(dense_days(entities, "e", daily, "day", "v", "2024-12-31"), "e", "day", "v", [7, 30]).collect()
    got = {(r["e"], str(r["day"])): (r["total_7d"], r["total_30d"]) for r in rows}
    assert min(got)[1] == "2021-12-20" and max(d for _, d in got) == "2024-12-31" and len(got) == len(rows)
    assert got["x", "2022-01-05"] == (0, 5) and got["x", "2022-01-18"] == (0, 5) and got["x", "2022-01-19"] == (0, 0)
    assert dense_days(entities, "e", daily.limit(0), "day", "v", "2024-12-31").count() == 2
