"""Lloyd's steps and two-step limits beside the same in memory; shared relations follow their files."""

import random

from ledgerweave.operators.clusters import lloyd, nearest
from ledgerweave.operators.lookups import smallest
from ledgerweave.plans import base


def test_steps_equal_the_same_in_memory(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(m, 0.4), rng.gauss(-m, 0.4), rng.randrange(1, 4)) for m in (0, 3, 6) for _ in range(60)]
    centres = [[0.1, 0.2], [2.0, -4.0], [9.0, -1.0], [50.0, 50.0]]
    df = spark.createDataFrame(rows, "x double, y double, n int")
    got = lloyd(df, ["x", "y"], "n", centres, 4)
    own = lambda p: min(range(4), key=lambda k: ((p[0] - want[k][0]) ** 2 + (p[1] - want[k][1]) ** 2, k))
    want = [list(c) for c in centres]
    for _ in range(4):
        at = [own(r) for r in rows]
        for k in set(at):
            mine = [r for r, a in zip(rows, at, strict=True) if a == k]
            n = sum(r[2] for r in mine)
            want[k] = [sum(r[c] * r[2] for r in mine) / n for c in (0, 1)]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))
    assert got[3] == [50.0, 50.0]
    assert [r[0] for r in df.select(nearest(["x", "y"], got)).collect()] == [own(r) for r in rows]


def test_two_step_limit_equals_sorting_each_key(spark):
    rng = random.Random(2)
    rows = [(i % 3, rng.randrange(50), f"a{i:03d}", [5, 0, 400][i % 3]) for i in range(300)]
    got = smallest(spark.createDataFrame(rows, "k int, h int, addr string, want int"), ["k"], ["h", "addr"], "want", "addr", 4).collect()
    for k, want in ((0, 5), (1, 0), (2, 400)):
        assert sorted((r["h"], r["addr"]) for r in got if r["k"] == k) == sorted((r[1], r[2]) for r in rows if r[0] == k)[:want]


def test_a_stage_is_written_anew_when_its_files_change(spark, tmp_path):
    import time

    make = lambda: spark.read.parquet(str(tmp_path / "t.parquet")).select("id")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert base.stage(spark, str(tmp_path), "ids", make).count() == 3
    first = base._STAGES[spark.sparkContext.applicationId, str(tmp_path), "ids"][1].path
    assert base.stage(spark, str(tmp_path), "ids", make).count() == 3
    time.sleep(0.01)
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert base.stage(spark, str(tmp_path), "ids", make).count() == 5
    assert base._STAGES[spark.sparkContext.applicationId, str(tmp_path), "ids"][1].path != first
