"""Exactly one copy of each message, over several batches, late deliveries included."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerweave.streaming.dedup import once

SCHEMA = pa.schema([("tx", pa.string()), ("li", pa.int32()), ("load", pa.int32()), ("v", pa.float64())])
WEEK = 7 * 86400


def run(spark, source, **options):
    at = F.timestamp_seconds(F.col("load").cast("long") * WEEK)
    return once(spark, str(source), {"tx": F.lower("tx"), "li": F.col("li")}, at, ["v", "load", "tx"], **options)


def write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.Table.from_pylist([dict(zip(("tx", "li", "load", "v"), r, strict=True)) for r in rows], SCHEMA), folder / f"part-{number:03d}.parquet")


def test_one_of_each_over_many_batches(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    rows = []
    for load in range(1, 9):
        batch = [(f"T{i % 7}", load // 3, load, float(load)) for i in range(9)] + [(None, 1, load, 0.0), ("x", None, load, 1.0)]
        write(folder, load, batch)
        os.utime(folder / f"part-{load:03d}.parquet", (1_700_000_000 + load, 1_700_000_000 + load))
        rows += batch
    write(folder, 9, [("t1", 0, 30, 7.0)])  # comes back long after its state has expired
    os.utime(folder / "part-009.parquet", (1_700_000_100, 1_700_000_100))
    rows.append(("t1", 0, 30, 7.0))
    got = run(spark, folder, horizon="2 weeks", bytes_per_batch=1)
    kept = [(r["tx"], r["li"]) for r in got.kept.collect()]
    ids = Counter((t.lower(), i) for t, i, *_ in rows if t and i is not None)
    assert sorted(kept) == sorted(ids)
    assert got.batches > 3
    assert {(r["tx"], r["li"]) for r in got.repeats.collect()} == {k for k, n in ids.items() if n > 1}
    assert got.repeats.count() == sum(ids.values()) - len(ids)
    assert got.without_id.count() == 16
    assert "in_tx" in got.kept.columns and got.kept.filter("lower(in_tx) <> tx").count() == 0


def test_a_load_older_than_the_watermark_is_not_lost(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    for n, (tx, load) in enumerate([("a", 50), ("b", 51), ("old", 1), ("a", 2)]):
        write(folder, n, [(tx, 0, load, 1.0)])
        os.utime(folder / f"part-{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    got = run(spark, folder, horizon="2 weeks", bytes_per_batch=1)
    assert sorted(r["tx"] for r in got.kept.collect()) == ["a", "b", "old"]
    assert [r["tx"] for r in got.repeats.collect()] == ["a"]


def test_empty_table(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, 0, [])
    got = run(spark, folder)
    assert got.kept.count() == got.repeats.count() == got.without_id.count() == 0


def fill(folder, loads, per):
    """Files of one load each; every third identifier comes again two loads later, and again long after."""
    import os

    rows = []
    for load in range(1, loads + 1):
        batch = [(f"t{i % 3 if i % 2 else load * 10 + i}", i % 4, load, float(load)) for i in range(per)] + [(f"t{max(0, load - 6) * 10}", 0, load, -1.0)]
        write(folder, load, batch)
        os.utime(folder / f"part-{load:03d}.parquet", (1_700_000_000 + load, 1_700_000_000 + load))
        rows += batch
    return Counter((t, i) for t, i, *_ in rows)


@pytest.mark.parametrize("broken", [0, 4])
def test_a_run_broken_off_goes_on(spark, tmp_path, broken):
    """The driver ends between the output of a batch and its commit; the next run repeats that batch only."""
    ids = fill(tmp_path / "in", 7, 8)
    seen = []

    def fail(epoch):
        seen.append(epoch)
        if epoch == broken:
            raise RuntimeError("ended")

    with pytest.raises(Exception, match="ended"):
        run(spark, tmp_path / "in", horizon="2 weeks", bytes_per_batch=1, folder=str(tmp_path / "state"), after_batch=fail)
    again = []
    got = run(spark, tmp_path / "in", horizon="2 weeks", bytes_per_batch=1, folder=str(tmp_path / "state"), after_batch=again.append)
    assert seen[-1] == broken and min(again) == broken
    assert sorted((r["tx"], r["li"]) for r in got.kept.collect()) == sorted(ids)
    assert got.repeats.count() == sum(ids.values()) - len(ids)
    # nothing new: nothing is read again, and the result stays
    more = []
    got = run(spark, tmp_path / "in", horizon="2 weeks", bytes_per_batch=1, folder=str(tmp_path / "state"), after_batch=more.append)
    assert len(more) <= 1 and sorted((r["tx"], r["li"]) for r in got.kept.collect()) == sorted(ids)


def test_new_files_are_held_against_what_was_kept(spark, tmp_path):
    ids = fill(tmp_path / "in", 4, 8)
    first = run(spark, tmp_path / "in", horizon="2 weeks", bytes_per_batch=1, folder=str(tmp_path / "state"))
    assert first.kept.count() == len(ids)
    write(tmp_path / "in", 90, [(t, i, 30, 5.0) for t, i in list(ids)[:6]] + [("new", 1, 30, 5.0)] * 2)
    got = run(spark, tmp_path / "in", horizon="2 weeks", folder=str(tmp_path / "state"))
    assert sorted((r["tx"], r["li"]) for r in got.kept.collect()) == sorted([*ids, ("new", 1)])
    assert got.repeats.count() == sum(ids.values()) - len(ids) + 7
