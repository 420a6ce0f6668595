"""Files in and out."""

from ledgerweave.plans.extras import best_relabelling
from ledgerweave.sources.files import EDGES, read_csv, read_seeds, write_result


def test_csv_seeds_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to,value,block_timestamp\na,b,1.5,10\nc,,x,11\n")
    got = read_csv(spark, str(tmp_path / "e.csv"), EDGES, ["from", "value"]).collect()
    assert [tuple(r) for r in got] == [("a", 1.5), ("c", None)]
    eth = "0x" + "Ab" * 20
    (tmp_path / "s.txt").write_text(f"{eth}\n{eth.lower()},note\nTXSPLcayvvcSZbqDY9yRGDjBuvN2uEEu8W\nnonsense\n\n")
    assert sorted(r["chain"] for r in read_seeds(spark, str(tmp_path / "s.txt")).collect()) == ["eth", "tron"]
    df = spark.createDataFrame([(1, ["x"])], "a int, b array<string>")
    for form in ("parquet", "json", "csv"):
        write_result(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() >= 1


def test_relabelling_takes_the_heaviest_assignment():
    assert best_relabelling({(0, 1): 5, (1, 0): 4, (1, 1): 6, (2, 2): 1}, 3) == [1, 0, 2]
    assert best_relabelling({}, 3) == [0, 1, 2]
