"""The fourth provider's records, which may stand for two categories."""

from pyspark.sql import functions as F

from ledgerweave.plans.labelling import fourth_categories


def test_two_categories_one_or_none(spark):
    rows = [
        (" Exchange ", ["Hot Wallet"], ["CEX"]),
        ("exchange", ["OFAC sanctioned"], ["SUSPICIOUS", "CEX"]),
        ("mixer", None, ["SUSPICIOUS"]),
        (None, ["Phishing", None], ["SUSPICIOUS"]),
        ("fund", [], ["INSTITUTION"]),
        (None, None, []),
        ("", [""], []),
    ]
    df = spark.createDataFrame(rows, "kind string, labels array<string>, want array<string>")
    got = df.select(fourth_categories(F.col("kind"), F.col("labels")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
