"""Spelling, decoding and the registered queries as a whole."""

import hashlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerweave.functions.base58 import decode, encode
from ledgerweave.functions.ledger import address, usable_amount, utc_day
from ledgerweave.operators.lookups import lookup
from tools.compare import canonical

SAMPLE = ["q_duplicate_share", "q_hex_amount", "q_by_order", "q_weekly_summary", "q_lorenz", "q_custody", "q_features_v3_flow", "q_label_precedence", "q_ari", "q_stream_session", "p2_keys", "p5_found", "p6_found"]


def test_addresses_and_amounts(spark):
    body = "AB" * 20
    rows = [("0x" + body, 1e8, -1), ("000000000000000000000000" + body.lower(), 1.0000001e8, 86_400_000), ("41" + body, 0.0, None), (None, None, 0), ("", -1.0, 5)]
    got = spark.createDataFrame(rows, "a string, v double, ms long").select(address("a").alias("a"), usable_amount("v").alias("v"), utc_day("ms").cast("string").alias("d")).collect()
    assert [r["a"] for r in got] == [body.lower()] * 3 + [None, None]
    assert [r["v"] is not None for r in got] == [True, False, False, False, False]
    assert [r["d"] for r in got] == ["1969-12-31", "1970-01-02", None, "1970-01-01", "1970-01-01"]


def test_base58_round_trip_and_checksum():
    body = hashlib.sha1(b"x").hexdigest()
    text = encode(body)
    assert decode(f" {text} ") == body
    assert decode(text[:-1] + ("2" if text[-1] != "2" else "3")) is None
    assert decode(None) is None and decode("") is None and decode("0OIl") is None


def test_lookup_with_a_hot_key(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id"))
    table = spark.range(500).select(F.col("id").alias("x"), (F.col("id") * 2).alias("v"))
    got = {r["id"]: r["out"] for r in lookup(left, "k", table, "x", "v", F.col("x") == 7, "out").collect()}
    want = {i: (14 if i % 3 == 0 else i * 2 if i % 3 == 1 and i < 500 else None) for i in range(1000)}
    assert got == want


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), columns)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
