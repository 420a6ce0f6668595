"""Queries of the general data-processing problems: p2, p5 and p6."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.ledger import DAY_MS, address, tx_hash, usable_amount, utc_day
from ledgerweave.operators.chunks import per_key
from ledgerweave.operators.lookups import semi_by_size
from ledgerweave.operators.rolling import dense_days, trailing_totals
from ledgerweave.sources.tables import TRANSFERS, path_of, table
from ledgerweave.storage import store
from ledgerweave.streaming.dedup import Deduplicated, once

LAST_DAY = "2024-12-31"  # the problem asks for days up to this one


def sides(transfers: DataFrame, **payload) -> DataFrame:
    """Each transfer once per side that has an address: (side, addr_hex, payload)."""
    each = F.explode(
        F.array(
            F.struct(F.lit("from_hex").alias("side"), address("from_hex").alias("addr_hex")),
            F.struct(F.lit("to_hex").alias("side"), address("to_hex").alias("addr_hex")),
        )
    )
    rows = transfers.select(each.alias("_lw_s"), *[c.alias(n) for n, c in payload.items()])
    return rows.select("_lw_s.*", *payload).filter(F.col("addr_hex").isNotNull())


def per_address(transfers: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """Number, usable sum, first and last time of the rows of every address on either side."""
    rows = sides(transfers, ms=F.col("blockTimestamp"), amount=usable_amount("value"))
    return per_key(
        rows,
        ["side", "addr_hex"],
        {
            "n": F.count(F.lit(1)),
            "amount": F.sum("amount"),
            "first_ms": F.min("ms"),
            "last_ms": F.max("ms"),
        },
        {
            "n_rows": F.sum("n"),
            "sum_value": F.sum("amount").cast("double"),
            "first_ms": F.min("first_ms"),
            "last_ms": F.max("last_ms"),
        },
        chunk_rows,
    )


def p2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_address(table(spark, sf_dir, TRANSFERS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    transfers = table(spark, sf_dir, TRANSFERS)
    rows = transfers.count()
    return per_address(transfers).filter(F.col("n_rows") * 50 >= rows).select("side", "addr_hex")


def received_daily(transfers: DataFrame, addresses: DataFrame) -> DataFrame:
    """(addr_hex, day, received) of the usable receipts of ``addresses``."""
    rows = transfers.select(address("to_hex").alias("addr_hex"), utc_day("blockTimestamp").alias("day"), usable_amount("value").alias("amount"))
    rows = rows.filter(F.col("day").isNotNull() & F.col("amount").isNotNull())
    return semi_by_size(rows, addresses, ["addr_hex"]).groupBy("addr_hex", "day").agg(F.sum("amount").alias("received"))


def rolling_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "tron_usdt_blacklist_added").select(address("addr_hex").alias("addr_hex"))
    listed = listed.filter(F.col("addr_hex").isNotNull()).distinct()
    daily = store(received_daily(table(spark, sf_dir, TRANSFERS), listed), "daily").df  # one row per address and active day
    return trailing_totals(dense_days(listed, "addr_hex", daily, "day", "received", LAST_DAY), "addr_hex", "day", "received", [7, 30])


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling_receipts(spark, sf_dir)
    return r.select(
        "addr_hex",
        F.col("day").cast("string").alias("day_utc"),
        *[F.col(f"total_{w}d").cast("double").alias(f"total_{w}d") for w in (7, 30)],
        *[F.round(f"mean_{w}d", 6).alias(f"mean_{w}d") for w in (7, 30)],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolling_receipts(spark, sf_dir)
    return r.filter((F.col("total_7d") == 0) & (F.col("total_30d") != 0)).select("addr_hex", F.col("day").cast("string").alias("day_utc"))


def deduplicated(spark: SparkSession, sf_dir: str, columns: list[str], **options) -> Deduplicated:
    return once(
        spark,
        path_of(sf_dir, TRANSFERS),
        {"transactionHash": tx_hash("transactionHash"), "logIndex": F.col("logIndex")},
        F.timestamp_seconds(F.col("batch_id").cast("long") * (7 * DAY_MS // 1000)),
        columns,
        **options,
    )


def p6_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per identifier; which copy stays isn't defined, so only the identifier is given here."""
    return deduplicated(spark, sf_dir, ["value"]).kept.select("transactionHash", "logIndex")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir, []).repeats.select("transactionHash", "logIndex").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_keys": p2_keys,
    "p5_found": p5_found,
    "p5_rolling": p5_rolling,
    "p6_found": p6_found,
    "p6_once": p6_once,
}

_T = f"SELECT *, right(lower(from_hex), 40) AS f, right(lower(to_hex), 40) AS t FROM {TRANSFERS}"
_SIDES = f"""
WITH x AS ({_T}), s AS (
  SELECT 'from_hex' AS side, f AS addr_hex, blockTimestamp AS ms, value FROM x WHERE f IS NOT NULL
  UNION ALL SELECT 'to_hex', t, blockTimestamp, value FROM x WHERE t IS NOT NULL)
"""
_DAILY = f"""
WITH x AS ({_T}),
a AS (SELECT DISTINCT right(lower(addr_hex), 40) AS addr_hex FROM tron_usdt_blacklist_added WHERE addr_hex IS NOT NULL),
d AS (SELECT t AS addr_hex, DATE '1970-01-01' + CAST(floor(blockTimestamp / {DAY_MS}) AS INT) AS day, sum(CAST(value AS DECIMAL(20,6))) AS v
      FROM x JOIN a ON x.t = a.addr_hex WHERE blockTimestamp IS NOT NULL AND value > 0 AND value <= 1e8 GROUP BY 1, 2),
s AS (SELECT addr_hex, CAST(u.day AS DATE) AS day FROM a, (SELECT unnest(range((SELECT coalesce(min(day), DATE '{LAST_DAY}') FROM d), DATE '{LAST_DAY}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day) u),
z AS (SELECT s.addr_hex, s.day, coalesce(d.v, 0) AS v FROM s LEFT JOIN d ON s.addr_hex = d.addr_hex AND s.day = d.day),
r AS (SELECT addr_hex, day,
        CAST(sum(v) OVER (PARTITION BY addr_hex ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS t7,
        CAST(sum(v) OVER (PARTITION BY addr_hex ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE) AS t30 FROM z)
"""
_IDS = f"SELECT right(lower(transactionHash), 64) AS \"transactionHash\", logIndex AS \"logIndex\" FROM {TRANSFERS} WHERE transactionHash IS NOT NULL AND logIndex IS NOT NULL"

ORACLES = {
    "p2_found": f"{_SIDES} SELECT side, addr_hex FROM s GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM {TRANSFERS})",
    "p2_keys": f"""{_SIDES} SELECT side, addr_hex, CAST(count(*) AS BIGINT) AS n_rows,
      CAST(sum(CASE WHEN value > 0 AND value <= 1e8 THEN CAST(value AS DECIMAL(20,6)) END) AS DOUBLE) AS sum_value,
      min(ms) AS first_ms, max(ms) AS last_ms FROM s GROUP BY 1, 2""",
    "p5_found": f"{_DAILY} SELECT addr_hex, CAST(day AS VARCHAR) AS day_utc FROM r WHERE t7 = 0 AND t30 <> 0",
    "p5_rolling": f"""{_DAILY} SELECT addr_hex, CAST(day AS VARCHAR) AS day_utc, t7 AS total_7d, t30 AS total_30d,
      round(t7 / 7, 6) AS mean_7d, round(t30 / 30, 6) AS mean_30d FROM r""",
    "p6_found": f"SELECT * FROM ({_IDS}) GROUP BY 1, 2 HAVING count(*) > 1",
    "p6_once": f"SELECT DISTINCT * FROM ({_IDS})",
}
