"""Joins that stay even when one key holds most of the rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.storage import is_within

BROADCAST_ROWS = 20_000


def semi_by_size(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``; broadcast only after counting that ``keys`` is small."""
    keys = keys.select(*on).distinct()
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if is_within(df, limit) else df


def smallest(df: DataFrame, keys: list[str], order: list[str], want: str, spread_by: str, salts: int = 64) -> DataFrame:
    """The first ``want`` rows (a column that is constant per key) of each key by ``order``.

    Each of ``salts`` parts of a key is cut down to ``want`` rows first, so that no task sorts a whole key
    and at most ``salts * want`` rows of a key meet.
    """
    salted = df.withColumn("_lw_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    for by in ([*keys, "_lw_salt"], keys):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("_lw_place", place).filter(F.col("_lw_place") <= F.col(want)).drop("_lw_place")
    return salted.drop("_lw_salt")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, hot: Column, out: str) -> DataFrame:
    """``df`` with ``out`` = ``value`` of the row of ``table`` whose ``table_key`` equals ``key``.

    ``table_key`` is unique. Rows of ``table`` where ``hot`` holds are broadcast: ``hot`` must be a
    condition that only a bounded number of rows can meet, such as a share of all rows of ``df``.
    The rest is joined by shuffle, rows already answered being spread by a hash of themselves, so that
    no key sends more than a hot key's least share to one task. Unmatched rows get null.
    """
    hots = table.filter(hot).select(F.col(table_key).alias("_lw_hk"), F.col(value).alias("_lw_hv"))
    colds = table.filter(~F.coalesce(hot, F.lit(False))).select(F.col(table_key).alias("_lw_ck"), F.col(value).alias("_lw_cv"))
    first = df.join(F.broadcast(hots), F.col(key) == F.col("_lw_hk"), "left")
    answered = F.col("_lw_hk").isNotNull() | F.col(key).isNull()
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    if dict(df.dtypes)[key] != "bigint":
        spread = spread.cast("string").cast(dict(df.dtypes)[key])
    first = first.withColumn("_lw_done", answered).withColumn("_lw_probe", F.when(answered, spread).otherwise(F.col(key)))
    both = first.join(colds, (F.col("_lw_probe") == F.col("_lw_ck")) & ~F.col("_lw_done"), "left")
    return both.select(*df.columns, F.coalesce("_lw_hv", "_lw_cv").alias(out))
