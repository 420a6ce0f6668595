"""Per-key work without per-key tasks: exact offset chunking.

The rows are written once with their place in their input partition. Counting keys per partition and
summing those counts over the partitions before gives each (partition, key) pair the offset of its
first row within the key; a row's number is that offset plus its place inside the pair. Rows numbered
so fall into chunks of at most ``chunk_rows`` rows, whatever the size of the key, and every chunk is a
group of its own. The states of a key's chunks, in chunk order, are then merged into one result.

No task ever sees more of one key than an input partition or a chunk holds, and no key is hashed to
one task before it is reduced to one state per chunk.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.storage import Stored, store

PART, SEQ, RANK, CHUNK = "_lw_part", "_lw_seq", "_lw_rank", "_lw_chunk"


@dataclass
class Numbered:
    """Rows with ``_lw_rank`` (0, 1, ... per key); ``source`` is the written table behind them."""

    df: DataFrame
    source: Stored


def number_rows(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> Numbered:
    """Number the rows of each key from 0, without gaps.

    The numbers follow the input order, or ``order`` over the whole table if given (the table is then
    range-partitioned by it first). Rows with a null in a key column have no key and are left out.
    An empty table gives an empty table. Repeated rows are numbered one by one.
    """
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    if order:
        present = present.repartitionByRange(*order).sortWithinPartitions(*order)
    source = store(present.withColumn(SEQ, F.monotonically_increasing_id()), "numbered")
    rows = source.df.withColumn(PART, F.shiftright(SEQ, 33).cast("int"))
    counts = rows.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("_lw_n"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, PART, F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias("_lw_off"))
    inside = Window.partitionBy(*keys, PART).orderBy(SEQ)
    numbered = (
        rows.join(offsets.hint("merge"), [*keys, PART])
        .withColumn(RANK, F.col("_lw_off") + F.row_number().over(inside) - 1)
        .drop("_lw_off", PART, SEQ)
    )
    return Numbered(numbered, source)


def per_key(
    df: DataFrame,
    keys: list[str],
    chunk_state: dict[str, Column],
    merged: dict[str, Column],
    chunk_rows: int = 100_000,
    order: list[Column] | None = None,
) -> DataFrame:
    """One row per key from equal-sized chunks.

    ``chunk_state`` are aggregates over the rows of one chunk (they may use ``_lw_rank``); ``merged``
    are aggregates over the chunk states of one key (they may use ``_lw_chunk`` for order).
    """
    rows = number_rows(df, keys, order).df.withColumn(CHUNK, F.floor(F.col(RANK) / chunk_rows))
    states = rows.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in chunk_state.items()])
    return states.groupBy(*keys).agg(*[c.alias(n) for n, c in merged.items()])


def running_total(df: DataFrame, keys: list[str], value: str, order: list[Column], chunk_rows: int = 100_000) -> DataFrame:
    """``df`` with ``_lw_rank`` and ``running`` (sum of ``value`` up to and with the row, by ``order``).

    Each chunk is summed on its own; the totals of the chunks before are the boundary state that is
    added to it. A null value counts as 0. Ties in ``order`` are broken arbitrarily but once.
    """
    numbered = store(number_rows(df, keys, order).df.withColumn(CHUNK, F.floor(F.col(RANK) / chunk_rows)), "chunks")
    v = F.coalesce(F.col(value), F.lit(0))
    totals = numbered.df.groupBy(*keys, CHUNK).agg(F.sum(v).alias("_lw_sum"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, CHUNK, F.coalesce(F.sum("_lw_sum").over(earlier), F.lit(0)).alias("_lw_carry"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(RANK).rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.df.join(carried, [*keys, CHUNK])
        .withColumn("running", F.col("_lw_carry") + F.sum(v).over(inside))
        .drop("_lw_carry", CHUNK)
    )


def latest_before(df: DataFrame, keys: list[str], values: list[str], order: list[Column], chunk_rows: int = 100_000) -> DataFrame:
    """``df`` with ``<v>_before`` for each of ``values``: the largest value in earlier rows of the key.

    Earlier is by ``order``. For a column that grows along the order this is the last one before; nulls
    are passed over, so a column set only on some rows gives the last such row. Null where there is none.
    The largest values of the chunks before are the boundary state that enters each chunk.
    """
    numbered = store(number_rows(df, keys, order).df.withColumn(CHUNK, F.floor(F.col(RANK) / chunk_rows)), "chunks")
    tops = numbered.df.groupBy(*keys, CHUNK).agg(*[F.max(v).alias(f"_lw_top_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, CHUNK, *[F.max(f"_lw_top_{v}").over(earlier).alias(f"_lw_carry_{v}") for v in values])
    inside = Window.partitionBy(*keys, CHUNK).orderBy(RANK).rowsBetween(Window.unboundedPreceding, -1)
    out = numbered.df.join(carried, [*keys, CHUNK])
    for v in values:
        out = out.withColumn(f"{v}_before", F.greatest(F.max(v).over(inside), F.col(f"_lw_carry_{v}")))
    return out.drop(CHUNK, *[f"_lw_carry_{v}" for v in values])
