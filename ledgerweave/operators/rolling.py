"""Trailing totals over dense days by block decomposition.

Days are cut into blocks as long as the window. Inside a block, prefix sums run forward and suffix
sums backward; the last ``w`` days that end on day ``d`` are the suffix that starts at ``d - w + 1``
in the block before plus the prefix that ends at ``d``. Nothing is ever subtracted, so a total is zero
exactly if every day in it is, and each window costs two sums per row however long it is.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_days(entities: DataFrame, entity: str, daily: DataFrame, day: str, total: str, last: str, first: str | None = None) -> DataFrame:
    """One row per entity and day from ``first`` to ``last``, with ``total`` or 0.

    ``daily`` has one row per entity and active day. Without ``first`` the days begin with the first
    active one of any entity, so that nothing before a day is missing from its totals; days after ``last``
    are left out. Without any active day there is the day ``last`` alone.
    """
    if first is None:
        low = daily.filter(F.col(day) <= F.lit(last)).agg(F.min(day).cast("string")).first()[0]
        first = low or last
    span = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    spine = entities.select(F.col(entity), F.explode(span).alias(day))
    return spine.join(daily, [entity, day], "left").withColumn(total, F.coalesce(total, F.lit(0)))


def trailing_totals(dense: DataFrame, entity: str, day: str, total: str, windows: list[int]) -> DataFrame:
    """``dense`` with ``total_<w>d`` and ``mean_<w>d`` for each window length of ``windows``.

    ``dense`` must have every day of its range once per entity. Days before the range count as 0, and
    the mean is over the full window length there too. An entity absent from ``dense`` has no row.
    """
    rows = dense.withColumn("_lw_i", F.unix_date(day))
    for w in windows:
        block = f"_lw_b{w}"
        rows = rows.withColumn(block, F.floor(F.col("_lw_i") / w))
        inside = Window.partitionBy(entity, block)
        up = inside.orderBy("_lw_i").rowsBetween(Window.unboundedPreceding, 0)
        down = inside.orderBy("_lw_i").rowsBetween(0, Window.unboundedFollowing)
        rows = rows.withColumn(f"_lw_p{w}", F.sum(total).over(up)).withColumn(f"_lw_s{w}", F.sum(total).over(down))
    for_entity = Window.partitionBy(entity).orderBy("_lw_i")
    so_far = for_entity.rowsBetween(Window.unboundedPreceding, 0)
    out = [c for c in dense.columns]
    for w in windows:
        # the row w - 1 days ago, or the first of all; its suffix counts only if it lies in the block before
        suffix = F.struct(F.col(f"_lw_b{w}").alias("b"), F.col(f"_lw_s{w}").alias("s"))
        oldest = F.coalesce(F.lag(suffix, w - 1).over(for_entity), F.first(suffix).over(so_far)) if w > 1 else suffix
        before = F.when(oldest["b"] < F.col(f"_lw_b{w}"), oldest["s"])
        rows = rows.withColumn(f"total_{w}d", F.col(f"_lw_p{w}") + F.coalesce(before, F.lit(0)))
        rows = rows.withColumn(f"mean_{w}d", F.col(f"total_{w}d").cast("double") / w)
        out += [f"total_{w}d", f"mean_{w}d"]
    return rows.select(*out)
