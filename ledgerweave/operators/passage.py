"""First passage below a level that differs from row to row, for keys of any size.

A key's rows, numbered 1, 2, ... along time, are cut into chunks. Inside a chunk, going backwards, the
running minima ahead of a row are kept on a stack; the first later row below the row's level is found
on it by binary search. Rows without one in their chunk go up a level: every chunk is represented by
its least value, and the first later chunk whose minimum lies below the level is found in the same way
among the chunks of a key. In that chunk the answer is the first running minimum below the level. So
no pair of rows is ever formed, and no task holds more of a key than a chunk or the minima of its chunks.
"""

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000


def _ahead(values: list, levels: list) -> list:
    """For each place the least later place whose value is below the place's level, or None."""
    out: list = [None] * len(values)
    places: list[int] = []  # running minima ahead: nearest last, values rising along the lists
    minima: list = []
    for i in range(len(values) - 1, -1, -1):
        k = bisect_left(minima, levels[i]) if levels[i] is not None else 0
        if k:
            out[i] = places[k - 1]
        while minima and minima[-1] >= values[i]:
            minima.pop()
            places.pop()
        minima.append(values[i])
        places.append(i)
    return out


def first_below(df: DataFrame, key: str, seq: str, value: str, level: str, time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``hit``: the ``time`` of the first later row of the key with ``value`` < ``level``.

    ``seq`` numbers the rows of each key from 1 without gaps. Null where there is no such row.
    """
    rows = df.withColumn("_lw_c", F.floor((F.col(seq) - 1) / chunk_rows))
    slim = rows.select(key, "_lw_c", seq, value, level, time)
    types = dict(slim.dtypes)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        times = pdf[time].tolist()
        found = _ahead(pdf[value].tolist(), pdf[level].tolist())
        return pd.DataFrame({key: pdf[key], seq: pdf[seq], "_lw_hit": pd.array([None if j is None else times[j] for j in found], "Int64")})

    near = slim.groupBy(key, "_lw_c").applyInPandas(inside, f"{key} {types[key]}, {seq} bigint, _lw_hit bigint")
    rows = rows.join(near, [key, seq])
    open_rows = rows.filter("_lw_hit is null")

    # the running minima of each chunk, in order: their last is the chunk's minimum
    def minima(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        keep, now = [], None
        for v in pdf[value].tolist():
            keep.append(now is None or v < now)
            now = v if now is None or v < now else now
        return pdf.loc[keep, [key, "_lw_c", value, time]].rename(columns={value: "_lw_v", time: "_lw_t"})

    records = slim.groupBy(key, "_lw_c").applyInPandas(minima, f"{key} {types[key]}, _lw_c bigint, _lw_v {types[value]}, _lw_t bigint")
    lists = records.groupBy(key, "_lw_c").agg(F.sort_array(F.collect_list(F.struct("_lw_t", "_lw_v"))).alias("_lw_r"), F.min("_lw_v").alias("_lw_m"))
    chunks = lists.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_lw_c", "_lw_m"))).alias("_lw_cs"))
    several = chunks.filter(F.size("_lw_cs") > 1)
    aimed = open_rows.select(key, seq, "_lw_c", level).join(several, key).select(key, seq, level, F.get(F.filter("_lw_cs", lambda x: (x["_lw_c"] > F.col("_lw_c")) & (x["_lw_m"] < F.col(level))), F.lit(0))["_lw_c"].alias("_lw_c"))
    far = aimed.filter("_lw_c is not null").join(lists.select(key, "_lw_c", "_lw_r"), [key, "_lw_c"])
    far = far.select(key, seq, F.get(F.filter("_lw_r", lambda x: x["_lw_v"] < F.col(level)), F.lit(0))["_lw_t"].alias("_lw_far"))
    out = rows.join(far, [key, seq], "left")
    return out.select(*df.columns, F.coalesce("_lw_hit", "_lw_far").alias("hit"))
