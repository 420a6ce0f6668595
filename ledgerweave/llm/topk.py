"""Most frequent values by a three-phase threshold search.

A node is a task over its share of the input splits; there are as many nodes as cores, however many
splits, for a node's share of the bound below falls with the number of nodes. It holds its local counts,
written once: its rows are sorted by value and counted run by run, so its memory doesn't depend on the
number of values. Then

1. every node names its ``k`` local leaders; the k-th largest sum of what they report is a lower bound
   of the k-th largest count,
2. every node reports the values that reach its share of that bound (a value below it on all nodes
   can't be among the first k); the sums give each value a lower and an upper bound, and values whose
   upper bound stays below the k-th lower bound drop out,
3. the counts of the remaining values are fetched from all nodes and added exactly.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.operators.lookups import semi_by_size
from ledgerweave.storage import Stored, store


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, v, n) of a sorted column, a run that goes on over batches being carried along."""
    node = TaskContext.get().partitionId()
    last, n = None, 0

    def out(values: list | pa.Array, counts: list | pa.Array) -> pa.RecordBatch:
        values = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
        counts = pa.array(counts, pa.int64())
        return pa.record_batch([pa.array([node] * len(values), pa.int32()), values.cast(pa.string()), counts], names=["node", "v", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = pc.run_end_encode(batch.column(0))
        ends = coded.run_ends.to_numpy(zero_copy_only=False)
        counts = ends - [0, *ends[:-1]]
        values = coded.values
        if last is not None:
            if values[0].as_py() == last:
                counts[0] += n
            else:
                yield out([last], [n])
        last, n = values[-1].as_py(), int(counts[-1])
        if len(values) > 1:
            yield out(values.slice(0, len(values) - 1), counts[:-1])
    if last is not None:
        yield out([last], [n])


def local_counts(df: DataFrame, column: str, nodes: int | None = None) -> Stored:
    """(node, v, n): the count of each value on each node, of which there are as many as cores; nulls are left out."""
    values = df.select(F.col(column).cast("string").alias("v")).filter(F.col("v").isNotNull())
    values = values.coalesce(nodes or df.sparkSession.sparkContext.defaultParallelism)
    return store(values.sortWithinPartitions("v").mapInArrow(_runs, "node int, v string, n bigint"), "local")


def _kth(counts: DataFrame, column: str, k: int) -> int:
    rows = counts.select(column).orderBy(F.desc(column)).limit(k).collect()
    return int(rows[-1][0]) if len(rows) == k else 0


def top_k(df: DataFrame, column: str, k: int, nodes: int | None = None, told: dict | None = None) -> DataFrame:
    """(v, n): the ``k`` most frequent values of ``column`` with their exact counts.

    Ties at the end go to the smaller value in text order. Null is no value. With fewer than ``k``
    values all are returned; an empty table gives none. ``told`` takes the numbers of nodes and local
    counts, the share of the second phase and how many local counts and values were fetched by it.
    """
    counts = local_counts(df, column, nodes).df
    m = counts.agg(F.max("node")).first()[0]
    m = 0 if m is None else m + 1
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "v"))
    leaders = counts.withColumn("place", place).filter(F.col("place") <= k).groupBy("v").agg(F.sum("n").alias("s"))
    share = max(1, -(-_kth(leaders, "s", k) // max(1, m)))
    sums = counts.filter(F.col("n") >= share).groupBy("v").agg(F.sum("n").alias("low"), F.count(F.lit(1)).alias("told"))
    sums = store(sums.withColumn("high", F.col("low") + (m - F.col("told")) * (share - 1)), "bounds")
    second = _kth(sums.df, "low", k)
    if told is not None:
        fetched = counts.filter(F.col("n") >= share).count()
        told |= {"nodes": m, "local_counts": counts.count(), "share": share, "fetched": fetched, "values": sums.df.count()}
    candidates = store(sums.df.filter(F.col("high") >= second).select("v"), "candidates")
    exact = semi_by_size(counts, candidates.df, ["v"]).groupBy("v").agg(F.sum("n").alias("n"))
    return exact.orderBy(F.desc("n"), "v").limit(k)
