"""Filling containers of fixed capacity by best-fit decreasing.

Sizes are whole numbers from 1 to the capacity, so what best fit does depends on how many items there
are of each size, not on which. A plan is made from that histogram alone (at most ``capacity`` numbers):
sizes are taken in falling order, and a segment tree over the remaining capacities finds the tightest
open bins that still take an item, in logarithmic time. Items of one size and bins of one remaining
capacity are dealt with as runs; the result is the one that item by item placement gives. The items are
then numbered within their size without a task that holds a size (exact offsets, see
``operators.chunks``) and each finds its bin from its number.
"""

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.chunks import RANK, number_rows
from ledgerweave.storage import store

WORD_RUN = "[^ \\t\\n\\x0b\\f\\r]+"


class Tightest:
    """Segment tree over remaining capacities; finds the least one >= s that has open bins."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, remaining: int, present: bool) -> None:
        i = remaining + self.leaves
        self.any[i] = present
        while i := i >> 1:
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def find(self, least: int) -> int | None:
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, first bin, items per bin, fill before) in order of size and rank.

    Item ``r`` of a run goes to bin ``first bin + (r - first rank) // items per bin``.
    """
    tree, open_bins = Tightest(capacity), [[] for _ in range(capacity + 1)]
    runs, bins = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins[remaining].append((first, n))
            tree.set(remaining, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            remaining = tree.find(size)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = open_bins[remaining].pop()
                if not open_bins[remaining]:
                    tree.set(remaining, False)
            per = remaining // size
            whole = min(left // per, n)
            if whole:
                runs.append((size, rank, first, per, capacity - remaining))
                rank, left = rank + whole * per, left - whole * per
                put(remaining - per * size, first, whole)
            if left and whole < n:  # fewer items than one more bin takes
                runs.append((size, rank, first + whole, left, capacity - remaining))
                put(remaining - left * size, first + whole, 1)
                put(remaining, first + whole + 1, n - whole - 1)
                rank, left = rank + left, 0
            elif whole < n:
                put(remaining, first + whole, n - whole)
    return runs


def pack(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """(item_id, piece_no, start, size, bin, at): where each piece of each item goes.

    ``start`` is where the piece begins in the item, ``at`` where it lies in its bin. An item longer than
    ``capacity`` is cut into pieces of ``capacity`` and a rest; every other item is one piece. Items of
    size null or <= 0 take no room and get one row with null bin. Equal items are packed one by one.
    """
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    cut = items.select(F.col(item_id).alias("item_id"), n.alias("n")).withColumn("last", F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)))
    pieces = cut.select("item_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("piece_no"))
    start = F.col("piece_no") * capacity
    pieces = pieces.select("item_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("start"), F.greatest(F.lit(0), F.least(F.col("n") - start, F.lit(capacity))).cast("int").alias("size"))
    written = store(pieces, "pieces").df
    # at most ``capacity`` rows reach the driver
    histogram = {r["size"]: r["count"] for r in written.filter("size > 0").groupBy("size").count().collect()}
    runs = np.array(plan(histogram, capacity) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            sizes, ranks = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
            i = np.searchsorted(starts, (sizes << 44) + ranks, side="right") - 1
            past, per = ranks - runs[i, 1], runs[i, 3]
            into = pa.array(runs[i, 2] + past // per, pa.int64())
            at = pa.array((runs[i, 4] + past % per * sizes).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], into, at], names=["item_id", "piece_no", "start", "size", "bin", "at"])

    numbered = number_rows(written.filter("size > 0"), ["size"]).df.select("item_id", "piece_no", "start", "size", RANK)
    kind = dict(written.dtypes)["item_id"]
    placed = numbered.mapInArrow(place, f"item_id {kind}, piece_no int, start bigint, size int, bin bigint, at int")
    empty = written.filter("size <= 0").select("*", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("at"))
    return placed.unionByName(empty)


def word_runs(text: str) -> F.Column:
    """Number of longest runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RUN)), F.lit(0))


@lru_cache(4)
def _coder(name: str, pattern: str):
    """The tokenizer of a worker, read once."""
    import base64

    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_sizes(documents: DataFrame, item_id: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """(item_id, n_tokens) by a public byte-level BPE vocabulary given as ranks; null text has 0 tokens.

    The file of ranks need only lie where the driver runs: it is sent to the executors.
    """
    documents.sparkSession.sparkContext.addFile(ranks_path)
    name = os.path.basename(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, pattern)
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["item_id", "n_tokens"])

    kind = dict(documents.dtypes)[item_id]
    return documents.select(F.col(item_id).alias("item_id"), text).mapInArrow(run, f"item_id {kind}, n_tokens bigint")


def check(packed: DataFrame, capacity: int) -> DataFrame:
    """(items, tokens, bins, over_capacity, overlaps, least): what a packing holds and whether it is one.

    ``over_capacity`` counts bins beyond their capacity, ``overlaps`` pieces that begin before the one
    before them in their bin ends, and ``least`` is the number of bins no packing of these tokens can go below.
    """
    in_bin = Window.partitionBy("bin").orderBy("at")  # a bin holds at most ``capacity`` pieces
    before = F.lag(F.col("at") + F.col("size")).over(in_bin)
    placed = packed.filter("bin is not null").withColumn("overlap", F.coalesce(before > F.col("at"), F.col("at") < 0))
    bins = placed.groupBy("bin").agg(F.sum("size").alias("fill"), F.max(F.col("at") + F.col("size")).alias("end"), F.count_if("overlap").alias("overlaps"))
    whole = bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.count_if((F.col("fill") > capacity) | (F.col("end") > capacity)).alias("over_capacity"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"))
    items = packed.groupBy("item_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("items"))
    return whole.crossJoin(items).select("items", "tokens", "bins", "over_capacity", "overlaps", F.ceil(F.col("tokens") / capacity).alias("least"))
