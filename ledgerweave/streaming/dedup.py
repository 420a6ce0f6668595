"""Exactly one copy of every message, however often and however late it is delivered.

Messages stream in micro-batches. A keyed state store holds the identifiers seen; the event time of a
delivery is the time of its load, and an identifier expires once the watermark has passed its load by
``horizon``. Spark commits the state with the offsets of the batch, and a batch writes the rows that pass
into a folder of its own number, which a repeated batch overwrites: state and output agree after any
failure, and with a ``folder`` of its own a run goes on where the one before was broken off, the driver
included. The work of a batch doesn't depend on how much was delivered before it.

What the state store can't answer any more is looked up in the output when the stream has caught up:

* an identifier that came back after its state had expired lies in the output of more than one batch. The
  batches that can hold such rows are known from the first and last load of each, which is written beside
  the output; their identifiers are compared once, and all rows but the first are marked as repeats, and
* a row whose load is older than the watermark, which the state store discards and counts, comes back if
  its identifier was never kept.
"""

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ledgerweave.operators.lookups import broadcast_if_small
from ledgerweave.storage import exists, fresh_path, is_file, store

FILE, ROW, EPOCH = "_lw_file", "_lw_row", "_lw_epoch"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Deduplicated:
    """``kept``: one row per identifier. ``repeats``: every other row that bears an identifier.
    ``without_id``: rows that lack a part of the identifier, all of them, for they can't be told apart."""

    kept: DataFrame
    repeats: DataFrame
    without_id: DataFrame
    late_restored: int
    batches: int


def _with_place(df: DataFrame) -> DataFrame:
    return df.withColumn(FILE, F.xxhash64("_metadata.file_path")).withColumn(ROW, F.col("_metadata.row_index"))


class _Discarded(StreamingQueryListener):
    """Rows discarded by the watermark in all batches of a query, not only the recent ones."""

    def __init__(self) -> None:
        self.rows, self.ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def once(
    spark: SparkSession,
    path: str,
    identifier: dict[str, Column],
    load_time: Column,
    columns: list[str],
    horizon: str = "26 weeks",
    bytes_per_batch: int = 256 << 20,
    folder: str | None = None,
    after_batch: Callable[[int], None] | None = None,
) -> Deduplicated:
    """Run the Parquet files at ``path`` through the stream until all that is there has been read.

    ``identifier`` names the identifying expressions; ``load_time`` is the timestamp of the delivery
    (null counts as 1970). ``columns`` are carried to the output beside the identifier, under their own
    names prefixed ``in_`` if they clash with it. Which copy stays is not defined, but it is one whole
    delivered row. An empty table gives empty results.

    ``folder`` keeps state and output, so that a later call reads only what is new or was broken off;
    without one they lie in a fresh folder. ``after_batch`` is called with the number of each batch when
    its output is written, before Spark commits it.
    """
    raw = spark.read.parquet(path)
    names = list(identifier)
    carried = [F.col(c).alias(f"in_{c}" if c in names else c) for c in columns]
    out_columns = [f"in_{c}" if c in names else c for c in columns]
    shaped = [c.alias(n) for n, c in identifier.items()]
    has_id = F.lit(True)
    for n in names:
        has_id = has_id & F.col(f"_lw_id.{n}").isNotNull()
    when = F.coalesce(load_time, F.timestamp_seconds(F.lit(0)))

    def identified(df: DataFrame) -> DataFrame:
        picked = _with_place(df).select(F.struct(*shaped).alias("_lw_id"), when.alias("_lw_at"), *carried, FILE, ROW)
        return picked.filter(has_id).select("_lw_id.*", "_lw_at", *out_columns, FILE, ROW)

    resumed = folder is not None and exists(spark, f"{folder}/checkpoint")
    base = folder or fresh_path(spark, "once")
    passed_path, loads_path = f"{base}/passed", f"{base}/loads"
    passed_schema = identified(raw).schema.add(EPOCH, "integer")

    def settle(batch: DataFrame, epoch: int) -> None:
        target = f"{passed_path}/{EPOCH}={epoch}"
        batch.write.mode("overwrite").parquet(target)
        written = spark.read.schema(batch.schema).parquet(target)
        written.agg(F.min("_lw_at").alias("low"), F.max("_lw_at").alias("high")).write.mode("overwrite").parquet(f"{loads_path}/{EPOCH}={epoch}")
        if after_batch:
            after_batch(epoch)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)
    count = _Discarded()
    spark.streams.addListener(count)
    try:
        reader = spark.readStream.schema(raw.schema).option("maxBytesPerTrigger", str(bytes_per_batch))
        if is_file(spark, path):
            parent, _, name = path.rpartition("/")
            stream = reader.option("pathGlobFilter", name).parquet(parent)
        else:
            stream = reader.parquet(path)
        query = (
            identified(stream)
            .withWatermark("_lw_at", horizon)
            .dropDuplicatesWithinWatermark(names)
            .writeStream.foreachBatch(settle)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        counted = count.ended.wait(60)
    finally:
        spark.streams.removeListener(count)
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)

    if not exists(spark, passed_path):
        spark.createDataFrame([], passed_schema).write.partitionBy(EPOCH).mode("overwrite").parquet(passed_path)
        spark.createDataFrame([], f"low timestamp, high timestamp, {EPOCH} int").write.partitionBy(EPOCH).mode("overwrite").parquet(loads_path)
    loads = spark.read.schema(f"low timestamp, high timestamp, {EPOCH} int").option("basePath", loads_path).parquet(loads_path).filter(f"low is not null and {EPOCH} >= 0")
    passed = spark.read.schema(passed_schema).option("basePath", passed_path).parquet(passed_path).filter(f"{EPOCH} >= 0")
    kept = _first_of_each(passed, loads, names, horizon)
    restored = 0
    # a run that was broken off didn't leave its count
    if count.rows or resumed or not counted:
        late = identified(raw).join(kept.select(*names), names, "left_anti")
        one = late.groupBy(*names).agg(F.min_by(F.struct("_lw_at", *out_columns, FILE, ROW), F.struct(FILE, ROW)).alias("_lw_row_"))
        found = store(one.select(*names, "_lw_row_.*"), "late").df
        restored = found.count()
        kept = kept.unionByName(found.withColumn(EPOCH, F.lit(-1)))

    rows = identified(raw)
    repeats = rows.join(kept.select(FILE, ROW), [FILE, ROW], "left_anti")
    without = raw.select(F.struct(*shaped).alias("_lw_id"), *carried).filter(~has_id).select("_lw_id.*", *out_columns)
    return Deduplicated(
        kept.select(*names, *out_columns),
        repeats.select(*names, *out_columns),
        without,
        restored,
        loads.count(),
    )


def _first_of_each(passed: DataFrame, loads: DataFrame, names: list[str], horizon: str) -> DataFrame:
    """``passed`` without rows whose identifier an earlier batch passed, which it can only where state may have expired.

    A batch can hold such rows if an earlier one holds a load older than the newest load up to it by more
    than the horizon. Without such a batch nothing is compared.
    """
    order = Window.orderBy(EPOCH)  # one row per batch
    newest = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, 0))
    oldest = F.min("low").over(order.rowsBetween(Window.unboundedPreceding, -1))
    suspect = loads.withColumn("newest", newest).withColumn("oldest", oldest).filter(F.col("oldest") + F.expr(f"interval {horizon}") <= F.col("newest"))
    if suspect.isEmpty():
        return passed
    # batches are compared by a hash of the identifier first, which is short to shuffle; an identifier passes once per batch at most
    key = F.xxhash64(*names)
    again = passed.groupBy(key.alias("_lw_key")).agg(F.min(EPOCH).alias("a"), F.max(EPOCH).alias("b")).filter("a < b").select("_lw_key")
    again = broadcast_if_small(store(again, "again").df)
    place = F.struct(EPOCH, FILE, ROW)
    some = store(passed.withColumn("_lw_key", key).join(again, "_lw_key", "left_semi").select(*names, place.alias("_lw_place")), "again").df
    least = some.groupBy(*names).agg(F.min("_lw_place").alias("_lw_least"))
    more = store(some.join(least, names).filter("_lw_place > _lw_least").select("_lw_place.*"), "expired").df
    return passed.join(broadcast_if_small(more), [EPOCH, FILE, ROW], "left_anti")
