"""Streaming twins of batch operators, run to the end of what is there."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.plans.base import query
from ledgerweave.sources.tables import path_of, table
from ledgerweave.storage import fresh_path, is_file


def drained(spark: SparkSession, sf_dir: str, name: str, shape: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The final output of a streaming query over a table, from a sink that every batch overwrites by number.

    Complete and update output is settled by the last batch that gave a row; append output adds up.
    """
    path, schema = path_of(sf_dir, name), table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    if is_file(spark, path):
        folder, _, file = path.rpartition("/")
        stream = reader.option("pathGlobFilter", file).parquet(folder)
    else:
        stream = reader.parquet(path)
    out = shape(stream)
    base = fresh_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query_ = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{base}/out") if mode == "complete" else spark.read.schema(out.schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    return got.select(*out.columns)


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals by tumbling windows."""

    def shape(s: DataFrame) -> DataFrame:
        return s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    got = drained(spark, sf_dir, "events", shape, "complete")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
  SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM y GROUP BY user_id, k""")
def q_stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, closed by six hours of silence."""

    def shape(s: DataFrame) -> DataFrame:
        return s.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))

    got = drained(spark, sf_dir, "events", shape, "complete")
    return got.select("user_id", F.unix_millis(F.col("a").cast("timestamp")).alias("first_ms"), F.unix_millis(F.col("b").cast("timestamp")).alias("last_ms"), "n")


@query("SELECT DISTINCT event_id FROM events")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir, "events", lambda s: s.select("event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]), "append").select("event_id")


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 4) AS balance, count(*) AS n FROM events GROUP BY 1")
def q_stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running balance per user, kept in the state of a streaming aggregate."""

    def shape(s: DataFrame) -> DataFrame:
        signed = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))
        return s.groupBy("user_id").agg(F.sum(signed).alias("balance"), F.count(F.lit(1)).alias("n"))

    got = drained(spark, sf_dir, "events", shape, "complete")
    return got.select("user_id", F.round("balance", 4).alias("balance"), "n")
