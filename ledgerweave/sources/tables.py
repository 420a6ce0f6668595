"""Readers of the input tables, with declared schemas where the test data is fixed."""

from pyspark.sql import DataFrame, SparkSession

TRANSFERS = "designated_usdt_transfers_complete_490"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"
