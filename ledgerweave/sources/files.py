"""Files in and out: declared schemas for what is read, one folder per relation for what is written."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSFER_HISTORY = T.StructType(
    [T.StructField(n, t) for n, t in (("blockNumber", T.LongType()), ("blockTimestamp", T.LongType()), ("transactionHash", T.StringType()), ("logIndex", T.IntegerType()), ("from_hex", T.StringType()), ("to_hex", T.StringType()), ("value", T.DoubleType()))]
)
EDGES = T.StructType([T.StructField(n, t) for n, t in (("from", T.StringType()), ("to", T.StringType()), ("value", T.DoubleType()), ("block_timestamp", T.LongType()))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a heading, plain or gzipped; fields that don't fit their type are null."""
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=False)
    return df.select(*columns) if columns else df


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(addr, chain): addresses, one a line or first in a CSV line; T... as they are, 0x... in lower case."""
    first = F.trim(F.split_part(F.col("value"), F.lit(","), F.lit(1)))
    seeds = spark.read.text(path).select(first.alias("addr"))
    chain = F.when(F.col("addr").rlike("^T[1-9A-HJ-NP-Za-km-z]{33}$"), "tron").when(F.col("addr").rlike("^0[xX][0-9a-fA-F]{40}$"), "eth")
    known = seeds.select("addr", chain.alias("chain")).filter("chain is not null")
    return known.select(F.when(F.col("chain") == "eth", F.lower("addr")).otherwise(F.col("addr")).alias("addr"), "chain").distinct()


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write as parquet, json or csv, overwriting; nested columns are JSON text in CSV."""
    if form == "csv":
        flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.StructType | T.ArrayType | T.MapType) else F.col(c) for c in df.columns]
        df.select(*flat).write.mode("overwrite").csv(path, header=True)
    elif form in ("parquet", "json"):
        df.write.mode("overwrite").format(form).save(path)
    else:
        raise ValueError(f"no such form: {form}")
