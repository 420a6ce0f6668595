"""The relations every ledger query starts from, for Spark and, as common table expressions, for SQL.

The deduplicated transfers are a stage of their own: written once per session and input folder.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.base58 import ALPHABET, body_hex
from ledgerweave.functions.ledger import DAY_MS, VALUE_CAP, address, tx_hash, usable_amount
from ledgerweave.sources.tables import TRANSFERS, table
from ledgerweave.storage import Stored, files_state, store

WEEK_MS = 7 * DAY_MS
END_MS = 1_735_689_600_000  # 2025-01-01
W = 26

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it is checked against."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_STAGES: dict[tuple[str, str, str], tuple[int, Stored]] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A relation that many queries share, written once per state of the input files; an outdated one is deleted."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), files_state(spark, sf_dir)
    if key in _STAGES and _STAGES[key][0] != now:
        _STAGES.pop(key)[1].drop()
    if key not in _STAGES:
        _STAGES[key] = now, store(make(), name)
    return _STAGES[key][1].df


def drop_stages(spark: SparkSession) -> None:
    """Delete the shared relations of this session."""
    for key in [k for k in _STAGES if k[0] == spark.sparkContext.applicationId]:
        _STAGES.pop(key)[1].drop()


def once_only(raw: DataFrame) -> DataFrame:
    """One row per (transactionHash, logIndex), the first in a total order; rows without either stay.

    The first is a minimum, which is combined before the shuffle: many copies of one transfer make
    no large group.
    """
    rows = raw.select(
        tx_hash("transactionHash").alias("tx"),
        F.col("logIndex").alias("li"),
        "batch_id",
        F.col("blockTimestamp").alias("ms"),
        "value",
        address("from_hex").alias("src"),
        address("to_hex").alias("dst"),
    )
    has = F.col("tx").isNotNull() & F.col("li").isNotNull()
    first = F.min(F.struct("batch_id", "ms", "value", "src", "dst")).alias("r")
    one = rows.filter(has).groupBy("tx", "li").agg(first).select("tx", "li", "r.*")
    return one.unionByName(rows.filter(~has))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, li, batch_id, ms, value, src, dst) without repeated deliveries."""
    return stage(spark, sf_dir, "deliveries", lambda: once_only(table(spark, sf_dir, TRANSFERS)))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, v, ms, tx, li): usable transfers; v is an exact decimal."""
    d = deliveries(spark, sf_dir).withColumn("v", usable_amount("value"))
    return d.filter("v is not null and ms is not null and src is not null and dst is not null").select("src", "dst", "v", "ms", "tx", "li")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, cp, dir, v, ms, tx, li): each transfer once per endpoint."""
    both = F.array(
        F.struct(F.col("dst").alias("addr"), F.col("src").alias("cp"), F.lit("in").alias("dir")),
        F.struct(F.col("src").alias("addr"), F.col("dst").alias("cp"), F.lit("out").alias("dir")),
    )
    return transfers(spark, sf_dir).select(F.explode(both).alias("e"), "v", "ms", "tx", "li").select("e.*", "v", "ms", "tx", "li")


def to_ms(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, ord, signed, published): designated addresses, each under its first order; times in ms."""
    raw = table(spark, sf_dir, "designation_list").select(
        F.regexp_extract(F.regexp_replace("order_text", r"\s", ""), r"(\d+/\d+)", 1).alias("ord"),
        F.trim("address").alias("b58"),
        to_ms("signed").alias("signed"),
        to_ms("published").alias("published"),
        F.upper(F.trim("currency")).alias("currency"),
    )
    first = raw.filter("currency = 'USDT' and b58 like 'T%'").groupBy("b58").agg(F.min(F.struct("signed", "ord", "published")).alias("r"))
    return first.select(body_hex("b58").alias("addr"), "r.ord", "r.signed", "r.published").filter("addr is not null and signed is not null")


def freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, frozen): the first blacklisting of each address."""
    raw = table(spark, sf_dir, "tron_usdt_blacklist_added")
    return raw.filter("event = 'AddedBlackList'").groupBy(address("addr_hex").alias("addr")).agg(F.min("blockTimestamp").alias("frozen")).filter("addr is not null")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, cnt, w)"""
    return stage(spark, sf_dir, "pairs", lambda: transfers(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("w")))


LABEL = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("label", "source", "name_tag")]))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, label, provider, name_tag) of the latest fetch of each cached lookup."""
    raw = table(spark, sf_dir, "label_cache")
    last = raw.groupBy("chain", "address", "source").agg(F.max(F.struct("fetched_at", "raw_json")).alias("r"))
    one = F.from_json("r.raw_json", LABEL)
    rows = last.select(F.trim("address").alias("b58"), F.explode(one).alias("l"))
    return rows.select(body_hex("b58").alias("addr"), F.col("l.label").alias("label"), F.lower("l.source").alias("provider"), F.nullif(F.col("l.name_tag"), F.lit("")).alias("name_tag")).filter("addr is not null and label is not null")


def week(ms: str, event: str) -> Column:
    return F.floor((F.col(ms) - F.col(event)) / WEEK_MS)


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# ---- the same relations in SQL -------------------------------------------------------------------

_B58 = f"""braw AS (SELECT DISTINCT trim(a) AS a FROM (SELECT address AS a FROM designation_list UNION ALL SELECT address FROM label_cache) WHERE a IS NOT NULL),
bdec AS (SELECT a, 0 AS i, 0::HUGEINT AS hi, 0::HUGEINT AS lo FROM braw UNION ALL
  SELECT a, i + 1, hi * 58 + ((lo * 58 + strpos('{ALPHABET}', substr(a, i + 1, 1)) - 1) >> 100),
    (lo * 58 + strpos('{ALPHABET}', substr(a, i + 1, 1)) - 1) & ((1::HUGEINT << 100) - 1) FROM bdec WHERE i < length(a)),
b58 AS (SELECT a, substr(lower(lpad(to_hex(hi), 25, '0') || lpad(to_hex(lo), 25, '0')), 3, 40) AS hex FROM bdec WHERE i = length(a))"""

D_SQL = f"""dall AS (SELECT right(lower(transactionHash), 64) AS tx, logIndex AS li, batch_id, blockTimestamp AS ms, value, right(lower(from_hex), 40) AS src, right(lower(to_hex), 40) AS dst FROM {TRANSFERS}),
d AS MATERIALIZED (SELECT tx, li, batch_id, ms, value, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY tx, li ORDER BY batch_id NULLS FIRST, ms NULLS FIRST, value NULLS FIRST, src NULLS FIRST, dst NULLS FIRST) AS rn FROM dall WHERE tx IS NOT NULL AND li IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT * FROM dall WHERE tx IS NULL OR li IS NULL)"""
T_SQL = f"""{D_SQL},
t AS MATERIALIZED (SELECT src, dst, CAST(value AS DECIMAL(20,6)) AS v, ms, tx, li FROM d WHERE value > 0 AND value <= {VALUE_CAP} AND ms IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL)"""
ACT_SQL = f"""{T_SQL},
act AS MATERIALIZED (SELECT dst AS addr, src AS cp, 'in' AS dir, v, ms, tx, li FROM t UNION ALL SELECT src, dst, 'out', v, ms, tx, li FROM t)"""
ANCHOR_SQL = f"""{_B58},
anchor AS MATERIALIZED (SELECT hex AS addr, ord, signed, published FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY signed NULLS FIRST, ord NULLS FIRST, published NULLS FIRST) AS rn FROM (
  SELECT trim(address) AS a, regexp_extract(regexp_replace(order_text, '[ \\t\\n\\r\\f\\v]', '', 'g'), '([0-9]+/[0-9]+)', 1) AS ord, epoch_ms(signed) AS signed, epoch_ms(published) AS published
  FROM designation_list WHERE upper(trim(currency)) = 'USDT' AND trim(address) LIKE 'T%')) r JOIN b58 ON r.a = b58.a WHERE rn = 1 AND signed IS NOT NULL)"""
FREEZE_SQL = "freeze_ev AS (SELECT right(lower(addr_hex), 40) AS addr, min(blockTimestamp) AS frozen FROM tron_usdt_blacklist_added WHERE event = 'AddedBlackList' AND addr_hex IS NOT NULL GROUP BY 1)"
PAIR_SQL = f"{T_SQL}, pair AS MATERIALIZED (SELECT src, dst, count(*) AS cnt, sum(v) AS w FROM t GROUP BY 1, 2)"
LABEL_SQL = f"""{_B58},
lraw AS (SELECT trim(address) AS a, raw_json FROM (SELECT *, row_number() OVER (PARTITION BY chain, address, source ORDER BY fetched_at DESC NULLS LAST, raw_json DESC NULLS LAST) AS rn FROM label_cache) WHERE rn = 1),
lrec AS (SELECT a, unnest(CASE WHEN json_valid(raw_json) THEN json_extract(raw_json, '$[*]') END) AS j FROM lraw),
lab AS MATERIALIZED (SELECT b58.hex AS addr, json_extract_string(j, '$.label') AS label, lower(json_extract_string(j, '$.source')) AS provider, nullif(json_extract_string(j, '$.name_tag'), '') AS name_tag
  FROM lrec JOIN b58 ON lrec.a = b58.a WHERE json_extract_string(j, '$.label') IS NOT NULL)"""


def with_(*parts: str) -> str:
    """A WITH clause of the given parts, base58 decoding named once; it recurses, so the clause may."""
    text = ",\n".join(parts)
    if text.count(_B58) > 1:
        head, tail = text.split(_B58, 1)
        text = head + _B58 + tail.replace(_B58 + ",", "").replace(_B58, "SELECT 1")
    return "WITH RECURSIVE " + text + "\n"
